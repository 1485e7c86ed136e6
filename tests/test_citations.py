import random

import pytest
from pyspark.sql import functions as F

from peerlight.functions import text as T
from peerlight.operators import authors, citations, claims, entailment, inference, title_index, verification

CATALOG = (
    "source string, source_rank int, catalog_id string, title string, authors array<string>, year int, "
    "venue string, doi string, arxiv_id string, abstract string"
)
REFS = (
    "paper_id string, ref_id string, ref_pos int, raw string, title string, authors array<string>, year int, "
    "venue string, doi string, arxiv_id string"
)


def _cat(spark, *rows):
    ranks = {"crossref": 0, "semantic_scholar": 1, "openalex": 2}
    return spark.createDataFrame(
        [(s, ranks[s], i, t, ["Ann Lee"], 2015, "V", d, a, b) for s, i, t, d, a, b in rows], CATALOG
    )


def _refs(spark, *rows):
    return spark.createDataFrame(
        [("p", f"ref-{i + 1}", i, t or "raw", t, ["Lee, A."], 2015, None, d, a) for i, (t, d, a) in enumerate(rows)], REFS
    )


def test_cascade_is_source_major(spark):
    cat = _cat(
        spark,
        ("crossref", "c1", "deep nets for graphs", None, None, None),
        ("semantic_scholar", "s1", "something else", "10.1/x", "1706.00001", "abs"),
        ("openalex", "o1", "third thing here", "10.1/y", None, None),
    )
    refs = _refs(
        spark, ("Deep nets for graphs", "10.1/X", None), ("q", None, "1706.00001"), ("w", "10.1/Y", None), ("unknown work", "10.1/zz", None)
    )
    out = {r.ref_id: r for r in citations.lookup_refs(refs, cat).collect()}
    assert out["ref-1"].source == "crossref"
    assert out["ref-2"].source == "semantic_scholar"
    assert out["ref-3"].source == "openalex"
    assert out["ref-4"].status == "NOT_FOUND" and out["ref-4"].source == "none"
    by_key = {r.ref_id: r for r in citations.lookup_refs(refs, cat, key_major=True).collect()}
    assert by_key["ref-1"].source == "semantic_scholar"


def test_errors_only_when_all_sources_errored(spark):
    cat = _cat(spark, ("openalex", "o1", "t", "10.1/a", None, None))
    refs = _refs(spark, ("nothing alike", "10.1/a", None), ("else", "10.1/b", None))
    sources = ["crossref", "semantic_scholar", "openalex"]
    errs = spark.createDataFrame(
        [("crossref", "doi", "10.1/a")] + [(s, "doi", "10.1/b") for s in sources], "source string, key_kind string, key string"
    )
    out = {r.ref_id: r.status for r in citations.lookup_refs(refs, cat, errs).collect()}
    assert out == {"ref-1": "FOUND", "ref-2": "ERROR"}


def test_fabricated_dois_are_caught_and_real_ones_found(spark):
    cat = _cat(spark, *[("crossref", f"c{i}", f"work number {i} zzz{i}", f"10.5/r{i}", None, None) for i in range(10)])
    refs = _refs(spark, *[(f"totally made up {i}{i}q", f"10.9/f{i}", None) for i in range(10)], *[("x", f"10.5/r{i}", None) for i in range(10)])
    out = [r.status for r in citations.lookup_refs(refs, cat).orderBy(F.col("ref_id").substr(5, 9).cast("int")).collect()]
    assert out == ["NOT_FOUND"] * 10 + ["FOUND"] * 10


@pytest.mark.parametrize("floor", [0.6, 0.75])
def test_title_search_equals_brute_force(spark, floor):
    rng = random.Random(3)
    words = ["aa", "bbb", "cccc", "ddddd", "eeeeee", "fffffff", "gg", "hhh", "iiii", "jjjjj"]
    title = lambda: " ".join(rng.sample(words, rng.randint(1, 7)))
    cat = [("crossref", f"c{i:03d}", title(), None, None, None) for i in range(60)]
    asked = [title() for _ in range(60)]
    got = {
        r.ref_id: (r.catalog_id, round(r.similarity, 9))
        for r in citations.title_search(_refs(spark, *[(t, None, None) for t in asked]), _cat(spark, *cat), min_similarity=floor, hot_rows=1).collect()
    }
    want = {}
    for i, t in enumerate(asked):
        a = set(t.split())
        best = min(((-len(a & set(c[2].split())) / len(a | set(c[2].split())), c[1]) for c in cat))
        if -best[0] >= floor:
            want[f"ref-{i + 1}"] = (best[1], round(-best[0], 9))
    assert got == want


def test_titles_of_any_script_are_found(spark):
    cat = _cat(spark, ("crossref", "c1", "Глубокие сети для графов", None, None, None), ("openalex", "o1", "深層学習 グラフ", None, None, None))
    refs = _refs(spark, ("Глубокие сети для графов", None, None), ("Глубокие сети больших графов", None, None), ("深層学習 グラフ", None, None))
    out = {r.ref_id: r.status for r in citations.lookup_refs(refs, cat).collect()}
    assert out == {"ref-1": "FOUND", "ref-2": "FOUND", "ref-3": "FOUND"}


def test_blocks_of_common_words_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(citations, "BLOCK_PAIRS", 16)
    base = ["common", "model", "title", "words"]
    cat = [("crossref", f"c{i:03d}", " ".join([*base, f"x{i}"]), None, None, None) for i in range(40)]
    asked = spark.createDataFrame([("title:" + " ".join(sorted([*base, f"y{i}"])), 3) for i in range(30)], "key string, below int")
    held = citations.catalog_keys(_cat(spark, *cat), ["title"])
    got = citations.similar_titles(asked, held, 0.6)
    rows = [(r.key, r.catalog_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 30 * 40
    assert all(abs(r.similarity - 4 / 6) < 1e-9 for r in got.collect())


def test_metadata_match(spark):
    cat = _cat(spark, ("crossref", "c", "A Fine Title", "10.1/a", None, None))
    refs = _refs(spark, ("A fine title", "10.1/a", None))
    row = citations.metadata_match(refs, citations.lookup_refs(refs, cat)).first()
    assert (row.title_score, row.author_score, row.year_score, row.venue_score) == (1.0, 1.0, 1.0, 0.0)
    assert row.match_ok and row.mismatches == []


def test_claim_response_shapes(spark):
    replies = [
        '[{"text": "a", "ref_ids": ["r"]}]',
        '```json\n[{"text": "a"}]\n```',
        'Sure: [{"text": "a"}] ok',
        "nonsense [",
        '["x", {"text": ""}, {"text": 3}, {"ref_ids": []}, {"text": "a", "ref_ids": "r"}, {"text": "a", "ref_ids": null}, {"text": "a"}]',
        "[" + ",".join('{"text": "a"}' for _ in range(15)) + "]",
        '[{"text": "a"}] or [{"text": "b"}]',
    ]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(replies)], "paper_id string, ord int, text string")
    out = claims.parse_claims(df).groupBy("ord").count().collect()
    assert {r["ord"]: r["count"] for r in out} == {0: 1, 1: 1, 2: 1, 4: 1, 5: 10}
    assert [tuple(r) for r in claims.left_out_items(df).collect()] == [("p", 5, 5)]


def test_claim_types_and_severity(spark):
    cases = {
        "The model reaches 94.5% accuracy": ("STATISTICAL", "HIGH"),
        "Smith et al. (2019) showed this": ("CITATION", "HIGH"),
        "Since 2015 things changed": ("TEMPORAL", "LOW"),
        "It can translate": ("CAPABILITY", "MEDIUM"),
        "Cats sleep": ("EMPIRICAL", "MEDIUM"),
        "SOTA result [3]": ("CITATION", "CRITICAL"),
        "We train 10 layers": ("EMPIRICAL", "MEDIUM"),
    }
    df = spark.createDataFrame([(k, []) for k in cases], "text string, ref_ids array<string>")
    out = claims.severity(claims.categorize(df)).collect()
    assert {r.text: (r.claim_type, r.severity) for r in out} == cases


def test_verdict_order(spark):
    meta = "struct<title:string,authors:array<string>,year:int,venue:string,doi:string>"
    look = spark.createDataFrame(
        [("p", "a", "FOUND", "crossref", ("T", [], 2000, None, None)), ("p", "b", "NOT_FOUND", "none", None), ("p", "e", "ERROR", "none", None)],
        f"paper_id string, ref_id string, status string, source string, meta {meta}",
    )
    cl = spark.createDataFrame(
        [("p", "c1", "CITATION", []), ("p", "c2", "CITATION", ["a", "b"]), ("p", "c3", "CITATION", ["a", "e"]), ("p", "c4", "CITATION", ["a"]), ("p", "c5", "CITATION", ["zz"])],
        "paper_id string, claim_id string, claim_type string, ref_ids array<string>",
    )
    match = spark.createDataFrame([("p", "a", 0.9)], "paper_id string, ref_id string, overall double")
    late = spark.createDataFrame([], "paper_id string, ref_id string")
    out = {r.claim_id: r for r in verification.verify_claims(cl, look, match, late).collect()}
    assert out["c1"].notes.startswith("Categorized CITATION") and not out["c1"].hallucination_flag
    assert out["c2"].hallucination_flag and out["c2"].notes == "1/2 citations unresolved" and out["c2"].source == "crossref"
    assert out["c3"].notes == "Resolver errored on refs: e" and not out["c3"].hallucination_flag
    assert out["c4"].verified and out["c4"].confidence == 0.9 and out["c4"].evidence == "a: T (2000) via crossref"
    assert out["c5"].hallucination_flag
    hit = spark.createDataFrame([("p", "a")], "paper_id string, ref_id string")
    capped = {r.claim_id: r for r in verification.verify_claims(cl, look, match, hit).collect()}["c4"]
    assert (capped.verified, capped.confidence, capped.hallucination_flag) == (False, 0.3, True)
    bad = spark.createDataFrame(
        [("p", "c4", 0, "a", "NOT_SUPPORTED", 0.8)], "paper_id string, claim_id string, ref_pos int, ref_id string, verdict string, confidence double"
    )
    merged = {r.claim_id: r for r in verification.merge_entailment(verification.verify_claims(cl, look, match, late), bad).collect()}
    assert merged["c4"].confidence == 0.8 and merged["c4"].notes == "Entailment: a NOT_SUPPORTED (0.80)"
    total = verification.ledger(verification.verify_claims(cl, look, match, late), spark.createDataFrame([("p",), ("q",)], "paper_id string"))
    rows = {r.paper_id: r for r in total.collect()}
    assert rows["p"].total_claims == 5 and rows["p"].mean_confidence == 0.18 and rows["q"].total_claims == 0


def test_keyword_entailment(spark):
    df = spark.createDataFrame(
        [("Graph networks improve molecule prediction", "We study graph networks for molecule prediction tasks"), ("Cooking pasta requires salt", "We study graph networks"), ("it is", "x")],
        "c string, a string",
    )
    out = [r[0].verdict for r in df.select(entailment.keyword_verdict(F.col("c"), F.col("a"))).collect()]
    assert out == ["SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT"]


def test_surnames_and_author_match(spark):
    df = spark.createDataFrame([("Yann LeCun",), ("LeCun, Y.",), ("O'Neil",)], "n string")
    assert [r[0] for r in df.select(T.surname(F.col("n"))).collect()] == ["lecun", "lecun", "oneil"]
    asked = spark.createDataFrame([("p", "Jane Q Doe"), ("p", "Nobody Here")], "paper_id string, queried_name string")
    cand = spark.createDataFrame(
        [("Jane Q Doe", 0, None, "John Roe", None), ("Jane Q Doe", 1, "0000-0001-2345-6789", "Jane Doe", "MIT"), ("Nobody Here", 0, None, "Else", None)],
        "queried_name string, hit_rank int, orcid_id string, candidate string, institution string",
    )
    out = {r.queried_name: r for r in authors.match_authors(asked, cand, hot_rows=0).collect()}
    assert out["Jane Q Doe"].matched_name == "Jane Doe" and out["Jane Q Doe"].confidence == 1.0
    assert out["Nobody Here"].orcid_id is None and out["Nobody Here"].confidence == 0.0


def test_provider_chain_downgrades(spark):
    rows = spark.createDataFrame([("k1", "p", "m")], "cache_key string, prompt string, model string")

    def broken():
        raise RuntimeError("no key")

    def fine():
        return lambda b: b[["cache_key", "model"]].assign(
            text="hi", provider="b", prompt_tokens=1, completion_tokens=1, cost_usd=0.0, finish_reason="stop"
        )[["cache_key", "text", "model", "provider", "prompt_tokens", "completion_tokens", "cost_usd", "finish_reason"]]

    out = inference.run_chain(rows, [("a", broken), ("b", fine)]).first()
    assert out.text == "hi" and out.finish_reason.startswith("downgraded: a")
    none = inference.run_chain(rows, [("a", broken)])
    assert none.first().provider == "heuristic" and none.first().text is None
    assert inference.downgrades(none).first().n_responses == 1


def _brute_contained(entry, title, share, least=3):
    """Largest share of a title's words in place at one offset of an entry, if it reaches ``share``."""
    k = len(title)
    best = max(
        (sum(entry[o + i : o + i + 1] == [w] for i, w in enumerate(title) if o + i >= 0)
         for o in range(-k + 1, len(entry))),
        default=0,
    )
    return best / k if k >= least and best >= -(-k * share // 1) - 1e-9 and best >= k * share - 1e-9 else None


@pytest.mark.parametrize("share,pairs", [(0.9, 1_000_000), (0.7, 4), (1.0, 1)])
def test_titles_in_entries_equal_brute_force(spark, monkeypatch, share, pairs):
    monkeypatch.setattr(title_index, "BLOCK_PAIRS", pairs)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 6
    titles = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 13))] for _ in range(60)]
    entries = []
    for _ in range(80):
        inner = list(rng.choice(titles))
        for _ in range(rng.randrange(3)):
            if inner:
                inner[rng.randrange(len(inner))] = rng.choice(vocabulary)
        entries.append([rng.choice(vocabulary) for _ in range(rng.randrange(5))] + inner + ["press"] * rng.randrange(3))
    left = spark.createDataFrame([(f"e{i}", e) for i, e in enumerate(entries)], "key string, entry_words array<string>")
    right = spark.createDataFrame(
        [("crossref", f"t{i:02}", t) for i, t in enumerate(titles)], "source string, catalog_id string, title_words array<string>"
    )
    got = title_index.contained_titles(left, right, share).collect()
    found = {(r.key, r.catalog_id): (r.similarity, r.n_words) for r in got}
    want = {}
    for i, e in enumerate(entries):
        for j, t in enumerate(titles):
            sim = _brute_contained(e, t, share)
            if sim is not None:
                want[f"e{i}", f"t{j:02}"] = (sim, len(t))
    assert found == want and len(got) == len(found) and len(want) > 15


def test_undated_entries_are_found(spark):
    cat = _cat(spark, ("openalex", "o1", "Attention over sparse graphs", None, None, None), ("crossref", "c1", "Sparse graphs", None, None, None))
    long = "A. Miller, B. Okafor, " * 12 + "Attention over sparse graphs. Proceedings of Tests, pp. 1-9."
    rows = [("p", "r1", 0, long, long[:200], [], None, None, None, None), ("p", "r2", 1, "nothing of it", None, [], None, None, None, None)]
    refs = spark.createDataFrame(rows, REFS)
    out = {r.ref_id: (r.status, r.source) for r in citations.lookup_refs(refs, cat).collect()}
    assert out == {"r1": ("FOUND", "openalex"), "r2": ("NOT_FOUND", "none")}


@pytest.mark.parametrize("postings,hot", [(128, 1_000_000), (2, 3)])
def test_top_titles_equal_brute_force_scores(spark, postings, hot):
    rng = random.Random(2)
    vocabulary = ["the"] * 8 + [f"w{i}" for i in range(40)]
    titles = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 9))] for _ in range(150)]
    queries = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 7))] for _ in range(60)] + [["unknown"]]
    right = spark.createDataFrame(
        [(("crossref", "openalex")[i % 2], f"t{i:03}", t) for i, t in enumerate(titles)],
        "source string, catalog_id string, title_words array<string>",
    )
    left = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "key string, words array<string>")
    index = title_index.index_titles(right, postings, hot)
    vectors = {(r.source, r.catalog_id): r.vector for r in index.vectors.collect()}
    want = {}
    for i, q in enumerate(queries):
        for (source, c), vector in vectors.items():
            score = sum(vector.get(w, 0) for w in set(q))
            if score:
                want[f"q{i}", source] = min(want.get((f"q{i}", source), (0, "")), (-score, c))
    got = title_index.top_titles(left, index, hot).collect()
    assert {(r.key, r.source): (-r.score, r.catalog_id) for r in got} == want and len(want) > 80


def test_exploded_sides_of_a_block_join_are_never_broadcast(spark):
    # Spark takes exploded rows for as few as they came from; the driver would gather them all.
    left = spark.createDataFrame([(f"e{i}", [f"w{j}" for j in range(30)]) for i in range(20)], "key string, entry_words array<string>")
    right = spark.createDataFrame([("crossref", "t", ["w1", "w2", "w3"])], "source string, catalog_id string, title_words array<string>")
    asked = left.select("key", F.explode("entry_words").alias("word"))
    held = right.select("catalog_id", F.explode("title_words").alias("word"))
    met = title_index.meet(asked, held, "word", ["key"], ["catalog_id"])
    assert met.count() == 60
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_queries_with_the_same_known_words_are_one_search(spark, monkeypatch):
    titles = spark.createDataFrame(
        [("crossref", f"t{i:02}", ["a", "model", "with", f"x{i}"]) for i in range(20)], "source string, catalog_id string, title_words array<string>"
    )
    queries = spark.createDataFrame([(f"q{i:02}", ["a", "model", "with", f"y{i}"]) for i in range(40)], "key string, words array<string>")
    met, meet = [], title_index.meet
    monkeypatch.setattr(title_index, "meet", lambda left, right, *by: met.append(left) or meet(left, right, *by))
    got = title_index.top_titles(queries, title_index.index_titles(titles)).collect()
    assert sorted((r.key, r.catalog_id) for r in got) == [(f"q{i:02}", "t00") for i in range(40)]
    assert met[0].select("key").distinct().count() == 1
