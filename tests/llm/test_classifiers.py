import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlight.llm import langid, quality_qda, quality_rules, toxicity
from peerlight.llm.common import fold
from peerlight.llm.text_stats import COUNTS, text_counts


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        dup,
        len(covered),
    )


def test_counts_match_brute_force(odd_docs):
    rng = np.random.default_rng(1)
    texts = [r.text for r in odd_docs.collect()]
    for _ in range(60):
        words = rng.choice(["a", "b|", "cé", "d e", "#$", "\n", "\x0b", " "], rng.integers(0, 60))
        texts.append(" ".join(words))
    got = text_counts(texts)
    assert [tuple(int(got[c][i]) for c in COUNTS) for i in range(len(texts))] == list(map(brute_counts, texts))


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    got = spark.range(50).select("id", fold(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_quality_rules_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = quality_rules.apply_rules(odd_docs)
    assert got.columns == [c for c in odd_docs.columns if c != "text"] + [*COUNTS, "base_failed", "kept"]
    found = sorted(tuple(r[c] for c in COUNTS) for r in got.collect())
    assert found == sorted(brute_counts(r.text) for r in rows)
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_rules_adapt_to_their_group(spark):
    rng = np.random.default_rng(2)

    def text(size, symbols):
        words = ["".join(rng.choice(list("abcdefgh"), size)) for _ in range(60)]
        return " ".join(words) + "#" * symbols

    rows = [(i, text(5, 0), "en", "prose") for i in range(400)]
    rows += [(1000 + i, text(5, 60), "en", "code") for i in range(400)]
    rows += [(2000, text(5, 90), "en", "prose"), (2001, text(25, 0), "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.apply_rules(docs).where("kept").collect()}
    assert {*range(400), *range(1000, 1400)} <= kept and not {2000, 2001} & kept


def test_sketch_quantiles_and_merging(spark):
    values = [0.0] * 10 + [1.02**i for i in range(-200, 200)]
    rows = spark.createDataFrame(
        [(i % 7, "en", max(1, round(1000 * v)), 1000, 0, 0, 0) for i, v in enumerate(values)],
        "source int, lang string, word_chars long, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long",
    )
    whole = quality_rules.sketch(rows, ["lang"])
    merged = quality_rules.merge(quality_rules.sketch(rows, ["lang", "source"]), ["lang"])
    assert sorted(whole.collect()) == sorted(merged.select(*whole.columns).collect())


def test_qda_separates_what_a_line_cannot(spark):
    rng = np.random.default_rng(3)
    size = len(quality_qda.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (400, size)), rng.normal(0, 4, (400, size))])
    y = np.repeat([1, 0], 400)
    moments = {c: (400, x[y == c].sum(axis=0), x[y == c].T @ x[y == c]) for c in (0, 1)}
    model = quality_qda.fit(moments, 0.02, 0.1)
    odds = model.log_odds(x)
    assert ((odds > 0) == y).mean() > 0.97
    # Against densities written out in full.
    for c in (0, 1):
        covariance = model.factors[c] @ model.factors[c].T
        far = np.einsum("ij,jk,ik->i", x - model.means[c], np.linalg.inv(covariance), x - model.means[c])
        side = np.log(0.5) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * far
        odds = odds - side if c else odds + side
    assert np.abs(odds).max() < 1e-6


@pytest.mark.parametrize("module,label", [(quality_qda, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, odd_docs, no_docs, module, label):
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2, None) for i in range(1, 14)] + [(None, 1, 1, "x"), (5, None, None, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = module.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    same = [r.score for r in got if r.doc_id in (6, 7)]
    assert same[0] == same[1]
    assert module.classify(no_docs, labels).count() == 0
    unlabelled = module.classify(odd_docs, labels.where("doc_id = 1")).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_qda.op6_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert got[got.quality == 1].predicted.mean() > 0.98


def test_toxicity_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.op5_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.94
    assert got[got.toxic == 0].predicted.mean() < 0.02
    assert got[got.toxic == 1].predicted.mean() > 0.85  # 305 toxic texts to learn from


def brute_places(text):
    """Places of all lower-cased character 4- and 5-grams, by the hash written out."""
    t, out, mask = (text or "").lower().replace("\0", " "), set(), 0xFFFFFFFF
    for n in toxicity.ORDERS:
        for i in range(len(t) - n + 1):
            code = n
            for c in t[i : i + n]:
                code = (((code ^ (code >> 15)) * 2654435761 & mask) + ord(c)) & mask
            code = (code ^ (code >> 13)) * 2246822519 & mask
            out.add(code >> (32 - toxicity.BITS))
    return out


def test_ngrams_match_brute_force(odd_docs):
    texts = [r.text[:300] if r.text else r.text for r in odd_docs.collect()] + ["a\0b\0cdef", "ABCDE abcde", "é" * 9]
    owner, place = toxicity.ngrams(texts)
    for i, text in enumerate(texts):
        assert set(place[owner == i].tolist()) == brute_places(text)
    wanted = np.zeros(1 << toxicity.BITS, dtype=bool)
    wanted[list(brute_places("abcde"))] = True
    owner, place = toxicity.ngrams(texts, wanted)
    assert sorted(zip(owner.tolist(), place.tolist())) == sorted(
        (i, p) for i, t in enumerate(texts) for p in brute_places(t) & brute_places("abcde")
    )


def test_ratios_count_all_rows_and_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS_PER_CLASS", 30)
    monkeypatch.setattr(toxicity, "CLEAR", 0.0)
    seen = {}
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda rows, ratios: seen.update(rows=rows, ratios=ratios) or fit(rows, ratios))
    docs = [(i, ("vile " if i % 4 == 0 else "kind ") + f"words {i % 7}") for i in range(200)]
    docs += [(0, "vile words again")] * 50  # rows that repeat a sampled id
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert seen["rows"].num_rows == 60
    side = {0: [t for i, t in docs if i % 4], 1: [t for i, t in docs if i % 4 == 0]}
    counts = {c: Counter(p for t in texts for p in brute_places(t)) for c, texts in side.items()}
    want = np.zeros(1 << toxicity.BITS)
    for p in {*counts[0], *counts[1]}:
        own = [(counts[c][p] + toxicity.SMOOTHING) / (len(side[c]) + 2 * toxicity.SMOOTHING) for c in (0, 1)]
        want[p] = np.log(own[1]) - np.log(own[0])
    chosen = seen["ratios"] != 0
    assert chosen.any() and np.allclose(seen["ratios"][chosen], want[chosen])


def test_language_counts_match_brute_force(spark):
    texts = [("x", "abcabc"), ("y", "Zoë zoe"), ("x", "abd"), ("x", None), (None, "abc"), ("z", "ab")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    total = np.full((1 << langid.BITS, len(model.names)), langid.SMOOTHING)
    for lang, text in texts:
        if lang and text:
            grams, _ = langid.trigrams([text])
            np.add.at(total[:, model.names.index(lang)], grams, 1)
    assert model.names == ["x", "y", "z"]
    assert np.allclose(model.log_p, np.log(total / total.sum(axis=0)), atol=1e-5)


def brute_limits(rows):
    """Limits per (lang, source) and measure from sorted values: rows are (lang, source, counts)."""

    def bucket(v):
        return int(np.floor(np.log(max(v, quality_rules.TINY)) / np.log(quality_rules.GAMMA)))

    def quantiles(values):
        buckets, out = sorted(map(bucket, values)), []
        for q in (0.1, 0.5, 0.9):
            b = next(b for k, b in enumerate(buckets, 1) if k >= q * len(buckets))
            value = quality_rules.GAMMA ** (b + 0.5)
            out.append(0.0 if value <= quality_rules.TINY * quality_rules.GAMMA else value)
        return np.array(out)

    good = [r for r in rows if not failed(r[2])]
    out = {}
    for name, (count, whole, _, below) in quality_rules._RULES.items():
        value = [c[COUNTS.index(count)] / max(1, c[COUNTS.index(whole)]) for _, _, c in good]
        every = quantiles(value)
        for group in {r[:2] for r in good}:
            own = [v for v, r in zip(value, good) if r[:2] == group]
            lang = [v for v, r in zip(value, good) if r[0] == group[0]]
            a, b = (len(x) / (len(x) + quality_rules.PRIOR_ROWS) for x in (own, lang))
            low, mid, high = a * quantiles(own) + (1 - a) * (b * quantiles(lang) + (1 - b) * every)
            upper = (high + quality_rules.WIDTHS * (high - mid)) * quality_rules.GAMMA
            lower = (low - quality_rules.WIDTHS * (mid - low)) / quality_rules.GAMMA
            out[(*group, name)] = (lower if below else -np.inf, upper)
    return out


def failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def test_limits_and_verdicts_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(r.doc_id, r.lang, r.source, brute_counts(r.text)) for r in docs.collect()]
    limits = brute_limits([r[1:] for r in rows])
    counted = quality_rules.base_counts(docs)
    got = quality_rules.thresholds(counted).collect()
    assert len(got) == len({k[:2] for k in limits})
    for r in got:
        for name in quality_rules._RULES:
            assert np.allclose((r[f"{name}_lower"], r[f"{name}_upper"]), limits[r.lang, r.source, name], rtol=1e-9)
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()}
    for i, lang, source, c in rows:
        inside = not failed(c)
        for name, (count, whole, unit, _) in quality_rules._RULES.items():
            value = (c[COUNTS.index(count)] - quality_rules.FREE * unit) / max(1, c[COUNTS.index(whole)])
            low, high = limits.get((lang, source, name), (np.inf, -np.inf))
            inside = inside and low <= value <= high
        assert kept[i] == inside


def test_rules_leave_good_texts_alone(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    got = quality_rules.op7_quality_rules(spark, sf_dir).where("NOT base_failed").join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.1


def test_clashing_names_pass_through(spark, odd_docs):
    from peerlight.llm import mixing, simhash

    names = ["text_md5", "times", "own_source", "parts", "cdf", "own_print", "key", "row", "print", "_text", "_times",
             "_source", "_parts", "_key", "_print", "_lang", "group_lang", "group_source", "limits", "counts", "measure",
             "lower", "upper", "rate", "weight"]
    clash = odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    mixed = mixing.mix(clash, {"a": 1.0, "b": 1.0, "": 1.0, "c": 1.0}, epochs=3.0)
    assert mixed.columns == [*(c for c in clash.columns if c != "copy"), "copy", "shuffle_key"]
    plain = mixing.mix(odd_docs, {"a": 1.0, "b": 1.0, "": 1.0, "c": 1.0}, epochs=3.0)
    assert sorted(r.shuffle_key for r in mixed.collect()) == sorted(r.shuffle_key for r in plain.collect())
    kept = simhash.drop_near_duplicates(clash)
    assert kept.columns == clash.columns
    assert kept.count() == simhash.drop_near_duplicates(odd_docs).count()
    rules = quality_rules.apply_rules(clash)
    assert [c for c in rules.columns if c in names] == names
    assert sorted(r.kept for r in rules.collect()) == sorted(r.kept for r in quality_rules.apply_rules(odd_docs).collect())


def test_mixture_finds_the_proportions():
    rng = np.random.default_rng(0)
    letters = {"x": "abcdefgh", "y": "ijklmnop", "z": "qrstuvwx"}
    log_p = np.full((1 << langid.BITS, 3), 1.0)
    texts = {k: "".join(rng.choice(list(v), 6_000)) for k, v in letters.items()}
    for column, text in enumerate(texts.values()):
        grams, _ = langid.trigrams([text])
        log_p[:, column] += np.bincount(grams, minlength=len(log_p))
    model = langid.Languages(list(letters), np.log(log_p / log_p.sum(axis=0)).astype(np.float32))
    share, none = langid.infer([texts["x"][:3000] + texts["y"][:1000], texts["z"][:500], "123", None, ""], model)
    assert np.allclose(share[0], [0.75, 0.25, 0], atol=0.05) and share[0, 2] == 0
    assert (share[1] == [0, 0, 1]).all() and list(none) == [False, False, True, True, True]


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.learn(langid.training_rows(odd_docs))
    clash = odd_docs.withColumn("lang_pred", F.lit("zz")).withColumn("lang_set", F.lit(1))
    got = langid.predict(clash, model).collect()
    for r in got:
        lettered = bool(r.text and re.search(r"[^\W\d_]", r.text))
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    assert langid.keep_identified(odd_docs, model).columns == odd_docs.columns
    nothing = langid.learn(no_docs)
    assert nothing.names == [] and langid.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = langid.op8_langid(spark, sf_dir).where("held_out").join(docs, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98


def test_registered_rules_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in quality_rules.op7_quality_rules(spark, sf_dir).collect():
        want = brute_counts(texts[r.doc_id])
        assert tuple(r[c] for c in COUNTS) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
