import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from peerlight.llm import ann, bpe, simhash, suffix_dedup
from test_dedup import brute_print, brute_removal


@pytest.fixture(scope="module")
def tok():
    return bpe.load(bpe.default_path())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(bpe.default_path())


def test_tokens_equal_the_library(tok, theirs, odd_docs):
    rng = np.random.default_rng(0)
    texts = [r.text or "" for r in odd_docs.collect()]
    texts += ["aaaaaaa  bbb\n\n c", "don't we'll 12a!!! ", " x  y", "<|endoftext|", "<<|endoftext|>>", "a" * 3000]
    pool = list("aab éß日🙂'st  \n\t.1<|>") + ["the", "ing", "<|endoftext|>"]
    texts += ["".join(rng.choice(pool, rng.integers(0, 80))) for _ in range(300)]
    encoder = bpe.Encoder(tok)
    for at in range(0, len(texts), 100):  # later batches meet remembered words
        part = texts[at : at + 100]
        tokens, counts = encoder.encode(part)
        want = [e.ids for e in theirs.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])] == want
        decoded = bpe.decode_tokens(tok, tokens.astype(np.int64), counts)
        assert decoded == [theirs.decode(w, skip_special_tokens=False) for w in want] == part


def test_forgetting_words_changes_nothing(tok, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder = bpe.Encoder(tok)
    for text in ["one two three four", "five <|endoftext|> six seven eight", "one two nine"]:
        assert encoder.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_to_signs(tok, theirs):
    ids = theirs.encode("日", add_special_tokens=False).ids[:1] + [0]
    got = bpe.decode_tokens(tok, np.array(ids), np.array([len(ids)]))
    assert got == [theirs.decode(ids, skip_special_tokens=False)]


def test_digests(spark, odd_docs, no_docs, theirs):
    clash = odd_docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    rows, got = clash.collect(), bpe.digests(clash).collect()

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for r in rows:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(r.text or "")))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(no_docs).count() == 0


def test_one_pass_equals_two(spark, odd_docs, tok):
    one = bpe.round_trip(odd_docs, tok)
    two = bpe.decode(bpe.encode(odd_docs, tok), tok)
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def brute_nearest(rows, every, k):
    usable = [
        (i, np.array(v, dtype=np.float64))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for i, q in usable:
        if i % every == 0:
            others = sorted((-float(q @ v), j) for j, v in usable if j != i)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(others)]
    return out


def test_nearest_of_odd_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(1, 60)]
    rows += [(60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [float("nan"), 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0]), (160, [2.0, 2.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.nearest(frame).collect()]
    assert sorted(got) == sorted(brute_nearest(rows, 20, 20))
    few = [tuple(r) for r in ann.nearest(frame.where("vec_id IN (1, 2, 20)")).collect()]
    assert sorted(few) == sorted(brute_nearest([r for r in rows if r[0] in (1, 2, 20)], 20, 20))
    assert ann.nearest(frame.where("vec_id < 0")).count() == 0
    assert ann.nearest(frame.where("vec_id IN (60, 80)")).count() == 0


def test_a_third_of_all_vectors_equal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, -1.0]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r)[:3] for r in ann.nearest(frame).collect() if r.query_id >= 1000}
    want = {r[:3] for r in brute_nearest(rows, 20, 20) if r[0] >= 1000}
    assert got == want


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want = {r[:1] + r[2:3] for r in brute_nearest([tuple(r) for r in rows.collect()], 20, 20)}
    got = {(r.query_id, r.vec_id) for r in ann.nearest(rows).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 ... 456", "en", "src0", 11)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.union(junk), sf_dir)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
    unique = corpus_pipeline.simhash_dedup(spark, kept, sf_dir)
    want, _ = brute_kept([(r.doc_id, r.text) for r in kept.collect()])
    rows = sorted((r.doc_id, r.text) for r in unique.collect())
    assert {i for i, _ in rows} == want
    left = corpus_pipeline.suffix_array_dedup(spark, unique, sf_dir).collect()
    by_id = {i: (kept_bytes, spans) for i, kept_bytes, spans in brute_removal(rows, 50)}
    assert len(left) == len(rows)
    for r in left:
        assert r.n_chars == len(r.text)
        assert len(r.text.encode()) >= len(by_id[r.doc_id][0]) >= len(r.text.encode()) - 6 * len(by_id[r.doc_id][1])


def test_pipeline_runs_through(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "suffix_array_dedup", "mixing", "bpe"]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_pipeline_of_odd_and_no_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert name == "bpe" or docs.columns == columns
        assert all(r.round_trip for r in docs.collect())
