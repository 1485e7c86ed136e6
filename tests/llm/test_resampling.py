import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from peerlight.llm import resampling
from peerlight.llm.word_arrays import folded, pieces, word_runs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["One two, ONE\ttwo Äpfel Ärger", None, "", " -- ", "x" * 70 + " b " + "x" * 70, "a\nb a", "日本 a b"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text, least, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least_words, buckets, least, most, seed):
    """doc_id, n_words, n_features, weight, score, rank of every (doc_id, text)."""

    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, least, most))

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for i, text in docs:
        found = features(text, least, most)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        u = (int(digest[:8], 16) + 0.5) / 4294967296
        rows.append([i, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u)))])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for r in rows:
        r.append(None)
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("least,most", [(1, 1), (2, 2), (1, 3)])
def test_runs_hashes_and_interning(least, most):
    slices, n_words = word_runs([folded(t) for t in TEXTS], least, most)
    got = [(k, slices.bytes_of(i)) for i, k in enumerate(slices.text.tolist())]
    want = [(k, f.encode()) for k, t in enumerate(TEXTS) for f in features(t, least, most)]
    assert sorted(got) == sorted(want) and n_words.tolist() == [len(words(t)) for t in TEXTS]
    keys = slices.hashes()
    assert keys.tolist() == [xxh64_intdigest(b) for _, b in got]
    # Keys that all collide: bytes still keep different slices apart.
    for table_keys in (None, np.zeros(len(keys), np.uint64), keys & np.uint64(1)):
        slot, holder = resampling.intern(slices, table_keys)
        by_slot = {}
        for i, (_, b) in enumerate(got):
            assert by_slot.setdefault(slot[i], b) == b
        assert len(by_slot) == len({b for _, b in got}) == (holder >= 0).sum()


def test_pieces_keep_order_and_whole_texts():
    texts = ["a" * 900_000] * 5 + [None, "b"]
    found = list(pieces(texts))
    assert len(found) > 1 and [x for _, part in found for x in part] == [folded(t) for t in texts]
    assert [first for first, _ in found] == np.cumsum([0] + [len(p) for _, p in found])[:-1].tolist()


@pytest.mark.parametrize("least,most,percent", [(1, 1, 40), (1, 2, 100), (2, 3, 7)])
def test_equal_to_brute_force(spark, least, most, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = resampling.resample(docs, target, percent, 20, 500, least, most, 7)
    want = brute([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], percent, 20, 500, least, most, 7)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(None, 1), ("brown fox", 2), ("", 3)], "text string, doc_id int")
    got = resampling.resample(odd_docs, target, 50, 5, 100)
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], [None, "brown fox", ""], 50, 5, 100, 1, 1, 2024)
    assert sorted(map(tuple, got.collect()), key=str) == want
    clash = odd_docs.selectExpr("*", "1 AS weight", "2 AS rank", "'x' AS at_", "3 AS tie_", "4 AS w", "5 AS place")
    assert sorted(map(tuple, resampling.resample(clash, target, 50, 5, 100).collect()), key=str) == want
    assert resampling.resample(no_docs, target).count() == 0
    no_target = resampling.resample(odd_docs, no_docs, 50, 5, 100).collect()
    assert sorted(map(tuple, no_target), key=str) == brute(
        [(r.doc_id, r.text) for r in odd_docs.collect()], [], 50, 5, 100, 1, 1, 2024
    )
    assert resampling.resample(odd_docs, target, 0).where("rank IS NOT NULL").count() == 0


def test_equal_rows_spread_and_rank_without_gaps(spark):
    docs = spark.createDataFrame([(5, "a b c")] * 400 + [(i, "a b") for i in range(200)], "doc_id long, text string")
    target = spark.createDataFrame([("a",)], "text string")
    got = resampling.resample(docs, target, 100, 1)
    ranked = sorted((r["rank"], -r.score, r.doc_id) for r in got.collect())
    assert [r[0] for r in ranked] == list(range(1, 601)) and [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)


def test_draw_goes_with_the_target(spark):
    near, far = "alpha beta gamma delta", "one two three four"
    docs = spark.createDataFrame(
        [(i, " ".join([near if i % 10 == 0 else far] * 6)) for i in range(500)], "doc_id long, text string"
    )
    target = spark.createDataFrame([(near,)], "text string")
    drawn = [r.doc_id for r in resampling.resample(docs, target).collect() if r["rank"]]
    assert len(drawn) == 50 and sum(i % 10 == 0 for i in drawn) == 50
