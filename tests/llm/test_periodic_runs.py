import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlight.llm import periodic_runs as pr

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words, least_words=6, least_times=4):
    """(start, length, period) of all runs: every maximal stretch of every period, smallest kept."""
    n, found = len(words), {}
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    word = np.array([names[w] for w in words], dtype=np.int64)
    for q in range(1, n // least_times + 1):
        edge = np.diff(np.r_[False, word[:-q] == word[q:], False].astype(np.int8))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if j - i + q >= max(least_words, least_times * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text):
    """Every column of the query, from the statement of the task."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = (None,) * 4
    if runs:
        from fractions import Fraction

        s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *best, *sha)


@pytest.mark.parametrize("least_words,least_times", [(6, 4), (1, 2), (4, 3), (9, 2), (2, 5)])
def test_runs_equal_brute_force(least_words, least_times):
    rng = random.Random(least_words)
    texts = [[], [b"a"], [b"a"] * 50, [b"a", b"b"] * 20 + [b"a"]]
    for _ in range(300):
        letters = rng.choice([1, 2, 2, 3, 6])
        words = [bytes([97 + rng.randrange(letters)]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at, period = rng.randrange(len(words) + 1), rng.randrange(1, 8)
            piece = [bytes([97 + rng.randrange(letters)]) for _ in range(period)]
            words[at:at] = (piece * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        texts.append(words)
    got = pr.find_runs(texts, least_words, least_times)
    for words, runs in zip(texts, got):
        assert [(r.start, r.length, r.period) for r in runs] == sorted(
            brute_runs(words, least_words, least_times), key=lambda r: (r[0], r[2])
        )


def test_fibonacci_words_and_nested_runs():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(12):
        a, b = b, b + a
    nested = ([b"x"] * 8 + [b"y"]) * 6
    for words in (b, nested, nested + b, [b"z"] + nested * 4):
        for least in ((6, 4), (2, 2)):
            got = [(r.start, r.length, r.period) for r in pr.find_runs([words], *least)[0]]
            assert got == sorted(brute_runs(words, *least), key=lambda r: (r[0], r[2]))


def test_suffix_order_and_common_words():
    rng = np.random.default_rng(5)
    text = np.repeat(np.arange(6), [0, 1, 40, 40, 3, 60][0:6])
    word = rng.integers(0, 3, len(text))
    places, common = pr.repeated_places(word, text, 2)
    tails = [tuple(word[p : np.flatnonzero(text == text[p])[-1] + 1].tolist()) for p in places]

    def shared(i, j):
        if text[places[i]] != text[places[j]]:
            return 0
        k = 0
        while k < min(len(tails[i]), len(tails[j])) and tails[i][k] == tails[j][k]:
            k += 1
        return k

    for i in range(1, len(places)):
        k = shared(i - 1, i)
        assert common[i] == (k if k >= 2 else 0)
    # Places with as many words in common stand together: what lies between shares them too.
    for i in range(len(places)):
        for j in range(i + 1, len(places)):
            if shared(i, j) >= 2:
                assert common[i + 1 : j + 1].min() == shared(i, j)


def test_long_run_of_one_word_and_long_boilerplate():
    words = [b"w"] * 30_000
    assert [(r.start, r.length, r.period) for r in pr.find_runs([words])[0]] == [(0, 30_000, 1)]
    mixed = [x for i in range(4_000) for x in (b"one", b"two", b"three", b"four", b"five", str(i).encode())]
    assert pr.find_runs([mixed]) == [[]]


def test_query_equals_brute_force_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = pr.op13_periodic_runs(spark, "/root/testdata/sf0.001")
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    want = sorted(brute_row(r.doc_id, r.text) for r in docs)
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] for r in want) > 10


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "1 AS start", "'x' AS d", "2 AS period")
    digest = pr.digests(F.col("doc_id"), F.col("text"), prepare=pr.made_periodic)
    got = clash.select("doc_id", digest.alias("d")).select("doc_id", "d.*").collect()
    want = [brute_row(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert no_docs.select(digest).count() == 0


def test_runs_and_collapsed_texts(spark):
    rows = [(1, "say it again again again again again again now"), (2, None), (3, "a b c"), (None, "x y " * 9 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", pr.word_runs(F.col("doc_id"), F.col("text")).alias("r")).select("doc_id", "r.*").collect()
    found = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert found == {
        1: ([(2, 6, 1)], "say it again now"), 2: ([], ""), 3: ([], "a b c"), None: ([(0, 18, 2)], "x y z"),
    }
    with pytest.raises(ValueError):
        pr.find_runs([[b"a"]], 6, 1)
