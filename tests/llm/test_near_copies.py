import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from peerlight.llm import near_copies


def shingles(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Smallest id of every group of Jaccard similarity 0.8 or more, and the linked pairs."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    near = [
        (a, b) for a in ids for b in ids
        if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    label, changed = {i: i for i in ids}, True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return set(label.values()), near


def changed(words, share, rng):
    out = list(words)
    for at in rng.choice(len(out), max(1, round(share * len(out))), replace=False):
        out[at] = f"new{rng.integers(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("crowded,group", [(128, 512), (3, 4)])
def test_stage_drops_copies_of_one_to_five_percent_changed_words(spark, monkeypatch, crowded, group):
    monkeypatch.setattr(near_copies, "CELL_ROWS", crowded)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", group)
    rng = np.random.default_rng(9)
    line = "a common line of some ten words stands in here".split()
    rows, at = [], 0
    for base in range(24):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60 + 12 * base)] + line
        texts = [" ".join(words)] + [changed(words, share / 100, rng) for share in (1, 2, 3, 4, 5)]
        for text in texts:
            rows.append((at, text))
            at += 1
    words = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    rows += [(1000 + i, changed(words, 0.01 + 0.02 * (i % 2), rng)) for i in range(30)]
    want, near = brute_kept(rows)
    assert len(near) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == want


def test_stage_keeps_exactly_what_brute_force_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _ = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    ids = [r.doc_id for r in near_copies.drop_near_copies(odd_docs).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 6, 8, 9, 10, 11, 12, 13] and None not in ids
    assert near_copies.drop_near_copies(no_docs).count() == 0
    lost = spark.createDataFrame([(None, "alpha beta gamma")] * 3 + [(None, "quite another text")], "doc_id long, text string")
    assert near_copies.drop_near_copies(lost).count() == 2


def test_large_groups_and_clashing_names(spark, monkeypatch):
    """Two families of near copies that share one short frame: blocks of a root and shared ones."""
    monkeypatch.setattr(near_copies, "CELL_ROWS", 3)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_copies, "FIRST", 1)
    monkeypatch.setattr(near_copies, "ROUNDS", 1)
    monkeypatch.setattr(near_copies, "ROWS", 20)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = np.random.default_rng(2)
    frame = [f"f{x}" for x in range(60)]
    rows = []
    for family in range(6):
        own = [f"{family}x{x}" for x in range(8 + family)]
        for i in range(14):
            rows.append((100 * family + i, " ".join(frame + own[: len(own) - i % 3] + [f"e{rng.integers(4)}"])))
    rows += [(900 + i, "alpha beta gamma " * 3) for i in range(20)]
    want, _ = brute_kept(rows)
    docs = spark.createDataFrame(
        [(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, `key` int, `row` int, _key int, node int, best int"
    )
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_rows_that_repeat_the_smallest_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (3, "other words here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [1, 3]


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_pieces_part_at_tokens(monkeypatch, rows):
    monkeypatch.setattr(near_copies, "ROWS", rows)
    tokens = np.sort(np.random.default_rng(rows).integers(0, 12, 60))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(tokens[i : i + 4])], names=["token"]) for i in range(0, 60, 4)
    ]
    pieces = [p["token"] for p in near_copies._cut_at_tokens(iter(batches))]
    shared = [t for p in pieces for t in set(p[(np.r_[False, p[1:] == p[:-1]]) | np.r_[p[1:] == p[:-1], False]].tolist())]
    assert set(shared) == {t for t in tokens.tolist() if (tokens == t).sum() > 1}
    assert set(np.concatenate(pieces).tolist()) == set(tokens.tolist())


def unlike_and_alike(sizes, rng):
    """Texts of so many words, each with one near copy."""
    texts = []
    for n in sizes:
        words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        texts += [" ".join(words).encode(), changed(words, 0.01, rng).encode()]
    return texts


def test_texts_that_share_a_shingle_by_chance_are_no_pairs():
    rng = np.random.default_rng(5)
    texts = unlike_and_alike([40, 300, 320, 330, 350, 390, 410, 500, 700, 790, 830, 900, 1500, 1700, 4000, 4200], rng)
    own, sizes, _ = near_copies.shingle_sets(texts)
    mark = near_copies._signs(texts, np.zeros(0, np.uint64), 42)[-1]
    assert {len(m) // 8 for m in mark.to_pylist()} == {4, 8, 16, 32}
    n = len(texts)
    columns = {
        "token": np.zeros(n, np.int64), "node": np.arange(n), "root": np.arange(n),
        "size": sizes.astype(np.int32), "at": np.zeros(n, np.int32),
    }
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), mark], names=[*columns, "mark"])
    pairs = [(a, b) for out in near_copies._pair_up(iter([batch])) for a, b in zip(*(out.column(c).to_pylist() for c in "ab"))]
    sets = [set(x.tolist()) for x in np.split(own, np.cumsum(sizes)[:-1])]
    near = {(a, b) for a in range(n) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(near) > 10 and {(b, a) for a, b in near} <= set(pairs)
    assert len(pairs) <= n // 2 + 2  # 130 pairs of sizes that fit came before


def test_shingles_shared_by_chance_end_where_they_meet(spark):
    """Rows of a shingle that sizes and places rule out are not stored; those of near copies are."""
    rows = [
        (1, 100, [11, 12, 13]), (2, 300, [11]),  # sizes too far apart
        (3, 100, [21, *range(1000, 1018), 22]), (4, 100, [31, *range(2000, 2018), 22]),  # place 19 of 100 in both
        (5, 100, [41, 42]), (6, 101, [41, 43]),
    ]
    nodes = spark.createDataFrame(
        [(n, size, len(p), p) for n, size, p in rows], "node long, size int, rare int, prefix array<long>"
    )
    cells = near_copies._shared_cells(nodes, lambda df: df).collect()
    assert {(r.token, r.node) for r in cells} == {(41, 5), (41, 6)}


def test_long_texts_that_share_a_shingle_by_chance_are_told_apart(spark):
    rng = np.random.default_rng(8)
    texts = [t.decode() for t in unlike_and_alike([4100, 4300, 4500, 5000, 6000, 8300, 8500, 9000, 17000], rng)]
    rows = spark.createDataFrame([((i,), t) for i, t in enumerate(texts)], "best struct<i int>, text string")
    signed = near_copies.signs(rows, np.zeros(0, np.uint64))
    place = {r.node: r.best.i for r in signed.select("node", "best").collect()}
    edges = spark.createDataFrame(
        [(a, b) for a in place for b in place if place[a] < place[b]], "a long, b long"
    )
    told = {(place[r.a], place[r.b]) for r in near_copies._alike(edges, signed).collect()}
    assert told == {(i, i + 1) for i in range(0, len(texts), 2)}


def test_many_keys_pass_a_filter_before_texts_are_exchanged(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FEW_KEYS", 0)
    rng = np.random.default_rng(4)
    rows = []
    for base in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 80)]
        rows += [(3 * base, " ".join(words)), (3 * base + 1, changed(words, 0.01, rng))]
    rows += [(500, None), (501, ""), (502, rows[0][1]), (0, rows[0][1])]
    want, _ = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == sorted(want)
