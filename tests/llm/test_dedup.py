import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from peerlight.llm import simhash, suffix_dedup
from peerlight.llm.suffix_sort import suffix_order


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(spark, odd_docs):
    got = odd_docs.select("text", simhash.fingerprint(odd_docs["text"]).alias("f")).collect()
    assert all(r.f & (2**64 - 1) == brute_print(r.text) for r in got)


@pytest.mark.parametrize("crowded", [128, 3])
def test_links_and_components_match_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CELL_ROWS", crowded)
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(0, 2**63, 40)]
    for seed in prints[:8]:  # chains and clouds of near fingerprints
        at = seed
        for _ in range(8):
            at ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            prints.append(at)
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fingerprint long")
    got = {r.fingerprint: r.component_id for r in simhash.fingerprint_groups(rows).collect()}
    assert [got[s] for s in signed] == brute_components(prints)


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    rows = odd_docs.collect()
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    by_print = {}
    for r in rows:
        by_print.setdefault(brute_print(r.text), []).append(r.doc_id)
    for r in got:
        ids = [i for i in by_print[r.fingerprint & (2**64 - 1)] if i is not None]
        assert r.component_id is None or r.component_id <= min(ids)
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 6 in ids and 7 not in ids and None not in ids


def test_a_group_without_ids_keeps_one_row(spark):
    rows = [(None, "alpha beta gamma delta")] * 3 + [(None, "quite another text of words")] * 2
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == 2


def test_nothing_has_no_duplicates(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_suffix_order_matches_sorting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        rows, width, letters = rng.integers(1, 6), rng.integers(1, 40), rng.integers(1, 5)
        lengths = rng.integers(1, width + 1, rows)
        lanes = rng.integers(1, letters + 1, (rows, width)).astype(np.int16)
        lanes[np.arange(rows), lengths - 1] = 0
        got = suffix_order(lanes, lengths)
        for r, n in enumerate(lengths):
            own = lanes[r, :n].tolist()
            assert got[r, :n].tolist() == sorted(range(n), key=lambda i: own[i:])


def brute_removal(rows, length):
    """(doc_id, text) rows; per row what is left and the removed spans."""
    last = float("inf")
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            key = b[p : p + length]
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (last if i is None else i):
                gone[p : p + length] = True
        spans, start = [], None
        for p, g in enumerate(gone):
            if g and start is None:
                start = p
            elif not g and start is not None:
                spans.append((start, p))
                start = None
        out.append((i, bytes(x for x, g in zip(b, gone) if not g), spans))
    return out


def check_removal(spark, rows, length=50):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [
        (r.doc_id, bytes(r.kept), [(s.start, s.stop) for s in r.removed])
        for r in suffix_dedup.remove_repeats(docs, length).collect()
    ]
    assert sorted(got, key=repr) == sorted(brute_removal(rows, length), key=repr)


@pytest.mark.parametrize("hot", [96, 2])
def test_removal_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(7)
    words = ["ba", "do", "kim", "loré", "su", "ti", "vex", "日本"]
    passages = [" ".join(rng.choice(words, 25)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(3)]
        for p in rng.choice(passages, 2):
            cut = rng.integers(0, 20)
            parts.insert(int(rng.integers(0, len(parts))), p[cut:])
        rows.append((int(rng.integers(0, 50)), " ".join(parts)))
    rows += [(None, rows[0][1]), (None, None), (3, None), (4, ""), (90, "ab" * 200), (91, "ab" * 150)]
    check_removal(spark, rows)
    check_removal(spark, rows, 31)


def test_removal_in_odd_rows(spark, odd_docs):
    check_removal(spark, [(r.doc_id, r.text if r.doc_id not in (6, 7) else r.text[:5000]) for r in odd_docs.collect()])
    left = suffix_dedup.remove_repeats(odd_docs, as_text=True).collect()
    texts = {(r.doc_id, r.source): r.text for r in left}
    assert texts[(7, "b")] == "" and texts[(6, "a")] is not None
    assert texts[(3, None)] is None and texts[(4, "")] == ""
    assert suffix_dedup.remove_repeats(odd_docs).columns == [*odd_docs.columns, "kept", "removed"]


def test_characters_stay_whole(spark):
    shared = "é" * 40
    rows = [(1, "x" + shared), (2, "ÿ" + shared + "日")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs, as_text=True).collect()}
    assert left == {1: rows[0][1], 2: "ÿ日"}


def test_nothing_to_remove(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_registered_dedup_queries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {
        i: (len((t or "").encode()), len((t or "").encode()) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        for (i, t), (_, kept, spans) in zip(rows, brute_removal(rows, 50))
    }
    got = suffix_dedup.op10_suffix_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    prints = [brute_print(t) for _, t in rows]
    ids = [i for i, _ in rows]
    order = np.argsort(ids)
    labels = brute_components([prints[i] for i in order])
    want = {ids[order[k]]: (f"{prints[order[k]]:016x}", ids[order[label]]) for k, label in enumerate(labels)}
    got = simhash.op9_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def judged(monkeypatch, texts, anchor):
    """Strings that the suffix sort gets for stretches of one anchor, and the verdicts."""
    sorted_ = []
    classes = suffix_dedup.window_classes
    monkeypatch.setattr(
        suffix_dedup, "window_classes", lambda groups, length: sorted_.extend(groups) or classes(groups, length)
    )
    n = len(texts)
    row = {
        "part": 0, "bucket": 0, "kind": suffix_dedup.STRETCH, "keys": np.full(n, 7, np.uint64).tobytes(),
        "ids": np.arange(n, dtype=np.uint64).tobytes(), "text": pa.compress(b"".join(texts), codec="zstd", asbytes=True),
        "sizes": np.array([len(t) for t in texts], np.uint16).tobytes(),
        "starts": np.array([t.index(anchor) for t in texts], np.uint16).tobytes(),
        "docs": np.arange(n, dtype=np.int64).tobytes(), "most": np.arange(n, dtype=np.int64).tobytes(),
    }
    out = suffix_dedup._judge(50)((pa.scalar(0),), suffix_dedup._exchanged([row])).to_pylist()
    return sorted_, [
        (int(i), int(start), int(stop), int(doc))
        for r in out
        for i, start, stop, doc in zip(
            np.frombuffer(r["ids"], np.uint64), np.frombuffer(r["starts"], np.uint16),
            np.frombuffer(r["sizes"], np.uint16), np.frombuffer(r["docs"], np.int64),
        )
    ]


def test_only_bytes_shared_around_an_anchor_are_sorted(monkeypatch):
    anchor = b"an anchor of 20 byte"
    left, right = b"abcdefghijklmnopqrstuvwxyz0123", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ4567"
    texts = [left + anchor + right, left + anchor + b"-" * 30, b"+" * 30 + anchor + b"=" * 30]
    texts += [b"*" * 10 + left[10:] + anchor + right[:12] + b"#" * 18, b"/" * 25 + left[25:] + anchor + right[:20] + b"?" * 10]
    sorted_, verdicts = judged(monkeypatch, texts, anchor)
    # The third and the last one share less than 50 bytes with any other; the first one 20 behind.
    assert sorted_ == [[texts[0][:70], texts[1][:50], texts[3][10:62]]]
    # Windows of the fourth one: 10 to 12 are in the first one.
    assert sorted(verdicts) == [(1, 0, 1, 0), (3, 10, 13, 0)]


def test_trimmed_stretches_keep_all_equal_windows(spark):
    rng = np.random.default_rng(11)
    base = "".join(rng.choice(list("abcde "), 400))
    rows = []
    for i in range(120):
        text = list(base[rng.integers(0, 200) : rng.integers(220, 400)])
        for place in rng.integers(0, len(text), 3):
            text[place] = rng.choice(list("xyz\0é"))
        rows.append((i, "".join(text)))
    check_removal(spark, rows)
    check_removal(spark, rows, 21)


@pytest.mark.parametrize("edges_a_task", [50_000, 40])
def test_components_of_chains_and_clouds(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(simhash, "EDGE_ROWS", edges_a_task)
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(300) if i % 60] + [(-5, 2**62), (2**62, 17)]
    edges += [(1000 + int(x), 1000 + int(y)) for x, y in rng.integers(0, 200, (150, 2)) if x != y]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in simhash.components(frame).collect()}
    assert got == {x: low for x, low in label.items() if x != low}


def test_few_edges_take_no_rounds_of_stars(spark, monkeypatch):
    kept = []
    settle = simhash.settle
    monkeypatch.setattr(simhash, "settle", lambda df: kept.append(df) or settle(df))
    edges = spark.range(400).selectExpr("id as a", "id + 1 as b").where("a % 100 != 99")
    assert {r.root for r in simhash.components(edges).collect()} == {0, 100, 200, 300}
    assert len(kept) == 2  # a chain took a checkpoint for every doubling


def test_places_that_share_an_anchor_by_chance_are_not_sent():
    """Twenty to thirty bytes in common make no window; a text on both sides of an anchor does."""
    rng = np.random.default_rng(11)

    def noise(n):
        return bytes(rng.integers(97, 123, n, dtype=np.uint8))

    def sent(texts, length=50):
        table = pa.table({
            "doc_id": pa.array(range(len(texts)), pa.int64()),
            "text": [zstandard.compress(t) for t in texts], "_digest": [str(i) for i in range(len(texts))],
        })
        heads = suffix_dedup._exchanged([{"part": 0, "kind": 0, "heads": list(range(len(texts)))}])
        key = (pa.scalar(0),)
        counted = suffix_dedup._count_anchors(length, 1)(key, table, heads)
        told = suffix_dedup._repeated_anchors(key, counted)
        out = suffix_dedup._stretches(length, 1)(key, table, pa.concat_tables([heads, told]))
        return [suffix_dedup._texts(out.slice(i, 1)) for i in range(len(out))]

    common = noise(34)
    assert sent([noise(70) + common + noise(70) for _ in range(6)]) == []
    for size in (50, 51, 65, 80):
        whole = noise(size)
        found = b"".join(sent([noise(60) + whole + noise(60), noise(40) + whole, whole + noise(40)]))
        assert all(whole[i : i + 50] in found for i in range(size - 49))
