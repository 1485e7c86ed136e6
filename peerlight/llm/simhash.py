"""Near-duplicate groups from SimHash fingerprints, joined in a grid of segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from peerlight.llm.common import bounded_batches, documents, free_name, settle

#: A fingerprint has 32 segments of two bits; its embedding is the bit count of each.
SEGMENTS = 32
#: Cells with more fingerprints than this are linked through shared neighbours, not in pairs.
CELL_ROWS = 128
#: Edges that a task contracts by itself.
EDGE_ROWS = 50_000

# Per byte value, its eight bits.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_words(text: str | None, shingle: int = 3, seed: int = 42) -> list[int]:
    """Shingle hashes of a text: A-Z lowered, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < shingle:
        return [xxh64_intdigest(b" ".join(words), seed)]
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return list(map(xxh64_intdigest, joined, repeat(seed)))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint per text of ``sizes`` consecutive hashes: bits set in over half of them."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    if not len(hashes):
        return out
    text = np.repeat(np.arange(len(sizes)), sizes)
    for lane, octet in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        counts = np.bincount(text * 256 + octet, minlength=len(sizes) * 256).reshape(-1, 256)
        bits = 2 * (counts @ _BITS) > sizes[:, None]
        value = (bits * (1 << np.arange(8))).sum(axis=1).astype(np.uint64)
        out |= value << np.uint64(8 * lane)
    return out


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """SimHash of a text as a long; no words: zero."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = [np.zeros(0, dtype=np.int64)]
            for at in range(0, len(texts), 256):  # bounds the hashes held at a time
                part = texts.iloc[at : at + 256]
                lists = [fingerprint_words(t, shingle, seed) for t in part]
                sizes = np.array([len(x) for x in lists])
                flat = np.fromiter((h for x in lists for h in x), np.uint64, int(sizes.sum()))
                prints.append(majority(flat, sizes).view(np.int64))
            yield pd.Series(np.concatenate(prints))

    return run(text)


def _popcounts(x: Column) -> Column:
    """The embedding in one long: each segment of two bits holds its own bit count."""
    low = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(x, 1)
    both, one = x.bitwiseAND(half).bitwiseAND(low), x.bitwiseXOR(half).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def _block_masks(blocks: int) -> list[int]:
    """Bit masks of the segments of each block; segments are dealt out in runs."""
    masks = []
    for b in range(blocks):
        low, high = b * SEGMENTS // blocks, (b + 1) * SEGMENTS // blocks
        masks.append(((1 << 2 * (high - low)) - 1) << 2 * low)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _manhattan(a: Column, b: Column, places: int = 8) -> Column:
    """Manhattan distance of two embeddings summed over runs of segments: a lower bound of it."""
    total = F.lit(0)
    width = 64 // places
    for i in range(places):
        mask = F.lit((1 << width) - 1)
        x = F.bit_count(F.shiftrightunsigned(a, width * i).bitwiseAND(mask))
        y = F.bit_count(F.shiftrightunsigned(b, width * i).bitwiseAND(mask))
        total = total + F.abs(x - y)
    return total


def links(prints: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints within ``distance`` bits.

    Each flipped bit moves one coordinate of the segment-popcount embedding by one, so the
    Manhattan distance there never exceeds the Hamming distance, and two embeddings within
    ``distance`` agree in all but ``distance`` of the blocks of coordinates. The grid has one
    cell per choice of agreeing blocks and their counts; members of a cell are paired once
    (at the first choice on which they agree), kept if the Manhattan distance allows, and
    verified on the bits. Larger ``blocks`` give finer cells for larger tables.

    A cell of many fingerprints would pair quadratically. Fingerprints in such cells are
    linked through the points at most half the distance away instead: two of them are within
    two bits exactly if they share such a point, and each point gives a star. That adds no
    link that does not hold: members of a star are within ``distance`` of each other.
    """
    if distance != 2:
        raise ValueError("the shared-neighbour rule for crowded cells is built for two bits")
    masks = _block_masks(blocks)
    choices = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    embedding = _popcounts(F.col("fingerprint"))
    cells = [
        F.struct(F.lit(i).alias("choice"), embedding.bitwiseAND(F.lit(_signed(m))).alias("counts"))
        for i, m in enumerate(choices)
    ]
    placed = prints.select("fingerprint", F.explode(F.array(*cells)).alias("cell"))
    cell = ["cell.choice", "cell.counts"]
    members = settle(
        placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    few, many = members.where(F.col("n") <= CELL_ROWS), members.where(F.col("n") > CELL_ROWS)
    flat = placed.select("fingerprint", *cell)
    left = flat.join(few.drop("n"), ["choice", "counts"])
    right = left.select("choice", "counts", F.col("fingerprint").alias("other"))
    a, b = F.col("fingerprint"), F.col("other")
    same = embedding.bitwiseXOR(_popcounts(b))
    first = F.lit(len(choices))
    for i, mask in reversed(list(enumerate(choices))):
        first = F.when(same.bitwiseAND(F.lit(_signed(mask))) == 0, i).otherwise(first)
    # A pair whose first shared cell is crowded comes from the stars.
    pairs = (
        left.join(right, ["choice", "counts"])
        .where(a < b)
        .where(F.col("choice") == first)
        .where(_manhattan(a, b) <= distance)
        .where(F.bit_count(a.bitwiseXOR(b)) <= distance)
        .select(a.alias("a"), b.alias("b"))
    )
    crowded = flat.join(many.drop("n"), ["choice", "counts"]).select("fingerprint").distinct()
    flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])
    around = crowded.select(
        "fingerprint", F.explode(F.transform(flips, lambda x: a.bitwiseXOR(x))).alias("point")
    )
    heads = around.groupBy("point").agg(
        F.min("fingerprint").alias("b"), F.count(F.lit(1)).alias("n")
    )
    stars = (
        around.join(heads.where("n > 1"), "point")
        .where(a != F.col("b"))
        .select(a.alias("a"), "b")
    )
    return pairs.union(stars).distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars: every node with the smallest one that the edges at hand reach.

    Some ``EDGE_ROWS`` are taken together, so memory does not follow the size of the task.
    """

    def stars(held: list[np.ndarray]) -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
        far = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"]
        )

    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in "uv"]))
        size += batch.num_rows
        if size >= 2 * EDGE_ROWS:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from every node that has an edge: columns node, root.

    Edges are longs (a, b). Tasks of some ``EDGE_ROWS`` edges contract what they have to stars;
    rounds of large-star and small-star contraction join what several tasks have. Every round is
    checkpointed and holds one row per edge at most.
    """
    current = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # Few edges in many partitions cost more files than rows.
        tasks = 1 + state[0] // EDGE_ROWS
        if before is None:
            current = settle(current.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
            if tasks == 1:  # all edges were at hand
                return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node move to the smallest node around it.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        current = settle(small.coalesce(tasks).mapInArrow(_contract, "u long, v long"))


def fingerprint_groups(prints: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """root and component_id (smallest doc_id, null if none) of every distinct fingerprint."""
    nodes = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fingerprint"), distance, blocks))
    rooted = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return settle(rooted.drop("least").join(least, "root"))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4
) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row.

    Documents whose fingerprints differ in ``distance`` bits or fewer are linked; component_id
    is the smallest id reachable. Equal fingerprints are one node, so copies are never
    paired. Null and empty texts have fingerprint zero and are linked like any other; rows
    without an id get the smallest id of their group, or null if no row of it has one; rows
    that repeat an id stay rows of their own. Further columns do not enter.
    """
    bounded_batches(docs.sparkSession)
    prints = settle(docs.select("doc_id", fingerprint(F.col("text"), shingle, seed).alias("fingerprint")))
    groups = fingerprint_groups(prints, distance, blocks)
    # A fingerprint may hold a third of all rows; the adaptive join splits its partition.
    return prints.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4
) -> DataFrame:
    """``docs`` with one row per group: the row with the group's smallest id.

    Of rows that repeat that id, one stays; of a group without ids, one row stays. Columns
    pass through.
    """
    bounded_batches(docs.sparkSession)
    own, key = (free_name(docs, n) for n in ("own_print", "key"))
    marked = docs.withColumn(own, fingerprint(F.col("text"), shingle, seed))
    marked = marked.withColumn(key, F.struct(F.col("doc_id"), F.col(own).alias("print")))
    prints = settle(marked.select("doc_id", F.col(own).alias("fingerprint")))
    groups = fingerprint_groups(prints, distance, blocks)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")
    firsts = prints.groupBy("fingerprint").agg(F.min(order).alias("best"))
    best = firsts.join(groups, "fingerprint").groupBy("root").agg(F.min("best").alias("best"))
    keep = best.select(
        F.struct(
            F.col("best.doc_id").alias("doc_id"), F.col("best.fingerprint").alias("print")
        ).alias(key)
    )
    kept = marked.join(keep, key, "left_semi")
    return kept.dropDuplicates([key]).select(*docs.columns)


def op9_simhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
