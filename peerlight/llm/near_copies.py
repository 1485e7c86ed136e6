"""Near copies by Jaccard similarity of five-word shingles: SimHash groups, then a prefix join.

Texts with equal shingle sets are one node. First rounds link nodes of a SimHash group (the grid
of segment bit counts) and nodes that share one of their smallest shingles, a few links a node.
What follows is exact: of two near copies, the first shingle they share (in one order for all
texts) stands among the first fifth of both, so all nodes meet by those shingles in one exchange;
shingles that only one node brings, or only nodes that can't be near copies by their sizes and the
shingle's places, end there. Of the others, only those that nodes of different components share are
looked at: first, for some rounds, the most alike other node of every component, then all pairs that
are left. Every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from peerlight.llm.common import bounded_batches, free_name, scratch, settle, stored
from peerlight.llm.simhash import components, fingerprint_groups, majority
from peerlight.llm.word_arrays import UNBROKEN, folded, pieces, shingle_hashes
from peerlight.operators.bloom import key_filter, may_hold

#: Texts are near copies if 4 of 5 of their joint five-word shingles are in both.
SHINGLE = 5
#: Longs of a text's parity bitmap.
LANES = 32
#: Longs of the bitmap folded for pairing: the first number of them that is enough for so many
#: shingles each. Fewer let more pairs through, which the whole bitmap and the texts still tell apart.
MARK_LANES, MARK_SHINGLES = (4, 8, 16, 32), 100
#: A text of more shingles than this has a second, wider bitmap: about so many shingles fill one of
#: ``LANES`` longs so far that it tells no texts apart. Its width doubles with the text's length.
LONG = 4_200
#: Smallest shingles by which the first rounds link nodes, and how many rounds there are.
FIRST, ROUNDS = 3, 2
#: Rounds in which every component is linked to its closest other one, and the shared shingles of
#: a node that these rounds look at.
CLOSEST_ROUNDS, CLOSEST_CELLS = 3, 4
#: Shingles of more nodes than this are compared in blocks, not in one task's groups.
CELL_ROWS = 64
BLOCK_ROWS = 512
#: One text in so many is counted to learn which shingles are frequent; at most so many are
#: put last. Both only steer the order of shingles: any order finds the same pairs.
SAMPLE = 16
FREQUENT = 50_000
#: Rows that a task pairs up at a time.
ROWS = 65_536
#: Texts wanted by more keys than this pass a Bloom filter of the keys before they are exchanged.
FEW_KEYS = 10_000


def _prefix_length(n: np.ndarray) -> np.ndarray:
    """A text shares 4/5 of its shingles with any near copy, so one of its first so many."""
    return np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of folded texts, sorted per text; their numbers; fingerprints."""
    hashes, sizes = shingle_hashes(texts, SHINGLE)
    prints = majority(hashes, sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(texts)), prints


def _folded_bits(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmaps of ``width`` longs from larger ones, row by row."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def _parity_bits(own: np.ndarray, sizes: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Parity bitmaps of sets of shingle hashes, each of its own number of longs, one after the other."""
    width = 64 * lanes.astype(np.int64)
    start = np.cumsum(width) - width
    place = np.repeat(start, sizes) + (own % np.repeat(width, sizes).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(width.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _signs(texts: list[bytes], frequent: np.ndarray, seed: int) -> list[pa.Array]:
    own, sizes, prints = shingle_sets(texts)
    n, owner = len(texts), np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    node = np.array(
        [xxh64_intdigest(own[e - s : e].tobytes(), seed) for s, e in zip(sizes.tolist(), ends.tolist())],
        dtype=np.uint64,
    )
    bits = _parity_bits(own, sizes, np.full(n, LANES))
    long = sizes > LONG
    lanes_wide = np.where(long, LANES << np.ceil(np.log2(np.maximum(sizes, 1) / LONG)).clip(0).astype(np.int64), 0)
    wide = _parity_bits(own[np.repeat(long, sizes)], sizes[long], lanes_wide[long])
    whole, marks = bits.reshape(n, LANES), [b""] * n
    lanes = np.array(MARK_LANES)[np.searchsorted(np.array(MARK_LANES[:-1]) * MARK_SHINGLES, sizes)]
    for width in np.unique(lanes).tolist():
        rows = np.flatnonzero(lanes == width)
        for row, mark in zip(rows.tolist(), _folded_bits(whole[rows], width)):
            marks[row] = mark.tobytes()
    last = np.zeros(len(own), dtype=bool)
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    order = np.lexsort((last, owner))  # stable: by hash among frequent ones and others
    at = np.arange(len(own)) - np.repeat(ends - sizes, sizes)
    wanted = _prefix_length(sizes)
    chosen = order[at < np.repeat(wanted, sizes)]
    rare = np.bincount(owner[~last], minlength=n)
    few = at < FIRST

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))

    return [
        pa.array(node.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(rare.astype(np.int32)),
        pa.array(prints.view(np.int64)), lists(bits, np.full(n, LANES)), lists(own[chosen], wanted),
        lists(own[few], np.minimum(sizes, FIRST)), lists(wide, lanes_wide), pa.array(marks, pa.binary()),
    ]


def signs(rows: DataFrame, frequent: np.ndarray, seed: int = 42) -> DataFrame:
    """``rows`` (best, text) with the text's sign in place of the text.

    The digest of its shingle set (node), its size, how many of it are not ``frequent`` (sorted),
    its SimHash, the parity bitmap of the set, the first shingles (frequent ones come last, else
    the order is that of the hashes), the smallest ones, the wider bitmap of a long text (else empty)
    and the bitmap folded (mark).
    """
    added = StructType.fromDDL(
        "node long, size int, rare int, fingerprint long, bits array<long>, prefix array<long>, "
        "least array<long>, wide array<long>, mark binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in pieces(batch.column("text").to_pylist(), UNBROKEN):
                best = batch.column("best").slice(first, len(part))
                yield pa.RecordBatch.from_arrays([best, *_signs(part, frequent, seed)], names=["best", *added.names])

    return rows.select("best", "text").mapInArrow(run, StructType([rows.schema["best"], *added]))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold, as far as a sample shows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in pieces(batch.column("text").to_pylist(), UNBROKEN):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part)[0].view(np.int64))], names=["token"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "token long")
    counts = some.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    many = counts.where(F.col("n") > 2).orderBy(F.desc("n"), "token")
    found = np.array([r.token for r in many.limit(FREQUENT).collect()], dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _differing(x: Column, y: Column) -> Column:
    """Bits that differ between two bitmaps (arrays of longs); one twice as wide is folded."""

    def halved(bits: Column, width: Column) -> Column:
        half = F.shiftright(F.size(bits), 1)
        both = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(bits) > width, both).otherwise(bits)

    width = F.least(F.size(x), F.size(y))
    bits = F.zip_with(halved(x, width), halved(y, width), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda acc, n: acc + n)


def _alike(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b, ...) whose sizes and parity bitmaps allow a Jaccard similarity of 0.8, with the
    bits that differ (``apart``).

    Each shingle that one text has alone flips one bit at most, and near copies have at most a
    ninth of their joint sizes of those. Two long texts are told apart by their wider bitmaps.
    """
    kept = edges.columns
    # Sizes that fit differ by a quarter, so widths by one doubling.
    signed = nodes.select("node", "size", F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("bits")).alias("bits"))
    for side in "ab":
        signed_side = signed.select(
            F.col("node").alias(side), F.col("size").alias(f"s{side}"), F.col("bits").alias(f"b{side}")
        )
        edges = edges.join(signed_side, side)
    apart = _differing(F.col("ba"), F.col("bb"))
    sizes_fit = 5 * F.least("sa", "sb") >= 4 * F.greatest("sa", "sb")
    told = edges.where(sizes_fit).select(*kept, "sa", "sb", apart.alias("apart"))
    return told.where(9 * F.col("apart") <= F.col("sa") + F.col("sb")).select(*kept, "apart")


def _packed(text: Column) -> Column:
    """Folded text, compressed: a third of its shingle set."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            yield pd.Series([packer.compress(folded(t, UNBROKEN)) for t in texts], dtype=object)

    return run(text)


def _near(left: Column, right: Column) -> Column:
    """Whether two packed texts have a Jaccard similarity of 0.8 or more on their whole sets."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdDecompressor()
        for a, b in batches:
            # Batches come sorted by the left text, so each is taken apart once.
            known, sets, out = None, None, []
            for x, y in zip(a, b):
                if x != known:
                    known, sets = x, shingle_sets([packer.decompress(x)])[0]
                other = shingle_sets([packer.decompress(y)])[0]
                common = len(np.intersect1d(sets, other, assume_unique=True))
                out.append(9 * common >= 4 * (len(sets) + len(other)))
            yield pd.Series(out, dtype=bool)

    return run(left, right)


def _verified(docs: DataFrame, nodes: DataFrame, edges: DataFrame, keep: Callable) -> DataFrame:
    """Edges (a, b) of Jaccard similarity 0.8 or more, by the whole texts of both nodes."""
    used = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # A stored table has a known size: Spark sends a small one to the texts, not them to it.
    keys = keep(nodes.join(used, "node").select("node", "best.doc_id", "best.text_key"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    if keys.count() > FEW_KEYS:
        texts = texts.where(may_hold(texts, "text_key", key_filter(keys, "text_key")))
    same = texts["doc_id"].eqNullSafe(keys["doc_id"]) & (texts["text_key"] == keys["text_key"])
    held = keep(
        texts.join(keys, same).select("node", _packed(F.col("text")).alias("text")).dropDuplicates(["node"])
    )
    for side in "ab":
        edges = edges.join(held.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    edges = edges.sortWithinPartitions("a")
    return keep(edges.where(_near(F.col("text_a"), F.col("text_b"))).select("a", "b"))


def _rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``nodes`` with the root of their component; a node without links is its own."""
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _first_links(nodes: DataFrame, roots: DataFrame | None, round_: int) -> DataFrame:
    """At most ``FIRST`` edges (a, b) of every node, to nodes of other components: to one node for
    all that share one of its smallest shingles, another one in every round; in the first round
    also to the smallest node of its SimHash group. Sizes and bitmaps must allow a link."""
    rooted = _rooted(nodes, roots)
    low = rooted.select("node", "root", F.explode("least").alias("token"))
    centre = F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(round_))).alias("c")
    heads = low.groupBy("token").agg(centre, F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = low.join(heads, "token").where("root != c.root").select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")
    )
    if not round_:
        simhash = fingerprint_groups(nodes.select(F.col("node").alias("doc_id"), "fingerprint"))
        close = nodes.select("node", "fingerprint").join(simhash, "fingerprint").select(
            F.col("component_id").alias("a"), F.col("node").alias("b")
        )
        edges = edges.union(close.where("a != b"))
    return _alike(edges.distinct(), nodes).select("a", "b")


def _fits(size_a: np.ndarray, size_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether two nodes may be near copies whose first common shingle is the one at these places."""
    least = np.minimum(size_a - at_a, size_b - at_b)
    close = 5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)
    return close & (9 * least >= 4 * (size_a + size_b))


def _cut_at_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by token, in pieces of about ``ROWS`` that part at tokens.

    A token of more rows than that parts as well, with one row of it on both sides.
    """
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
            size += batch.num_rows
        if size >= ROWS:
            rows = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            cut = int(np.searchsorted(rows["token"], rows["token"][-1]))
            cut = cut or size - 1
            yield {n: x[:cut] for n, x in rows.items()} if cut < size - 1 else rows
            held, size = [{n: x[cut:] for n, x in rows.items()}], size - cut
    if size:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _row_pairs(token: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all two rows of a token, in steps; rows come sorted by token. Tokens of more than
    ``most`` rows are left out."""
    head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    count = np.diff(np.r_[head, len(token)])
    left = np.repeat(head + count, count) - np.arange(len(token))  # rows of the token from here on
    left[np.repeat(count > most, count)] = 0
    for step in range(1, int(left.max(initial=1))):
        i = np.flatnonzero(left > step)
        yield i, i + step


def _meeting(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Whether another row of its token fits a row, or its token has over ``CELL_ROWS`` rows."""
    token, size, at = rows["token"], rows["size"], rows["at"]
    _, place, count = np.unique(token, return_inverse=True, return_counts=True)
    met = count[place] > CELL_ROWS
    for i, j in _row_pairs(token, CELL_ROWS):
        fit = _fits(size[i], size[j], at[i], at[j])
        met[i[fit]] = met[j[fit]] = True
    return met


def _shared_cells(nodes: DataFrame, keep: Callable) -> DataFrame:
    """(token, node, size, at) of the first shingles that more than one node brings, if sizes and
    places allow two of them to be near copies.

    All first shingles meet here, and only here, by their hash; nearly all belong to one node, or
    to nodes that share it by chance and don't fit, and end in this task. Frequent ones are shared
    anyway and are not sent, so no task gets the rows of a shingle that a large part of all texts
    holds.
    """
    placed = nodes.select("node", "size", "rare", F.posexplode("prefix").alias("at", "token"))
    often = F.col("at") >= F.col("rare")
    columns = ["token", "node", "size", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut_at_tokens(batches):
            met = _meeting(rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][met]) for c in columns], names=columns)

    met = (
        placed.where(~often)
        .select(*columns)
        .repartition("token")
        .sortWithinPartitions("token")
        .mapInArrow(run, "token long, node long, size int, at int")
    )
    # A row on both sides of a cut is there twice; pairs are made distinct later.
    return keep(met.unionByName(placed.where(often).select(*columns)))


_PAIRS = "a long, b long, low long, high long"


class _Marks:
    """Folded parity bitmaps of rows, which tell whether sizes allow what differs between two."""

    def __init__(self, marks: np.ndarray, size: np.ndarray):
        self.size, self.lanes, self.bits = size, np.array([len(m) // 8 for m in marks]), {}
        for width in np.unique(self.lanes).tolist():
            rows = np.flatnonzero(self.lanes >= width)
            self.bits[width] = np.zeros((len(marks), width), dtype=np.uint64)
            for own in np.unique(self.lanes[rows]).tolist():
                mine = rows[self.lanes[rows] == own]
                held = np.frombuffer(b"".join(marks[mine].tolist()), dtype=np.uint64).reshape(-1, own)
                self.bits[width][mine] = _folded_bits(held, width)

    def allow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows ``i`` and ``j`` may be near copies, by the smaller bitmap of both."""
        lanes, out = np.minimum(self.lanes[i], self.lanes[j]), np.zeros(len(i), dtype=bool)
        for width, bits in self.bits.items():
            mine = np.flatnonzero(lanes == width)
            a, b = i[mine], j[mine]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            out[mine] = 9 * apart <= self.size[a].astype(np.int64) + self.size[b]
        return out


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a < b of nodes of different roots (low < high) that share a token, fit and whose
    marks allow a link.

    Rows come sorted by token, a token has at most about ``CELL_ROWS``, so a row is held against
    no more than that; texts that share a shingle by chance are no pairs. A pair comes once a piece.
    """
    for rows in _cut_at_tokens(batches):
        token, marks = rows["token"], _Marks(rows["mark"], rows["size"])
        found = [np.zeros((0, 4), dtype=np.int64)]
        for i, j in _row_pairs(token, len(token)):
            fit = rows["root"][i] != rows["root"][j]
            fit &= _fits(rows["size"][i], rows["size"][j], rows["at"][i], rows["at"][j])
            i, j = i[fit], j[fit]
            near = marks.allow(i, j)
            i, j = i[near], j[near]
            a, b = rows["node"][i], rows["node"][j]
            x, y = rows["root"][i], rows["root"][j]
            sides = [np.minimum(a, b), np.maximum(a, b), np.minimum(x, y), np.maximum(x, y)]
            found.append(np.stack(sides, axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in both.T], names=["a", "b", "low", "high"])


def _crowded_pairs(crowded: DataFrame, nodes: DataFrame, best: bool, keep: Callable) -> DataFrame:
    """Pairs (a, b, low, high, apart) of crowded tokens that sizes, places and bitmaps allow.

    ``crowded`` has token, n, node, root, size and at. A token's nodes are dealt into blocks of
    about ``BLOCK_ROWS``: the nodes of a root of more than that have blocks of their own, which
    are not compared with each other. Every other two blocks meet in one task. With ``best``, a
    task gives one pair of every root, the one of fewest different bits: no more than it has nodes.
    """
    per_root = crowded.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    large = F.col("k") > BLOCK_ROWS
    parts = F.ceil(F.when(large, F.col("k")).otherwise(F.col("n")) / BLOCK_ROWS).cast("int")
    part = F.pmod(F.when(large, F.xxhash64("node")).otherwise(F.xxhash64("root")), parts).cast("int")
    block = F.struct(
        large.alias("large"), F.when(large, F.col("root")).otherwise(0).alias("own"), part.alias("part")
    )
    dealt = keep(
        crowded.join(per_root, ["token", "root"])
        .join(nodes.select("node", "bits"), "node")
        .select("token", "node", "root", "size", "at", "bits", block.alias("mine"))
    )
    blocks = dealt.select("token", "mine").distinct()
    other = blocks.select("token", F.col("mine").alias("other"))
    # Blocks against blocks, not rows against rows; two of one large root have nothing to compare.
    meet = blocks.join(other, "token").where(
        "NOT (mine.large AND other.large AND mine.own = other.own)"
    )
    sent = dealt.join(meet, ["token", "mine"]).select(
        "token", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"),
        (F.col("mine") <= F.col("other")).alias("left"), "node", "root", "size", "at", "bits",
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["left"]]
        right = rows[~rows["left"]] if not rows["left"].all() else left
        out = [np.zeros((0, 5), dtype=np.int64)]
        # Unsigned: numpy counts the bits of a signed number's absolute value.
        bits = np.array(right["bits"].tolist(), dtype=np.int64).reshape(-1, LANES).view(np.uint64)
        node, root, size, at = (right[c].to_numpy() for c in ("node", "root", "size", "at"))
        for r in left.itertuples():
            fit = np.flatnonzero((root != r.root) & _fits(size, np.int64(r.size), at, np.int64(r.at)))
            apart = np.bitwise_count(bits[fit] ^ np.array(r.bits, np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = 9 * apart <= size[fit] + r.size
            fit, apart = fit[near], apart[near]
            if best and len(fit):  # the closest one, and for each other root its closest
                order = np.lexsort((apart, root[fit]))
                fit, apart = fit[order], apart[order]
                first = np.r_[True, root[fit][1:] != root[fit][:-1]]
                fit, apart = fit[first], apart[first]
            a, x = np.full(len(fit), r.node), np.full(len(fit), r.root)
            b, y = node[fit], root[fit]
            sides = [np.minimum(a, b), np.maximum(a, b), np.minimum(x, y), np.maximum(x, y), apart]
            out.append(np.stack(sides, axis=1))
        found = pd.DataFrame(np.concatenate(out), columns=["a", "b", "low", "high", "apart"])
        if best:
            found = found.sort_values(["apart", "a", "b"])
            closest = ~found["low"].duplicated() | ~found["high"].duplicated()
            return found[closest]
        return found.drop_duplicates()

    return sent.groupBy("token", "first", "second").applyInPandas(run, _PAIRS + ", apart long")


def _missing_links(
    cells: DataFrame, nodes: DataFrame, roots: DataFrame, best: bool, keep: Callable
) -> DataFrame:
    """Edges (a, b) between nodes of different components that may be near copies: all, or with
    ``best`` for every component the one of fewest different bits, looking at the first cells of
    every node that another component is in."""
    rooted = _rooted(cells, roots)
    mixed = (
        rooted.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
        .where("x != y")
        .select("token", "n")
    )
    open_ = rooted.join(mixed, "token").select("token", "n", "node", "root", "size", "at")
    if best:
        # At most ``CLOSEST_CELLS`` of a node's first shingles, themselves a fifth of a text.
        first = F.slice(F.array_sort(F.collect_list(F.struct("at", "token", "n", "root", "size"))), 1, CLOSEST_CELLS)
        listed = open_.groupBy("node").agg(first.alias("c")).select("node", F.explode("c").alias("c"))
        open_ = listed.select("c.token", "c.n", "node", "c.root", "c.size", "c.at")
    open_ = keep(open_)
    few = open_.where(F.col("n") <= CELL_ROWS).drop("n").join(nodes.select("node", "mark"), "node")
    pairs = few.repartition("token").sortWithinPartitions("token").mapInArrow(_pair_up, _PAIRS)
    crowded = _crowded_pairs(open_.where(F.col("n") > CELL_ROWS), nodes, best, keep)
    found = _alike(pairs.unionByName(crowded.drop("apart")).distinct(), nodes)
    if best:
        least = F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("e")
        sided = found.select("a", "b", "apart", F.explode(F.array("low", "high")).alias("root"))
        return keep(sided.groupBy("root").agg(least).select("e.a", "e.b").distinct())
    return keep(found.select("a", "b").distinct())


def near_copy_groups(docs: DataFrame, keep: Callable = stored) -> tuple[DataFrame, DataFrame]:
    """Node and representative of every distinct shingle set, and the root of linked nodes.

    Texts with equal shingle sets are one node (by a 64-bit digest). Two nodes are linked
    exactly if the Jaccard similarity of their sets is 0.8 or more; nodes that the first round
    connects need no further links. ``keep`` stores a table.
    """
    bounded_batches(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("text_key"))
    rows = signs(docs.select(order.alias("best"), "text"), frequent_shingles(docs))
    nodes = keep(
        rows.groupBy("node").agg(
            F.min("best").alias("best"),
            *[F.first(c).alias(c) for c in ("size", "rare", "fingerprint", "bits", "prefix", "least", "wide", "mark")],
        )
    )
    linked, roots = None, None
    for round_ in range(ROUNDS):
        edges = keep(_first_links(nodes, roots, round_))
        fresh = _verified(docs, nodes, edges, keep)
        linked = fresh if linked is None else linked.union(fresh)
        roots = keep(components(linked))
    cells = _shared_cells(nodes, keep)
    for _ in range(CLOSEST_ROUNDS):
        edges = _missing_links(cells, nodes, roots, True, keep)
        fresh = _verified(docs, nodes, edges, keep)
        if fresh.isEmpty():
            break
        linked = linked.union(fresh)
        roots = keep(components(linked))
    rest = _missing_links(cells, nodes, roots, False, keep)
    if not rest.isEmpty():
        linked = linked.union(_verified(docs, nodes, rest, keep))
        roots = components(linked)
    return nodes.select("node", "best"), roots


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per group of near copies: the row with the group's smallest id.

    Null and empty texts are one group. Of rows that repeat the smallest id, one stays; of a
    group without ids, one row stays. Columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        nodes, roots = near_copy_groups(docs, keep)
        best = (
            nodes.join(roots, "node", "left")
            .groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min("best").alias("best"))
        )
        # What leaves: keys of the rows that stay, and whether such a row is there twice.
        wanted = keep(best.select(F.struct("best.doc_id", "best.text_key").alias("key")))
        keys = docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_key")).alias("key"))
        times = keys.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
        found = stored(times.join(wanted.withColumn("stays", F.lit(True)), "key", "left"))
    key, row, print_ = (free_name(docs, n) for n in ("key", "row", "text_key"))
    # Rows of a text that no row to drop has stay where they are; only the others are exchanged.
    doubtful = found.where("stays IS NULL OR times > 1").select(F.col("key.text_key").alias("text_key"))
    printed = docs.withColumn(print_, F.xxhash64("text"))
    doubt = may_hold(printed, print_, key_filter(doubtful, "text_key"))
    marked = printed.withColumn(row, doubt)
    alone = marked.where(~F.col(row)).select(*docs.columns)
    keyed = marked.where(F.col(row)).select(
        *docs.columns, F.struct(F.col("doc_id"), F.col(print_).alias("text_key")).alias(key)
    )
    once = found.where("stays AND times = 1").select(F.col("key").alias(key))
    twice = found.where("stays AND times > 1").select(F.col("key").alias(key))
    kept = alone.union(keyed.join(once, key, "left_semi").select(*docs.columns))
    if twice.isEmpty():
        return kept
    again = keyed.join(twice, key, "left_semi").groupBy(key).agg(F.first(F.struct(*docs.columns)).alias(row))
    return kept.union(again.select(F.col(row + ".*")))
