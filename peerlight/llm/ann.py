"""Approximate nearest neighbours by inner product: a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlight.llm.common import Shipped, settle, shuffle_partitions

#: The trees are fit on at most this many distinct vectors; every vector is indexed.
SAMPLE = 16_384
TREES, LEAF = 4, 64
#: Leaves visited by a query: this share of all leaves, and this many at least.
VISIT_SHARE, VISIT_LEAST = 0.3, 64
#: Vectors of one leaf that meet in one task; larger leaves are split in blocks.
BLOCK = 50_000
#: Queries merged in one task.
MERGED = 100


@dataclass
class Forest:
    """Hyperplanes of all trees; a child below zero is the leaf numbered -child - 1."""

    normals: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]
    leaves: int
    largest: float  # norm that the vectors are scaled by

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Points on a sphere whose angle to a lifted query falls with the inner product."""
        scaled = x / self.largest
        rest = np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1))
        return np.column_stack([scaled, np.sqrt(rest)])

    def lifted_query(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree (vectors x trees)."""
        points = self.lifted(x)
        out = np.empty((len(points), len(self.roots)), dtype=np.int64)
        for tree, root in enumerate(self.roots):
            node = np.full(len(points), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                low = np.einsum("ij,ij->i", points[inner], self.normals[at]) <= self.cuts[at]
                node[inner] = np.where(low, self.left[at], self.right[at])
            out[:, tree] = -node - 1
        return out

    def search(self, q: np.ndarray, visits: int) -> list[list[int]]:
        """The first ``visits`` leaves of each query from one priority queue over all trees.

        The priority of a node is the smallest margin by which the path to it was preferred.
        """
        margins = self.lifted_query(q) @ self.normals.T - self.cuts if len(self.cuts) else None
        left, right = self.left.tolist(), self.right.tolist()
        out = []
        for i in range(len(q)):
            own = margins[i].tolist() if margins is not None else []
            queue = [(-np.inf, root) for root in self.roots]
            heapq.heapify(queue)
            found: list[int] = []
            while queue and len(found) < visits:
                worst, node = heapq.heappop(queue)
                if node < 0:
                    found.append(-node - 1)
                    continue
                heapq.heappush(queue, (max(worst, own[node]), left[node]))
                heapq.heappush(queue, (max(worst, -own[node]), right[node]))
            out.append(found)
        return out


def grow(sample: np.ndarray, largest: float, seed: int = 5) -> Forest:
    """Trees that halve the sample by hyperplanes between two random members."""
    rng = np.random.default_rng(seed)
    forest = Forest(np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), [], 0, largest)
    points = forest.lifted(sample)
    normals, cuts, left, right = [], [], [], []

    def split(members: np.ndarray) -> int:
        if len(members) > LEAF:
            for _ in range(3):  # a pair of equal points gives no plane
                a, b = points[rng.choice(members, 2, replace=False)]
                if (length := np.linalg.norm(a - b)) > 1e-9:
                    normal = (a - b) / length
                    side = points[members] @ normal
                    cut = float(np.median(side))
                    low = side <= cut
                    if low.any() and not low.all():
                        node = len(cuts)
                        for store, value in zip((normals, cuts, left, right), (normal, cut, 0, 0)):
                            store.append(value)
                        left[node] = split(members[low])
                        right[node] = split(members[~low])
                        return node
        forest.leaves += 1
        return -forest.leaves

    for _ in range(TREES):
        forest.roots.append(split(np.arange(len(points))))
    forest.normals = np.array(normals).reshape(len(cuts), points.shape[1])
    forest.cuts = np.array(cuts)
    forest.left, forest.right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    return forest


def _usable(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    rows, kept = [], []
    for i, v in enumerate(vectors.to_pylist()):
        if v is None or len(v) != dimension or any(x is None for x in v):
            continue
        rows.append(i)
        kept.append(v)
    x = np.array(kept, dtype=np.float64).reshape(len(kept), dimension)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    # Minus zero and zero are one value.
    return np.array(rows, dtype=np.int64)[good], x[good] + 0.0


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest other rows found for each row whose id is divisible by ``every``.

    Columns query_id, rank (from 1), vec_id, score: the inner product in double precision,
    largest first, ties to the smaller id. Rows whose id is null or whose vector is null,
    zero, of another length than most, or holds null or non-finite components take no part.
    Rows with equal vectors are one point of the index and all count as neighbours.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n")
    most = lengths.where("n > 0").first()
    result = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], result)
    dimension, held = int(most[0]), k + 1

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch in one row, with their smallest ids."""
        for batch in batches:
            at, x = _usable(batch.column("v"), dimension)
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column("vec_id").to_numpy()[at].tolist(), x):
                found.setdefault(v.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.binary()),
                    pa.array([sorted(i)[:held] for i in found.values()], pa.list_(pa.int64())),
                    pa.array([float((np.frombuffer(v) ** 2).sum()) for v in found], pa.float64()),
                ],
                names=["v", "ids", "square"],
            )

    classes = settle(
        rows.mapInArrow(classes_of, "v binary, ids array<long>, square double")
        .groupBy("v")
        .agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, held).alias("ids"),
            F.max("square").alias("square"),
        )
        .withColumn("point", F.element_at("ids", 1))
    )
    count, square = classes.agg(F.count(F.lit(1)), F.max("square")).first()
    if not count:
        return spark.createDataFrame([], result)
    drawn = classes.select("v", "point").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()
    sample = np.frombuffer(b"".join(drawn["v"]), dtype=np.float64).reshape(-1, dimension)
    forest = grow(sample, float(np.sqrt(square)))
    sent = Shipped(spark, forest)  # bounded by SAMPLE
    visits = max(VISIT_LEAST, int(np.ceil(VISIT_SHARE * forest.leaves)))
    blocks = int(np.ceil(TREES * count / max(1, forest.leaves) / BLOCK))
    blob = pa.schema(
        [("leaf", pa.int32()), ("block", pa.int32()), ("points", pa.binary()), ("v", pa.binary())]
    )

    def blobs(leaf: np.ndarray, row: np.ndarray, block: np.ndarray, points, x) -> pa.RecordBatch:
        key = leaf * blocks + block
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True]) if len(key) else [0]
        out = []
        for low, high in zip(edges[:-1], edges[1:]):
            mine = order[low:high]
            out.append(
                {
                    "leaf": int(leaf[mine[0]]),
                    "block": int(block[mine[0]]),
                    "points": points[row[mine]].tobytes(),
                    "v": x[row[mine]].tobytes(),
                }
            )
        return pa.RecordBatch.from_pylist(out, schema=blob)

    def read(batch) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype=np.float64)
        return batch.column("point").to_numpy(), x.reshape(-1, dimension)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, x = read(batch)
            leaf = sent.value.place(x)
            row = np.repeat(np.arange(len(x)), TREES)
            block = (points[row] // 20) % blocks
            yield blobs(leaf.reshape(-1), row, block, points, x)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, x = read(batch)
            found = sent.value.search(x, visits)
            row = np.repeat(np.arange(len(x)), [len(f) for f in found])
            leaf = np.array([n for f in found for n in f], dtype=np.int64)
            for b in range(blocks):
                yield blobs(leaf, row, np.full(len(leaf), b), points, x)

    asked = rows.where(F.col("vec_id") % every == 0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _usable(batch.column("v"), dimension)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at)),
                    pa.array([v.tobytes() for v in x], pa.binary()),
                ],
                names=["query_id", "v"],
            )

    queries = settle(
        asked.mapInArrow(keyed, "query_id long, v binary").join(classes.select("v", "point"), "v")
    )
    distinct = queries.dropDuplicates(["point"]).select("point", "v")
    groups = max(shuffle_partitions(spark), int(np.ceil(count / every / MERGED)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """Inner products of a leaf's vectors and the queries that visit it; the best of each."""
        out = []
        if left.num_rows and right.num_rows:
            points = np.frombuffer(b"".join(left.column("points").to_pylist()), dtype=np.int64)
            x = np.frombuffer(b"".join(left.column("v").to_pylist())).reshape(-1, dimension)
            seekers = np.frombuffer(b"".join(right.column("points").to_pylist()), dtype=np.int64)
            q = np.frombuffer(b"".join(right.column("v").to_pylist())).reshape(-1, dimension)
            for at in range(0, len(q), 512):
                scores = q[at : at + 512] @ x.T
                best = min(held, len(points))
                top = np.argpartition(-scores, best - 1, axis=1)[:, :best]
                # Ties at the last place: every point as good as it stays.
                last = np.take_along_axis(scores, top, axis=1).min(axis=1)
                row, column = np.nonzero(scores >= last[:, None])
                group = (seekers[at + row] // every) % groups
                for g in np.unique(group).tolist():
                    mine = group == g
                    out.append(
                        {
                            "part": g,
                            "seekers": seekers[at + row[mine]].tobytes(),
                            "points": points[column[mine]].tobytes(),
                            "scores": scores[row[mine], column[mine]].tobytes(),
                        }
                    )
        schema = [("part", pa.int32()), *[(n, pa.binary()) for n in ("seekers", "points", "scores")]]
        return pa.Table.from_pylist(out, schema=pa.schema(schema))

    def merged(table: pa.Table) -> pa.Table:
        """The best points of every query over all leaves it visited."""
        seekers, points, scores = (
            np.frombuffer(b"".join(table.column(n).to_pylist()), dtype=t)
            for n, t in (("seekers", np.int64), ("points", np.int64), ("scores", np.float64))
        )
        order = np.lexsort((points, -scores, seekers))
        s, p, v = seekers[order], points[order], scores[order]
        # A point seen in several trees follows itself, up to rounding: keep it once.
        by = np.lexsort((np.arange(len(s)), p, s))
        first = np.zeros(len(s), dtype=bool)
        first[by] = np.r_[True, (s[by][1:] != s[by][:-1]) | (p[by][1:] != p[by][:-1])]
        s, p, v = s[first], p[first], v[first]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        place = np.arange(len(s)) - np.repeat(head, np.diff(np.r_[head, len(s)]))
        keep = place < held
        return pa.table({"seeker": s[keep], "point": p[keep], "score": v[keep]})

    sides = [
        classes.select("v", "point").mapInArrow(index, "leaf int, block int, points binary, v binary"),
        distinct.mapInArrow(visit, "leaf int, block int, points binary, v binary"),
    ]
    best = (
        sides[0]
        .groupBy("leaf", "block")
        .cogroup(sides[1].groupBy("leaf", "block"))
        .applyInArrow(compare, "part int, seekers binary, points binary, scores binary")
        .groupBy("part")
        .applyInArrow(merged, "seeker long, point long, score double")
    )
    # Points back to rows: at most held points of held ids for each query.
    others = best.join(classes.select("point", "ids"), "point").select(
        "seeker", "score", F.explode("ids").alias("vec_id")
    )
    ranked = others.groupBy("seeker").agg(
        F.slice(
            F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, held
        ).alias("list")
    )
    answers = queries.join(ranked, queries["point"] == ranked["seeker"])
    own = F.filter("list", lambda x: x["vec_id"] != F.col("query_id"))
    return answers.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.less")).alias("score"),
    )


def op4_ann(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
