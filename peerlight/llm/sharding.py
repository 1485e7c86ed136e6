"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlight.llm.common import documents, settle, shuffle_partitions

ROUNDS = 8
#: Copies of one row are numbered in blocks of this many.
BLOCK = 65_536


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def _mixed(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    """Round function; all products stay below 2**63, so SQL integers can follow it."""
    t = (half * 1_103_515_245 + key) % 2_147_483_647
    t ^= t >> 15
    return ((t * 69_069 + 12_345) % 2_147_483_647) & mask


def _keys(seed: int) -> list[int]:
    return [(seed * 7_919 + 104_729 * (i + 1)) % 2_147_483_647 for i in range(ROUNDS)]


def _pass(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    left_bits, right_bits = _halves(n)
    left, right = x >> right_bits, x & ((1 << right_bits) - 1)
    rounds = list(enumerate(_keys(seed)))
    for i, key in reversed(rounds) if back else rounds:
        if i % 2 == 0:
            left = left ^ _mixed(right, key, (1 << left_bits) - 1)
        else:
            right = right ^ _mixed(left, key, (1 << right_bits) - 1)
    return (left << right_bits) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Place of each row number in 0..n-1 under the keyed permutation (``back``: the inverse).

    The Feistel network permutes the smallest power of two that holds n (4 at least); numbers
    that fall outside 0..n-1 are passed through it again until they fall inside.
    """
    if n > 2**62:
        raise ValueError("at most 2**62 rows")
    x = _pass(np.asarray(rows, dtype=np.int64), n, seed, back)
    while (out := np.flatnonzero(x >= n)).size:
        x[out] = _pass(x[out], n, seed, back)
    return x


def shard_and_slot(row: int, n: int, n_shards: int, seed: int) -> tuple[int, int]:
    """Where row number ``row`` of ``n`` goes."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % n_shards, place // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int) -> int:
    """Which row number is in a slot of a shard."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, back=True)[0])


def number_rows(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Number all rows from 0 in the order of all their columns (nulls first); and their count.

    Equal rows are first counted, so a row that fills a third of the table is one row in the
    range shuffle. Each range keeps a running sum; the ranges' totals are one small table.
    """
    spark, columns = rows.sparkSession, rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    # The ranges are cut from a sample, which a rerun may draw anew: store them first.
    ranged = settle(
        counted.repartitionByRange(shuffle_partitions(spark), *columns).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    )  # one row per shuffle partition
    n = offsets.agg(F.coalesce(F.sum("_total"), F.lit(0))).first()[0]
    within = (
        Window.partitionBy("_range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    numbered = (
        ranged.join(F.broadcast(offsets.select("_range", "_offset")), "_range")
        .withColumn("_first", first)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {BLOCK}"))))
        .withColumn("_from", F.col("_block") * BLOCK)
        .withColumn("_to", F.least(F.col("_n"), F.col("_from") + BLOCK) - 1)
        .withColumn("_step", F.explode(F.sequence("_from", "_to")))
        .withColumn(name, F.col("_first") + F.col("_step"))
    )
    return numbered.select(*columns, name), int(n)


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, row_number, shard, slot.

    Rows are numbered in the order of id, size and checksum; the place of a number under the
    permutation gives shard (place mod shards) and slot (place div shards), so shards differ
    by one row at most and slots have no gaps. Null ids come first, null texts have size 8
    and checksum 0, repeated rows get places of their own, an empty table gives no rows.
    Further columns do not enter.
    """
    if n_shards < 1:
        raise ValueError("one shard at least")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(narrow, "row_number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = permute(batch.column("row_number").to_numpy(), n, seed)
            shard = pa.array((places % n_shards).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, shard, pa.array(places // n_shards)],
                names=[*batch.schema.names, "shard", "slot"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, size long, text_crc32 long, row_number long, shard int, slot long"
    return numbered.mapInArrow(place, schema)


def op2_sharding(spark, sf_dir):
    placed = shards(documents(spark, sf_dir))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

