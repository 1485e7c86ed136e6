"""Importance resampling towards a target distribution of hashed word n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.llm.common import bounded_batches, documents, settle, shuffle_partitions
from peerlight.llm.word_arrays import Slices, pieces, word_runs

#: Buckets that features are hashed to, and the lengths of the word runs that are features.
BUCKETS, LEAST, MOST = 10_000, 1, 1
#: Documents of fewer words are never drawn; so many percent of the others are.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024


def intern(slices: Slices, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every slice in an open-addressed table, and the slice that each slot holds (or -1).

    Slices of equal bytes share a slot, others never do: a slice stays where the slot's key
    (XXH64) and bytes are its own and else goes on to the next slot. All slices probe at once;
    of those that meet an empty slot in one round, one takes it.
    """
    keys = slices.hashes() if keys is None else keys
    size = 1 << max(1, int(2 * len(keys)).bit_length())
    holder = np.full(size, -1, dtype=np.int64)
    slot = (keys & np.uint64(size - 1)).astype(np.int64)
    open_ = np.arange(len(keys))
    while open_.size:
        at = slot[open_]
        free = holder[at] < 0
        holder[at[free]] = open_[free]
        held = holder[at]
        mine = keys[held] == keys[open_]
        mine[mine] = slices.equal(held[mine], open_[mine])
        open_ = open_[~mine]
        slot[open_] = (slot[open_] + 1) & (size - 1)
    return slot, holder


def bucket_table(slices: Slices, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every slice; bucket and count of every slot. The crc32 is taken once a slot."""
    slot, holder = intern(slices)
    count = np.bincount(slot, minlength=len(holder))
    bucket = np.zeros(len(holder), dtype=np.int64)
    for at in np.flatnonzero(holder >= 0).tolist():
        bucket[at] = zlib.crc32(slices.bytes_of(holder[at])) % buckets
    return slot, bucket, count


def bucket_counts(texts: DataFrame, buckets: int, least: int, most: int) -> DataFrame:
    """side, bucket, n over whole texts; ``texts`` has side (int) and text."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sides = batch.column("side").to_numpy()
            for side in np.unique(sides).tolist():
                mine = batch.column("text").filter(pa.array(sides == side)).to_pylist()
                total = sums.setdefault(side, np.zeros(buckets, dtype=np.int64))
                for _, part in pieces(mine):
                    slices, _ = word_runs(part, least, most)
                    _, bucket, count = bucket_table(slices, buckets)
                    np.add.at(total, bucket[count > 0], count[count > 0])
        for side, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), side, np.int32)), pa.array(used), pa.array(total[used])],
                names=["side", "bucket", "n"],
            )

    rows = texts.select("side", "text").mapInArrow(run, "side int, bucket long, n long")
    return rows.groupBy("side", "bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed distributions, rounded down, per bucket."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t)))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def learn(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least: int = LEAST, most: int = MOST
) -> np.ndarray:
    """Gain of every bucket, counted over all texts of both tables (null: no words)."""
    sides = [df.select(F.lit(k).alias("side"), "text") for k, df in enumerate((docs, target))]
    counts = np.zeros((2, buckets), dtype=np.int64)
    # At most 2 x ``buckets`` rows, however large the tables are.
    for r in bucket_counts(sides[0].union(sides[1]), buckets, least, most).toLocalIterator():
        counts[r.side, r.bucket] = r.n
    return gains(counts[0], counts[1])


def weights(text: Column, gain: np.ndarray, least: int = LEAST, most: int = MOST) -> Column:
    """Struct of a text's n_words, n_features and weight, the sum of its features' gains."""
    buckets = len(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = np.zeros((len(texts), 3), dtype=np.int64)
            for first, part in pieces(texts.tolist()):
                slices, words = word_runs(part, least, most)
                slot, bucket, _ = bucket_table(slices, buckets)
                rows = out[first : first + len(part)]
                rows[:, 0] = words
                rows[:, 1] = np.bincount(slices.text, minlength=len(part))
                np.add.at(rows[:, 2], slices.text, gain[bucket[slot]])
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return run(text)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, rounded down, hashed from seed and id (null: empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.substring(F.sha2(name.cast("binary"), 256), 1, 8)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(unit)))


def ranked(rows: DataFrame, drawn: Column, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``: their place from 1 among the ``drawn`` rows in ``order``, else null.

    Drawn rows are sorted over ranges; a row's place is its place in its range and the sizes of
    the ranges before. Equal rows are told apart by where they stand, so they spread too.
    """
    parts = shuffle_partitions(rows.sparkSession)
    tie = F.monotonically_increasing_id()
    wanted = rows.where(drawn).withColumn("tie_", tie)
    in_order = settle(
        wanted.repartitionByRange(parts, *order, "tie_")
        .sortWithinPartitions(*order, "tie_")
        .withColumn("at_", F.monotonically_increasing_id())
    )
    span = 1 << 33  # monotonic ids: the partition above, the row in it below this bit
    part = F.shiftright("at_", 33)
    sizes = {r[0]: r[1] for r in in_order.groupBy(part.alias("part")).count().collect()}  # one row a partition
    before, starts = 0, []
    for k in sorted(sizes):
        starts += [F.lit(k).cast("long"), F.lit(before).cast("long")]
        before += sizes[k]
    start = F.create_map(*starts)[part] if starts else F.lit(None).cast("long")
    place = start + F.col("at_") % span + 1
    return in_order.select(*rows.columns, place.alias("place")).unionByName(
        rows.where(~drawn).withColumn("place", F.lit(None).cast("long"))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    least: int = LEAST,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``.

    A feature is a run of ``least`` to ``most`` words; its gain is the log ratio of its bucket in
    ``target`` and in ``docs``. The rows with the highest weight plus Gumbel number are a draw
    without replacement with chances that go with the exponential of the weight: ``rank`` counts
    them from 1 (ties to the smaller id), null for rows not drawn.

    Null and empty texts have no words and weight 0; a null id hashes as the empty text and
    ranks before others of its score; repeated rows count and rank one by one; without documents
    there are no rows, without target texts all gains come from smoothing. Other columns of
    ``docs``, whatever their names, are left out.
    """
    bounded_batches(docs.sparkSession)
    gain = learn(docs, target, buckets, least, most)
    found = weights(F.col("text"), gain, least, most).alias("w")
    rows = settle(
        docs.select("doc_id", found)
        .select("doc_id", "w.*")
        .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    )
    able = F.col("n_words") >= least_words
    draws = rows.where(able).count() * percent // 100
    if not draws:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    placed = ranked(rows, able, [F.desc("score"), F.asc_nulls_first("doc_id")])
    return placed.select(*rows.columns, F.when(F.col("place") <= draws, F.col("place")).alias("rank"))


def op11_resampling(spark, sf_dir):
    rows = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT side, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
held AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
spelled AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM held)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
      range(length(digits) // 2), lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::UBIGINT)),
    lambda c, b: xor(t[(xor(c, b) % 256 + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket
  FROM spelled, crc_table),
counts AS (
  SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END)::DOUBLE AS s,
         sum(CASE WHEN side = 1 THEN n ELSE 0 END)::DOUBLE AS t
  FROM held JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM counts, totals),
weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM held JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT
           + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
