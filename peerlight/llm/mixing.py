"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.llm.common import documents, free_name, settle

#: Rate above which a Poisson draw is the sum of several, so that exp(-rate) stays above zero.
PIECE = 256.0
#: Tables of rates with more sources than this are joined by shuffle, not broadcast.
BROADCAST_SOURCES = 10_000


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
) -> DataFrame:
    """Target repetition rate per source: columns source, n_docs, rate.

    The mixed corpus has ``epochs`` times as many documents as ``docs`` on average. The share
    of a source is its weight over the sum of weights; without ``weights`` it goes with
    ``n_docs ** temperature``. A source that ``weights`` does not name has weight zero. Rows
    without a source form a source of their own (name them with the key ``""``).
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights are zero or more")
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        named = F.create_map(*pairs)[F.coalesce("source", F.lit(""))] if pairs else F.lit(0.0)
        weight = F.coalesce(named, F.lit(0.0))
    counts = settle(counts.withColumn("weight", weight.cast("double")))
    total = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("weight").alias("all_weight"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .select(
            "source",
            "n_docs",
            F.when(
                F.col("all_weight") > 0,
                F.col("weight") / F.col("all_weight") * epochs * F.col("all_docs") / F.col("n_docs"),
            )
            .otherwise(0.0)
            .alias("rate"),
        )
    )


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts: 52 bits, the same in any SQL engine."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def poisson_cdf(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... as far as doubles can tell from one."""
    last = (rate + 12.0 * F.sqrt(rate) + 30.0).cast("int")
    start = F.struct(
        F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all")
    )

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(
            p.alias("p"),
            (acc["c"] + p).alias("c"),
            F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """Repeat every document a Poisson number of times and shuffle all copies globally.

    The draw inverts the Poisson distribution with the rate of the document's source at a
    number hashed from seed, id and text, so a rerun gives the same corpus and rows can be
    drawn anywhere. Adds ``copy`` (from 1) and ``shuffle_key``; equal keys do not occur for
    different ids. Rows come in random partitions, each sorted by the key.

    Null ids and texts hash as a marker of their own; rows that repeat id and text repeat the
    draw; an empty table gives an empty one; other columns pass through. Input columns named
    ``copy`` or ``shuffle_key`` are replaced; others pass through, whatever their names.
    """
    docs = docs.drop("copy", "shuffle_key")
    kept = docs.columns
    text, times, source, parts, cdf = (free_name(docs, n) for n in ("text_md5", "times", "own_source", "parts", "cdf"))
    rates = source_rates(docs, weights, temperature, epochs).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    )
    rates = settle(
        rates.select(
            F.col("source").alias(source),
            F.col("parts").alias(parts),
            poisson_cdf(F.col("rate") / F.col("parts")).alias(cdf),
        )
    )
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # The text enters by its own digest, so that one long text is hashed once, not per piece.
    docs = docs.withColumn(text, F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")))
    joined = docs.join(rates, docs["source"].eqNullSafe(rates[source]))

    numbers = F.transform(
        F.sequence(F.lit(1), F.col(parts)),
        lambda piece: unit(F.lit(str(seed)), name, F.col(text), piece.cast("string")),
    )
    draws = F.transform(numbers, lambda u: F.size(F.filter(cdf, lambda c: c < u)))
    count = F.aggregate(draws, F.lit(0), lambda acc, k: acc + k)
    copies = (
        joined.withColumn(times, count)
        .where(F.col(times) > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))
        .withColumn(
            "shuffle_key",
            F.md5(
                F.concat_ws(
                    "|", F.lit(f"{seed} order"), name, F.col(text), F.col("copy").cast("string")
                ).cast("binary")
            ),
        )
        .select(*kept, "copy", "shuffle_key")
    )
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op1_mixing(spark, sf_dir):
    """All documents mixed to temperature weights: the copies with their texts, shuffled."""
    return mix(documents(spark, sf_dir))


OP1_SQL = """
WITH c AS (SELECT source, count(*) AS n_docs, pow(count(*)::DOUBLE, 0.7) AS weight
           FROM documents GROUP BY source),
t AS (SELECT sum(n_docs) AS all_docs, sum(weight) AS all_weight FROM c),
r AS (SELECT source, weight / all_weight * 1.0 * all_docs / n_docs AS rate,
             greatest(1, ceil(weight / all_weight * 1.0 * all_docs / n_docs / 256.0)) AS parts
      FROM c, t),
k AS (SELECT source, parts, rate / parts AS piece,
             unnest(range(0, CAST(floor(rate / parts + 12 * sqrt(rate / parts) + 30) AS BIGINT) + 1)) AS k
      FROM r),
cdf AS (SELECT source, parts, k, sum(exp(-piece + k * ln(piece) - lgamma(k + 1)))
               OVER (PARTITION BY source ORDER BY k) AS c FROM k),
d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name, coalesce(md5(text), 'null') AS t
      FROM documents),
p AS (SELECT d.*, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS piece
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT *, (CAST('0x' || substr(md5('17|' || name || '|' || t || '|' || piece), 1, 13) AS BIGINT) + 0.5)
             / 4503599627370496.0 AS u FROM p),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.name, u.t, count(*) AS times
      FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c < u.u
      GROUP BY ALL),
x AS (SELECT *, unnest(range(1, times + 1)) AS i FROM n)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS copy,
       md5('17 order|' || name || '|' || t || '|' || i) AS shuffle_key FROM x
"""
