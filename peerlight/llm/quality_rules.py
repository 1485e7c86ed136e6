"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlight.llm.common import bounded_batches, documents, free_name, settle
from peerlight.llm.text_stats import COUNTS, text_counts

#: Relative error of the sketch: bucket i holds values up to GAMMA ** i.
GAMMA = 1.02
#: Values below this share the lowest bucket.
TINY = 1e-4
#: Weight of a group's language, in rows, beside its own quantiles; and that of all rows beside
#: a language's. A group of so many rows counts half.
PRIOR_ROWS = 200
#: Limits lie this many widths of the group's own tail (90th percentile less median) beyond the
#: 90th percentile, lower limits as many (median less 10th) below the 10th.
WIDTHS = 4.0
#: Counts that no share is held against: that many symbols, duplicate lines or repeated windows
#: (of ten words, both times) are a handful in a text of any length.
FREE = 3
_RULES = {
    # measure: (count, what it is a share of, words or characters of one count, limit below too)
    "mean_word": ("word_chars", "n_words", 0, True),
    "symbol_share": ("n_symbols", "word_chars", 1, False),
    "dup_line_share": ("n_dup_lines", "n_words", 1, False),
    "repeat_share": ("n_repeat_words", "n_words", 10, False),
}
_TEXTS = 256


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``text_stats.COUNTS`` over whole texts (null: empty)."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [pd.DataFrame({c: pd.Series(dtype="int64") for c in COUNTS})]
            for at in range(0, len(texts), _TEXTS):
                counts = text_counts(texts.iloc[at : at + _TEXTS].tolist())
                parts.append(pd.DataFrame({c: counts[c] for c in COUNTS}))
            yield pd.concat(parts, ignore_index=True)

    docs = docs.drop(*COUNTS)
    bounded_batches(docs.sparkSession)
    kept, found = docs.columns, free_name(docs, "counts")
    return docs.withColumn(found, run("text")).select(*kept, F.col(found + ".*"))


def measures(free: int = 0) -> dict[str, Column]:
    """The measures of a row, without ``free`` counts of each."""
    return {
        name: (F.col(count) - free * unit) / F.greatest(F.col(whole), F.lit(1))
        for name, (count, whole, unit, _) in _RULES.items()
    }


def base_failed() -> Column:
    """Fixed rules that hold for every group: too few words, or too many repeated ones."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketch of every measure per group: keys, measure, bucket, n.

    Counts in logarithmic buckets: sketches merge by adding counts, whatever the order, and a
    quantile is right to ``GAMMA`` in its value.
    """
    values = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures().items()]
        )
    ).alias("m")
    bucket = F.floor(F.log(F.greatest(F.col("m.value"), F.lit(TINY))) / F.log(F.lit(GAMMA)))
    return (
        rows.select(*keys, values)
        .groupBy(*keys, F.col("m.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and the 10th, 50th and 90th percentile per group and measure: low, mid, high.

    A percentile is the middle of the first bucket at which so many rows are reached, zero for
    the lowest bucket.
    """
    by = [*keys, "measure"]
    upto = Window.partitionBy(*by).orderBy("bucket")  # at most a few hundred buckets a group
    whole = Window.partitionBy(*by)
    ranked = sketches.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "rows", F.sum("n").over(whole)
    )

    def quantile(q: float) -> Column:
        reached = F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bucket")))
        value = F.pow(F.lit(GAMMA), reached + 0.5)
        return F.when(value <= TINY * GAMMA, 0.0).otherwise(value)

    return ranked.groupBy(*by, "rows").agg(
        quantile(0.1).alias("low"), quantile(0.5).alias("mid"), quantile(0.9).alias("high")
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per (lang, source) with the limits of every measure.

    Sketches are taken over all rows that pass the fixed rules. A group's quantiles are blended
    with those of its language, and these with those of all rows, by ``PRIOR_ROWS``. An upper
    limit is the 90th percentile and ``WIDTHS`` widths of the tail, and the sketch's error: if no
    row in ten has symbols, symbols beyond a handful are out of place, however many the rest has.
    """
    fine = settle(sketch(rows.where(~base_failed()), ["lang", "source"]))
    mid = merge(fine, ["lang"])
    values = ["low", "mid", "high"]
    by_lang = quantiles(mid, ["lang"]).select(
        F.col("lang").alias("l"), F.col("measure").alias("lm"), F.struct("rows", *values).alias("by_lang")
    )
    by_all = quantiles(merge(mid, []), []).select(
        F.col("measure").alias("am"), F.struct(*values).alias("by_all")
    )
    own = quantiles(fine, ["lang", "source"])
    joined = own.join(
        by_lang, own["lang"].eqNullSafe(F.col("l")) & (own["measure"] == F.col("lm"))
    ).join(F.broadcast(by_all), F.col("measure") == F.col("am"))  # one row per measure

    def blended(name: str) -> Column:
        of_lang = F.col("by_lang.rows") / (F.col("by_lang.rows") + PRIOR_ROWS)
        lang = of_lang * F.col(f"by_lang.{name}") + (1 - of_lang) * F.col(f"by_all.{name}")
        share = F.col("rows") / (F.col("rows") + PRIOR_ROWS)
        return (share * F.col(name) + (1 - share) * lang).alias(name)

    found = joined.select("lang", "source", "measure", *[blended(n) for n in values])
    below = F.col("measure").isin([m for m, rule in _RULES.items() if rule[3]])
    lower = (F.col("low") - WIDTHS * (F.col("mid") - F.col("low"))) / GAMMA
    upper = (F.col("high") + WIDTHS * (F.col("high") - F.col("mid"))) * GAMMA
    sides = found.select(
        "lang", "source", "measure", upper.alias("upper"),
        F.when(below, lower).otherwise(F.lit(float("-inf"))).alias("lower"),
    )
    return sides.groupBy("lang", "source").agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
            for m in _RULES
            for side in ("lower", "upper")
        ]
    )


def apply_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with counts, ``base_failed`` and ``kept``.

    A row is kept if it passes the fixed rules and every measure, less a handful of counts, lies
    within the limits of its (lang, source). Null languages and sources are groups of their own;
    null texts count as empty and fail; repeated rows count one by one; an empty table gives
    none. Input columns named like the results are replaced; others but ``text`` pass through,
    whatever their names.
    """
    rows = settle(
        base_counts(docs.drop("base_failed", "kept")).drop("text")
        .withColumn("base_failed", base_failed())
    )
    found = thresholds(rows.select("lang", "source", *COUNTS))
    lang, source, limits = (free_name(rows, n) for n in ("group_lang", "group_source", "limits"))
    sides = [c for c in found.columns if c not in ("lang", "source")]
    found = found.select(
        F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*sides).alias(limits)
    )
    # One row per language and source; the adaptive join broadcasts or splits by size.
    joined = rows.join(
        found, rows["lang"].eqNullSafe(found[lang]) & rows["source"].eqNullSafe(found[source]), "left"
    )
    inside = F.lit(True)
    for name, value in measures(FREE).items():
        inside = inside & value.between(F.col(f"{limits}.{name}_lower"), F.col(f"{limits}.{name}_upper"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select(*rows.columns, kept.alias("kept"))


def op7_quality_rules(spark, sf_dir):
    rows = apply_rules(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept")
