"""Fairness audit over score tables: disparate impact and length correlation.

Everything is an aggregate with partial (map-side) combination; nothing is sorted or
windowed over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions.numbers import round_exact


def group_rates(df: DataFrame, group: Column, score: Column, threshold: float) -> DataFrame:
    """(label, n, positive, positive_rate) per group; rows without a label are left out."""
    return (
        df.select(group.cast("string").alias("label"), (score >= threshold).alias("hit"))
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("positive"))
        .withColumn("positive_rate", F.col("positive") / F.col("n"))
    )


def disparate_impact(
    df: DataFrame, group: Column, score: Column, threshold: float, list_rates: bool = False
) -> DataFrame:
    """One row: reference group (highest rate, first label on ties), ratio, 4/5 flag, notes.

    ``group`` and ``score`` are column expressions. ``group_rates`` gives the rates as rows;
    with ``list_rates`` the row also lists them in label order, for groups known to be few.
    """
    return impact_of(group_rates(df, group, score, threshold), list_rates)


def impact_of(rates: DataFrame, list_rates: bool = False) -> DataFrame:
    row = F.struct("label", "n", "positive", "positive_rate")
    listed = [F.array_sort(F.collect_list(row)).alias("group_rates")] if list_rates else []
    summary = rates.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min_by("label", F.struct((-F.col("positive_rate")).alias("r"), F.col("label"))).alias(
            "reference_group"
        ),
        F.max("positive_rate").alias("hi"),
        F.min("positive_rate").alias("lo"),
        *listed,
    )
    ratio = F.when(F.col("hi") > 0, F.try_divide("lo", "hi")).otherwise(F.lit(1.0))
    several = F.col("n_groups") >= 2
    return summary.select(
        *(["group_rates"] if list_rates else []),
        "n_groups",
        "reference_group",
        F.when(several, round_exact(ratio)).alias("di_ratio"),
        F.coalesce(several & (ratio < P.FOUR_FIFTHS), F.lit(False)).alias("flagged_4_5ths_rule"),
        F.when(F.col("n_groups") == 0, F.lit("No records with group labels."))
        .when(~several, F.lit("Only one group; DI ratio undefined."))
        .otherwise(F.lit(""))
        .alias("notes"),
    )


def _centered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rubric_adjusted_total").isNotNull()).select(
        F.col("word_count").cast("double").alias("x"),
        F.col("rubric_adjusted_total").alias("y"),
    )


def length_score_corr(records: DataFrame) -> DataFrame:
    """Pearson correlation of word count and adjusted total, with its note.

    NULL below three records, 0 when one side is constant.
    """
    stats = _centered(records).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop("x").alias("vx"),
        F.var_pop("y").alias("vy"),
        F.covar_pop("x", "y").alias("cov"),
        (F.min("x") == F.max("x")).alias("flat_x"),
        (F.min("y") == F.max("y")).alias("flat_y"),
    )
    enough = F.col("n") >= 3
    pearson = F.when(F.col("flat_x") | F.col("flat_y"), F.lit(0.0)).otherwise(
        F.try_divide(F.col("cov"), F.sqrt("vx") * F.sqrt("vy"))
    )
    return stats.select(
        F.when(enough, round_exact(pearson)).alias("length_score_pearson"),
        F.when(enough, F.format_string("Pearson over %d records.", F.col("n")))
        .otherwise(F.lit("Too few records with rubric scores for correlation."))
        .alias("length_score_rationale"),
    )


def upper_median(records: DataFrame, column: str = "word_count") -> DataFrame:
    """``sorted(values)[n // 2]`` as one row.

    The discrete percentile keeps counts per distinct value (word counts repeat), combined
    map-side; in descending order it is the upper median for odd and even n.
    """
    return records.agg(
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)").alias("median")
    )


def length_groups(records: DataFrame) -> DataFrame:
    """Adds ``length_group``: long above the upper median word count, else short."""
    return records.withColumn(
        "length_group",
        F.when(
            F.col("word_count") > upper_median(records).scalar(), F.lit("long")
        ).otherwise(F.lit("short")),
    )


def fairness_report(records: DataFrame, threshold: float = P.ACCEPT_THRESHOLD) -> DataFrame:
    """One row over the log's flat columns (word_count, rubric_adjusted_total)."""
    score = F.coalesce("rubric_adjusted_total", F.lit(0.0))
    # Two groups: long and short.
    impact = disparate_impact(
        length_groups(records), F.col("length_group"), score, threshold, list_rates=True
    )
    row = F.struct("group_rates", "reference_group", "di_ratio", "flagged_4_5ths_rule", "notes")
    corr = length_score_corr(records).select(F.struct("*").alias("c"))
    # One-row aggregates meet as scalar subqueries.
    return records.agg(F.count(F.lit(1)).alias("n_records")).select(
        "n_records",
        corr.scalar().alias("c"),
        impact.select(row.alias("d")).scalar().alias("length_disparate_impact"),
    ).select(
        "n_records",
        "c.length_score_pearson",
        "c.length_score_rationale",
        F.lit("Position bias requires session ordering (v0.2 editor-triage).").alias(
            "position_bias"
        ),
        "length_disparate_impact",
        F.lit(float(threshold)).alias("accept_threshold"),
    )
