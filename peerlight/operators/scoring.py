"""Stage subscores and the weighted composite."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions.numbers import recommendation, round_exact
from peerlight.functions.rows import each
from peerlight.session import stage


def compliance_subscore(n_passed: Column, n_checks: Column) -> Column:
    return F.when(n_checks == 0, F.lit(1.0)).otherwise(F.try_divide(n_passed, n_checks))


def verification_subscore(hallucinations: Column, total: Column) -> Column:
    return F.when(
        total > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(hallucinations, total))
    )


def depth_subscore() -> Column:
    return (
        F.col("methodology")
        + F.col("limitations")
        + F.col("reproducibility")
        + F.col("logical_soundness")
    ) / F.lit(4.0)


def add_subscores(rows: DataFrame) -> DataFrame:
    """The four stage subscores beside the stage columns."""
    return rows.select(
        "*",
        compliance_subscore(F.col("n_passed"), F.col("n_checks")).alias("compliance"),
        verification_subscore(F.col("hallucination_count"), F.col("total_claims")).alias(
            "verification"
        ),
        depth_subscore().alias("depth"),
        F.col("bias_adjusted_total").alias("rubric"),
    )


def subscores(evaluated: DataFrame) -> DataFrame:
    """(paper_id, config_id, compliance, verification, depth, rubric) from stage columns."""
    return add_subscores(evaluated).select("paper_id", "config_id", *P.SCORING_KEYS)


def weights_struct(weights: dict[str, float]) -> Column:
    return F.struct(*[F.lit(float(weights[k])).alias(k) for k in P.SCORING_KEYS])


def subscore_array(weights: Column, values: dict[str, Column] | None = None) -> Column:
    """Per stage name, value, weight and contribution; absent stages give up their weight."""
    vals = values or {k: F.col(k) for k in P.SCORING_KEYS}
    present = None
    for key in P.SCORING_KEYS:
        w = F.when(vals[key].isNotNull(), weights[key]).otherwise(F.lit(0.0))
        present = w if present is None else present + w
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("name"),
                vals[k].alias("value"),
                weights[k].alias("weight"),
                F.coalesce(
                    F.when(
                        present > 0, vals[k] * F.try_divide(weights[k], present)
                    ),
                    F.lit(0.0),
                ).alias("contribution"),
            )
            for k in P.SCORING_KEYS
        ]
    )


def composite_of(subs: Column) -> Column:
    return round_exact(F.aggregate(subs, F.lit(0.0), lambda acc, s: acc + s["contribution"]))


def add_composite(rows: DataFrame, weights: Column | None = None) -> DataFrame:
    """Composite, recommendation, subscores and breakdown map on rows with the four stages."""
    w = weights if weights is not None else weights_struct(P.DEFAULT_WEIGHTS)
    keep = [c for c in rows.columns if c not in P.SCORING_KEYS]
    raw = rows.select(*keep, subscore_array(w).alias("raw_subs"))
    total = raw.select("*", composite_of(F.col("raw_subs")).alias("composite"))
    rounded = F.transform(
        "raw_subs",
        lambda s: F.struct(
            s["name"].alias("name"),
            round_exact(s["value"]).alias("value"),
            s["weight"].alias("weight"),
            round_exact(s["contribution"]).alias("contribution"),
        ),
    )
    return total.select(
        *keep,
        "composite",
        recommendation(F.col("composite")).alias("recommendation"),
        rounded.alias("subscores"),
    ).select(
        "*",
        F.map_from_entries(
            F.transform("subscores", lambda s: F.struct(s["name"], s["value"]))
        ).alias("breakdown"),
    )


def composite(scores: DataFrame, weights: Column | None = None) -> DataFrame:
    """Composites of subscore rows (paper_id, config_id, four stages)."""
    return add_composite(scores.select("paper_id", "config_id", *P.SCORING_KEYS), weights)


def subscores_long(composites: DataFrame) -> DataFrame:
    ids = ["paper_id", "config_id"]
    return each(composites, ids, "subscores", "s", "stage_pos").select(*ids, "stage_pos", "s.*")


def banner(triage: Column, issues: Column) -> Column:
    """Advice text for anything but PASS."""
    listed = F.when(F.size(issues) == 0, F.lit("see compliance section")).otherwise(
        F.array_join(issues, "; ")
    )
    return F.when(
        triage != "PASS",
        F.concat(
            F.lit("⚠️  Compliance "), triage, F.lit(": "), listed,
            F.lit(
                ". The composite score below does not force a recommendation — review these "
                "issues manually before accepting or rejecting."
            ),
        ),
    )


def triage_queue(composites: DataFrame) -> DataFrame:
    """Reviewer queue per config with rank: FAIL papers first, then by composite.

    A ranking window over a config would pull the whole corpus into one task. Composites
    carry four decimals, so a config has at most 2 x 10001 distinct queue places: their
    counts are aggregated map-side, the running count over that small table gives the
    exact rank, which joins back by place; the adaptive plan picks the join by its size.

    Counting and joining read the places twice. They are stored first, without texts or records,
    so that the review below is evaluated once, whether or not it was staged itself.
    """
    needed = ["config_id", "paper_id", "triage", "composite", "recommendation"]
    places = stage(composites.select(*needed), "places", f"queue-{uuid.uuid4().hex}")
    placed = places.withColumn("urgency", F.when(F.col("triage") == "FAIL", 0).otherwise(1))
    keys = ["config_id", "urgency", "composite"]
    ahead = (
        Window.partitionBy("config_id")
        .orderBy("urgency", F.col("composite").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = (
        placed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, (F.coalesce(F.sum("n").over(ahead), F.lit(0)) + 1).alias("queue_rank"))
    )
    return placed.join(ranks, keys).select(
        "config_id", "queue_rank", "paper_id", "triage", "composite", "recommendation"
    )
