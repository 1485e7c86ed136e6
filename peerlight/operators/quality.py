"""Quality of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_reference_recall(refs: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold (paper_id, doi, arxiv_id) entries whose id was extracted."""
    keys = (
        refs.select(
            "paper_id",
            F.explode(F.array_compact(F.array(F.lower("doi"), F.lower("arxiv_id")))).alias("key"),
        )
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    wanted = gold.select("paper_id", F.lower(F.coalesce("doi", "arxiv_id")).alias("key")).filter(
        F.col("key").isNotNull()
    )
    return wanted.join(keys, ["paper_id", "key"], "left").agg(
        F.count(F.lit(1)).alias("n_gold"),
        F.count("hit").alias("n_found"),
        F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"),
    )


def entailment_accuracy(verdicts: DataFrame) -> DataFrame:
    """Rows (verdict, supported) to accuracy; anything but SUPPORTED counts as not supported."""
    right = (F.col("verdict") == "SUPPORTED") == F.col("supported")
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(right).alias("n_right"),
        F.try_divide(F.count_if(right), F.count(F.lit(1))).alias("accuracy"),
    )


def catch_rate(lookups: DataFrame, gold: DataFrame) -> DataFrame:
    """Fabricated references caught and real ones wrongly missed (gold: paper_id, ref_id, fake)."""
    judged = gold.join(lookups.select("paper_id", "ref_id", "status"), ["paper_id", "ref_id"], "left")
    missed = F.coalesce(F.col("status") == "NOT_FOUND", F.lit(True))
    return judged.agg(
        F.count_if("fake").alias("n_fake"),
        F.count_if(F.col("fake") & missed).alias("n_caught"),
        F.count_if(~F.col("fake")).alias("n_real"),
        F.count_if(~F.col("fake") & missed).alias("n_false_alarms"),
    )
