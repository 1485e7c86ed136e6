"""Cost log: JSON-lines source and sink, price lookup and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight import schemas
from peerlight.sources.configs import model_prices


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COST_LOG).option("mode", "FAILFAST").json(path)


def append_costs(entries: DataFrame, path: str) -> None:
    """Append usage entries; the timestamp is UTC and filled in when absent."""
    stamped = (
        entries
        if "timestamp" in entries.columns
        else entries.withColumn("timestamp", F.current_timestamp())
    )
    stamped.select(
        "timestamp", "provider", "model", "prompt_tokens", "completion_tokens", "cost_usd", "kind"
    ).write.mode("append").json(path)


def estimate_cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds ``cost_usd`` from token counts; models without a price cost 0."""
    table = prices if prices is not None else model_prices(usage.sparkSession)
    cost = F.col("prompt_tokens") * F.col("input_per_mtok") / F.lit(1000000.0) + F.col(
        "completion_tokens"
    ) * F.col("output_per_mtok") / F.lit(1000000.0)
    return (
        usage.join(table, "model", "left")
        .withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
        .drop("input_per_mtok", "output_per_mtok")
    )


def cost_totals(costs: DataFrame) -> DataFrame:
    """Cost by model and, in the row without a model, over all. Added up as decimals, so
    totals do not depend on the order of rows."""
    return costs.rollup("model").agg(
        F.sum(F.col("cost_usd").cast("decimal(28,10)")).cast("double").alias("cost_usd"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.count(F.lit(1)).alias("n_calls"),
        F.grouping_id().alias("is_total"),
    )
