"""Running model cost per window over the cost log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight import schemas


def cost_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.COST_LOG).json(path)


def windowed_costs(
    entries: DataFrame, window: str = "1 day", watermark: str = "1 day"
) -> DataFrame:
    """Cost and tokens by model and window; rows later than the watermark are dropped.

    Works on batch and streaming frames. Cost is added up as a decimal so that the order of
    arrival does not show in the total.
    """
    return (
        entries.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", window).alias("w"), "model")
        .agg(
            F.sum(F.col("cost_usd").cast("decimal(28,10)")).cast("double").alias("cost_usd"),
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
            F.count(F.lit(1)).alias("n_calls"),
        )
        .select(F.col("w.start").alias("window_start"), "model", "cost_usd", "tokens", "n_calls")
    )
