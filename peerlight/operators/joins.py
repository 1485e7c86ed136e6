"""Equi-joins of a large fact table with per-key results, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 64


def key_counts(facts: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys with their row counts (map-side combined)."""
    return (
        facts.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("key_rows"))
    )


def attach_by_config(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with the other columns of ``right`` on (paper_id, config_id).

    The few rows of a paper are gathered and matched by config inside the paper, so the join is on
    ``paper_id`` alone and a wide ``left`` in buckets of it is read where it lies. A join on both
    columns would exchange it, as Spark asks both sides to be dealt by all keys.
    """
    added = [c for c in right.columns if c not in ("paper_id", "config_id")]
    gathered = right.groupBy("paper_id").agg(F.collect_list(F.struct("config_id", *added)).alias("_rows"))
    mine = F.filter("_rows", lambda r: r["config_id"] == F.col("config_id"))
    out = left.join(gathered, "paper_id", how).select(
        *[F.col(c) for c in left.columns], F.explode_outer(mine).alias("_row")
    )
    if how == "inner":
        out = out.filter(F.col("_row").isNotNull())
    return out.select(*left.columns, *[F.col("_row")[c].alias(c) for c in added])


def attach_by_key(
    facts: DataFrame,
    found: DataFrame,
    keys: DataFrame,
    key: str,
    spread: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """``facts`` joined with ``found`` (unique by ``key``; has ``key_rows``).

    ``keys`` is ``key_counts(facts, key)``, from which ``found`` was derived; using the same
    frame lets Spark reuse its exchange.

    A key with more than ``hot_rows`` facts is split over ``salts`` join groups: its single
    ``found`` row is copied once per salt, and facts of any key pick their salt from a hash
    of the ``spread`` columns. Whether a fact's key is hot is known from a broadcast of hot
    keys only, of which there are at most ``facts / hot_rows``. NULL keys, which never
    match, are spread as well instead of meeting in one task.
    """
    hot_keys = keys.filter(F.col("key_rows") > hot_rows).select(
        F.col(key).alias("_hot_key")
    )
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = facts.join(F.broadcast(hot_keys), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(), salt).otherwise(0)
    ).drop("_hot_key")
    copies = F.when(
        F.col("key_rows") > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))
    ).otherwise(F.array(F.lit(0)))
    right = found.withColumn("_salt", F.explode(copies)).drop("key_rows")
    return left.join(right, [key, "_salt"], how).drop("_salt")
