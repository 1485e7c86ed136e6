"""Row-shape helpers that keep costly expressions from being evaluated twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, items: Column | str, item: str, pos: str | None = None) -> DataFrame:
    """One row per array element, beside the ``keep`` columns.

    A plain ``explode`` makes Catalyst infer a non-empty filter, push it below the
    projections and compute the array there once more; the outer form with a filter on its
    output does not.
    """
    gen = F.posexplode_outer(items).alias(pos, item) if pos else F.explode_outer(items).alias(item)
    return df.select(*keep, gen).filter(F.col(item).isNotNull())


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a one-element explode.

    Filters and inferred null checks stop here instead of sinking through the projections
    below, where every computed column they mention would be computed again.
    """
    return df.select(F.explode_outer(F.array(F.struct("*"))).alias("_r")).select("_r.*")
