"""Numeric expressions: exact rounding, clamps, score tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions.text import let


def round_exact(c: Column, digits: int = 4) -> Column:
    """Round the exact binary value, ties to even.

    ``F.round`` works on the shortest decimal text of a double, which moves values that
    only look like ties. Here the rounding error of ``x * 10**digits`` is recovered with
    an error-free product, so the true value decides; ties go to the even neighbour.
    """
    scale = float(10**digits)

    def body(x: Column) -> Column:
        p = x * F.lit(scale)
        big = x * F.lit(134217729.0)
        hi = big - (big - x)
        err = (hi * F.lit(scale) - p) + (x - hi) * F.lit(scale)
        low = F.floor(p).cast("double")
        half = (p - low) - F.lit(0.5)
        even = F.pmod(low, F.lit(2.0)) == 0.0
        up = (half > 0) | ((half == 0) & ((err > 0) | ((err == 0) & ~even)))
        return F.when(up, low + 1.0).otherwise(low) / F.lit(scale)

    return let(c.cast("double"), body)


def fixed(c: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals; NULL stays NULL."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", round_exact(c, digits)))


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    lo = F.lit(low) if isinstance(low, float) else low
    hi = F.lit(high) if isinstance(high, float) else high
    return F.greatest(lo, F.least(hi, c))


def year_closeness(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0))
        .when(a.isNull() | b.isNull(), F.lit(0.0))
        .when(gap == 0, F.lit(1.0))
        .when(gap == 1, F.lit(0.8))
        .when(gap <= 3, F.lit(0.4))
        .otherwise(F.lit(0.0))
    )


def recommendation(score: Column) -> Column:
    """Recommendation band of a (rounded) composite."""
    out = None
    for bound, name in P.RECOMMENDATION_BANDS:
        hit = score >= F.lit(bound)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(P.LOWEST_BAND))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
