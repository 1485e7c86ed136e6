"""What-if arithmetic on saved subscores: reweighting, sweeps, tipping points, explanations.

Weight sets are constants of the plan, so nothing here shuffles or joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions.numbers import fixed, recommendation, round_exact
from peerlight.functions.rows import each
from peerlight.operators.scoring import composite_of, subscore_array, weights_struct
from peerlight.sources.configs import check_weights, merge_weights, weight_presets

IDS = ["paper_id", "config_id"]
BANDS = {name: bound for bound, name in P.RECOMMENDATION_BANDS}


def weight_sets(sets: dict[str, dict[str, float]]) -> Column:
    """Named weight sets (overrides over defaults) as a constant array of rows."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("weight_set"),
                F.lit(i).alias("set_ord"),
                *[F.lit(merge_weights(w)[k]).alias(f"w_{k}") for k in P.SCORING_KEYS],
            )
            for i, (name, w) in enumerate(sets.items())
        ]
    )


def _weights() -> Column:
    return F.struct(*[F.col(f"w_{k}").alias(k) for k in P.SCORING_KEYS])


def reweight(scores: DataFrame, sets: dict[str, dict[str, float]]) -> DataFrame:
    """Old and new composite, delta and recommendations per record and weight set.

    ``scores`` are subscore rows (paper_id, config_id, four stages).
    """
    product = scores.select(*IDS, *P.SCORING_KEYS, F.inline(weight_sets(sets)))
    old = composite_of(subscore_array(weights_struct(P.DEFAULT_WEIGHTS)))
    new = composite_of(subscore_array(_weights()))
    staged = product.select(
        *IDS, "weight_set", "set_ord",
        old.alias("original_composite"), new.alias("new_composite"),
        F.create_map(
            *[x for k in P.SCORING_KEYS for x in (F.lit(k), round_exact(F.col(k)))]
        ).alias("breakdown"),
        F.create_map(*[x for k in P.SCORING_KEYS for x in (F.lit(k), F.col(f"w_{k}"))]).alias("weights"),
    )
    return staged.select(
        *IDS, "weight_set", "set_ord", "original_composite", "new_composite",
        round_exact(F.col("new_composite") - F.col("original_composite")).alias("delta"),
        recommendation(F.col("original_composite")).alias("recommendation_before"),
        recommendation(F.col("new_composite")).alias("recommendation_after"),
        "breakdown", "weights",
    )


def preset_sets() -> dict[str, dict[str, float]]:
    return {
        n: dict(zip(P.SCORING_KEYS, w, strict=True)) for n, *w in P.WEIGHT_PRESETS
    }


def sweep(
    scores: DataFrame, key: str, low: float, high: float, step: float
) -> DataFrame:
    """Vary one weight in integer steps, the others at defaults; marks where the
    recommendation flips."""
    if key not in P.SCORING_KEYS:
        raise ValueError(f"unknown weight key {key}")
    if low < 0 or step <= 0 or high < low:
        raise ValueError("need 0 <= low <= high and a positive step")
    steps = int((high - low) / step + 1e-9)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct(
            i.alias("step"), (F.lit(float(low)) + i * F.lit(float(step))).alias("weight")
        ),
    )

    def score(p: Column) -> Column:
        w = F.struct(
            *[
                (p["weight"] if k == key else F.lit(P.DEFAULT_WEIGHTS[k])).alias(k)
                for k in P.SCORING_KEYS
            ]
        )
        return F.struct(
            p["step"].alias("step"),
            p["weight"].alias("weight"),
            composite_of(subscore_array(w)).alias("composite"),
        )

    # A record's points stay in its row, so finding flips needs no window and no shuffle.
    scored = scores.select(*IDS, F.transform(points, score).alias("pts"))
    named = scored.select(
        *IDS,
        F.transform(
            "pts",
            lambda p: F.struct(
                p["step"].alias("step"), p["weight"].alias("weight"),
                p["composite"].alias("composite"),
                recommendation(p["composite"]).alias("recommendation"),
            ),
        ).alias("pts"),
    )
    flips = F.transform(
        "pts",
        lambda p, i: F.struct(
            p["step"].alias("step"), p["weight"].alias("weight"), p["composite"].alias("composite"),
            p["recommendation"].alias("recommendation"),
            F.coalesce(
                (i > 0) & (p["recommendation"] != F.get(F.col("pts"), i - 1)["recommendation"]),
                F.lit(False),
            ).alias("flips"),
        ),
    )
    return each(named, IDS, flips, "p").select(*IDS, "p.*")


def tipping_point(scores: DataFrame, target: str) -> DataFrame:
    """First preset, in a fixed order, that lifts a record to the target band, else the best."""
    if target not in BANDS:
        raise ValueError(f"unknown target {target}")
    presets = preset_sets()
    tried = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(n).alias("preset"),
                composite_of(subscore_array(weights_struct(presets[n]))).alias("composite"),
            )
            for i, n in enumerate(P.TIPPING_ORDER)
        ]
    )
    rows = scores.select(*IDS, tried.alias("tried"))
    first = F.get(F.filter("tried", lambda t: t["composite"] >= BANDS[target]), F.lit(0))
    best = F.get(
        F.array_sort(
            F.transform(
                "tried", lambda t: F.struct((-t["composite"]).alias("k"), t["ord"], t.alias("t"))
            )
        ),
        F.lit(0),
    )["t"]
    picked = rows.select(*IDS, first.isNotNull().alias("reached"), F.coalesce(first, best).alias("p"))
    return picked.select(
        *IDS, "reached", F.col("p.preset").alias("preset"), F.col("p.composite").alias("composite"),
        recommendation(F.col("p.composite")).alias("recommendation"),
    )


def bar(value: Column) -> Column:
    """Ten segments, one per tenth; a line of dashes when the stage was skipped."""
    filled = F.floor(value * 10 + F.lit(1e-9)).cast("int")
    return F.coalesce(
        F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(10) - filled)),
        F.lit("─" * 10),
    )


def explain(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Value x weight per stage with a bar; marks the stage with the lowest value."""
    w = weights_struct(check_weights(weights) if weights else P.DEFAULT_WEIGHTS)
    rows = scores.select(*IDS, subscore_array(w).alias("subs"))
    lowest = F.array_min(F.transform("subs", lambda s: s["value"]))
    weakest = F.get(F.filter("subs", lambda s: s["value"] == lowest), F.lit(0))["name"]
    return (
        rows.select(*IDS, "subs", weakest.alias("weakest_stage"), composite_of(F.col("subs")).alias("composite"))
        .transform(
            lambda df: each(df, [*IDS, "weakest_stage", "composite"], "subs", "s", "stage_pos")
        )
        .select(
            *IDS,
            "stage_pos",
            F.col("s.name").alias("stage"),
            round_exact(F.col("s.value")).alias("value"),
            F.col("s.weight").alias("weight"),
            round_exact(F.col("s.value") * F.col("s.weight")).alias("weighted"),
            bar(F.col("s.value")).alias("bar"),
            (F.col("s.name") == F.col("weakest_stage")).alias("is_weakest"),
            "composite",
        )
    )


def side_by_side(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Stage values, composite and recommendation under two presets, one column each."""
    presets = preset_sets()

    def column(name: str) -> Column:
        total = composite_of(subscore_array(weights_struct(presets[name])))
        return F.struct(total.alias("t"), recommendation(total).alias("r"))

    rows = scores.select(
        *IDS, *P.SCORING_KEYS, column(a).alias("_a"), column(b).alias("_b")
    )
    stage = lambda k: F.coalesce(fixed(F.col(k), 2), F.lit("_skipped_"))
    entries = [(k, stage(k), stage(k)) for k in P.SCORING_KEYS]
    entries.append(("composite", fixed(F.col("_a.t"), 2), fixed(F.col("_b.t"), 2)))
    entries.append(("recommendation", F.col("_a.r"), F.col("_b.r")))
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("row_ord"), F.lit(n).alias("stage"), x.alias("value_a"), y.alias("value_b")
            )
            for i, (n, x, y) in enumerate(entries)
        ]
    )
    return each(rows, IDS, table, "p").select(*IDS, "p.*")


__all__ = [
    "bar", "explain", "preset_sets", "reweight", "side_by_side", "sweep", "tipping_point",
    "weight_presets", "weight_sets",
]
