"""Rubric dimensions: model scores where present, heuristics otherwise, length penalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import text as T
from peerlight.functions.numbers import clamp, fixed, round_exact
from peerlight.functions.rows import each
from peerlight.operators.joins import attach_by_config
from peerlight.sources.configs import Configs, config_array

FALLBACK_NOTE = " (LLM output unparseable; fell back to heuristics.)"


def signals() -> dict[str, Column]:
    """Inputs of the heuristic, by name, from ledger and depth columns."""
    col = F.col
    return {
        "verified": F.when(
            col("total_claims") > 0, col("verified_count") / col("total_claims")
        ).otherwise(F.lit(0.0)),
        "hallucinations": col("hallucination_count"),
        "methodology": col("methodology"),
        "limitations": col("limitations"),
        "reproducibility": col("reproducibility"),
        "logical": col("logical_soundness"),
    }


def heuristic_struct(s: dict[str, Column]) -> Column:
    """The four signal mixes and their rationales, computed once per paper x config."""
    penalty = F.when(s["hallucinations"] == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.2) * s["hallucinations"])
    )
    two = {k: fixed(v, 2) for k, v in s.items() if k != "hallucinations"}
    text = F.concat
    return F.struct(
        (F.lit(0.5) * s["verified"] + F.lit(0.3) * s["methodology"] + F.lit(0.2) * penalty).alias(
            "sound"
        ),
        text(
            F.lit("Heuristic: verified="), two["verified"],
            F.lit(", methodology="), two["methodology"],
            F.lit(", hallucinations="), s["hallucinations"].cast("string"), F.lit("."),
        ).alias("sound_why"),
        (F.lit(0.6) * s["logical"] + F.lit(0.4) * s["limitations"]).alias("present"),
        text(
            F.lit("Heuristic: logical_soundness="), two["logical"],
            F.lit(", limitations="), two["limitations"], F.lit("."),
        ).alias("present_why"),
        (F.lit(0.5) * s["methodology"] + F.lit(0.5) * s["reproducibility"]).alias("contrib"),
        text(
            F.lit("Heuristic: methodology="), two["methodology"],
            F.lit(", reproducibility="), two["reproducibility"], F.lit("."),
        ).alias("contrib_why"),
        (
            F.lit(0.5) * s["methodology"] + F.lit(0.3) * s["logical"]
            + F.lit(0.2) * s["limitations"]
        ).alias("signif"),
        text(
            F.lit("Heuristic: methodology="), two["methodology"],
            F.lit(", logical="), two["logical"],
            F.lit(", limitations="), two["limitations"], F.lit("."),
        ).alias("signif_why"),
    )


def heuristic_dim(dim: Column, h: Column) -> Column:
    """Score in [0, max] and rationale of one dimension from the signal mixes."""
    name = F.lower(dim["name"])
    has = lambda word: F.contains(name, F.lit(word))
    base = (
        F.when(has("sound"), h["sound"])
        .when(has("present") | has("clarity"), h["present"])
        .when(has("contribution") | has("original"), h["contrib"])
        .when(has("significance") | has("impact"), h["signif"])
        .otherwise(F.lit(0.5))
    )
    why = (
        F.when(has("sound"), h["sound_why"])
        .when(has("present") | has("clarity"), h["present_why"])
        .when(has("contribution") | has("original"), h["contrib_why"])
        .when(has("significance") | has("impact"), h["signif_why"])
        .otherwise(
            F.concat(
                F.lit("Heuristic: unknown dimension '"),
                dim["name"],
                F.lit("'; defaulting to neutral 0.5."),
            )
        )
    )
    return F.struct((clamp(base, 0.0, 1.0) * dim["max_score"]).alias("score"), why.alias("why"))


def score_dim(dim: Column, heuristics: Column, parsed: Column | None, with_model: Column) -> Column:
    """Model score clamped to [0, max] if present, else the heuristic (marked as fallback)."""
    plain = heuristic_dim(dim, heuristics)

    def finish(h: Column) -> Column:
        score, why = h["score"], h["why"]
        if parsed is not None:
            model = F.try_element_at(parsed, dim["name"])
            why = (
                F.when(model.isNotNull(), model["rationale"])
                .when(with_model, F.concat(why, F.lit(FALLBACK_NOTE)))
                .otherwise(why)
            )
            score = F.when(
                model.isNotNull(), clamp(model["score"], 0.0, dim["max_score"])
            ).otherwise(score)
        return F.struct(
            dim["name"].alias("name"),
            round_exact(score).alias("score"),
            dim["max_score"].alias("max_score"),
            dim["weight"].alias("weight"),
            why.alias("rationale"),
        )

    return T.let(plain, finish)


CONFIG_RUBRIC = [
    "rubric_id", "dims", "length_adjust", "penalty_start", "penalty_full", "max_penalty",
]


def add_rubric(rows: DataFrame, model_dims: DataFrame | None = None) -> DataFrame:
    """Rubric columns on rows that hold word_count, ledger counts, depth scores and the
    rubric part of a config; that part is dropped but for ``rubric_id``.

    ``model_dims`` optionally gives (paper_id, config_id, model_dims map<name,
    struct<score, rationale>>) for the pairs a model was asked about.
    """
    keep = [c for c in rows.columns if c not in CONFIG_RUBRIC[1:]]
    base, model, asked = rows, None, F.lit(False)
    if model_dims is not None:
        said = model_dims.select("paper_id", "config_id", "model_dims", F.lit(True).alias("asked"))
        base = attach_by_config(base, said, "left")
        model, asked = F.col("model_dims"), F.coalesce("asked", F.lit(False))
    with_h = base.select("*", heuristic_struct(signals()).alias("h"))
    scored = with_h.select(
        "*",
        F.transform("dims", lambda d: score_dim(d, F.col("h"), model, asked)).alias("dimensions"),
    )
    totals = scored.select("*", weighted_total(F.col("dimensions")).alias("raw"))
    return bias_adjust(totals).select(
        *keep,
        "dimensions",
        round_exact(F.col("raw")).alias("raw_total"),
        round_exact(F.col("adjusted")).alias("bias_adjusted_total"),
        "adjustment_notes",
    )


def rubric(
    signals_df: DataFrame, configs: Configs = None, model_dims: DataFrame | None = None
) -> DataFrame:
    """Rubric per paper x config from (paper_id, config_id, word_count, ledger, depth) rows."""
    mine = F.filter(config_array(configs), lambda c: c["config_id"] == F.col("config_id"))
    with_cfg = signals_df.select("*", F.get(mine, F.lit(0)).alias("_cfg"))
    rows = add_rubric(
        with_cfg.select(*signals_df.columns, *[F.col(f"_cfg.{c}").alias(c) for c in CONFIG_RUBRIC]),
        model_dims,
    )
    return rows.select(
        "paper_id", "config_id", "rubric_id", "dimensions", "raw_total", "bias_adjusted_total",
        "adjustment_notes",
    )


def weighted_total(dims: Column) -> Column:
    """Weighted mean of score / max, in [0, 1]."""
    top = F.aggregate(
        dims, F.lit(0.0), lambda acc, d: acc + d["weight"] * (d["score"] / d["max_score"])
    )
    return top / F.aggregate(dims, F.lit(0.0), lambda acc, d: acc + d["weight"])


def bias_adjust(df: DataFrame) -> DataFrame:
    """Subtract the length penalty from ``raw``; adds ``adjusted`` and ``adjustment_notes``."""
    over = F.col("word_count") - F.col("penalty_start")
    share = F.least(F.lit(1.0), over / (F.col("penalty_full") - F.col("penalty_start")))
    applies = F.col("length_adjust") & (over > 0)
    penalty = share * F.col("max_penalty")
    note = F.concat(
        F.lit("Length bias: word_count="), F.col("word_count").cast("string"),
        F.lit(", penalty="), fixed(penalty, 3),
        F.lit(" (x of "), fixed(F.col("max_penalty"), 2), F.lit(")"),
    )
    return df.select(
        "*",
        F.when(applies, F.greatest(F.lit(0.0), F.col("raw") - penalty))
        .otherwise(F.col("raw"))
        .alias("adjusted"),
        F.when(applies, F.array(note))
        .otherwise(F.array().cast("array<string>"))
        .alias("adjustment_notes"),
    )


def rubric_dims(rubrics: DataFrame) -> DataFrame:
    """Long table of dimension scores."""
    ids = ["paper_id", "config_id"]
    return each(rubrics, ids, "dimensions", "d", "dim_pos").select(*ids, "dim_pos", "d.*")
