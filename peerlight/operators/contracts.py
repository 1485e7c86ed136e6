"""Contract checks: rows that break a rule, with the rule's name (a quarantine table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions.rows import each


def _unit(name: str) -> Column:
    return F.col(name).between(0.0, 1.0)


def _among(name: str, kind: str) -> Column:
    return F.col(name).isin(P.ENUMS[kind])


def rules_for(columns: list[str]) -> dict[str, Column]:
    """The rules that apply to a table with these columns; each must hold for every row."""
    have = set(columns)
    rules: dict[str, Column] = {}
    for name in (
        "confidence", "overall", "mean_confidence", "methodology", "limitations",
        "reproducibility", "logical_soundness", "raw_total", "bias_adjusted_total", "composite",
        "overall_score", "reviewer_confidence",
    ):
        if name in have:
            rules[f"{name}_in_unit_range"] = _unit(name)
    for name, kind in (
        ("claim_type", "claim_type"), ("severity", "severity"), ("source", "source"),
        ("triage", "triage"), ("recommendation", "recommendation"), ("status", "status"),
        ("verdict", "verdict"),
    ):
        if name in have:
            rules[f"{name}_domain"] = _among(name, kind)
    if {"char_start", "char_end"} <= have:
        rules["span_start_non_negative"] = F.col("char_start") >= 0
        rules["span_ordered"] = F.col("char_end") >= F.col("char_start")
    if {"score", "max_score"} <= have:
        rules["max_score_positive"] = F.col("max_score") > 0
        rules["score_in_range"] = F.col("score").between(F.lit(0.0), F.col("max_score"))
    if "cost_usd" in have:
        rules["cost_non_negative"] = F.col("cost_usd") >= 0
    if {"total_claims", "verified_count", "hallucination_count"} <= have:
        rules["claim_counts_consistent"] = (
            (F.col("verified_count") <= F.col("total_claims"))
            & (F.col("hallucination_count") <= F.col("total_claims"))
        )
    if set(P.SCORING_KEYS) <= have and "weight_set" in have:
        for key in P.SCORING_KEYS:
            rules[f"weight_{key}_non_negative"] = F.col(key) >= 0
    if {"penalty_start", "penalty_full", "max_penalty"} <= have:
        rules["penalty_bounds_ordered"] = F.col("penalty_full") > F.col("penalty_start")
        rules["max_penalty_in_unit_range"] = _unit("max_penalty")
    return rules


def contract_violations(table: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Offending rows, once per broken rule. NULLs do not break a rule."""
    checks = rules if rules is not None else rules_for(table.columns)
    broken = F.array_compact(
        F.array(*[F.when(~rule, F.lit(name)) for name, rule in checks.items()])
        if checks
        else F.array().cast("array<string>")
    )
    return each(table, ["*"], broken, "rule")
