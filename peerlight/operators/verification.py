"""Claim verdicts from lookups, matches, temporal issues and entailments, and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.numbers import fixed, round_exact

PAIR = ["paper_id", "ref_id"]
CLAIM_KEY = ["paper_id", "claim_id"]


def claim_refs(claims: DataFrame, lookups: DataFrame) -> DataFrame:
    """Claim x cited reference with the lookup outcome; no lookup means unresolved."""
    cited = claims.select(*CLAIM_KEY, F.posexplode("ref_ids").alias("ref_pos", "ref_id"))
    return cited.join(lookups.select(*PAIR, "status", "source", "meta"), PAIR, "left").withColumn(
        "status", F.coalesce("status", F.lit("NOT_FOUND"))
    )


def _ids(condition: Column) -> Column:
    """Reference ids of a claim that meet the condition, in citation order."""
    ordered = F.array_sort(
        F.collect_list(F.when(condition, F.struct(F.col("ref_pos"), F.col("ref_id"))))
    )
    return F.transform(ordered, lambda x: x["ref_id"])


def verify_claims(
    claims: DataFrame, lookups: DataFrame, matches: DataFrame, temporal: DataFrame
) -> DataFrame:
    """One verdict per claim.

    Joins are on (paper_id, ref_id): a paper's few references bound each group, whatever
    the size of the corpus.
    """
    late = temporal.select(*PAIR, F.lit(True).alias("late")).distinct()
    per_ref = (
        claim_refs(claims, lookups)
        .join(matches.select(*PAIR, "overall"), PAIR, "left")
        .join(late, PAIR, "left")
    )
    col = F.col
    evidence = F.concat(
        col("ref_id"), F.lit(": "),
        F.coalesce(T.blank_to_null(col("meta.title")), F.lit("?")), F.lit(" ("),
        F.coalesce(F.nullif(col("meta.year"), F.lit(0)).cast("string"), F.lit("?")),
        F.lit(") via "), col("source"),
    )
    found = col("status") == "FOUND"
    per_claim = per_ref.groupBy(*CLAIM_KEY).agg(
        F.count(F.lit(1)).alias("n_refs"),
        _ids(col("status") == "NOT_FOUND").alias("missing"),
        _ids(col("status") == "ERROR").alias("errored"),
        _ids(col("late")).alias("late_refs"),
        F.array_sort(
            F.collect_list(F.when(col("overall").isNotNull(), F.struct("ref_pos", "overall")))
        ).alias("scores"),
        F.min_by(F.when(found, col("source")), F.when(found, col("ref_pos"))).alias("dominant"),
        F.array_sort(
            F.collect_list(F.when(col("meta").isNotNull(), F.struct("ref_pos", evidence.alias("e"))))
        ).alias("evidence"),
    )
    base = claims.select(*CLAIM_KEY, "claim_type").join(per_claim, CLAIM_KEY, "left")
    no_refs = col("n_refs").isNull()
    has_missing, has_errors = F.size("missing") > 0, F.size("errored") > 0
    has_late = F.coalesce(F.size("late_refs") > 0, F.lit(False))
    mean = F.when(F.size("scores") > 0, _mean(F.transform("scores", lambda s: s["overall"]))).otherwise(
        F.lit(1.0)
    )
    confident = F.when(has_late, F.least(mean, F.lit(P.TEMPORAL_CAP))).otherwise(mean)
    source = F.coalesce("dominant", F.lit("none"))
    staged = base.select(
        *CLAIM_KEY,
        F.when(no_refs, F.lit("no_refs"))
        .when(has_missing, F.lit("missing"))
        .when(has_errors, F.lit("errored"))
        .otherwise(F.lit("scored"))
        .alias("case"),
        "claim_type", "n_refs", "missing", "errored", "late_refs", "evidence",
        source.alias("dominant"), confident.alias("confident"), has_late.alias("has_late"),
    )
    scored = col("case") == "scored"
    return staged.select(
        *CLAIM_KEY,
        (scored & (col("confident") >= P.MATCH_THRESHOLD) & ~col("has_late")).alias("verified"),
        F.when(scored, round_exact(col("confident"))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(scored | (col("case") == "missing"), col("dominant"))
        .otherwise(F.lit("none"))
        .alias("source"),
        F.when(scored, F.array_join(F.transform("evidence", lambda e: e["e"]), " | "))
        .when(
            col("case") == "missing",
            F.concat(F.lit("Unresolvable citations: "), F.array_join("missing", ", ")),
        )
        .alias("evidence"),
        ((scored & col("has_late")) | (col("case") == "missing")).alias("hallucination_flag"),
        F.when(
            (col("case") == "no_refs") & (col("claim_type") == "CITATION"),
            F.lit("Categorized CITATION but no referenced citation ids; check extraction."),
        )
        .when(
            col("case") == "missing",
            F.format_string("%d/%d citations unresolved", F.size("missing"), col("n_refs")),
        )
        .when(
            col("case") == "errored",
            F.concat(F.lit("Resolver errored on refs: "), F.array_join("errored", ", ")),
        )
        .when(
            scored & col("has_late"),
            F.concat(F.lit("Temporal issue on refs: "), F.array_join("late_refs", ", ")),
        )
        .alias("notes"),
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def merge_entailment(results: DataFrame, entailments: DataFrame) -> DataFrame:
    """Downgrade claims that a confident NOT_SUPPORTED verdict refutes; never upgrade."""
    refuting = entailments.filter(
        (F.col("verdict") == "NOT_SUPPORTED") & (F.col("confidence") >= P.REFUTE_CONFIDENCE)
    )
    line = F.concat(
        F.col("ref_id"), F.lit(" NOT_SUPPORTED ("), fixed(F.col("confidence"), 2), F.lit(")")
    )
    refuted = refuting.groupBy(*CLAIM_KEY).agg(
        F.min("confidence").alias("r_confidence"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ref_pos", line.alias("t")))),
                lambda x: x["t"],
            ),
            "; ",
        ).alias("r_lines"),
    )
    col = F.col
    hit = col("r_confidence").isNotNull()
    joined = results.join(refuted, CLAIM_KEY, "left")
    note = F.concat(F.lit("Entailment: "), col("r_lines"))
    return joined.select(
        *CLAIM_KEY,
        (col("verified") & ~hit).alias("verified"),
        F.when(hit, F.least("confidence", "r_confidence"))
        .otherwise(col("confidence"))
        .alias("confidence"),
        F.when(hit & (col("source") == "none"), F.lit("llm")).otherwise(col("source")).alias("source"),
        "evidence",
        (col("hallucination_flag") | hit).alias("hallucination_flag"),
        F.when(hit, F.concat_ws(" | ", T.blank_to_null(col("notes")), note))
        .otherwise(col("notes"))
        .alias("notes"),
    )


def ledger(results: DataFrame, papers: DataFrame) -> DataFrame:
    """Claim counts and mean confidence per paper; papers without claims get zeros."""
    counts = results.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if("verified").alias("verified_count"),
        F.count_if("hallucination_flag").alias("hallucination_count"),
        # Decimals add up to the same mean in any order.
        F.sum(F.col("confidence").cast("decimal(28,18)")).alias("sum_confidence"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return (
        papers.select("paper_id")
        .join(counts, "paper_id", "left")
        .select(
            "paper_id",
            zero("total_claims"),
            zero("verified_count"),
            zero("hallucination_count"),
            F.coalesce(
                round_exact(F.col("sum_confidence").cast("double") / F.col("total_claims")), F.lit(0.0)
            ).alias("mean_confidence"),
        )
    )


#: Characters of a claim in the list of claims to look at; the full text stands beside it.
CLAIM_TEXT_CHARS = 120


def unverified_claims(
    claims: DataFrame, results: DataFrame, text_chars: int = CLAIM_TEXT_CHARS
) -> DataFrame:
    """Claims a reader must look at: not verified or flagged.

    ``claim_text`` is cut at ``text_chars``; ``full_text`` is the whole claim.
    """
    listed = results.filter(~F.col("verified") | F.col("hallucination_flag"))
    return claims.join(listed, CLAIM_KEY).select(
        *CLAIM_KEY,
        F.when(F.col("hallucination_flag"), F.lit("hallucination"))
        .otherwise(F.lit("unverified"))
        .alias("label"),
        "claim_type",
        "severity",
        "confidence",
        "source",
        F.when(F.length("text") > text_chars, F.concat(F.substring("text", 1, text_chars), F.lit("...")))
        .otherwise(F.col("text"))
        .alias("claim_text"),
        F.col("text").alias("full_text"),
        "notes",
    )


def flagged_citations(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Sorted distinct reference ids of flagged claims per paper (bounded by a paper's refs)."""
    flagged = results.filter("hallucination_flag").select(*CLAIM_KEY)
    return (
        claims.join(flagged, CLAIM_KEY)
        .select("paper_id", F.explode("ref_ids").alias("ref_id"))
        .groupBy("paper_id")
        .agg(F.array_sort(F.collect_set("ref_id")).alias("flagged_citations"))
    )
