"""Depth signals of a paper: methodology, limitations, reproducibility, soundness.

One projection over the parsed section array. The texts each cue needs are joined once,
then every cue is a regex test on that column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.numbers import round_exact

CATEGORIES = {
    "intro": P.INTRO_TITLES,
    "method": P.METHOD_TITLES,
    "results": P.RESULT_TITLES,
    "conclusion": P.CONCLUSION_TITLES,
    "limitations": P.LIMITATION_TITLES,
}


def in_category(title: Column, category: str) -> Column:
    """The lower-cased title contains one of the category's words."""
    return T.let(
        F.lower(T.strip(title)),
        lambda t: reduce(
            lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in CATEGORIES[category]]
        ),
    )


def section_categories(sections: DataFrame) -> DataFrame:
    return sections.select(
        "paper_id",
        "ord",
        "title",
        *[in_category(F.col("title"), c).alias(f"is_{c}") for c in CATEGORIES],
    )


def _joined(flag: str | None = None) -> Column:
    """Texts of the marked sections, joined by spaces."""
    rows = F.col("marked") if flag is None else F.filter("marked", lambda s: s[flag])
    return F.array_join(F.transform(rows, lambda s: s["text"]), " ")


def _marked() -> Column:
    """Sections as text with one flag per category, each title judged once."""
    closing = F.array(*[F.lit(t) for t in P.CONCLUSION_TITLES + P.LIMITATION_TITLES])
    return F.transform(
        "sections",
        lambda s: T.let(
            F.lower(T.strip(s["title"])),
            lambda t: F.struct(
                s["text"].alias("text"),
                F.array_contains(closing, t).alias("closing"),
                *[
                    reduce(
                        lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in CATEGORIES[c]]
                    ).alias(c)
                    for c in CATEGORIES
                ],
            ),
        ),
    )


def _has(category: str) -> Column:
    return F.exists("marked", lambda s: s[category])


#: Characters of results and conclusion whose words are compared.
COMPARED_CHARS = 2000


def _long_words(text: Column, chars: int) -> Column:
    start = F.substring(text, 1, chars)
    return F.array_distinct(F.regexp_extract_all(start, F.lit("[a-z]{5,}"), F.lit(0)))


def _share(flags: list[Column]) -> Column:
    hits = reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
    return hits / F.lit(float(len(flags)))


def _named(pairs: list[tuple[str, Column]], negate: bool = False) -> Column:
    return T.optional_list([((~f if negate else f), F.lit(n)) for n, f in pairs])


def depth(parsed: DataFrame, compared_chars: int = COMPARED_CHARS) -> DataFrame:
    """(paper_id, methodology, limitations, reproducibility, logical_soundness, rationales)."""
    return add_depth(parsed, ["paper_id"], compared_chars)


def add_depth(
    parsed: DataFrame, carry: list[str], compared_chars: int = COMPARED_CHARS
) -> DataFrame:
    """The depth columns of every row beside the ``carry`` columns; text is dropped."""
    texts = parsed.select(*carry, _marked().alias("marked")).select(
        *carry,
        _has("intro").alias("intro"),
        _has("method").alias("method"),
        _has("results").alias("results"),
        _has("conclusion").alias("conclusion"),
        _has("limitations").alias("limited"),
        _joined("method").alias("method_text"),
        _joined("limitations").alias("limit_text"),
        _joined("closing").alias("closing_text"),
        _joined().alias("full_text"),
        F.lower(_joined("results")).alias("results_text"),
        F.lower(_joined("conclusion")).alias("conclusion_text"),
    )
    cues = texts.select(
        *carry,
        "intro",
        "method",
        "results",
        "conclusion",
        "limited",
        (F.col("method_text") == "").alias("no_method"),
        F.rlike("method_text", F.lit(P.DATASET_CUE)).alias("m_dataset"),
        F.rlike("method_text", F.lit(P.BASELINE_CUE)).alias("m_baseline"),
        F.rlike("method_text", F.lit(P.ABLATION_CUE)).alias("m_ablation"),
        F.rlike("method_text", F.lit(P.METRIC_CUE)).alias("m_metric"),
        (T.word_count(F.col("method_text")) >= 150).alias("m_length"),
        T.word_count(F.col("limit_text")).alias("limit_words"),
        F.regexp_count("closing_text", F.lit(P.LIMITATION_WORDS)).alias("limit_hits"),
        F.rlike("full_text", F.lit(P.CODE_URL)).alias("r_code"),
        F.rlike("full_text", F.lit(P.SEED_CUE)).alias("r_seed"),
        F.rlike("full_text", F.lit(P.HYPERPARAM_CUE)).alias("r_hyper"),
        F.rlike("full_text", F.lit(P.DATASET_CUE)).alias("r_dataset"),
        F.size(
            F.array_intersect(
                _long_words(F.col("results_text"), compared_chars), _long_words(F.col("conclusion_text"), compared_chars)
            )
        ).alias("shared_words"),
    )
    col = F.col
    method_flags = [
        ("dataset_mentioned", col("m_dataset")),
        ("baseline_mentioned", col("m_baseline")),
        ("ablation_discussed", col("m_ablation")),
        ("metric_named", col("m_metric")),
        ("substantive_length", col("m_length")),
    ]
    repro_flags = [
        ("code_url", col("r_code")),
        ("seed_mentioned", col("r_seed")),
        ("hyperparameters", col("r_hyper")),
        ("dataset_named", col("r_dataset")),
    ]
    skeleton = [
        ("introduction", col("intro")),
        ("method", col("method")),
        ("results", col("results")),
        ("conclusion", col("conclusion")),
    ]
    base = _share([f for _, f in skeleton])
    bonus = F.when(col("shared_words") >= 5, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    hit_score = F.least(F.lit(0.5), col("limit_hits") * F.lit(0.1))
    section_score = F.greatest(F.least(F.lit(1.0), col("limit_words") / F.lit(200.0)), F.lit(0.5))
    missing = T.join_parts(_named(skeleton, negate=True), ", ")
    return cues.select(
        *carry,
        round_exact(
            F.when(col("no_method"), F.lit(0.0)).otherwise(_share([f for _, f in method_flags]))
        ).alias("methodology"),
        round_exact(
            F.when(col("limited"), section_score)
            .when(col("limit_hits") == 0, F.lit(0.0))
            .otherwise(hit_score)
        ).alias("limitations"),
        round_exact(_share([f for _, f in repro_flags])).alias("reproducibility"),
        round_exact(bonus).alias("logical_soundness"),
        F.create_map(
            F.lit("methodology"),
            F.when(col("no_method"), F.lit("No methodology section found.")).otherwise(
                F.concat(
                    F.lit("Methodology signals present: "),
                    T.join_parts(_named(method_flags), ", ", "none"),
                )
            ),
            F.lit("limitations"),
            F.when(
                col("limited"),
                F.format_string(
                    "Dedicated limitations/discussion section (%d words)", col("limit_words")
                ),
            )
            .when(
                col("limit_hits") == 0,
                F.lit("No limitations section and no limitation-flavored language."),
            )
            .otherwise(
                F.format_string(
                    "Limitations language mentioned %d time(s) in conclusion-adjacent sections.",
                    col("limit_hits"),
                )
            ),
            F.lit("reproducibility"),
            F.concat(
                F.lit("Reproducibility cues: "), T.join_parts(_named(repro_flags), ", ", "none")
            ),
            F.lit("logical_soundness"),
            F.when(missing == "", F.lit("All skeleton parts present.")).otherwise(
                F.concat(F.lit("Missing skeleton parts: "), missing)
            ),
        ).alias("rationales"),
    )
