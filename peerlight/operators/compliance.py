"""Compliance checks of every paper against every venue config, and the triage roll-up.

Papers meet configs by exploding the constant config array, after section text has been
dropped; nothing is shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.rows import each, settled
from peerlight.sources.configs import Configs, config_array, times_configs


def alias_match(titles: Column, aliases: Column) -> Column:
    """Any non-blank alias is part of any lower-cased title."""
    return F.exists(
        F.transform(aliases, lambda a: F.lower(T.strip(a))),
        lambda a: (a != "") & F.exists(titles, lambda t: F.contains(t, a)),
    )


def looks_anonymized(authors: Column) -> Column:
    """No named author, or a name that says anonymous."""
    named = F.filter(
        F.transform(authors, lambda a: F.lower(T.strip(a))), lambda a: a != ""
    )
    marked = F.exists(
        named,
        lambda a: F.contains(a, F.lit(P.ANONYMOUS_MARKERS[0]))
        | F.contains(a, F.lit(P.ANONYMOUS_MARKERS[1]))
        | F.contains(a, F.lit(P.ANONYMOUS_MARKERS[2])),
    )
    return F.coalesce(authors.isNull() | (F.size(named) == 0) | marked, F.lit(True))


def _check(block, name, passed, detail, issue, critical) -> Column:
    return F.struct(
        F.lit(block).alias("block"),
        name.alias("name"),
        passed.alias("passed"),
        detail.cast("string").alias("detail"),
        F.when(~passed, issue).alias("issue"),
        F.lit(critical).alias("critical"),
    )


def critical_failure(get: Callable[[str], Column]) -> Column:
    """A required section is missing or there are too few references; ``get`` names config
    fields, so the rule works on joined columns and inside arrays of configs."""
    missing = F.exists(
        get("required_sections"), lambda aliases: ~alias_match(F.col("titles"), aliases)
    )
    return missing | (F.col("n_refs") < F.coalesce(get("min_references"), F.lit(0)))


def live_papers(parsed: DataFrame, configs: Configs = None) -> DataFrame:
    """Papers that at least one config does not FAIL: a plain filter over the constant config
    array. No product, no shuffle, no text moved."""
    titles = F.transform("sections", lambda s: F.lower(T.strip(s["title"])))
    return settled(parsed).withColumn("titles", titles).filter(some_config_passes(configs)).drop("titles")


def some_config_passes(configs: Configs = None) -> Column:
    """Whether at least one config does not FAIL a row that holds ``titles`` and ``n_refs``."""
    return F.exists(config_array(configs), lambda c: ~critical_failure(lambda name: c[name]))


def _check_array() -> Column:
    col = F.col

    def required(aliases: Column) -> Column:
        label = F.coalesce(F.get(aliases, F.lit(0)), F.lit("unknown"))
        return T.let(
            alias_match(col("titles"), aliases),
            lambda ok: _check(
                "section",
                F.concat(F.lit("section_present:"), label),
                ok,
                F.when(~ok, F.concat(F.lit("No section matches any of "), T.quoted_list(aliases))),
                F.concat(F.lit("Missing required section: "), label),
                True,
            ),
        )

    min_refs = F.coalesce(col("min_references"), F.lit(0))
    refs = _check(
        "section",
        F.lit("references_present"),
        col("n_refs") >= min_refs,
        F.format_string("%d references found (min %d)", col("n_refs"), min_refs),
        F.format_string("Too few references: %d < required %d", col("n_refs"), min_refs),
        True,
    )
    within = F.coalesce(col("word_count") >= col("word_count_min"), F.lit(True)) & F.coalesce(
        col("word_count") <= col("word_count_max"), F.lit(True)
    )
    low, high = T.or_none(col("word_count_min")), T.or_none(col("word_count_max"))
    words = _check(
        "format",
        F.lit("word_count"),
        within,
        F.format_string("%d words (min %s, max %s)", col("word_count"), low, high),
        F.format_string("Word count %d outside [%s, %s]", col("word_count"), low, high),
        False,
    )
    ethics = T.let(
        alias_match(col("titles"), col("ethics_aliases")),
        lambda ok: _check(
            "section",
            F.lit("ethics_section"),
            ok,
            F.when(
                ~ok,
                F.concat(F.lit("None of "), T.quoted_list(col("ethics_aliases")), F.lit(" found")),
            ),
            F.lit("Ethics / broader-impact section missing"),
            False,
        ),
    )
    anon = looks_anonymized(col("authors"))
    anonymity = _check(
        "format",
        F.lit("anonymization"),
        anon,
        F.when(~anon, F.concat(F.lit("Authors present: "), T.quoted_list(col("authors")))),
        F.lit("Paper does not appear to be anonymized"),
        False,
    )
    return F.concat(
        F.transform("required_sections", required),
        F.array(refs, words),
        F.array_compact(
            F.array(
                F.when(col("require_ethics"), ethics),
                F.when(col("require_anonymization"), anonymity),
            )
        ),
    )


def paper_facts(parsed: DataFrame) -> DataFrame:
    """What the checks need of a paper: titles and counts, no text."""
    authors = (
        F.col("authors")
        if "authors" in parsed.columns
        else F.array().cast("array<string>").alias("authors")
    )
    return parsed.select(
        "paper_id",
        F.transform("sections", lambda s: F.lower(T.strip(s["title"]))).alias("titles"),
        authors.alias("authors"),
        "n_refs",
        "word_count",
    )


def checked(parsed: DataFrame, configs: Configs = None) -> DataFrame:
    """One row per paper x config with the ordered check array."""
    return (
        times_configs(paper_facts(parsed), configs)
        .select("paper_id", "config_id", "config_ord", _check_array().alias("checks"))
    )


def compliance_checks(parsed: DataFrame, configs: Configs = None) -> DataFrame:
    """Long table of checks in evaluation order."""
    ids = ["paper_id", "config_id", "config_ord"]
    return each(checked(parsed, configs), ids, "checks", "c", "check_seq").select(
        *ids, "check_seq", "c.*"
    )


def roll_up(checks: Column) -> Column:
    """Triage, check lists, issues and pass counts of one check array."""
    failed = F.filter(checks, lambda c: ~c["passed"])
    brief = lambda block: F.transform(
        F.filter(checks, lambda c: c["block"] == block),
        lambda c: F.struct(c["name"], c["passed"], c["detail"]),
    )
    return F.struct(
        F.when(F.exists(failed, lambda c: c["critical"]), F.lit("FAIL"))
        .when(F.size(failed) > 0, F.lit("CONDITIONAL"))
        .otherwise(F.lit("PASS"))
        .alias("triage"),
        brief("section").alias("section_checks"),
        brief("format").alias("format_checks"),
        F.transform(failed, lambda c: c["issue"]).alias("issues"),
        F.size(F.filter(checks, lambda c: c["passed"])).alias("n_passed"),
        F.size(checks).alias("n_checks"),
    )


CONFIG_RULES = [
    "required_sections", "word_count_min", "word_count_max", "min_references", "require_ethics",
    "ethics_aliases", "require_anonymization",
]


def add_compliance(product: DataFrame) -> DataFrame:
    """Roll-up columns on rows that hold ``titles, authors, n_refs, word_count`` and the
    config columns; the rule columns are dropped."""
    keep = [c for c in product.columns if c not in [*CONFIG_RULES, "titles"]]
    checks = product.select(*keep, _check_array().alias("checks"))
    return checks.select(*keep, roll_up(F.col("checks")).alias("r")).select(*keep, "r.*")


def compliance(parsed: DataFrame, configs: Configs = None) -> DataFrame:
    """One row per paper x config: triage, checks, issues. Stays narrow."""
    product = times_configs(paper_facts(parsed), configs)
    return add_compliance(
        product.select(
            "paper_id", "titles", "authors", "n_refs", "word_count", "config_id", "config_ord",
            *CONFIG_RULES,
        )
    ).drop("authors", "n_refs", "word_count")


def roll_up_checks(checks: DataFrame) -> DataFrame:
    """The same roll-up from a stored long check table (one shuffle on the pair)."""
    ordered = F.array_sort(
        F.collect_list(F.struct("check_seq", "block", "name", "passed", "detail", "issue", "critical"))
    )
    return (
        checks.groupBy("paper_id", "config_id")
        .agg(ordered.alias("checks"))
        .select("paper_id", "config_id", roll_up(F.col("checks")).alias("r"))
        .select("paper_id", "config_id", "r.*")
    )


def detect_venue(papers: DataFrame, full_doc: bool = True) -> DataFrame:
    """Best shipped config for each text, with confidence and reason."""
    scored = papers.select(
        "paper_id",
        F.regexp_count("md", F.lit(P.ROMAN_HEADER)).alias("roman"),
        F.rlike("md", F.lit(P.ARXIV_MENTION)).alias("arxiv"),
        F.rlike("md", F.lit(P.IMPACT_LANGUAGE)).alias("impact"),
        T.word_count(F.col("md")).alias("words"),
    )
    col = F.col
    rules = [
        (
            col("roman") >= 3,
            "ieee",
            F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.05) * col("roman")),
            F.format_string(
                "%d Roman-numeral section headers detected (I., II., III., …).", col("roman")
            ),
        ),
        (col("arxiv"), "arxiv", F.lit(0.85), F.lit("arXiv ID detected in paper body.")),
        (
            col("impact"),
            "neurips",
            F.lit(0.75),
            F.lit("Broader-impact / checklist language detected (NeurIPS convention)."),
        ),
    ]
    if full_doc:
        rules += [
            (
                col("words") < 3000,
                "ieee",
                F.lit(0.55),
                F.format_string(
                    "Short paper (%d words) — matches IEEE conference format.", col("words")
                ),
            ),
            (
                col("words") > 15000,
                "arxiv",
                F.lit(0.55),
                F.format_string(
                    "Long paper (%d words) — matches arXiv preprint norms.", col("words")
                ),
            ),
        ]
    fallback = F.struct(
        F.lit("neurips").alias("recommended"),
        F.lit(0.50).alias("confidence"),
        F.lit("No strong signal; defaulting to NeurIPS (generic ML venue).").alias("rationale"),
    )
    choice = None
    for cond, name, conf, why in rules:
        guess = F.struct(
            F.lit(name).alias("recommended"), conf.alias("confidence"), why.alias("rationale")
        )
        choice = F.when(cond, guess) if choice is None else choice.when(cond, guess)
    return scored.select("paper_id", choice.otherwise(fallback).alias("g")).select(
        "paper_id", "g.*"
    )
