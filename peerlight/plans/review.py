"""The whole review over a corpus: every stage composed into one plan.

Without a model the plan has no shuffle at all: parsing, depth, compliance, rubric and
composite are projections of one row per paper, and the handful of venue configs is a
constant array. With a catalog and a model, only keys, requests and claims are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight import __version__, schemas
from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.rows import settled
from peerlight.operators import citations, claims, entailment, inference, parsing, references
from peerlight.operators import verification
from peerlight.operators.compliance import add_compliance, live_papers, some_config_passes
from peerlight.operators.depth import add_depth
from peerlight.operators.rubric import add_rubric
from peerlight.operators.rubric_requests import rubric_requests
from peerlight.operators.scoring import add_composite, add_subscores, banner
from peerlight.session import append_stage, appended, stage, stage_buckets
from peerlight.sources.configs import Configs, times_configs
from peerlight.sources.papers import distinct_papers

LEDGER = {
    "total_claims": "int", "verified_count": "int", "hallucination_count": "int",
    "mean_confidence": "double",
}
RECORD_COLUMNS = [
    "paper_id", "config_id", "config_hash", "title", "abstract", "word_count", "n_refs", "triage",
    "section_checks", "format_checks", "issues", "n_passed", "n_checks", *LEDGER, "methodology",
    "limitations", "reproducibility", "logical_soundness", "rationales", "rubric_id",
    "dimensions", "raw_total", "bias_adjusted_total", "adjustment_notes", "composite",
    "recommendation", "breakdown", "banner", "created_at",
]


@dataclass
class Options:
    """Switches of a run that are not part of a venue config.

    With ``run_id`` set, parsed papers and model answers are staged as tables in the shared
    folder, so they are computed once however many later joins read them; a model needs it.
    Answers are kept under the id: a rerun asks only for what is missing.

    ``journal`` is the folder to which the model keeps its answers as they arrive
    (``inference.run_model``): what a run that died had paid for is taken from there.

    ``distinct_ids`` says that no two rows of the input share a ``paper_id``, which saves
    the exchange that makes it so.
    """

    model: str = P.DEFAULT_MODEL
    provider: str = "stub"
    include_entailment: bool = True
    strict_parity: bool = False
    use_config_weights: bool = False
    max_claims: int = P.MAX_CLAIMS_PER_SECTION
    min_similarity: float = 0.6
    key_major: bool = False
    current_year: int | None = None
    max_age: int | None = None
    created_at: str | None = None
    run_id: str | None = None
    distinct_ids: bool = False
    hot_rows: int = 1_000_000
    journal: str | None = None


@dataclass
class Review:
    """Results of a run; every field is a DataFrame (or a list of them)."""

    evaluations: DataFrame
    parsed: DataFrame
    rejected: DataFrame
    claims: DataFrame | None = None
    results: DataFrame | None = None
    lookups: DataFrame | None = None
    matches: DataFrame | None = None
    temporal: DataFrame | None = None
    entailments: DataFrame | None = None
    responses: list[DataFrame] = field(default_factory=list)


def with_metadata(parsed: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Attach optional (paper_id, authors, year, ...) metadata; papers without stay."""
    if metadata is None:
        return parsed
    cols = [c for c in metadata.columns if c == "paper_id" or c not in parsed.columns]
    return parsed.join(metadata.select(*cols), "paper_id", "left")


def paper_scores(parsed: DataFrame) -> DataFrame:
    """Config-independent columns per paper: facts and depth, without any section text."""
    authors = (
        F.col("authors") if "authors" in parsed.columns else F.array().cast("array<string>")
    )
    facts = parsed.select(
        "paper_id", "title", "abstract", "word_count", "n_refs", "sections",
        F.transform("sections", lambda s: F.lower(T.strip(s["title"]))).alias("titles"),
        authors.alias("authors"),
    )
    return add_depth(facts, [c for c in facts.columns if c != "sections"])


def triaged(parsed: DataFrame, configs: Configs = None) -> DataFrame:
    """Paper x config rows with depth and compliance."""
    return triaged_scores(paper_scores(parsed), configs)


def triaged_scores(scores: DataFrame, configs: Configs = None) -> DataFrame:
    """``triaged`` from the columns of ``paper_scores``, which may be stored."""
    return add_compliance(times_configs(scores, configs))


def with_ledger(rows: DataFrame, ledgers: DataFrame | None) -> DataFrame:
    """Claim counts; zeros without a ledger and for pairs a FAIL triage cut short."""
    if ledgers is None:
        return rows.select("*", *[F.lit(0).cast(t).alias(n) for n, t in LEDGER.items()])
    ran = F.col("triage") != "FAIL"
    kept = [F.coalesce(F.when(ran, F.col(n)), F.lit(0)).cast(t).alias(n) for n, t in LEDGER.items()]
    return rows.join(ledgers, "paper_id", "left").select(*rows.columns, *kept)


def finish(
    rows: DataFrame, model_dims: DataFrame | None, options: Options
) -> DataFrame:
    """Rubric, subscores and composite to record rows."""
    weights: Column | None = F.col("weights") if options.use_config_weights else None
    scored = add_composite(add_subscores(add_rubric(rows, model_dims)), weights)
    now = (
        F.lit(options.created_at).cast("timestamp") if options.created_at else F.current_timestamp()
    )
    return settled(
        scored.select(
            "*", banner(F.col("triage"), F.col("issues")).alias("banner"), now.alias("created_at")
        ).select(*RECORD_COLUMNS)
    )


def heuristic_review(
    parsed: DataFrame, configs: Configs = None, options: Options | None = None
) -> DataFrame:
    """Evaluations of parsed papers without model or catalog: one narrow pass."""
    return finish(with_ledger(triaged(parsed, configs), None), None, options or Options())


def evaluate_papers(
    papers: DataFrame,
    configs: Configs = None,
    catalog: DataFrame | None = None,
    infer: Callable[[DataFrame], DataFrame] | None = None,
    cache: DataFrame | None = None,
    metadata: DataFrame | None = None,
    errors: DataFrame | None = None,
    options: Options | None = None,
) -> Review:
    """Review every paper under every config; rows that repeat a ``paper_id`` count once.

    ``infer`` maps request rows to response rows (see ``operators.inference``). Without it
    the run is heuristic. Pairs with FAIL triage get no model calls and an empty ledger.
    Without a catalog claims cannot be verified and their subscore is absent;
    ``strict_parity`` instead counts every cited claim as unresolved.
    """
    opt = options or Options()
    if infer is not None and not opt.run_id:
        raise ValueError("a model needs Options(run_id=...), or its answers are paid for twice")
    if not opt.distinct_ids:
        papers = distinct_papers(papers)

    def staged(df: DataFrame, name: str) -> DataFrame:
        return stage(df, name, opt.run_id) if opt.run_id else df

    def in_place(df: DataFrame, name: str) -> DataFrame:
        """Rows that come from papers in their buckets, stored there without an exchange."""
        return stage_buckets(df, name, opt.run_id, "paper_id", dealt=True) if opt.run_id else df

    def ask(requests: DataFrame, name: str, stored: bool = False) -> tuple[DataFrame, DataFrame]:
        requests = requests if stored else staged(requests, f"{name}_requests")
        before = appended(requests.sparkSession, f"{name}_responses", opt.run_id, schemas.RESPONSES)
        kept = inference.journal_responses(requests.sparkSession, opt.journal) if opt.journal else None
        if kept is not None:  # answers of a run that died belong to this run now
            asked = requests.select("cache_key").distinct().join(before, "cache_key", "left_anti")
            before = append_stage(
                kept.join(asked, "cache_key", "left_semi"), f"{name}_responses", opt.run_id, schemas.RESPONSES
            )
        todo = inference.missing_requests(requests, cache, before)
        fresh = append_stage(infer(todo), f"{name}_responses", opt.run_id, schemas.RESPONSES)
        return inference.answer(requests, cache, fresh, opt.hot_rows), fresh

    parsed = with_metadata(parsing.parse_papers(papers), metadata)
    if opt.run_id:  # texts are read where they lie by every join on papers
        titles = F.transform("sections", lambda s: F.lower(T.strip(s["title"])))
        judged = parsed.withColumn("titles", titles).withColumn("live", some_config_passes(configs))
        held = stage_buckets(judged.drop("titles"), "parsed", opt.run_id, "paper_id")
        parsed, live = held.drop("live"), held.filter("live").drop("live")
    else:
        live = live_papers(parsed, configs) if catalog is not None else None
    # Section texts are searched for depth once; both readers below take the scores.
    scores = in_place(paper_scores(parsed), "scores")
    review = Review(parsed, parsed, parsing.rejected_papers(papers))

    if catalog is not None:
        refs = staged(references.refs(live), "refs")
        review.lookups = staged(
            citations.lookup_refs(
                refs, catalog, errors, opt.min_similarity, opt.key_major, opt.hot_rows
            ),
            "lookups",
        )
        review.matches = citations.metadata_match(refs, review.lookups)
        years = parsed if "year" in parsed.columns else None
        review.temporal = citations.temporal_issues(refs, years, opt.current_year, opt.max_age)

    ledgers = None
    if infer is not None:
        answers, fresh = ask(
            claims.decompose_requests(live, opt.model, opt.max_claims, opt.provider), "decompose"
        )
        review.responses.append(fresh)
        replies = answers.select("paper_id", F.col("unit_id").cast("int").alias("ord"), "text")
        review.claims = staged(
            claims.build_claims(claims.parse_claims(replies, opt.max_claims), live), "claims"
        )
        if catalog is not None:
            results = verification.verify_claims(
                review.claims, review.lookups, review.matches, review.temporal
            )
            if opt.include_entailment:
                review.entailments = staged(
                    entailments_of(review, catalog, ask, opt, staged), "entailments"
                )
                results = verification.merge_entailment(results, review.entailments)
            review.results = staged(results, "results")
        elif opt.strict_parity:
            review.results = staged(verification.verify_claims(review.claims, *empty_lookups(parsed)), "results")
        if review.results is not None:
            ledgers = verification.ledger(review.results, live)

    rows = with_ledger(triaged_scores(scores, configs), ledgers)
    model_dims = None
    if infer is not None:
        asked = settled(rows).filter("triage <> 'FAIL'").drop("title", "abstract")
        answers, fresh = ask(
            rubric_requests(live, asked, configs, opt.model, opt.provider), "rubric"
        )
        review.responses.append(fresh)
        model_dims = entailment.parse_rubric(answers.select("paper_id", "config_id", "text"), configs)
    review.evaluations = in_place(finish(rows, model_dims, opt), "evaluations")
    return review


def entailments_of(
    review: Review, catalog: DataFrame, ask: Callable, opt: Options, staged: Callable
) -> DataFrame:
    """Verdicts for all pairs; abstracts are looked up by the DOI that was found.

    Pairs are stored once with their keyword verdict; requests and verdicts are read from there.
    """
    found = review.lookups.filter("status = 'FOUND'").select(
        "paper_id", "ref_id", F.col("meta.doi").alias("doi"),
        F.lit(None).cast("string").alias("arxiv_id"),
    )
    abstracts = citations.abstracts_by_id(found, catalog, opt.hot_rows)
    pairs = entailment.entailment_pairs(review.claims, review.lookups, abstracts)
    pairs = staged(entailment.judged(pairs), "pairs")
    requests = entailment.entailment_requests(pairs, opt.model, opt.provider)
    answers, fresh = ask(requests, "entailment", stored=True)
    review.responses.append(fresh)
    return entailment.entailment(pairs, answers)


def empty_lookups(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lookup, match and temporal tables without rows."""
    spark = parsed.sparkSession
    meta = "struct<title:string,authors:array<string>,year:int,venue:string,doi:string>"
    return (
        spark.createDataFrame(
            [], f"paper_id string, ref_id string, status string, source string, meta {meta}"
        ),
        spark.createDataFrame([], "paper_id string, ref_id string, overall double"),
        spark.createDataFrame([], "paper_id string, ref_id string"),
    )


def provenance(
    evaluations: DataFrame, models: dict[str, str] | None = None, costs: DataFrame | None = None
) -> DataFrame:
    """Engine version, config hash, models, seeds and cost per evaluation.

    ``costs`` optionally holds (paper_id, config_id, cost_usd) of the run's model calls.
    """
    rows = evaluations.select("paper_id", "config_id", "config_hash")
    if costs is not None:
        rows = rows.join(costs, ["paper_id", "config_id"], "left")
    else:
        rows = rows.withColumn("cost_usd", F.lit(0.0))
    used = models or {}
    names = (
        F.create_map(*[F.lit(x) for kv in used.items() for x in kv])
        if used
        else F.create_map().cast("map<string,string>")
    )
    seeds = F.create_map(*[F.lit(x) for k in ("decompose", "entailment", "rubric") for x in (k, 0)])
    return rows.select(
        "paper_id",
        "config_id",
        F.struct(
            F.lit(__version__).alias("engine_version"),
            "config_hash",
            names.alias("llm_models"),
            seeds.alias("seeds"),
            F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        ).alias("provenance"),
    )
