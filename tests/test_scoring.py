import random

import pytest
from pyspark.sql import functions as F

from peerlight.functions.numbers import fixed, recommendation, round_exact
from peerlight.operators import depth, fairness, parsing, scoring, whatif
from peerlight.operators.compliance import compliance, detect_venue
from peerlight.operators.rubric import rubric
from peerlight.plans.review import Options, evaluate_papers, heuristic_review
from peerlight.sources.configs import ConfigError, complete_config, merge_weights, SHIPPED


def test_rounding_matches_exact_binary_rounding(spark):
    rng = random.Random(7)
    values = [k / 20000 for k in range(2000)] + [rng.random() for _ in range(2000)] + [0.12345, 1.00005, -0.00005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 4):
        got = [r[0] for r in df.select(round_exact(F.col("x"), digits)).collect()]
        assert got == [round(v, digits) for v in values]
    text = [r[0] for r in df.select(fixed(F.col("x"), 2)).collect()]
    assert text[:2000] == [f"{v:.2f}" for v in values[:2000]]
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 2)).first()[0] is None


def _scores(spark, *rows):
    return spark.createDataFrame(
        [(f"p{i}", "c", *r) for i, r in enumerate(rows)],
        "paper_id string, config_id string, compliance double, verification double, depth double, rubric double",
    )


def test_composite_and_redistribution(spark):
    rows = scoring.composite(_scores(spark, (1.0, 1.0, 0.75, 0.6), (1.0, None, 0.75, 0.6))).collect()
    assert [r.composite for r in rows] == [0.77, 0.7125]
    assert rows[1].breakdown["verification"] is None
    assert rows[0].recommendation == "ACCEPT"


@pytest.mark.parametrize(
    "score,band",
    [(0.85, "STRONG_ACCEPT"), (0.8499, "ACCEPT"), (0.55, "WEAK_ACCEPT"), (0.45, "BORDERLINE"),
     (0.3, "WEAK_REJECT"), (0.15, "REJECT"), (0.1, "STRONG_REJECT")],
)
def test_bands(spark, score, band):
    assert spark.range(1).select(recommendation(F.lit(score))).first()[0] == band


def test_weights_contract():
    assert merge_weights({"depth": 0.5})["rubric"] == 0.45
    for bad in ({"style": 1.0}, {"depth": -1.0}):
        with pytest.raises(ConfigError):
            merge_weights(bad)
    with pytest.raises(ConfigError):
        complete_config({**SHIPPED["neurips"], "extra": 1})


def test_depth_scores(spark):
    md = (
        "## Introduction\nx\n## Method\nWe use the ImageNet dataset and a baseline. An ablation shows accuracy.\n"
        "## Results\nwords alpha bravo charlie delta echoes foxtrot\n"
        "## Conclusion\nalpha bravo charlie delta echoes foxtrot, with one limitation"
    )
    df = spark.createDataFrame([("p", md)], "paper_id string, md string")
    row = depth.depth(parsing.parse_papers(df)).first()
    assert row.methodology == 0.8
    assert row.limitations == 0.1
    assert row.reproducibility == 0.25
    assert row.logical_soundness == 1.0
    assert row.rationales["methodology"].endswith("dataset_mentioned, baseline_mentioned, ablation_discussed, metric_named")


def test_custom_config_and_unknown_dimension(spark):
    cfg = {
        "venue": "blog",
        "compliance": {"required_sections": [["intro"]], "word_count_max": 1},
        "rubric": {"id": "r", "dimensions": [{"name": "style", "weight": 1, "max_score": 10}]},
    }
    df = spark.createDataFrame([("p", "## Intro\none two")], "paper_id string, md string")
    row = heuristic_review(parsing.parse_papers(df), [cfg]).first()
    assert row.triage == "CONDITIONAL" and row.issues == ["Word count 2 outside [None, 1]"]
    assert row.dimensions[0].score == 5.0 and row.raw_total == 0.5


def test_fail_without_references(spark):
    df = spark.createDataFrame([("p", "## Intro\none two")], "paper_id string, md string")
    rows = compliance(parsing.parse_papers(df), ["arxiv"]).collect()
    assert rows[0].triage == "FAIL"
    assert "Too few references: 0 < required 5" in rows[0].issues


def test_venue_detection(spark):
    texts = ["I. INTRO\nII. METHOD\nIII. RESULTS\n", "see arXiv:2001.01234", "the broader impact", "short"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "paper_id string, md string")
    full = {r.paper_id: r.recommended for r in detect_venue(df).collect()}
    assert full == {"0": "ieee", "1": "arxiv", "2": "neurips", "3": "ieee"}
    part = {r.paper_id: r.recommended for r in detect_venue(df, full_doc=False).collect()}
    assert part["3"] == "neurips"


def test_model_dims_are_clamped_and_fall_back(spark):
    sig = spark.createDataFrame(
        [("p", "neurips", 100, 2, 1, 1, 0.5, 0.5, 0.5, 0.5)],
        "paper_id string, config_id string, word_count int, total_claims int, verified_count int, "
        "hallucination_count int, methodology double, limitations double, reproducibility double, logical_soundness double",
    )
    dims = spark.createDataFrame(
        [("p", "neurips", {"soundness": (9.0, "ok")})],
        "paper_id string, config_id string, model_dims map<string,struct<score:double,rationale:string>>",
    )
    d = {x.name: x for x in rubric(sig, None, dims).first().dimensions}
    assert d["soundness"].score == 4.0 and d["soundness"].rationale == "ok"
    assert d["presentation"].rationale.endswith("(LLM output unparseable; fell back to heuristics.)")


def _groups(spark, rows):
    return spark.createDataFrame(rows, "grp string, score double")


def test_disparate_impact(spark):
    def run(rows):
        return fairness.disparate_impact(_groups(spark, rows), F.col("grp"), F.col("score"), 0.5, list_rates=True).first()

    a = [("a", 1.0)] * 5
    r = run(a + [("b", 1.0)] * 3 + [("b", 0.0)] * 2)
    assert (r.di_ratio, r.flagged_4_5ths_rule, r.reference_group) == (0.6, True, "a")
    assert run(a + [("b", 0.0)] * 5).di_ratio == 0.0
    assert run(a).di_ratio is None and not run(a).flagged_4_5ths_rule
    assert run([]).notes == "No records with group labels."
    assert run([("b", 1.0), ("a", 1.0)]).reference_group == "a"
    assert run([("a", 0.0), ("b", 0.0)]).di_ratio == 1.0


def test_length_correlation_edges(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "word_count int, rubric_adjusted_total double")
        return fairness.length_score_corr(df).first().length_score_pearson

    assert run([(5, 0.1), (5, 0.5), (5, 0.9)]) == 0.0
    assert run([(1, 0.1), (2, 0.2)]) is None
    assert run([(1, 0.1), (2, 0.2), (3, 0.3), (9, None)]) == 1.0


def test_upper_median(spark):
    for values in ([3, 1, 2], [4, 1, 2, 3], [7]):
        df = spark.createDataFrame([(v,) for v in values], "word_count int")
        assert fairness.upper_median(df).first().median == sorted(values)[len(values) // 2]


def test_queue_rank(spark):
    df = spark.createDataFrame(
        [("a", "c", "PASS", 0.9, "x"), ("b", "c", "FAIL", 0.1, "x"), ("d", "c", "PASS", 0.9, "x"), ("e", "c", "PASS", 0.2, "x")],
        "paper_id string, config_id string, triage string, composite double, recommendation string",
    )
    assert {r.paper_id: r.queue_rank for r in scoring.triage_queue(df).collect()} == {"b": 1, "a": 2, "d": 2, "e": 4}


def test_tipping_point_and_bar(spark):
    s = _scores(spark, (0.2, None, 0.2, 0.9), (0.1, 0.1, 0.1, 0.1))
    rows = {r.paper_id: r for r in whatif.tipping_point(s, "ACCEPT").collect()}
    assert rows["p0"].preset == "rubric-heavy" and rows["p0"].reached
    assert not rows["p1"].reached
    assert spark.range(1).select(whatif.bar(F.lit(0.42))).first()[0] == "█" * 4 + "░" * 6


def test_heuristic_plan_is_narrow(spark):
    df = spark.createDataFrame([("p", "## Intro\none two")], "paper_id string, md string")

    def plan_of(options):
        review = evaluate_papers(df, options=options)
        return review.evaluations._jdf.queryExecution().executedPlan().toString()

    plan = plan_of(Options(distinct_ids=True))
    for word in ("Exchange", "Join", "CartesianProduct", "Python", "Window"):
        assert word not in plan
    # Making ids distinct is the one exchange of the default.
    plan = plan_of(Options())
    assert plan.count("Exchange") == 1
    for word in ("Join", "CartesianProduct", "Python", "Window"):
        assert word not in plan
