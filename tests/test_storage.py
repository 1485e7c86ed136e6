import os
import uuid

import pytest
from pyspark.sql import functions as F

from peerlight import schemas
from peerlight.operators import drafts
from peerlight.operators.parsing import parse_papers
from peerlight.plans.review import Options, evaluate_papers, heuristic_review
from peerlight.sources import auditlog, costs, papers
from peerlight.streaming.intake import reject_stream, review_stream

MD = "# T\n## Abstract\nabs\n## Introduction\nx\n## Method\ny\n## Results\nz\n## Conclusion\nw\n## References\n" + "\n".join(
    f"[{i}] A. (2001). Work {i}. V." for i in range(1, 12)
)


def _evaluations(spark):
    df = spark.createDataFrame([("p1", MD), ("p2", "## Intro\nshort")], "paper_id string, md string")
    return heuristic_review(parse_papers(df), options=Options(created_at="2024-05-01 00:00:00"))


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = auditlog.log_rows(_evaluations(spark), "run")
    auditlog.append_log(rows, path)
    auditlog.append_log(rows, path)  # a retried append
    log = auditlog.once(auditlog.read_log(spark, path))
    assert auditlog.count_records(log).first().n_records == 6
    records = auditlog.scan_records(log).collect()
    assert [r.evaluation_id for r in records] == sorted(r.evaluation_id for r in records)
    assert {r.triage for r in records if r.paper_id == "p2"} == {"FAIL"}
    one = auditlog.load_record(log, records[0].evaluation_id).first()
    assert one.paper_id == records[0].paper_id and one.dimensions[0].max_score > 0
    with pytest.raises(KeyError):
        auditlog.load_record(log, "missing")
    out = str(tmp_path / "out")
    assert auditlog.export_jsonl(log, out) == 6
    assert auditlog.read_records(spark, out).count() == 6
    plan = auditlog.query_scores(auditlog.read_log(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "record_json" not in plan
    assert auditlog.latest_records(log).count() == 6


def test_text_sources(spark, tmp_path):
    for name, text in (("a.md", MD), ("b.txt", "plain"), ("c.bin", "x")):
        (tmp_path / name).write_text(text)
    got = {r.source_name: r for r in papers.read_papers(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"].md == MD and got["a"].paper_id.startswith("md:")
    assert [r.suffix for r in papers.rejected_files(spark, str(tmp_path)).collect()] == ["bin"]
    assert parse_papers(papers.read_papers(spark, str(tmp_path))).filter("title = 'b'").count() == 1


def test_cost_log(spark, tmp_path):
    use = spark.createDataFrame(
        [("a", "claude-sonnet-4-6", 1000000, 100000, "complete"), ("a", "unknown", 5, 5, "complete")],
        "provider string, model string, prompt_tokens bigint, completion_tokens bigint, kind string",
    )
    path = str(tmp_path / "costs")
    costs.append_costs(costs.estimate_cost(use), path)
    total = {r.model: r.cost_usd for r in costs.cost_totals(costs.read_costs(spark, path)).collect()}
    assert total == {"claude-sonnet-4-6": 4.5, "unknown": 0.0, None: 4.5}


def test_artifacts(spark, tmp_path):
    ev = _evaluations(spark)
    drafts.write_artifacts(ev, drafts.review_drafts(ev), str(tmp_path), "2024-05-01")
    back = spark.read.parquet(str(tmp_path / "reviews"))
    assert back.filter("config_id = 'ieee' and slug = 't'").count() == 1
    assert "## Summary" in back.first().value
    text = drafts.comparison_markdown(ev, ["ieee", "arxiv"]).filter("paper_id = 'p1'").first().comparison_md
    assert text.startswith("# Comparison — T\n\n| Metric | ieee | arxiv |\n|---|---|---|\n| Compliance triage |")


def test_review_stream(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    (src / "a.md").write_text(MD)
    (src / "copy.md").write_text(MD)
    log, chk = str(tmp_path / "log"), str(tmp_path / "chk")
    review_stream(spark, str(src), ["arxiv"], log, chk).awaitTermination()
    assert spark.read.parquet(log).count() == 1
    (src / "b.md").write_text("## Intro\nnew")
    review_stream(spark, str(src), ["arxiv"], log, chk).awaitTermination()
    rows = spark.read.parquet(log)
    assert rows.count() == 2 and rows.filter(F.col("compliance_triage") == "FAIL").count() == 1


def test_a_stream_reviews_files_that_carry_old_times(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    (src / "a.md").write_text(MD)
    log, chk = str(tmp_path / "log"), str(tmp_path / "chk")
    review_stream(spark, str(src), ["arxiv"], log, chk).awaitTermination()
    now = (src / "a.md").stat().st_mtime
    for days in (2, 30):
        (src / f"{days}.md").write_text(f"## Intro\nfrom {days} days ago")
        os.utime(src / f"{days}.md", (now - days * 86400,) * 2)
    (src / "copy.md").write_text(MD)
    os.utime(src / "copy.md", (now - 2 * 86400,) * 2)
    review_stream(spark, str(src), ["arxiv"], log, chk).awaitTermination()
    assert spark.read.parquet(log).count() == 3


def test_streams_share_a_log_with_batches(spark, tmp_path):
    log = str(tmp_path / "log")
    for n, name in enumerate(("one/a.MD", "two/deep/er/b.markdown")):
        source = tmp_path / f"in{n}"
        file = source / name
        os.makedirs(file.parent)
        file.write_text(f"## Intro\npaper {n}")
        (source / "c.bin").write_text("x")
        # Two streams with checkpoints of their own, both at batch 0.
        review_stream(spark, str(source), ["arxiv"], log, str(tmp_path / f"chk{n}")).awaitTermination()
        reject_stream(spark, str(source), str(tmp_path / "bad"), str(tmp_path / f"bad{n}")).awaitTermination()
    auditlog.append_log(auditlog.log_rows(_evaluations(spark), "batch run"), log)
    rows = auditlog.read_log(spark, log)
    assert rows.count() == 2 + 6 and rows.select("evaluation_id").distinct().count() == 8
    assert rows.select("run_id").distinct().count() == 3
    assert spark.read.parquet(str(tmp_path / "bad")).select("suffix").distinct().first().suffix == "bin"


def test_copies_of_a_paper_count_once(spark, tmp_path):
    for name in ("a.md", "sub/b.md"):
        file = tmp_path / "in" / name
        os.makedirs(file.parent, exist_ok=True)
        file.write_text(MD)
    two = papers.read_papers(spark, str(tmp_path / "in"))
    assert two.count() == 2 and papers.distinct_papers(two).first().source_name == "a"
    assert papers.paper_paths(two).count() == 2
    got = evaluate_papers(two, ["arxiv"], infer=_claims_model, options=Options(strict_parity=True, run_id=f"t-{uuid.uuid4().hex}"))
    assert got.evaluations.count() == 1 and got.claims.count() == 5
    assert got.evaluations.first().total_claims == 5


def test_answers_are_paid_for_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(requests):
        def answer(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch[["cache_key", "model"]].assign(
                    text="[]", provider="t", prompt_tokens=1, completion_tokens=1, cost_usd=0.0, finish_reason="stop"
                )[["cache_key", "text", "model", "provider", "prompt_tokens", "completion_tokens", "cost_usd", "finish_reason"]]

        return requests.mapInPandas(answer, schemas.RESPONSES)

    df = spark.createDataFrame([("p1", MD), ("p2", MD.replace("abs", "other"))], "paper_id string, md string")
    options = Options(run_id=f"t-{uuid.uuid4().hex}")
    first = evaluate_papers(df, ["arxiv"], infer=model, options=options)
    assert first.evaluations.count() == 2 and first.claims.count() == 0
    once = asked.value
    assert once > 0
    again = evaluate_papers(df, ["arxiv"], infer=model, options=options)
    assert again.evaluations.count() == 2 and asked.value == once


def _claims_model(requests):
    return requests.select(
        "cache_key", F.lit('[{"text": "We can do it", "ref_ids": ["ref-1"]}]').alias("text"), "model", F.lit("t").alias("provider"),
        F.lit(1).cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"),
        F.lit(0.0).alias("cost_usd"), F.lit("stop").alias("finish_reason"),
    )


def test_model_without_catalog_leaves_verification_open(spark):
    def model(requests):
        return requests.select(
            "cache_key", F.lit('[{"text": "We can do it", "ref_ids": ["ref-1"]}]').alias("text"), "model", F.lit("t").alias("provider"),
            F.lit(1).cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"),
            F.lit(0.0).alias("cost_usd"), F.lit("stop").alias("finish_reason"),
        )

    df = spark.createDataFrame([("p1", MD)], "paper_id string, md string")
    with pytest.raises(ValueError):
        evaluate_papers(df, ["arxiv"], infer=model)
    open_ = evaluate_papers(df, ["arxiv"], infer=model, options=Options(run_id=f"t-{uuid.uuid4().hex}"))
    assert open_.claims.count() == 5
    assert open_.evaluations.first().breakdown["verification"] is None
    strict = evaluate_papers(df, ["arxiv"], infer=model, options=Options(strict_parity=True, run_id=f"t-{uuid.uuid4().hex}"))
    row = strict.evaluations.first()
    assert (row.total_claims, row.hallucination_count, row.breakdown["verification"]) == (5, 5, 0.0)
