"""The log as files: compaction, records by id, fields of records, one pass for the queue."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from peerlight.operators import scoring
from peerlight.operators.parsing import parse_papers
from peerlight.plans.review import Options, heuristic_review
from peerlight.sources import auditlog, compaction


def _rows(spark, papers, run):
    md = "# T\n## Introduction\n" + "word " * 50
    df = spark.createDataFrame([(p, md + p) for p in papers], "paper_id string, md string")
    reviews = heuristic_review(parse_papers(df), ["ieee", "arxiv"], Options(created_at="2024-05-01 00:00:00"))
    return auditlog.log_rows(reviews, run)


def _files(path):
    return glob.glob(f"{path}*/**/*.parquet", recursive=True)


def _ids(log):
    return sorted((r.evaluation_id, r.paper_id, r.run_id) for r in log.select("evaluation_id", "paper_id", "run_id").collect())


def test_compaction_keeps_rows_and_readers(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        auditlog.append_log(_rows(spark, [f"p{k}a", f"p{k}b"], f"run-{k}"), path)
    opened = auditlog.read_log(spark, path)  # a reader from before
    before = _ids(opened)
    first = compaction.compact(spark, path)
    assert first.number == 1 and len(first.folders) == 1 and len(first.replaced) == 4
    assert _ids(auditlog.read_log(spark, path)) == before == _ids(opened)
    assert compaction.compact(spark, path) == first  # nothing new
    # Retried and new runs beside the rewritten folder.
    auditlog.replace_run(_rows(spark, ["p9a"], "run-9"), path)
    auditlog.replace_run(_rows(spark, ["p9a"], "run-9"), path)
    auditlog.replace_run(_rows(spark, ["p3a", "p3b"], "run-3"), path)  # already rewritten
    now = _ids(auditlog.read_log(spark, path))
    assert len(now) == len(before) + 2
    second = compaction.compact(spark, path, most_folders=1)
    assert second.number == 2 and len(second.folders) == 1 and second.folders != first.folders
    assert _ids(auditlog.read_log(spark, path)) == now
    compaction.remove_replaced(spark, path)
    assert _ids(auditlog.read_log(spark, path)) == now
    assert len(_files(path)) <= 1 + 2  # rows / rows_per_file, plus the configs


def test_the_slower_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    auditlog.append_log(_rows(spark, ["a"], "run-0"), path)
    stale = compaction.manifest(spark, path)
    compaction.compact(spark, path)
    auditlog.append_log(_rows(spark, ["b"], "run-1"), path)
    before, files = _ids(auditlog.read_log(spark, path)), len(_files(path))
    monkeypatch.setattr(compaction, "manifest", lambda *_: stale)
    with pytest.raises(RuntimeError):
        compaction.compact(spark, path)
    monkeypatch.undo()
    assert _ids(auditlog.read_log(spark, path)) == before and len(_files(path)) == files


def test_a_record_by_id_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "log")
    wide = spark.range(4_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("evaluation_id"),
        F.concat(F.lit("p"), (F.col("id") * 7919 % 4_000).cast("string")).alias("paper_id"),
        F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("record_json"),
    )
    writer = wide.repartitionByRange(8, "paper_id").sortWithinPartitions("paper_id").write
    compaction.bloom_writer(writer).option("parquet.block.size", "65536").parquet(path)
    asked = wide.filter("paper_id = 'p77'").first().evaluation_id
    found = spark.read.parquet(path).filter(F.col("evaluation_id") == asked)
    assert [r.paper_id for r in found.collect()] == ["p77"]
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = leaves.head().metrics().get("numOutputRows").get().value()
    assert 1 <= read <= 1_000  # the row groups of one file of eight, or of two


def test_fields_of_records_of_any_version(spark):
    old = {"paper_id": "p", "composite": "0.5", "gone": [1, 2]}
    new = {"paper_id": "q", "composite": 0.25, "nested": {"deep": [{"x": 7}]}}
    rows = [("1", json.dumps(old)), ("2", json.dumps(new)), ("3", "no json"), ("4", None)]
    log = spark.createDataFrame(rows, "evaluation_id string, record_json string")
    fields = {"paper": "$.paper_id string", "composite": "$.composite double", "x": "$.nested.deep[0].x int"}
    got = {r.evaluation_id: tuple(r)[1:] for r in auditlog.record_fields(log, fields).collect()}
    assert got == {"1": ("p", 0.5, None), "2": ("q", 0.25, 7), "3": (None, None, None), "4": (None, None, None)}


def test_copies_in_a_log_are_found_on_ids(spark):
    rows = [("a", "x" * 9), ("a", "x" * 9), ("b", "y")]
    log = spark.createDataFrame(rows, "evaluation_id string, record_json string")
    assert sorted(r.evaluation_id for r in auditlog.once(log).collect()) == ["a", "b"]


def test_the_queue_evaluates_the_review_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = "config_id string, paper_id string, triage string, composite double, recommendation string, text string"
    rows = [("c", f"p{i}", "FAIL" if i % 5 == 0 else "PASS", i % 7 / 10, "x", "long text") for i in range(50)]
    review = spark.createDataFrame(rows, schema).mapInPandas(touch, schema)
    got = scoring.triage_queue(review).collect()
    assert seen.value == 50 and len(got) == 50
    want = {r[1]: 1 + sum((q[2] != "FAIL", -q[3]) < (r[2] != "FAIL", -r[3]) for q in rows) for r in rows}
    assert {r.paper_id: r.queue_rank for r in got} == want


def test_long_records_are_rewritten_by_several_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    auditlog.append_log(_rows(spark, [f"p{i}" for i in range(40)], "run-0"), path)
    size = sum(len(r.record_json) for r in auditlog.read_log(spark, path).select("record_json").collect())
    before = _ids(auditlog.read_log(spark, path))
    monkeypatch.setattr(compaction, "BYTES_PER_FILE", size // 4, raising=False)
    name = compaction.compact(spark, path).folders[0]
    parts = spark.read.parquet(f"{path}.compacted/{name}").select(F.input_file_name()).distinct().count()
    assert parts >= 4 and _ids(auditlog.read_log(spark, path)) == before
