"""Requests that are not asked twice, and section texts that are not moved."""

import collections
import contextlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlight.operators import bloom, claims, inference
from peerlight.operators.parsing import parse_papers
from peerlight.session import stage_buckets


def _requests(spark, n):
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("unit_id"), F.lit("p").alias("paper_id"),
        F.concat(F.lit("prompt "), (F.col("id") % (n // 2)).cast("string")).alias("prompt"),
    )
    return inference.request_rows(rows, kind="k", system=None, model="m", max_tokens=5)


@contextlib.contextmanager
def _setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _exchanged(df):
    """Column lists that the exchanges of a plan carry."""
    return re.findall(r"\(\d+\) (?:BroadcastExchange|Exchange)\nInput \[\d+\]: \[([^\]]*)\]", _plan(df))


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(5_000).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.sql("SELECT NULL"))
    words = bloom.key_filter(keys, "key")
    assert words.dtype == np.uint64 and len(words) & (len(words) - 1) == 0
    other = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key"))
    held = lambda df: df.filter(bloom.may_hold(df, "key", words)).count()
    assert held(keys) == 5_000 and held(other) < 0.03 * 20_000
    none = bloom.key_filter(keys.limit(0), "key")
    assert keys.filter(bloom.may_hold(keys, "key", none)).count() == 0


def test_a_full_filter_only_lets_more_pass(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BITS", 128)
    asked = _requests(spark, 400)
    cache = asked.filter(F.col("unit_id").cast("int") % 200 >= 100).select("cache_key")
    got = {r.prompt for r in inference.missing_requests(asked, cache, None).collect()}
    assert got == {f"prompt {i}" for i in range(100)}


def test_answered_prompts_are_dropped_before_the_exchange(spark):
    asked = _requests(spark, 4_000)
    cache = asked.filter(F.col("unit_id").cast("int") % 2_000 >= 50).select("cache_key")
    missing = inference.missing_requests(asked, cache)
    assert missing.count() == 50
    with _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = _plan(inference.missing_requests(asked, cache))
        moved = [c for c in _exchanged(inference.missing_requests(asked, cache)) if "prompt" in c or "first" in c]
    assert len(moved) == 1  # the distinct requests, behind the filter
    assert plan.index("ArrowEvalPython") < len(plan)
    words = bloom.key_filter(asked.select("cache_key").distinct().join(cache, "cache_key", "left_anti"), "cache_key")
    assert asked.filter(bloom.may_hold(asked, "cache_key", words)).count() < 100 + 0.03 * 4_000


def test_a_run_that_dies_repeats_one_chunk_at_most(spark, tmp_path):
    calls, journal = str(tmp_path / "calls"), str(tmp_path / "journal")
    asked = inference.distinct_requests(_requests(spark, 200)).repartition(3)

    def factory(fail_at):
        def start():
            asked_here = []

            def answer(batch):
                asked_here.append(len(batch))
                with open(calls, "a") as f:
                    f.write("".join(k + "\n" for k in batch["cache_key"]))
                if len(asked_here) == fail_at:
                    raise RuntimeError("executor lost")
                return batch[["cache_key"]].assign(
                    text=batch["prompt"].str.upper(), model="m", provider="p", prompt_tokens=1,
                    completion_tokens=1, cost_usd=0.0, finish_reason="stop",
                )

            return answer

        return start

    with pytest.raises(Exception, match="executor lost"):
        inference.run_model(asked, factory(4), journal=journal, chunk=5).collect()
    before = collections.Counter(open(calls).read().split())
    kept = inference.journal_responses(spark, journal)
    assert 0 < kept.count() < 100 and set(before.values()) == {1}
    got = inference.run_model(asked, factory(0), journal=journal, chunk=5).collect()
    assert sorted(r.text for r in got) == sorted(f"PROMPT {i}" for i in range(100))
    times = collections.Counter(open(calls).read().split())
    lost = {r.cache_key for r in asked.collect()} - {r.cache_key for r in kept.collect()}
    # Only requests of chunks that were under way are asked twice: one chunk of 5 a task at most.
    assert len(times) == 100 and max(times.values()) <= 2
    assert sum(v == 2 for v in times.values()) <= 5 * 4 and {k for k, v in times.items() if v == 2} <= lost
    # A later run, cut differently, takes the journal for its cache and asks nothing.
    rest = inference.missing_requests(_requests(spark, 200), inference.journal_responses(spark, journal))
    assert rest.count() == 0
    assert inference.journal_responses(spark, str(tmp_path / "none")).count() == 0


def test_section_texts_are_not_exchanged(spark):
    md = "# T\n## Introduction\nWe improve by 3 %. See [1].\n## Method\nAll is new here.\n## References\n[1] A. (2001). W. V."
    papers = spark.createDataFrame([(f"p{i}", md) for i in range(8)], "paper_id string, md string")
    parsed = stage_buckets(parse_papers(papers), "parsed", "test-buckets", "paper_id")
    raw = spark.createDataFrame(
        [(f"p{i}", o, k, t, ["ref-1", "ref-9"]) for i in range(9) for o in (0, 1, 7)
         for k, t in enumerate(["We improve by 3 %.", "All is new here.", "nowhere to be found"])],
        "paper_id string, ord int, item_pos int, text string, ref_ids array<string>",
    )
    with _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        built = claims.build_claims(raw, parsed)
        lists = _exchanged(built)
        rows = built.collect()
        plain = claims.build_claims(raw, parse_papers(papers)).collect()
    assert lists and not any("sections" in c for c in lists)
    assert sorted(rows) == sorted(plain) and {r.paper_id for r in rows} == {f"p{i}" for i in range(8)}
    hit = next(r for r in rows if r.paper_id == "p0" and r.text == "All is new here." and r.section_id == rows[0].section_id or r.text == "All is new here.")
    assert hit.ref_ids == ["ref-1"]
    placed = claims.locate_span(claims.known_refs(claims.number_claims(raw), parsed), claims.sections_of(parsed))
    spans = {(r.paper_id, r.claim_id): (r.char_start, r.char_end, r.section_id) for r in placed.collect()}
    assert {(r.paper_id, r.claim_id): (r.char_start, r.char_end, r.section_id) for r in rows} == spans


def test_journal_answers_whatever_the_plan_and_the_batches(spark, tmp_path):
    def model():
        return lambda batch: batch[["cache_key", "model"]].assign(
            text=batch["prompt"], provider="p", prompt_tokens=1, completion_tokens=1, cost_usd=0.0, finish_reason="stop"
        )

    def again():
        raise RuntimeError("asked again")

    journal = str(tmp_path / "journal")
    asked = _requests(spark, 2000).dropDuplicates(["cache_key"])
    with _setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
        assert inference.run_model(asked, model, journal=journal).count() == 1000
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "100"):
        with _setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            got = inference.run_model(asked, again, journal=journal)
            assert got.select("cache_key").distinct().count() == 1000


def test_models_get_bounded_batches(spark):
    def model():
        return lambda batch: batch[["cache_key", "model"]].assign(
            text="", provider="p", prompt_tokens=len(batch), completion_tokens=1, cost_usd=0.0, finish_reason="stop"
        )

    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"):
        asked = _requests(spark, 5000).coalesce(1)
        for got in (inference.run_chain(asked, [("m", model)]), inference.run_model(asked, model)):
            assert got.agg(F.max("prompt_tokens")).first()[0] <= 1000 and got.count() == 5000
