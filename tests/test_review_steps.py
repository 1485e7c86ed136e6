"""Steps of a review that store or read once what several later steps need."""

import pytest
from pyspark.sql import functions as F

from peerlight.operators import entailment, inference
from peerlight.operators.joins import attach_by_config
from peerlight.session import stage_buckets
from tests.test_model_calls import _exchanged, _requests, _setting


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_by_config_leave_a_bucketed_table_in_place(spark, how):
    pairs = [(f"p{i}", c) for i in range(20) for c in ("a", "b", None)]
    wide = spark.createDataFrame([(p, c, f"text {p}") for p, c in pairs], "paper_id string, config_id string, body string")
    wide = stage_buckets(wide, "wide", f"test-config-{how}", "paper_id")
    # p0 has no rows, (p1, b) none, (p2, a) two.
    rows = [(p, c, 1) for p, c in pairs if p != "p0" and (p, c) != ("p1", "b")] + [("p2", "a", 2)]
    right = spark.createDataFrame(rows, "paper_id string, config_id string, n int")
    got = attach_by_config(wide, right, how)
    want = wide.join(right, ["paper_id", "config_id"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    with _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        assert not any("body" in c for c in _exchanged(attach_by_config(wide, right, how)))


def test_rows_in_buckets_are_stored_without_an_exchange(spark):
    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("paper_id"), "id")
    first = stage_buckets(rows, "first", "test-dealt", "paper_id")
    again = stage_buckets(first.withColumn("twice", F.col("id") * 2), "again", "test-dealt", "paper_id", dealt=True)
    with _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        both = first.join(again.select("paper_id", "twice"), "paper_id")
        assert not _exchanged(both)
    assert sorted(r.twice for r in both.collect()) == [2 * i for i in range(40)]


def test_prompts_asked_once_are_not_exchanged(spark):
    asked = _requests(spark, 4_000)  # every prompt twice
    single = asked.dropDuplicates(["cache_key"])
    answered = single.filter(F.col("unit_id").cast("int") % 2_000 >= 1_900).select("cache_key")
    for rows in (single, asked):
        todo = inference.missing_requests(rows, answered, None)
        assert sorted(r.prompt for r in todo.collect()) == sorted(f"prompt {i}" for i in range(1_900))
        # One side makes doubtful requests distinct, the other passes the rest from where they are.
        alone, shared = todo._jdf.queryExecution().analyzed().toString().split("Union")[1].split("Aggregate [cache_key")
        assert "doubtful" in alone and "Join" not in alone.split(":- ")[1].split("+- ")[0] and "doubtful" in shared


def test_texts_of_pairs_stay_behind_the_join_with_verdicts(spark):
    pairs = spark.createDataFrame(
        [("p", f"claim-{i}", 0, "ref-1", "scores improve greatly", None if i == 0 else "scores improve greatly here") for i in range(4)],
        "paper_id string, claim_id string, ref_pos int, ref_id string, claim_text string, abstract string",
    )
    said = spark.createDataFrame(
        [("p", "claim-1", 0, "ref-1", '{"supported": false, "confidence": 0.9}')],
        "paper_id string, claim_id string, ref_pos int, ref_id string, text string",
    )
    with _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = entailment.entailment(pairs, said)
        assert not any("abstract" in c.replace("no_abstract", "") or "claim_text" in c for c in _exchanged(out))
        plain = sorted(out.collect())
    assert [r.method for r in plain] == ["no_abstract", "llm", "keyword", "keyword"]
    assert sorted(entailment.entailment(entailment.judged(pairs), said).collect()) == plain
