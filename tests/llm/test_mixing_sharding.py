import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlight.llm import mixing, sharding


def test_mix_follows_the_rates(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("t"), "id").alias("text"),
        F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"),
    )
    mixed = mixing.mix(docs, {"rare": 1.0, "hot": 1.0})
    counts = dict(mixed.groupBy("source").count().collect())
    # 10,000 copies each are expected: five standard deviations are 500.
    assert abs(counts["rare"] - 10_000) < 500 and abs(counts["hot"] - 10_000) < 500
    per_doc = mixed.where("source = 'rare'").groupBy("doc_id").count().toPandas()["count"]
    for k in range(1, 9):
        expected = 2_000 * math.exp(-5) * 5**k / math.factorial(k)
        assert abs((per_doc == k).sum() - expected) < 6 * math.sqrt(expected)


def test_mix_is_reproducible_and_native(spark, odd_docs):
    first = mixing.mix(odd_docs)
    assert sorted(first.collect(), key=str) == sorted(mixing.mix(odd_docs).collect(), key=str)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix_large_rates_and_weights(spark, odd_docs):
    only = mixing.mix(odd_docs.where("doc_id = 12"), {"c": 1.0}, epochs=2_000.0)
    assert abs(only.count() - 2_000) < 250
    assert mixing.mix(odd_docs, {}).count() == 0
    assert mixing.mix(odd_docs, {"": 1.0}, epochs=20.0).where("source IS NOT NULL AND source != ''").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, {"a": -1.0})


def test_mix_of_nothing(no_docs):
    mixed = mixing.mix(no_docs)
    assert mixed.count() == 0 and {"copy", "shuffle_key"} <= set(mixed.columns)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 65, 1_000, 4_097])
def test_permutation_and_inverse(n):
    places = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(places) == list(range(n))
    assert (sharding.permute(places, n, seed=3, back=True) == np.arange(n)).all()
    assert n < 100 or (places != np.arange(n)).mean() > 0.9


def test_shards_of_odd_rows(spark, odd_docs):
    got = sharding.shards(odd_docs, 5).toPandas()
    rows = odd_docs.collect()
    assert len(got) == len(rows) and sorted(got.row_number) == list(range(len(rows)))
    for shard, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for r in got.itertuples():
        assert sharding.row_at(r.shard, r.slot, len(rows), 5, 11) == r.row_number
    want = sorted(
        (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows
    )
    assert sorted(zip(got["size"], got.text_crc32)) == want


def test_row_numbers_ascend_and_repeats_get_their_own(spark):
    rows = spark.createDataFrame([(5, "x")] * 300 + [(i, "y") for i in range(50)], "doc_id long, text string")
    got = sharding.shards(rows, 7).orderBy("row_number").toPandas()
    assert got.doc_id.is_monotonic_increasing and list(got.row_number) == list(range(350))


def test_shards_of_nothing(no_docs):
    assert sharding.shards(no_docs).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(no_docs, 0)
