"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlight.llm.common import Shipped, bounded_batches, documents, fold, settle

#: Lengths of the n-grams and places they are hashed to; texts handled at a time.
ORDERS, BITS, TEXTS = (4, 5), 18, 64
#: The ratios count at most so many labelled ids of each class, the weights are learned from at
#: most so many of those; both are taken in the order of a hash of the ids.
RATIO_ROWS, ROWS_PER_CLASS = 50_000, 5_000
#: Places with the clearest log-count ratios (in standard errors) become features.
FEATURES, CLEAR, SMOOTHING = 8_192, 4.0, 0.5
STEPS, RATE, PENALTY = 200, 0.1, 5e-4


@dataclass
class Toxicity:
    weight: np.ndarray  # of each hashed place; zero where it is no feature
    bias: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(margin + self.bias, -500, 500)))


def ngrams(texts: list[str | None], wanted: np.ndarray | None = None):
    """Distinct (text, place) pairs of the lower-cased n-grams, sorted by text and place.

    With ``wanted`` (a flag per place), only these places.
    """
    joined = "\0".join((t or "").lower().replace("\0", " ") for t in texts)
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    text = np.cumsum(flat == 0)
    owners, places = [], []
    for n in ORDERS:
        count = len(flat) - n + 1
        if count <= 0:
            continue
        code = np.full(count, n, dtype=np.uint32)
        for i in range(n):
            code = (code ^ (code >> np.uint32(15))) * np.uint32(2_654_435_761)
            code += flat[i : i + count]
        code = (code ^ (code >> np.uint32(13))) * np.uint32(2_246_822_519)
        place = (code >> np.uint32(32 - BITS)).astype(np.int64)
        inside = text[:count] == text[n - 1 :]
        inside &= flat[:count] != 0
        if wanted is not None:
            inside &= wanted[place]
        owners.append(text[:count][inside])
        places.append(place[inside])
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique((np.concatenate(owners) << BITS) | np.concatenate(places))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _labelled(labels: DataFrame, label: str) -> DataFrame:
    """One row per id: doc_id and label (the larger one, where an id has both)."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` ids of each class, in hash order."""
    sides = [
        rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for c in (0, 1)
    ]
    return settle(sides[0].union(sides[1]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Toxicity | None:
    """Ratios and weights from bounded samples of labelled rows; None if a class has no row.

    Rows that repeat an id count one by one in the ratios; the sample has one text of each id,
    the smallest.
    """
    told = _sample(_labelled(labels, label), RATIO_ROWS)
    bounded_batches(docs.sparkSession)
    # At most 2 x RATIO_ROWS ids go to the texts, not the texts to them.
    known = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id")
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if any(not sizes.get(c) for c in (0, 1)):
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                owner, place = ngrams(part.column("text").to_pylist())
                side = part.column("label").to_numpy()[owner]
                for c in (0, 1):
                    sums[c] += np.bincount(place[side == c], minlength=1 << BITS)
        used = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(sums[0][used]), pa.array(sums[1][used])],
            names=["place", "n0", "n1"],
        )

    counts = (
        known.select("text", "label")
        .mapInArrow(count, "place int, n0 long, n1 long")
        .groupBy("place")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    p = [F.col(f"n{c}") + SMOOTHING for c in (0, 1)]
    ratio = F.log(p[1] / (sizes[1] + 2 * SMOOTHING)) - F.log(p[0] / (sizes[0] + 2 * SMOOTHING))
    clear = F.abs(ratio) / F.sqrt(1 / p[0] + 1 / p[1])
    chosen = (
        counts.select("place", ratio.alias("ratio"), clear.alias("clear"))
        .where(F.col("clear") > CLEAR)
        .orderBy(F.desc("clear"), "place")
        .limit(FEATURES)
        .toPandas()
    )
    ratios = np.zeros(1 << BITS)
    ratios[chosen["place"].to_numpy(np.int64)] = chosen["ratio"].to_numpy(np.float64)
    wanted = ratios != 0

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                owner, place = ngrams(part.column("text").to_pylist(), wanted)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], names=["label", "places"])

    # At most 2 x ROWS_PER_CLASS rows of at most FEATURES places.
    drawn = docs.select("doc_id", "text").join(F.broadcast(_sample(told, ROWS_PER_CLASS)), "doc_id")  # bounded above
    texts = drawn.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
    rows = texts.mapInArrow(present, "label int, places array<int>").toArrow()
    return Toxicity(*_fit(rows, ratios))


def _fit(rows: pa.Table, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge penalty on features valued at their ratios.

    Classes weigh the same whatever their sizes, so a score is the chance of label 1 where both
    are equally common: rare labels are not held to a stricter threshold.
    """
    target = rows.column("label").to_numpy().astype(np.float64)
    lists = rows.column("places").combine_chunks()
    owner = np.repeat(np.arange(len(target)), lists.value_lengths().to_numpy(zero_copy_only=False))
    used = np.flatnonzero(ratios)
    place = np.searchsorted(used, lists.flatten().to_numpy(zero_copy_only=False))
    value = ratios[used][place]
    balance = np.where(target == 1, 0.5 / target.sum(), 0.5 / (len(target) - target.sum()))
    # Parameters: one weight per feature, then the bias; Adam over the whole sample.
    theta, first, second = (np.zeros(len(used) + 1) for _ in range(3))
    for step in range(1, STEPS + 1):
        margin = np.bincount(owner, value * theta[place], len(target)) + theta[-1]
        error = (1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - target) * balance
        slope = np.append(
            np.bincount(place, value * error[owner], len(used)) + PENALTY * theta[:-1], error.sum()
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    weight = np.zeros(len(ratios))
    weight[used] = theta[:-1] * ratios[used]
    return weight, float(theta[-1])


def score(docs: DataFrame, model: Toxicity | None) -> DataFrame:
    """``docs`` with ``score``: probability that a whole text is toxic (0.5 without a model).

    Null and empty texts have no n-grams and get the score of the bias.
    """
    sent = Shipped(docs.sparkSession, model)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        for texts in batches:
            if known is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            wanted = known.weight != 0
            found = [np.zeros(0)]
            for at in range(0, len(texts), TEXTS):
                part = texts.iloc[at : at + TEXTS].tolist()
                owner, place = ngrams(part, wanted)
                found.append(np.bincount(owner, known.weight[place], len(part)))
            yield pd.Series(known.probability(np.concatenate(found)))

    return docs.withColumn("score", run("text"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; learns outside the held-out third.

    Null and empty texts get the score of a text without features; without labels of both classes
    all scores are 0.5; repeated rows are scored one by one, an empty table gives none. Other
    columns of ``docs``, whatever their names, are left out.
    """
    held_out = fold(F.col("doc_id"), 3) == 1
    model = learn(docs, labels.where(~held_out), label)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"),
    )


def op5_toxicity(spark, sf_dir):
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
