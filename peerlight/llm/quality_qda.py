"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlight.llm.common import bounded_batches, documents, fold, settle
from peerlight.llm.text_stats import text_counts

_TEXTS = 256
FEATURES = [
    "length", "word_size", "symbols", "dup_lines", "repeats", "line_size", "variety",
    "same_next", "upper", "digits", "marks", "loud",
]


def statistics(texts: list[str | None]) -> np.ndarray:
    """Transformed statistics (texts x features): logs of sizes, smoothed logits of shares."""
    c = {k: v.astype(np.float64) for k, v in text_counts(texts).items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)

    def logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        # Shares of short texts are drawn to the middle of what one count can say.
        part = np.minimum(part, whole)
        return np.log((part + 0.5) / (whole - part + 0.5 + 0.02 * whole))

    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack(
        [
            np.log1p(words),
            np.log(chars / words),
            np.log(c["n_symbols"] / chars + 0.01),
            np.log(c["n_dup_lines"] / c["n_lines"] + 0.1),
            np.log(c["n_repeat_words"] / words + 0.05),
            np.log1p(words / c["n_lines"]),
            np.log(np.maximum(c["n_distinct"], 1) / words) / np.log(words + 2),
            np.log(c["n_same_next"] / words + 0.02),
            logit(c["n_upper"], letters),
            np.log(c["n_digits"] / chars + 0.01),
            np.log(c["n_marks"] / words + 0.05),
            np.log(c["n_loud"] / words + 0.01),
        ]
    )


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor of the shrunk covariance, log determinant, prior."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class one less that of class zero, priors included."""
        sides = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            whitened = np.linalg.solve(factor, (x - mean).T)
            sides.append(offset - 0.5 * (whitened**2).sum(axis=0))
        return sides[1] - sides[0]


def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float, pool: float):
    """Classes' (count, sum, sum of products) to a discriminant; None with one class only.

    A class covariance is mixed with the pooled one (``pool``) and then with its own mean
    variance on the diagonal (``shrink``), so it has full rank however few rows there are.
    """
    if any(c not in moments or moments[c][0] < 2 for c in (0, 1)):
        return None
    total = sum(m[0] for m in moments.values())
    covariances = {}
    for c, (n, s, ss) in moments.items():
        mean = s / n
        covariances[c] = ss / n - np.outer(mean, mean)
    pooled = sum(moments[c][0] * covariances[c] for c in (0, 1)) / total
    means, factors, offsets = [], [], []
    for c in (0, 1):
        n, s, _ = moments[c]
        mixed = (1 - pool) * covariances[c] + pool * pooled
        mixed = (1 - shrink) * mixed + shrink * (np.trace(mixed) / len(s) + 1e-9) * np.eye(len(s))
        factor = np.linalg.cholesky(mixed)
        means.append(s / n)
        factors.append(factor)
        offsets.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, factors, offsets)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, one double per feature."""

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [np.zeros((0, len(FEATURES)))]
            for at in range(0, len(texts), _TEXTS):
                parts.append(statistics(texts.iloc[at : at + _TEXTS].tolist()))
            yield pd.DataFrame(np.concatenate(parts), columns=FEATURES)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", run("text").alias("f")).select("doc_id", "f.*")


def learn(rows: DataFrame, label: str, shrink: float = 0.02, pool: float = 0.1):
    """Fit on all rows with label 0 or 1; their moments are summed on the cluster."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.sum(f) for f in FEATURES]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]
    found = (
        rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)), *sums, *products)
    ).collect()  # two rows at most
    moments = {}
    for row in found:
        values = np.array(row[2:], dtype=np.float64)
        square = np.zeros((len(FEATURES), len(FEATURES)))
        for (i, j), v in zip(pairs, values[len(FEATURES) :]):
            square[i, j] = square[j, i] = v
        moments[int(row[0])] = (int(row[1]), values[: len(FEATURES)], square)
    return fit(moments, shrink, pool)


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """``rows`` with ``score`` (probability of label 1) in place of the statistics.

    Without a model (a class has no labelled rows) every score is 0.5.
    """

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        odds = model.log_odds(x.to_numpy(np.float64)) if model and len(x) else np.zeros(len(x))
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))))

    return rows.withColumn("score", run(F.struct(*FEATURES))).drop(*FEATURES)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Learns from labelled rows whose fold is not held out; rows with equal ids share labels.
    Null and empty texts get a score from the statistics of an empty text; unlabelled and
    null ids are scored alike; further columns do not enter.
    """
    held_out = fold(F.col("doc_id"), 3) == 1
    rows = settle(features(docs))
    known = labels.where(~held_out).select("doc_id", F.col(label).alias("_label"))
    model = learn(rows.join(known, "doc_id"), "_label")
    return score(rows, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op6_quality(spark, sf_dir):
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
