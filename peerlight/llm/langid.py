"""Language identification by mixture inference over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlight.llm.common import Shipped, bounded_batches, documents, fold, settle

#: Byte trigrams are hashed to this many places; a unit is this many consecutive trigrams.
BITS, UNIT = 15, 24
#: More languages than this are refused: the model is sent to every executor.
MAX_LANGUAGES = 256
#: Expectation-maximisation rounds per language set, smoothing count, texts held at a time.
ROUNDS, SMOOTHING, TEXTS = 12, 0.5, 256

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# Lower case, and one blank for ASCII that is no letter.
_FOLDED = bytes(
    (c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


@dataclass
class Languages:
    """Log probability of each hashed trigram (rows) in each language (columns)."""

    names: list[str]
    log_p: np.ndarray


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, blank-padded at both ends, and how many each text has."""
    raw = [b" " + (t or "").encode("utf-8", "replace").translate(_FOLDED) + b" " for t in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    if not len(flat):
        return np.zeros(0, dtype=np.int64), sizes
    code = (flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:]
    code = (code * np.uint32(2_654_435_761)) >> np.uint32(32 - BITS)
    # Trigrams do not reach over the end of a text.
    last = np.cumsum(sizes)[:-1]
    inside = np.ones(len(code), dtype=bool)
    inside[np.concatenate([last - 1, last - 2])] = False
    return code[inside].astype(np.int64), sizes - 2


def learn(docs: DataFrame) -> Languages:
    """Trigram counts per language over all rows of (text, lang), summed on the cluster."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                own = sums.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                for at in range(0, len(texts), TEXTS):
                    grams, _ = trigrams(texts.iloc[at : at + TEXTS].tolist())
                    own += np.bincount(grams, minlength=1 << BITS)
        for lang, own in sums.items():
            places = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(places), pa.string()),
                    pa.array(places.astype(np.int32)),
                    pa.array(own[places]),
                ],
                names=["lang", "place", "n"],
            )

    rows = docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = settle(
        rows.mapInArrow(count, "lang string, place int, n long")
        .groupBy("lang", "place")
        .agg(F.sum("n").alias("n"))
    )
    names = [r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    total = np.full((1 << BITS, len(names)), SMOOTHING)
    # One row for each language, with one entry for each of 2**BITS places at most.
    lists = counts.groupBy("lang").agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n"))
    column = {name: i for i, name in enumerate(names)}
    for r in lists.toLocalIterator():
        total[r.place, column[r.lang]] += r.n
    return Languages(names, np.log(total / total.sum(axis=0)).astype(np.float32))


def mixtures(like: np.ndarray, sizes: np.ndarray, active: np.ndarray, share: np.ndarray):
    """EM over units: shares of the languages in ``active`` and log likelihood per text.

    ``like`` is the likelihood of each unit per language, scaled to a maximum of one;
    ``sizes`` the units of each text (one at least).
    """
    starts = np.cumsum(sizes) - sizes
    share = np.where(active, np.maximum(share, 1e-6), 0.0)
    share /= share.sum(axis=1, keepdims=True)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(ROUNDS):
        weight = like * share[text]
        weight /= weight.sum(axis=1, keepdims=True)
        share = np.add.reduceat(weight, starts, axis=0) / sizes[:, None]
    fit = np.log(np.maximum((like * share[text]).sum(axis=1), 1e-300))
    return share, np.add.reduceat(fit, starts)


def infer(texts: list[str | None], model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions per text (texts x languages), and which texts have none.

    Starts from the languages that are likeliest for some unit and drops the smallest share as
    long as the likelihood penalised by half log(units) for each language does not fall.
    """
    count = len(model.names)
    share = np.zeros((len(texts), count))
    lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], dtype=bool)
    if not lettered.any() or not count:
        return share, ~lettered
    grams, n_grams = trigrams([t for t, ok in zip(texts, lettered) if ok])
    n_units = np.maximum(1, n_grams // UNIT)
    first_gram = np.repeat(np.cumsum(n_grams) - n_grams, n_units)
    first_unit = np.repeat(np.cumsum(n_units) - n_units, n_units)
    begin = first_gram + (np.arange(n_units.sum()) - first_unit) * UNIT  # last takes the rest
    log_like = np.add.reduceat(model.log_p[grams], begin, axis=0).astype(np.float64)
    like = np.exp(np.maximum(log_like - log_like.max(axis=1, keepdims=True), -600.0))
    text = np.repeat(np.arange(len(n_units)), n_units)
    active = np.zeros((len(n_units), count), dtype=bool)
    active[text, like.argmax(axis=1)] = True
    best, fit = mixtures(like, n_units, active, active.astype(float))
    open_ = np.flatnonzero(active.sum(axis=1) > 1)
    while open_.size:
        units = np.flatnonzero(np.isin(text, open_)) if len(open_) < len(n_units) else slice(None)
        smaller = active[open_].copy()
        smallest = np.where(smaller, best[open_], np.inf).argmin(axis=1)
        smaller[np.arange(len(open_)), smallest] = False
        less, less_fit = mixtures(like[units], n_units[open_], smaller, best[open_])
        better = less_fit + 0.5 * np.log(n_units[open_] + 1) >= fit[open_]
        taken = open_[better]
        active[taken], best[taken], fit[taken] = smaller[better], less[better], less_fit[better]
        open_ = taken[active[taken].sum(axis=1) > 1]
    share[lettered] = best
    return share, ~lettered


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_set`` (the languages it is made of).

    lang_pred has the largest proportion (the first name of equals) and score is that
    proportion. Texts that are null or have no letter, and all texts if nothing was learned,
    get ``und`` and score 0. Input columns of these names are replaced; others pass through.
    """
    sent = Shipped(docs.sparkSession, model)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, lang_set array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        names = np.array([*known.names, UNKNOWN], dtype=object)
        for texts in batches:
            found = [(np.zeros(0, dtype=object), np.zeros(0), [])]
            for at in range(0, len(texts), TEXTS):
                share, none = infer(texts.iloc[at : at + TEXTS].tolist(), known)
                none |= not known.names
                top = share.argmax(axis=1) if known.names else np.zeros(len(share), dtype=int)
                score = share.max(axis=1, initial=0.0)
                top[none] = len(names) - 1
                sets = [[known.names[i] for i in np.flatnonzero(s > 0)] for s in share]
                found.append((names[top], np.where(none, 0.0, np.minimum(score, 1.0)), sets))
            yield pd.DataFrame(
                {
                    "lang_pred": np.concatenate([x[0] for x in found]),
                    "score": np.concatenate([x[1] for x in found]),
                    "lang_set": [s for x in found for s in x[2]],
                }
            )

    docs = docs.drop("lang_pred", "score", "lang_set", "_found")
    kept = docs.columns
    return docs.withColumn("_found", run("text")).select(*kept, "_found.*")


def keep_identified(docs: DataFrame, model: Languages, least: float = 0.5) -> DataFrame:
    """Rows whose language was found and makes up ``least`` of the text or more."""
    found = predict(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(
        *docs.columns
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: a known language and an id outside the held-out quarter."""
    return docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 4) != 2))


def op8_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), learn(training_rows(docs)))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )
