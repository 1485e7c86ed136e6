"""Pipeline over ``documents``: language, near copies, repeated passages, mixing, tokens.

Every stage takes what its predecessor kept and returns the columns of ``documents``, but for
the last, which returns tokens. Tables between stages are Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight.llm import bpe, langid, mixing, near_copies, suffix_dedup
from peerlight.llm.common import documents, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one language for the most part; those without letters go.

    Null, empty and letterless texts go; repeated rows stay rows of their own; no rows give none.
    """
    return langid.keep_identified(docs, langid.learn(langid.training_rows(docs)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Near copies share 0.8 or more of their five-word shingles; SimHash groups come first, what
    they leave is found by the shingles themselves.
    """
    return near_copies.drop_near_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more stay in the document with the smallest id only.

    Rows stay, with what is left of their text; ``n_chars`` follows it.
    """
    left = suffix_dedup.remove_repeats(docs, as_text=True)
    kind = dict(docs.dtypes).get("n_chars")
    if kind:
        left = left.withColumn("n_chars", F.char_length("text").cast(kind))
    return left.select(*docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target rate gives, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text.

    Null and empty texts have no ids; repeated rows are encoded one by one; no rows give none.
    """
    tok = bpe.load(bpe.default_path())
    rows = bpe.round_trip(docs, tok)
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing_to_weights),
    ("bpe", bpe_tokens),
]

#: SQL has no suffix arrays, mixture inference or merge rounds; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
