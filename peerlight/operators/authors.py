"""Paper authors to the best matching identity candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.numbers import round_exact
from peerlight.operators.joins import HOT_ROWS, attach_by_key, key_counts


def name_similarity(query: Column, candidate: Column) -> Column:
    """max(recall on the query, Jaccard) of name words longer than one letter."""
    shared = F.size(F.array_intersect(query, candidate))
    return F.when((F.size(query) == 0) | (F.size(candidate) == 0), F.lit(0.0)).otherwise(
        F.greatest(shared / F.size(query), shared / F.size(F.array_union(query, candidate)))
    )


def match_authors(
    authors: DataFrame, candidates: DataFrame, hot_rows: int = HOT_ROWS, hits: int = 3
) -> DataFrame:
    """(paper_id, queried_name) rows with their best candidate.

    ``candidates`` are search hits per queried name (queried_name, hit_rank, orcid_id,
    candidate, institution), of which the first ``hits`` per name are read. Each distinct name is matched once;
    a name on a third of all papers is joined back with its key split.
    """
    asked = authors.withColumn("name_key", T.blank_to_null(T.strip(F.col("queried_name"))))
    keys = key_counts(asked, "name_key")
    found = (
        candidates.filter(
            (F.coalesce("candidate", F.lit("")) != "") & (F.col("hit_rank") < hits)
        )
        .withColumn("name_key", T.strip(F.col("queried_name")))
        .withColumn(
            "score",
            name_similarity(T.name_words(F.col("name_key")), T.name_words(F.col("candidate"))),
        )
        .filter(F.col("score") >= P.AUTHOR_MATCH_FLOOR)
    )
    best = found.groupBy("name_key").agg(
        F.min_by(
            F.struct("orcid_id", F.col("candidate").alias("matched_name"), "institution", "score"),
            F.struct((-F.col("score")).alias("s"), F.col("hit_rank")),
        ).alias("b")
    )
    joined = attach_by_key(
        asked, keys.join(best, "name_key"), keys, "name_key", ["paper_id", "queried_name"],
        hot_rows=hot_rows,
    )
    return joined.select(
        "paper_id",
        "queried_name",
        "b.orcid_id",
        "b.matched_name",
        "b.institution",
        F.coalesce(round_exact(F.col("b.score")), F.lit(0.0)).alias("confidence"),
    )
