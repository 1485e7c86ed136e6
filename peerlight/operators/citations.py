"""Citation existence: references against the bibliographic catalog.

Every distinct DOI, arXiv id and title is resolved once (keys are pre-aggregated map-side)
and the answer is joined back to the references, with hot keys split. Title search is a
prefix-filtered set-similarity join: no cross join, no cap on candidates.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.numbers import year_closeness
from peerlight.functions.rows import each, settled
from peerlight.operators.joins import HOT_ROWS, attach_by_key, key_counts
from peerlight.operators.title_index import (
    TitleIndex,
    contained_titles,
    index_titles,
    meet,
    top_titles,
    words_in_order,
)
from peerlight.session import stage

KEY_RANK = {"doi": 0, "arxiv": 1, "title": 2, "entry": 3}
META = ["title", "authors", "year", "venue", "doi"]
HIT = (
    "array<struct<source_rank:int,key_rank:int,source:string,catalog_id:string,similarity:double,"
    "meta:struct<title:string,authors:array<string>,year:int,venue:string,doi:string>>>"
)
FAILED = "array<struct<source_rank:int,key_rank:int>>"


def _meta() -> Column:
    return F.struct(*[F.col(c) for c in META])


def _rank_of(source: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in P.SOURCE_RANKS.items() for x in kv])
    return F.try_element_at(ranks, source)


def _tagged(kind: str, value: Column) -> Column:
    """Lookup key as ``kind:value``; NULL when there is no value."""
    return F.concat(F.lit(f"{kind}:"), value)


def search_words(title: Column) -> Column:
    """Distinct words of a title in any script, for the search (scores keep ASCII words)."""
    return F.array_distinct(words_in_order(title))


def title_key(title: Column) -> Column:
    """Sorted distinct title words as one text; NULL when there are none."""
    return T.let(
        F.array_sort(search_words(title)),
        lambda w: F.when(F.size(w) > 0, F.array_join(w, " ")),
    )


def ref_keys(refs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(paper_id, ref_id, key): one row per lookup key of a reference.

    DOIs are compared without case. The title search asks for the title. An entry without a
    year has no title of its own: its whole raw text, never a prefix of it, is searched as a set
    of words like a title, and as an entry that may hold a title between authors and venue. A
    reference without any key keeps one row with a NULL key.
    """
    wanted = kinds or list(KEY_RANK)
    undated = F.col("year").isNull()
    title = F.when(undated, F.coalesce(T.blank_to_null(F.col("raw")), F.col("title"))).otherwise(
        F.coalesce(T.blank_to_null(F.col("title")), F.col("raw"))
    )
    entry = T.let(
        words_in_order(F.when(undated, F.coalesce("raw", "title"))),
        lambda w: F.when(F.size(w) > 0, F.array_join(w, " ")),
    )
    known = {
        "doi": _tagged("doi", F.lower(F.col("doi"))),
        "arxiv": _tagged("arxiv", F.lower(F.col("arxiv_id"))),
        "title": _tagged("title", title_key(title)),
        "entry": _tagged("entry", entry),
    }
    keys = F.array_compact(F.array(*[known[k] for k in wanted]))
    return settled(refs.select("paper_id", "ref_id", F.explode_outer(keys).alias("key")))


def catalog_keys(catalog: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(key, source, catalog_id): per source the row with the smallest id holds a key.

    Only Semantic Scholar rows are found by arXiv id.
    """
    wanted = kinds or list(KEY_RANK)
    known = {
        "doi": _tagged("doi", F.lower(F.col("doi"))),
        "arxiv": F.when(
            F.col("source") == "semantic_scholar", _tagged("arxiv", F.lower(F.col("arxiv_id")))
        ),
        "title": _tagged("title", title_key(F.col("title"))),
    }
    # An entry is no key of a title: it is searched for titles inside it.
    known["entry"] = F.lit(None).cast("string")
    keys = F.array_compact(F.array(*[known[k] for k in wanted]))
    return (
        each(catalog, ["source", "catalog_id"], keys, "key")
        .groupBy("key", "source")
        .agg(F.min("catalog_id").alias("catalog_id"))
    )


# --- title search -----------------------------------------------------------


#: A block whose pairs of query and title exceed this is split into groups of its root squared.
BLOCK_PAIRS = 1_000_000


def rare_first(keys: DataFrame, titles: DataFrame) -> DataFrame:
    """(key, words): the words of every title key, those in fewest catalog titles first.

    Frequencies are counted once over the distinct catalog keys and joined to the words, with
    words that are in many titles split over salts.
    """
    words = F.explode(F.split(F.substring_index("key", ":", -1), " ")).alias("word")
    rows = keys.select("key").distinct().select("key", words)
    counts = key_counts(rows, "word")
    known = titles.select("key").distinct().select(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_titles")
    )
    found = counts.join(known, "word", "left").select(
        "word", "key_rows", F.coalesce("n_titles", F.lit(0)).alias("n_titles")
    )
    placed = attach_by_key(rows, found, counts, "word", ["key"], how="inner")
    ordered = F.array_sort(F.collect_list(F.struct("n_titles", "word")))
    return placed.groupBy("key").agg(F.transform(ordered, lambda x: x["word"]).alias("words"))


def prefix_of(words: Column, min_similarity: float) -> Column:
    """The rarest words, of which two sets that reach the Jaccard floor share two.

    With floor s > 0.5, sets of two or more words overlap in ceil(s * size) >= 2 words at
    least, so prefixes of size - ceil(s * size) + 2 words share two of them.
    """
    n = F.size(words)
    return F.slice(words, F.lit(1), n - F.ceil(n * F.lit(min_similarity) - F.lit(1e-9)).cast("int") + 2)


def _pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def block_keys(prefix: Column) -> Column:
    """All pairs of the prefix words, in their order."""
    return F.flatten(
        F.transform(
            prefix,
            lambda a, i: F.transform(
                F.slice(prefix, i + 2, F.size(prefix)), lambda b: _pair(a, b)
            ),
        )
    )


def similar_titles(asked: DataFrame, titles: DataFrame, floor: float) -> DataFrame:
    """(key, source, catalog_id, similarity) of similar but unequal title sets.

    ``asked`` has (key, below): only sources ranked before ``below`` are searched. Sets meet on
    a shared pair of rare words and must fit in size; the exact Jaccard decides. A pair of
    sets is compared once, at its first shared block; a block with many sets on both sides is
    split into bounded groups. No candidate is capped or sampled. Sets of one word can only
    equal each other and take no part.
    """
    several = F.contains("key", F.lit(" "))
    queries = asked.select("key", "below").filter(several)
    held = titles.select("source", "catalog_id", "key").filter(several)
    order = rare_first(queries.select("key").union(held.select("key")), held)
    # A query longer than any title allows cannot match; it would make many blocks.
    size = lambda c: F.size(F.split(F.substring_index(c, ":", -1), " "))
    longest = held.agg(F.coalesce(F.max(size(F.col("key"))), F.lit(0)).alias("n"))
    q = (
        queries.filter(size(F.col("key")) * floor <= longest.scalar() + 1e-9)
        .join(order, "key")
        .select("key", "below", F.col("words").alias("q_words"), prefix_of(F.col("words"), floor).alias("q_prefix"))
    )
    c = held.join(order, "key").select(
        "source", "catalog_id", _rank_of(F.col("source")).alias("rank"), F.col("key").alias("c_key"),
        F.col("words").alias("c_words"), prefix_of(F.col("words"), floor).alias("c_prefix"),
    )
    q = each(q, q.columns, block_keys(F.col("q_prefix")), "block")
    c = each(c, c.columns, block_keys(F.col("c_prefix")), "block")
    shared = F.array_intersect("q_prefix", "c_prefix")
    fits = (
        (F.col("block") == _pair(F.get(shared, F.lit(0)), F.get(shared, F.lit(1))))
        & (F.col("key") != F.col("c_key"))
        & (F.col("rank") < F.col("below"))
        & (F.size("q_words") * floor <= F.size("c_words") + 1e-9)
        & (F.size("c_words") * floor <= F.size("q_words") + 1e-9)
    )
    return (
        meet(q, c, "block", ["key"], ["source", "catalog_id"], BLOCK_PAIRS)
        .filter(fits)
        .select(
            "key", "source", "catalog_id",
            T.jaccard(F.col("q_words"), F.col("c_words")).alias("similarity"),
        )
        .filter(F.col("similarity") >= floor)
    )


def resolve_keys(
    keys: DataFrame,
    catalog: DataFrame,
    kinds: list[str] | None = None,
    min_similarity: float = 0.6,
    prune: bool = False,
    held: DataFrame | None = None,
) -> DataFrame:
    """(key, hits, key_rows) for every distinct key some source can answer.

    A title set that a source holds verbatim is a perfect hit there. With ``prune``, sources
    after the first perfect one are not searched for it: the cascade would not get to them.
    ``held`` is ``catalog_keys`` of the catalog where they are stored.
    """
    if not 0.5 < min_similarity <= 1.0:
        raise ValueError("min_similarity must be in (0.5, 1]")
    wanted = kinds or list(KEY_RANK)
    held = catalog_keys(catalog, wanted) if held is None else held
    exact = keys.join(held, "key").select(
        "key", "key_rows", "source", "catalog_id", F.lit(1.0).alias("similarity")
    )
    hits = exact
    if "title" in wanted:
        is_title = F.startswith("key", F.lit("title:"))
        n_sources = len(P.SOURCE_RANKS)
        first = exact.filter(is_title).groupBy("key").agg(
            F.min(_rank_of(F.col("source"))).alias("first_rank"),
            F.collect_set("source").alias("covered"),
        )
        asked = keys.filter(is_title).join(first, "key", "left").withColumn(
            "below", F.coalesce("first_rank", F.lit(n_sources)) if prune else F.lit(n_sources)
        )
        open_keys = asked.filter(F.col("below") > 0)
        found = similar_titles(
            open_keys.select("key", "below"), held.filter(is_title), min_similarity
        )
        best = found.groupBy("key", "source").agg(
            F.min_by(
                F.struct("catalog_id", "similarity"),
                F.struct((-F.col("similarity")).alias("s"), F.col("catalog_id")),
            ).alias("b")
        )
        fuzzy = best.join(
            open_keys.select("key", "key_rows", "covered"), "key"
        ).filter(
            ~F.coalesce(F.array_contains("covered", F.col("source")), F.lit(False))
        ).select("key", "key_rows", "source", "b.catalog_id", "b.similarity")
        hits = exact.unionByName(fuzzy)
    if "entry" in wanted:
        hits = hits.unionByName(entry_hits(keys, catalog))
    rows = catalog.select("source", "catalog_id", _meta().alias("meta"))
    kind = F.substring_index("key", ":", 1)
    key_rank = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in KEY_RANK.items() for x in kv]), kind
    )
    hit = F.struct(
        _rank_of(F.col("source")).alias("source_rank"), key_rank.alias("key_rank"), F.col("source"),
        F.col("catalog_id"), F.col("similarity"), F.col("meta"),
    )
    return (
        hits.join(rows, ["source", "catalog_id"])
        .groupBy("key")
        .agg(F.collect_list(hit).alias("hits"), F.max("key_rows").alias("key_rows"))
    )


def entry_hits(keys: DataFrame, catalog: DataFrame, min_share: float = 0.9) -> DataFrame:
    """(key, key_rows, source, catalog_id, similarity): per entry key and source the catalog title
    that stands in the entry, most complete and then longest first; ties: smallest catalog id."""
    entries = keys.filter(F.startswith("key", F.lit("entry:")))
    words = F.split(F.substring_index("key", ":", -1), " ")
    titles = catalog.select("source", "catalog_id", words_in_order(F.col("title")).alias("title_words"))
    found = contained_titles(entries.select("key", words.alias("entry_words")), titles, min_share)
    order = F.struct(
        (-F.col("similarity")).alias("s"), (-F.col("n_words")).alias("n"), F.col("catalog_id")
    )
    best = found.groupBy("key", "source").agg(
        F.min_by(F.struct("catalog_id", "similarity"), order).alias("b")
    )
    return best.join(entries, "key").select("key", "key_rows", "source", "b.catalog_id", "b.similarity")


def top_hits(
    refs: DataFrame, catalog: DataFrame, index: TitleIndex | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per reference and source the title of highest BM25 score, whatever its similarity.

    That is what a search service answers first: (paper_id, ref_id, source, catalog_id, score).
    Query words are those of the title and the first author, or of a whole undated entry;
    references with equal words are searched once. ``index`` is the stored index of the catalog's
    titles; without it one is built within the plan.
    """
    titles = catalog.select("source", "catalog_id", words_in_order(F.col("title")).alias("title_words"))
    first_author = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    asked = F.when(F.col("year").isNull(), F.coalesce("raw", "title")).otherwise(
        F.when(T.blank_to_null(F.col("title")).isNull(), F.col("raw")).otherwise(
            F.concat_ws(" ", F.col("title"), first_author)
        )
    )
    keyed = settled(refs.select("paper_id", "ref_id", title_key(asked).alias("key")))
    keys = key_counts(keyed, "key")
    found = top_titles(
        keys.select("key", F.split("key", " ").alias("words")), index or index_titles(titles), hot_rows
    )
    per_key = found.groupBy("key").agg(F.collect_list(F.struct("source", "catalog_id", "score")).alias("hits"))
    joined = attach_by_key(
        keyed, keys.join(per_key, "key"), keys, "key", ["paper_id", "ref_id"], hot_rows=hot_rows
    )
    return _hit_rows(joined)


def hits_by_key(
    refs: DataFrame,
    catalog: DataFrame,
    kinds: list[str] | None = None,
    min_similarity: float = 0.6,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """References with the hits of each of their keys (paper_id, ref_id, key, hits)."""
    keyed = ref_keys(refs, kinds)
    keys = key_counts(keyed, "key")
    found = resolve_keys(keys, catalog, kinds, min_similarity)
    return attach_by_key(keyed, found, keys, "key", ["paper_id", "ref_id"], hot_rows=hot_rows)


def exact_lookup(refs: DataFrame, catalog: DataFrame, kind: str, **opts) -> DataFrame:
    """Hits under an exact DOI (all sources) or arXiv id: one row per hit."""
    return _hit_rows(hits_by_key(refs, catalog, [kind], **opts))


def title_search(refs: DataFrame, catalog: DataFrame, **opts) -> DataFrame:
    """Per source the most similar title above the floor: one row per hit.

    Distinct token sets stand for all references that share them, so a title cited by a
    third of the corpus is searched once. Ties: smallest catalog id.
    """
    return _hit_rows(hits_by_key(refs, catalog, ["title"], **opts))


def contained_title_search(refs: DataFrame, catalog: DataFrame, **opts) -> DataFrame:
    """Per source the title that stands in an undated entry: one row per hit."""
    return _hit_rows(hits_by_key(refs, catalog, ["entry"], **opts))


def _hit_rows(df: DataFrame) -> DataFrame:
    return each(df, ["paper_id", "ref_id"], "hits", "h").select("paper_id", "ref_id", "h.*")


# --- cascade ----------------------------------------------------------------


def failed_keys(errors: DataFrame) -> DataFrame:
    """(key, failed) from (source, key_kind, key) lookups that were errors."""
    kind = F.col("key_kind")
    key = F.when(kind == "title", title_key(F.col("key"))).otherwise(F.lower("key"))
    rank = F.when(kind == "doi", 0).when(kind == "arxiv", 1).otherwise(2)
    row = F.struct(_rank_of(F.col("source")).alias("source_rank"), rank.alias("key_rank"))
    return (
        errors.select(F.concat(kind, F.lit(":"), key).alias("key"), row.alias("f"))
        .groupBy("key")
        .agg(F.collect_set("f").alias("failed"))
    )


def lookup_refs(
    refs: DataFrame,
    catalog: DataFrame,
    errors: DataFrame | None = None,
    min_similarity: float = 0.6,
    key_major: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One lookup row per reference: status, source and the metadata found.

    The cascade is source-major: the first source with any hit wins, and inside a source
    DOI beats arXiv id beats title beats a title inside an undated entry. ``key_major`` prefers the key kind over the source. A
    source whose lookup errors before it hits counts as errored; only three errored
    sources make the reference an ERROR.

    References are read once and exchanged twice (by key, by reference): their keys, the distinct
    ones among them and those of the catalog are stored, as every kind of search reads them anew.
    """
    run = f"lookup-{uuid.uuid4().hex}"
    keyed = stage(ref_keys(refs), "ref_keys", run)
    keys = stage(key_counts(keyed, "key"), "distinct_keys", run)
    held = stage(catalog_keys(catalog), "catalog_keys", run)
    found = resolve_keys(keys, catalog, None, min_similarity, prune=errors is None, held=held)
    if errors is None:
        found = found.withColumn("failed", F.array().cast(FAILED))
    else:
        bad = keys.join(failed_keys(errors), "key")
        found = found.join(bad.withColumnRenamed("key_rows", "bad_rows"), "key", "full").select(
            "key", "hits", "failed", F.coalesce("key_rows", "bad_rows").alias("key_rows")
        )
    joined = attach_by_key(keyed, found, keys, "key", ["paper_id", "ref_id"], hot_rows=hot_rows)
    # At most four keys with at most three hits each.
    gathered = joined.groupBy("paper_id", "ref_id").agg(
        F.flatten(F.collect_list(F.coalesce("hits", F.array().cast(HIT)))).alias("hits"),
        F.flatten(F.collect_list(F.coalesce("failed", F.array().cast(FAILED)))).alias("failed"),
    )
    # An error under an earlier key hides later hits of the same source.
    valid = F.filter(
        "hits",
        lambda h: ~F.exists(
            "failed",
            lambda f: (f["source_rank"] == h["source_rank"]) & (f["key_rank"] <= h["key_rank"]),
        ),
    )
    order = (
        (lambda h: h["key_rank"] * 10 + h["source_rank"])
        if key_major
        else (lambda h: h["source_rank"] * 10 + h["key_rank"])
    )
    best = T.let(
        valid,
        lambda v: F.get(
            F.array_sort(
                F.transform(v, lambda h: F.struct(order(h).alias("k"), h.alias("h")))
            ),
            F.lit(0),
        )["h"],
    )
    n_failed = F.size(F.array_distinct(F.transform("failed", lambda f: f["source_rank"])))
    picked = gathered.select("paper_id", "ref_id", best.alias("hit"), n_failed.alias("n_failed"))
    status = (
        F.when(F.col("hit").isNotNull(), F.lit("FOUND"))
        .when(F.col("n_failed") == len(P.SOURCE_RANKS), F.lit("ERROR"))
        .otherwise(F.lit("NOT_FOUND"))
    )
    return settled(
        picked.select(
            "paper_id",
            "ref_id",
            status.alias("status"),
            F.coalesce("hit.source", F.lit("none")).alias("source"),
            F.col("hit.meta").alias("meta"),
            F.when(status == "ERROR", F.lit("all sources errored")).alias("error"),
        )
    )


# --- metadata match ---------------------------------------------------------


def title_score(a: Column, b: Column) -> Column:
    no_a, no_b = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
    return (
        F.when(no_a & no_b, F.lit(1.0))
        .when(no_a | no_b, F.lit(0.0))
        .otherwise(T.jaccard(T.title_words(a), T.title_words(b)))
    )


def author_score(a: Column, b: Column) -> Column:
    def names(c: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(c, lambda n: n != ""), T.surname))

    no_a = F.coalesce(F.size(a), F.lit(0)) <= 0
    no_b = F.coalesce(F.size(b), F.lit(0)) <= 0
    return (
        F.when(no_a & no_b, F.lit(1.0))
        .when(no_a | no_b, F.lit(0.0))
        .otherwise(T.jaccard(names(a), names(b)))
    )


def venue_score(a: Column, b: Column) -> Column:
    no_a, no_b = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
    x, y = F.lower(T.strip(a)), F.lower(T.strip(b))
    return (
        F.when(no_a & no_b, F.lit(1.0))
        .when(no_a | no_b, F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(F.contains(y, x) | F.contains(x, y), F.lit(0.7))
        .otherwise(T.jaccard(T.title_words(x), T.title_words(y)))
    )


def match_scores(pairs: DataFrame) -> DataFrame:
    """Adds the four sub-scores, overall, mismatches and match_ok.

    ``pairs`` has the cited fields and ``meta`` with the found ones.
    """
    m = lambda f: F.col(f"meta.{f}")
    scored = pairs.select(
        "*",
        title_score(F.col("title"), m("title")).alias("title_score"),
        author_score(F.col("authors"), m("authors")).alias("author_score"),
        year_closeness(F.col("year"), m("year")).alias("year_score"),
        venue_score(F.col("venue"), m("venue")).alias("venue_score"),
    )
    w = P.MATCH_WEIGHTS
    overall = (
        F.lit(w["title"]) * F.col("title_score")
        + F.lit(w["author"]) * F.col("author_score")
        + F.lit(w["year"]) * F.col("year_score")
        + F.lit(w["venue"]) * F.col("venue_score")
    )
    years_apart = (
        (F.coalesce("year", F.lit(0)) != 0)
        & (F.coalesce(m("year"), F.lit(0)) != 0)
        & (F.abs(F.col("year") - m("year")) > 1)
    )
    mismatches = T.optional_list(
        [
            ((F.coalesce("title", F.lit("")) != "") & (F.col("title_score") < 0.2), F.lit("title")),
            (years_apart, F.lit("year")),
            ((F.size("authors") > 0) & (F.col("author_score") < 0.2), F.lit("author")),
        ]
    )
    out = scored.select("*", overall.alias("overall"), mismatches.alias("mismatches"))
    return out.withColumn(
        "match_ok",
        (F.col("overall") >= P.MATCH_THRESHOLD) & ~F.array_contains("mismatches", F.lit("title")),
    )


def metadata_match(refs: DataFrame, lookups: DataFrame) -> DataFrame:
    """Scores of every FOUND reference (paper_id, ref_id, four scores, overall, ...)."""
    found = lookups.filter("status = 'FOUND'").select("paper_id", "ref_id", "meta")
    cited = refs.select("paper_id", "ref_id", "title", "authors", "year", "venue")
    return match_scores(cited.join(found, ["paper_id", "ref_id"])).select(
        "paper_id", "ref_id", "title_score", "author_score", "year_score", "venue_score",
        "overall", "match_ok", "mismatches",
    )


def temporal_issues(
    refs: DataFrame,
    papers: DataFrame | None = None,
    current_year: int | None = None,
    max_age: int | None = None,
) -> DataFrame:
    """References from the future of their paper, or older than ``max_age`` years.

    ``papers`` optionally gives (paper_id, year); papers without a year use
    ``current_year``; without either there is no check.
    """
    dated = refs.filter(F.col("year").isNotNull()).select(
        "paper_id", "ref_id", F.col("year").alias("ref_year")
    )
    fallback = F.lit(current_year).cast("int")
    if papers is not None:
        years = papers.filter(F.coalesce("year", F.lit(0)) != 0).select(
            "paper_id", F.col("year").alias("_y")
        )
        dated = dated.join(years, "paper_id", "left").withColumn(
            "paper_year", F.coalesce("_y", fallback)
        )
    else:
        dated = dated.withColumn("paper_year", fallback)
    late = F.when(
        F.col("ref_year") > F.col("paper_year"),
        F.format_string(
            "Citation year %d is after paper year %d", F.col("ref_year"), F.col("paper_year")
        ),
    )
    if max_age is not None:
        late = late.when(
            F.col("ref_year") < F.col("paper_year") - max_age,
            F.format_string(
                f"Citation year %d is more than {max_age} years older than paper year %d",
                F.col("ref_year"),
                F.col("paper_year"),
            ),
        )
    return dated.select("paper_id", "ref_id", late.alias("reason"), "ref_year", "paper_year").filter(
        F.col("reason").isNotNull()
    )


def abstracts_by_id(refs: DataFrame, catalog: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Abstract per reference by DOI, else by arXiv id, from the source that carries them."""
    held = catalog.filter(
        (F.col("source") == "semantic_scholar")
        & (F.coalesce(T.strip(F.col("abstract")), F.lit("")) != "")
    )
    out = refs.select("paper_id", "ref_id", "doi", "arxiv_id")
    for kind, column in (("doi", F.lower(F.col("doi"))), ("arxiv", F.lower(F.col("arxiv_id")))):
        name = f"_{kind}_key"
        keyed = out.withColumn(name, column)
        table = (
            held.filter(column.isNotNull())
            .groupBy(column.alias(name))
            .agg(F.min_by(T.strip(F.col("abstract")), "catalog_id").alias(f"_{kind}_abstract"))
        )
        keys = key_counts(keyed, name)
        out = attach_by_key(
            keyed, keys.join(table, name), keys, name, ["paper_id", "ref_id"], hot_rows=hot_rows
        ).drop(name)
    return out.select(
        "paper_id",
        "ref_id",
        F.coalesce("_doi_abstract", "_arxiv_abstract").alias("abstract"),
    )


def union_catalog(*parts: DataFrame) -> DataFrame:
    """One catalog of several sources; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
