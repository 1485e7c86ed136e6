"""Inverted indexes of catalog titles: titles inside longer entries, and the best hit by relevance.

``contained_titles`` is an asymmetric join: a title counts if nearly all of its words stand in an
entry in one stretch, whatever else the entry holds. ``top_titles`` finds the title of highest
BM25 score per query and source without scoring all titles that share a word with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions.rows import each, settled
from peerlight.operators.joins import HOT_ROWS, attach_by_key, key_counts
from peerlight.session import stage

#: A block whose pairs exceed this is split into groups of its root squared.
BLOCK_PAIRS = 1_000_000
#: Titles of fewer words stand in too many entries by chance.
LEAST_WORDS = 3
#: BM25 constants, and the scale at which a word's share of a score becomes a whole number.
K1, B, SCALE = 1.2, 0.75, 1_000
#: Postings of one word in one block; all of a block have one share.
POSTINGS = 128


def words_in_order(text: Column) -> Column:
    """Words of a text in any script, lower-cased, in their order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def meet(
    left: DataFrame, right: DataFrame, key: str, by_left: list[str], by_right: list[str],
    block_pairs: int | None = None,
) -> DataFrame:
    """Inner join on ``key``; keys of many rows on both sides are split into bounded groups.

    Rows are dealt by hashes of ``by_left`` and ``by_right``; every two rows of a key meet once.
    Both sides are exploded, which Spark's size estimates do not see: without the hints it takes
    one for small, and the driver gathers all of it for a broadcast.
    """
    block_pairs = block_pairs or BLOCK_PAIRS
    sizes = (
        left.groupBy(key).agg(F.count(F.lit(1)).alias("nl_"))
        .join(right.groupBy(key).agg(F.count(F.lit(1)).alias("nr_")).hint("merge"), key)
    )
    large = F.col("nl_") * F.col("nr_") > block_pairs

    def groups(n: str) -> Column:
        return F.when(large, F.ceil(F.col(n) / block_pairs**0.5)).otherwise(1).cast("int")

    sizes = sizes.select(key, groups("nl_").alias("kl_"), groups("nr_").alias("kr_"))

    def dealt(rows: DataFrame, own: str, other: str, name: str, copies: str, by: list[str]) -> DataFrame:
        group = F.pmod(F.xxhash64(*by), F.col(own)).cast("int").alias(name)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(copies)
        return rows.join(sizes.hint("merge"), key).select(*rows.columns, group, every)

    return dealt(left, "kl_", "kr_", "gl_", "gr_", by_left).join(
        dealt(right, "kr_", "kl_", "gr_", "gl_", by_right).hint("merge"), [key, "gl_", "gr_"]
    ).drop("gl_", "gr_")


# --- titles inside entries ----------------------------------------------------


def _bigrams(words: Column) -> Column:
    """(at, gram) of every two neighbouring words."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.struct(i.alias("at"), F.concat(w, F.lit(" "), F.get(words, i + 1)).alias("gram")),
    )


def words_needed(n: Column, min_share: float) -> Column:
    """Words of a title of ``n`` words that must stand in their places."""
    return F.ceil(n * F.lit(min_share) - F.lit(1e-9)).cast("int")


def contained_titles(
    entries: DataFrame, titles: DataFrame, min_share: float = 0.9, least_words: int = LEAST_WORDS
) -> DataFrame:
    """(key, source, catalog_id, similarity, n_words) of the titles that stand in an entry.

    ``entries`` has (key, entry_words) with distinct keys, ``titles`` (source, catalog_id,
    title_words); words are in order. A title of ``least_words`` or more counts if at one offset
    ``min_share`` of its words stand in the entry word by word; similarity is that share at its
    best offset. ``d`` misses break 2 d neighbouring pairs at most, so of the 2 d + 1 pairs of a
    title that are in fewest titles one stands in the entry: only those are indexed, and an entry
    probes with all of its own. Nothing is capped; pairs in many entries and titles are split. The
    words of an entry do not travel with its pairs but come to the titles it meets.
    Entries and titles without words, or null, give no rows.
    """
    if not 2 / 3 < min_share <= 1.0:
        raise ValueError("min_share must be in (2/3, 1]")
    n = F.size("title_words")
    held = titles.where(n >= least_words).select(
        "source", "catalog_id", "title_words", words_needed(n, min_share).alias("needed")
    )
    grams = each(held, ["source", "catalog_id"], _bigrams(F.col("title_words")), "g").select(
        "source", "catalog_id", "g.at", "g.gram"
    )
    counts = key_counts(grams, "gram")
    found = counts.withColumn("n_titles", F.col("key_rows"))
    placed = attach_by_key(grams, found, counts, "gram", ["source", "catalog_id"], how="inner")
    rare_first = F.array_sort(F.collect_list(F.struct("n_titles", "gram", "at")))
    order = placed.groupBy("source", "catalog_id").agg(rare_first.alias("grams"))
    probes = 2 * (n - F.col("needed")) + 1
    indexed = held.join(order, ["source", "catalog_id"]).withColumn(
        "grams", F.slice("grams", F.lit(1), probes)
    )
    kept = ["source", "catalog_id", "title_words", "needed"]
    index = each(indexed, kept, "grams", "g").select(*kept, F.col("g.gram").alias("gram"), F.col("g.at").alias("title_at"))
    asked = each(entries, ["key"], _bigrams(F.col("entry_words")), "g").select(
        "key", F.col("g.gram").alias("gram"), F.col("g.at").alias("entry_at")
    )
    met = meet(asked, index, "gram", ["key", "entry_at"], ["source", "catalog_id"])
    pairs = met.join(entries.select("key", "entry_words").hint("merge"), "key")
    offset = F.col("entry_at") - F.col("title_at")
    hits = F.aggregate(
        F.transform(
            "title_words",
            lambda w, i: F.coalesce((F.get(F.col("entry_words"), offset + i) == w).cast("int"), F.lit(0)),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    scored = settled(pairs.select("key", "source", "catalog_id", "needed", n.alias("n_words"), hits.alias("hits")))
    best = scored.where("hits >= needed").groupBy("key", "source", "catalog_id", "n_words").agg(F.max("hits").alias("hits"))
    return best.select(
        "key", "source", "catalog_id", (F.col("hits") / F.col("n_words")).alias("similarity"), "n_words"
    )


# --- relevance ----------------------------------------------------------------


@dataclass
class TitleIndex:
    """BM25 shares of a catalog. Store both tables once (``stored_index``); many searches use them.

    ``vectors`` (source, catalog_id, vector) maps every distinct word of a title to its share;
    ``blocks`` (word, source, top, ids) are postings by falling share, ``top`` the share in a block.
    """

    vectors: DataFrame
    blocks: DataFrame


def index_titles(titles: DataFrame, postings: int = POSTINGS, hot_rows: int = HOT_ROWS) -> TitleIndex:
    """Index of (source, catalog_id, title_words). Each source is a collection of its own.

    A share is the word's part of the score of any query that has it, in thousandths rounded down
    and 1 at least, so scores are sums of whole numbers. Words of many titles are split.
    """
    words = titles.select("source", "catalog_id", F.col("title_words").alias("w")).where(F.size("w") > 0)
    per_source = words.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_titles"), F.sum(F.size("w")).alias("all_words")
    )
    rows = each(words.withColumn("n", F.size("w")), ["source", "catalog_id", "n"], "w", "word")
    place = F.struct("word", "source").alias("place")
    tf = rows.groupBy("source", "catalog_id", "n", "word").agg(F.count(F.lit(1)).alias("tf")).select("*", place)
    counts = key_counts(tf, "place")
    found = counts.withColumn("df", F.col("key_rows"))
    counted = attach_by_key(tf, found, counts, "place", ["catalog_id"], "inner", hot_rows)
    counted = counted.join(F.broadcast(per_source), "source")  # one row for each named source
    idf = F.log((F.col("n_titles") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n") * F.col("n_titles") / F.col("all_words"))
    share = F.greatest(F.floor(SCALE * idf * F.col("tf") * (K1 + 1) / norm), F.lit(1)).cast("long")
    shares = settled(counted.select("source", "catalog_id", "word", share.alias("share"), "df"))
    vectors = shares.groupBy("source", "catalog_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "share"))).alias("vector")
    )
    part = F.pmod(F.xxhash64("catalog_id"), F.ceil(F.col("df") / postings)).alias("part")
    blocks = shares.groupBy("word", "source", F.col("share").alias("top"), part).agg(
        F.collect_list("catalog_id").alias("ids")  # about ``postings`` of them at most
    )
    return TitleIndex(vectors, blocks.drop("part"))


def stored_index(index: TitleIndex, name: str, run_id: str) -> TitleIndex:
    return TitleIndex(stage(index.vectors, f"{name}_vectors", run_id), stage(index.blocks, f"{name}_blocks", run_id))


def _sum_of(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc - w["less"])


def top_titles(queries: DataFrame, index: TitleIndex, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, source, catalog_id, score): the best title of every source for every query.

    ``queries`` has (key, words) with distinct keys; words count once. Highest BM25 score, ties to
    the smaller catalog_id; a source none of whose titles shares a word gives no row. Words that a
    source does not know add nothing, so queries that share the rest are searched there once:
    all that hold only common words are one search, not one each over nearly all titles. First some
    titles with the query's word of largest bound are scored: the best of them is a threshold.
    Words whose bounds together stay below it cannot lift a title above it alone, so only the
    other words' blocks are read, and of those only blocks whose share plus the bounds of the
    query's other words reaches the threshold. What is left is scored in full.
    """
    place = F.struct("word", "source").alias("place")
    bounds = index.blocks.groupBy("word", "source").agg(F.max("top").alias("bound"))
    asked = each(queries.select("key", F.array_distinct("words").alias("w")), ["key"], "w", "word")
    counts = key_counts(asked, "word")
    by_word = bounds.groupBy("word").agg(F.collect_list(F.struct("source", "bound")).alias("s"))
    known = attach_by_key(asked, counts.join(by_word, "word"), counts, "word", ["key"], "inner", hot_rows)
    # The words of a query by falling bound, per source: as long as the query.
    every = settled(
        known.select("key", "word", F.explode("s").alias("s"))
        .groupBy("key", F.col("s.source").alias("source"))
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("s.bound")).alias("less"), "word"))).alias("words"))
    )
    asking = every.select(F.col("key").alias("query"), F.struct("source", "words").alias("search"))
    searches = key_counts(asking, "search")
    listed = searches.select(
        F.transform("search.words", lambda w: w["word"]).alias("key"), "search.source", "search.words"
    )

    def scored(candidates: DataFrame) -> DataFrame:
        """Full scores of candidates (key, source, words, catalog_id)."""
        pairs = candidates.join(index.vectors, ["source", "catalog_id"])
        score = F.aggregate(
            "words", F.lit(0).cast("long"),
            lambda acc, w: acc + F.coalesce(F.try_element_at("vector", w["word"]), F.lit(0).cast("long")),
        )
        return pairs.select("key", "source", "words", "catalog_id", score.alias("score"))

    first = F.get("words", F.lit(0))
    heads = listed.select("key", "source", "words", first["word"].alias("word"), (-first["less"]).alias("top"))
    best_block = index.blocks.groupBy("word", "source", "top").agg(F.min("ids").alias("ids"))
    probe = heads.join(best_block, ["word", "source", "top"])
    floor = scored(probe.select("key", "source", "words", F.explode("ids").alias("catalog_id"))).groupBy(
        "key", "source"
    ).agg(F.max("score").alias("floor"))
    with_floor = listed.join(floor, ["key", "source"]).withColumn("total", _sum_of(F.col("words")))
    tails = F.transform(
        "words",
        lambda w, i: F.struct(
            w["word"].alias("word"), (-w["less"]).alias("bound"),
            _sum_of(F.slice("words", i + 1, F.size("words"))).alias("tail"),
        ),
    )
    essential = F.filter(tails, lambda x: x["tail"] >= F.col("floor"))
    kept = ["key", "source", "words", "floor", "total"]
    wanted = each(with_floor.withColumn("e", essential), kept, "e", "x").select(
        "key", "words", F.struct(F.col("x.word").alias("word"), "source").alias("place"),
        (F.col("floor") - F.col("total") + F.col("x.bound")).alias("least"),
    )
    read = meet(wanted, index.blocks.select(place, "top", "ids"), "place", ["key"], ["top", "ids"])
    candidates = (
        read.where("top >= least")
        .select("key", F.col("place.source").alias("source"), "words", F.explode("ids").alias("catalog_id"))
        .dropDuplicates(["key", "source", "catalog_id"])
    )
    best = F.min_by(F.struct("catalog_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("catalog_id")))
    found = scored(candidates).groupBy("key", "source", "words").agg(best.alias("b")).select(
        F.struct("source", "words").alias("search"), "b.catalog_id", "b.score"
    )
    hits = attach_by_key(
        asking, searches.join(found, "search"), searches, "search", ["query"], "inner", hot_rows
    )
    return hits.select(F.col("query").alias("key"), "search.source", "catalog_id", "score")
