"""Reference entries to structured references. All expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.rows import each, settled
from peerlight.operators.parsing import clean_entry


def find_doi(raw: Column) -> Column:
    return T.blank_to_null(F.rtrim(T.extract(raw, P.DOI, 0), F.lit(".,;)")))


def find_arxiv(raw: Column) -> Column:
    marked = F.regexp_replace(T.extract(raw, P.ARXIV_EXPLICIT), P.ARXIV_VERSION, "")
    return F.coalesce(marked, T.extract(raw, P.ARXIV_NEW), T.extract(raw, P.ARXIV_OLD))


def find_year(raw: Column) -> Column:
    return T.extract(raw, P.YEAR).try_cast("int")


def guess_title(raw: Column, year: Column) -> Column:
    """The sentence after the first mention of the year, else the start of the entry."""
    whole = T.blank_to_null(F.substring(T.collapse_spaces(raw), 1, 200))
    text_year = year.cast("string")
    after = F.regexp_replace(F.substr(raw, F.instr(raw, text_year) + 4), P.TITLE_LEAD, "")
    sentence = F.when(
        F.rlike(after, F.lit(P.TITLE_END)), F.regexp_extract(after, P.TITLE_END, 1)
    ).otherwise(after)
    return F.when(year.isNull(), whole).otherwise(
        F.coalesce(T.blank_to_null(F.btrim(sentence, F.lit(" ."))), whole)
    )


def guess_authors(raw: Column, title: Column) -> Column:
    """Names before the first year; empty when there is none."""
    none = F.array().cast("array<string>")
    prefix = F.btrim(T.strip(F.regexp_extract(raw, P.BEFORE_YEAR, 1)), F.lit("(.,"))

    def names(p: Column) -> Column:
        parts = F.transform(F.split(p, P.AUTHOR_SPLIT), lambda x: F.btrim(x, F.lit(" .,")))
        return F.when((p == "") | p.eqNullSafe(title), none).otherwise(
            F.filter(parts, lambda x: x != "")
        )

    return F.coalesce(T.let(prefix, names), none)


def reference_entries(parsed: DataFrame) -> DataFrame:
    """Raw entries (paper_id, ref_pos, entry)."""
    return each(parsed, ["paper_id"], "ref_entries", "entry", "ref_pos")


def refs(parsed: DataFrame) -> DataFrame:
    """Structured references. Ids keep the gaps left by empty entries."""
    raw = reference_entries(parsed).select(
        "paper_id", "ref_pos", clean_entry(F.col("entry")).alias("raw")
    )
    keyed = raw.filter(F.col("raw") != "").select(
        "paper_id",
        F.concat(F.lit("ref-"), (F.col("ref_pos") + 1).cast("string")).alias("ref_id"),
        "ref_pos",
        "raw",
        find_year(F.col("raw")).alias("year"),
    )
    titled = keyed.select("*", guess_title(F.col("raw"), F.col("year")).alias("title"))
    return settled(titled.select(
        "paper_id",
        "ref_id",
        "ref_pos",
        "raw",
        "title",
        guess_authors(F.col("raw"), F.col("title")).alias("authors"),
        "year",
        F.lit(None).cast("string").alias("venue"),
        find_doi(F.col("raw")).alias("doi"),
        find_arxiv(F.col("raw")).alias("arxiv_id"),
    ))
