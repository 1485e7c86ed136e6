"""Markdown papers to sections, figures, tables and reference entries.

``parse_papers`` is a narrow projection: one row in, one row out, no shuffle. The long
tables (sections, blocks, figures, pipe tables) are explodes of it. Text never crosses an
exchange here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.rows import each


def _first_line(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _is_header(piece: Column) -> Column:
    """Told by the first line: a pattern is tried on a copy of its whole text."""
    return F.rlike(_first_line(piece), F.lit(P.HEADER_START))


def _block(piece: Column) -> Column:
    """(level, title, body) of a piece that begins with a header line."""

    def build(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, "^(#{1,6})", 1))
        return F.struct(
            level.alias("level"),
            T.strip(F.substr(line, level + 1)).alias("title"),
            T.strip(F.substr(piece, F.length(line) + 2)).alias("body"),
        )

    return T.let(_first_line(piece), build)


def block_array(md: Column) -> Column:
    """Blocks in document order; the first one is the text before any header (level 0)."""

    def build(pieces: Column) -> Column:
        first = F.get(pieces, F.lit(0))
        lead = F.struct(
            F.lit(0).alias("level"),
            F.lit("").alias("title"),
            F.when(_is_header(first), F.lit("")).otherwise(T.strip(first)).alias("body"),
        )
        return F.concat(F.array(lead), F.transform(F.filter(pieces, _is_header), _block))

    return T.let(F.split(T.unify_newlines(md), P.HEADER_SPLIT), build)


def _reference_titles() -> Column:
    return F.array(*[F.lit(t) for t in P.REFERENCE_HEADERS])


def _label_blocks(blocks: Column) -> Column:
    """Blocks that can become sections, with their clean title and a references flag."""

    def label(b: Column, pos: Column) -> Column:
        clean = F.coalesce(T.blank_to_null(T.normalize_title(b["title"])), F.lit("Introduction"))
        return F.struct(
            pos.alias("pos"),
            b["level"].alias("level"),
            clean.alias("title"),
            b["body"].alias("body"),
            (
                F.array_contains(_reference_titles(), F.lower(b["title"]))
                | F.array_contains(_reference_titles(), F.lower(clean))
            ).alias("is_refs"),
        )

    named = F.filter(
        F.transform(blocks, label),
        lambda b: (F.get(blocks, b["pos"])["title"] != "") | (b["body"] != ""),
    )

    def keep(rows: Column) -> Column:
        first = F.array_min(
            F.transform(
                F.filter(rows, lambda b: (b["level"] != 1) & ~b["is_refs"]), lambda b: b["pos"]
            )
        )
        # A level-1 header is the paper title as long as no section has been opened.
        return F.filter(
            rows, lambda b: (b["level"] != 1) | F.coalesce(b["pos"] > first, F.lit(False))
        )

    return T.let(named, keep)


def _section_array(labelled: Column, md: Column) -> Column:
    def section(b: Column, ord_: Column) -> Column:
        section_id = F.coalesce(
            T.blank_to_null(T.slug(b["title"])),
            F.concat(F.lit("section-"), ord_.cast("string")),
        )
        return F.struct(
            section_id.alias("section_id"),
            b["title"].alias("title"),
            b["body"].alias("text"),
            ord_.alias("ord"),
        )

    whole = F.array(
        F.struct(
            F.lit("body").alias("section_id"),
            F.lit("Body").alias("title"),
            T.strip(md).alias("text"),
            F.lit(0).alias("ord"),
        )
    )
    rows = F.transform(F.filter(labelled, lambda b: ~b["is_refs"]), section)
    return T.let(
        rows,
        lambda s: F.when(F.size(s) == 0, whole).otherwise(
            F.filter(s, lambda x: x["text"] != "")
        ),
    )


def entry_array(body: Column) -> Column:
    """Reference entries of a references body.

    With markers at line starts an entry runs from marker to marker; without any, entries
    are blank-line separated paragraphs.
    """

    def split(b: Column) -> Column:
        marked = F.split(b, P.REF_MARKER_SPLIT)
        loose = F.split(b, f"\\n{P.INLINE_WS}*\\n{P.WS}*")
        pieces = F.when(F.rlike(b, F.lit(P.REF_MARKER_LINE)), marked).otherwise(loose)
        return F.when(b == "", F.array().cast("array<string>")).otherwise(
            F.transform(pieces, T.fold_lines)
        )

    return T.let(F.coalesce(body, F.lit("")), split)


def clean_entry(entry: Column) -> Column:
    return T.strip(F.regexp_replace(entry, P.REF_MARKER_PREFIX, ""))


def read_valid(papers: DataFrame) -> DataFrame:
    """Papers with some text; the others belong to ``rejected_papers``."""
    return papers.filter(~T.is_blank(F.col("md")))


def rejected_papers(papers: DataFrame) -> DataFrame:
    return papers.filter(F.coalesce(T.strip(F.col("md")), F.lit("")) == "").withColumn(
        "reason", F.lit("empty markdown")
    )


def header_blocks(papers: DataFrame) -> DataFrame:
    """Long table (paper_id, pos, level, title, body)."""
    return each(papers, ["paper_id"], block_array(F.col("md")), "b", "pos").select(
        "paper_id", "pos", "b.level", "b.title", "b.body"
    )


def parse_papers(papers: DataFrame) -> DataFrame:
    """One parsed row per paper.

    Input: ``paper_id, md`` and optionally ``source_name`` (title fallback), ``authors``,
    ``year``, ``venue``, ``doi``, ``arxiv_id``. Output adds ``title, abstract, sections,
    ref_entries, n_refs, word_count``; extra input columns are kept, ``md`` is dropped.
    """
    have = papers.columns
    extra = [c for c in have if c not in ("md", "source_name", "title", "abstract")]
    name = F.col("source_name") if "source_name" in have else F.lit(None).cast("string")
    blocks = read_valid(papers).select(
        *extra, name.alias("source_name"), "md", block_array(F.col("md")).alias("blocks")
    )
    labelled = blocks.select(
        *extra,
        "source_name",
        "md",
        F.get(
            F.filter("blocks", lambda b: (b["level"] == 1) & (b["title"] != "")), F.lit(0)
        )["title"].alias("h1"),
        _label_blocks(F.col("blocks")).alias("labelled"),
    )
    arrays = labelled.select(
        *extra,
        F.coalesce("h1", T.blank_to_null(F.col("source_name")), F.lit("Untitled")).alias("title"),
        _section_array(F.col("labelled"), F.col("md")).alias("sections"),
        entry_array(
            F.try_element_at(F.filter("labelled", lambda b: b["is_refs"]), F.lit(-1))["body"]
        ).alias("ref_entries"),
    )
    with_abstract = arrays.select(
        "*",
        T.blank_to_null(
            T.strip(
                F.get(
                    F.filter("sections", lambda s: F.lower(T.strip(s["title"])) == "abstract"),
                    F.lit(0),
                )["text"]
            )
        ).alias("abstract"),
    )
    return with_abstract.select(
        "*",
        F.size(F.filter("ref_entries", lambda e: clean_entry(e) != "")).alias("n_refs"),
        total_words(F.col("abstract"), F.col("sections")).alias("word_count"),
    )


def total_words(abstract: Column, sections: Column) -> Column:
    """Words of the abstract plus all sections (an abstract section counts twice)."""
    return T.word_count(abstract) + F.aggregate(
        sections, F.lit(0), lambda acc, s: acc + T.word_count(s["text"])
    )


def sections(parsed: DataFrame) -> DataFrame:
    """Long table (paper_id, section_id, title, text, ord)."""
    return each(parsed, ["paper_id"], "sections", "s").select("paper_id", "s.*")


def paper_titles(papers: DataFrame) -> DataFrame:
    return parse_papers(papers).select("paper_id", "title")


def abstracts(parsed: DataFrame) -> DataFrame:
    return parsed.select("paper_id", "abstract")


def word_counts(parsed: DataFrame) -> DataFrame:
    return parsed.select("paper_id", "word_count")


def figures(papers: DataFrame) -> DataFrame:
    """Image links (paper_id, figure_id, caption)."""
    captions = F.regexp_extract_all("md", F.lit(P.IMAGE), F.lit(1))
    return each(papers, ["paper_id"], captions, "raw", "pos").select(
        "paper_id",
        F.concat(F.lit("fig-"), (F.col("pos") + 1).cast("string")).alias("figure_id"),
        T.blank_to_null(T.strip(F.col("raw"))).alias("caption"),
    )


def pipe_tables(papers: DataFrame) -> DataFrame:
    """Pipe tables with the caption line above, if any (paper_id, table_id, caption).

    A table is a row line, a rule line and the row lines after it. Splitting the text at
    tables leaves exactly the text above each of them, whose last non-blank line is the
    caption candidate.
    """
    above = F.split(T.unify_newlines(F.col("md")), P.PIPE_TABLE)
    last_line = F.substring_index(F.rtrim("above", F.lit(P.WHITESPACE)), "\n", -1)
    caption = T.strip(last_line)
    pieces = papers.select("paper_id", above.alias("pieces"))
    but_last = F.slice("pieces", F.lit(1), F.size("pieces") - 1)
    return (
        each(pieces, ["paper_id"], but_last, "above", "pos")
        .select(
            "paper_id",
            F.concat(F.lit("table-"), (F.col("pos") + 1).cast("string")).alias("table_id"),
            F.when(
                F.rlike(last_line, F.lit(P.TABLE_CAPTION)), F.btrim(caption, F.lit("*"))
            ).alias("caption"),
        )
    )
