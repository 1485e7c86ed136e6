"""Paper sources: text files, and text already extracted from page formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.sources.files import list_files, local_root, read_files

TEXT_SUFFIXES = ["md", "markdown", "txt"]


def file_parts(df: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.select(
        "*",
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"),
        F.regexp_replace(name, r"\.[^.]+$", "").alias("source_name"),
    )


def from_text(df: DataFrame) -> DataFrame:
    """Rows with ``md`` get their content-stable ``paper_id``."""
    return df.withColumn("paper_id", T.content_id(F.col("md")))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Text papers under ``path``: (paper_id, md, source_name, path). Other suffixes are left
    to ``rejected_files``. Files with one text share an id; see ``distinct_papers``."""
    root = local_root(spark, path)
    if root:
        files = read_files(list_files(spark, root), TEXT_SUFFIXES)
    else:
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .text(path, wholetext=True)
            .select(F.col("value").alias("md"), F.col("_metadata.file_path").alias("path"))
        )
    return from_text(file_parts(files).filter(is_text())).select("paper_id", "md", "source_name", "path")


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with a suffix no reader takes (content is not read)."""
    root = local_root(spark, path)
    if root:
        files = list_files(spark, root).select(
            F.concat(F.lit("file:"), F.col("file").cast("string")).alias("path"), "length"
        )
    else:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select("path", "length")
        )
    return reject_rows(file_parts(files))


def is_text() -> Column:
    return F.col("suffix").isin(TEXT_SUFFIXES)


def reject_rows(files: DataFrame) -> DataFrame:
    return files.filter(~is_text()).select(
        "path",
        "suffix",
        F.concat(F.lit("Unsupported input format: ."), "suffix").alias("reason"),
    )


def distinct_papers(papers: DataFrame) -> DataFrame:
    """One row per ``paper_id``. Rows with one id hold one text; where ``path`` is known, the
    row with the first path stays, so that a rerun keeps the same one.

    The first path per id is found on narrow columns; texts cross one exchange at most.
    """
    if "path" not in papers.columns:
        return papers.dropDuplicates(["paper_id"])
    first = papers.groupBy("paper_id").agg(F.min("path").alias("path"))
    return papers.join(first, ["paper_id", "path"], "left_semi").dropDuplicates(["paper_id", "path"]).select(
        *papers.columns
    )


def paper_paths(papers: DataFrame) -> DataFrame:
    """All source paths of every paper: (paper_id, path)."""
    return papers.select("paper_id", "path").distinct()


def promote_header(line: Column) -> Column:
    """``## line`` when the line looks like a section header, else NULL."""
    looks = None
    for pattern in P.PAGE_HEADERS:
        hit = F.rlike(line, F.lit(f"(?U){pattern}"))
        looks = hit if looks is None else looks | hit
    return F.when(looks, F.concat(F.lit("## "), line))


def page_lines(text: Column) -> Column:
    """Lines of one page with headers promoted and set off by blank lines."""
    lines = F.transform(F.split(T.unify_newlines(text), "\n"), T.strip)
    marked = F.transform(
        lines,
        lambda ln: T.let(
            promote_header(ln),
            lambda h: F.when(h.isNotNull(), F.concat(F.lit("\n"), h, F.lit("\n"))).otherwise(ln),
        ),
    )
    return F.array_join(marked, "\n")


def promote_headers(pages: DataFrame) -> DataFrame:
    """Long table of page lines that were promoted (paper_id, page_no, line_no, header)."""
    return (
        pages.select(
            "paper_id",
            "page_no",
            F.posexplode(F.split(T.unify_newlines(F.col("text")), "\n")).alias("line_no", "raw"),
        )
        .select("paper_id", "page_no", "line_no", promote_header(T.strip(F.col("raw"))).alias("header"))
        .filter(F.col("header").isNotNull())
    )


def collapse_blank_runs(c: Column) -> Column:
    """At most one blank line between lines."""
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def _ordered_pages(pages: DataFrame, value: Column, sep: str) -> DataFrame:
    """Pages of a document are few and shuffle once by document."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page_no"), value.alias("v"))))
    return pages.groupBy("paper_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["v"]), sep).alias("joined")
    )


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(paper_id, page_no, text) rows of extracted pages to one markdown text per paper."""
    joined = _ordered_pages(pages, page_lines(F.coalesce(F.col("text"), F.lit(""))), "\n\n")
    return joined.select(
        "paper_id",
        F.concat(T.strip(collapse_blank_runs(F.col("joined"))), F.lit("\n")).alias("md"),
    )


def first_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """Text of the first ``n`` pages (numbered from 0), for venue detection."""
    return _ordered_pages(
        pages.filter(F.col("page_no") < n), F.coalesce(F.col("text"), F.lit("")), "\n\n"
    ).withColumnRenamed("joined", "md")


def clean_word_markdown(c: Column) -> Column:
    """Drop heading anchors and backslash escapes left by word-processor conversion."""
    return F.regexp_replace(F.regexp_replace(c, P.WORD_ANCHOR, ""), P.WORD_ESCAPE, "$1")
