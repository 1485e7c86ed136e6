"""Check corpus: papers, catalog, model replies and prices derived from the given tables.

The ``documents`` table holds plain prose, so every document is wrapped into a markdown
paper whose shape depends on its id. The expressions are SQL text that Spark and DuckDB
read alike (but for list lambdas); the whole text of a document ends up in its paper. Used by the registered
queries and tests, not part of the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerlight.functions.rows import settled

NL = "chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _when(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} ELSE '' END"


def _head(number: int, roman: str, name: str) -> str:
    return (
        f"(CASE d % 3 WHEN 0 THEN '## {name}' WHEN 1 THEN '## {number}. {name}' "
        f"ELSE '## {roman}. {name.upper()}' END || {NL})"
    )


def work_title(c: str) -> str:
    """Title of the work that document ``c`` stands for in the catalog."""
    h = f"md5({_s(c)})"
    return (
        f"('Adaptive ' || substr({h}, 1, 6) || ' model ' || substr({h}, 7, 6) || ' with ' "
        f"|| substr({h}, 13, 6))"
    )


# Document cited by reference i; a third of all papers cite document 42 first.
CITED = "CASE WHEN i = 1 AND d % 3 = 0 THEN 42 ELSE d + 37 * i - 200 END"


def work_year(c: str) -> str:
    return f"(1990 + abs({c}) % 35)"


def work_arxiv(c: str) -> str:
    return f"('1706.' || {_s(f'10000 + abs({c}) % 90000')})"


def _entries(dialect: str) -> str:
    """Reference list: an entry per number up to d % 13, styled by d % 4."""
    n = _s("j + 1") if dialect == "spark" else _s("j")
    marker = f"(CASE d % 4 WHEN 0 THEN '[' || {n} || '] ' WHEN 1 THEN {n} || '. ' WHEN 2 THEN '- ' ELSE '' END)"
    year = _s(work_year("c"))
    body = f"""(CASE abs(c) % 5
      WHEN 0 THEN 'Miller, A., Okafor, B. (' || {year} || '). ' || {work_title("c")}
        || '. Journal of Tests, 3.' || {NL} || '   doi:10.5555/work.' || {_s("c")} || '.'
      WHEN 1 THEN 'Miller, A. and Okafor, B. (' || {year} || '). ' || {work_title("c")}
        || '. arXiv:' || {work_arxiv("c")} || 'v2'
      WHEN 2 THEN 'Miller, A. (' || {year} || '). ' || {work_title("c")}
        || '. In Proceedings of Tests.'
      WHEN 3 THEN {work_title("c")} || ' without a date'
      ELSE 'B. Okafor, ' || {year} || ', ' || {work_title("c")}
        || '. Advances in Tests. DOI 10.5555/WORK.' || {_s("c")} END)"""
    sep = f"(CASE WHEN d % 4 = 3 THEN {NL} || {NL} ELSE {NL} END)"
    entry = f"{marker} || {body} || {sep}"
    if dialect == "spark":
        works = f"transform(sequence(1, CAST(d % 13 AS INT)), i -> {CITED})"
        text = f"array_join(transform({works}, (c, j) -> {entry}), '')"
    else:
        works = f"list_transform(range(1, d % 13 + 1), lambda i: {CITED})"
        text = f"array_to_string(list_transform({works}, lambda c, j: {entry}), '')"
    return f"CASE WHEN d % 13 = 0 THEN '' ELSE {text} END"


def paper_markdown(dialect: str) -> str:
    """SQL text of the markdown of document (d, t, q, source); q is a quarter of its length."""
    parts = [
        _when("d % 7 <> 6", f"'# Study of ' || source || ' record ' || {_s('d')} || {NL} || {NL}"),
        _when("d % 19 = 7", f"'A stray opening line.' || {NL}"),
        _when("d % 11 <> 10", f"{_head(1, 'I', 'Abstract')} || substr(t, 1, 300) || {NL} || {NL}"),
        "CASE WHEN d % 8 = 7 THEN "
        f"{_head(2, 'II', 'Background')} ELSE {_head(2, 'II', 'Introduction')} END",
        "substr(t, 1, q)",
        # A quarter whose section is absent stays in the paper.
        _when("d % 5 = 4", "' ' || substr(t, q + 1, q)"),
        _when("d % 13 = 12", "' ' || substr(t, q * 2 + 1, q)"),
        _when("d % 17 = 16", "' ' || substr(t, q * 3 + 1)"),
        _when("d % 6 = 1", "' This work, arXiv:2001.04567, extends [3].'"),
        _when("d % 14 = 5", "' Broader impact is discussed below.'"),
        f"{NL} || {NL}",
        _when(
            "d % 5 <> 4",
            "CASE WHEN d % 4 = 3 THEN "
            f"{_head(3, 'III', 'Proposed Approach')} ELSE {_head(3, 'III', 'Method')} END"
            " || substr(t, q + 1, q)"
            " || " + _when("d % 2 = 0", "' We use the ImageNet dataset.'")
            + " || " + _when("d % 3 = 1", "' A baseline is compared to ours.'")
            + " || " + _when("d % 4 = 2", "' An ablation study follows.'")
            + " || " + _when("d % 5 = 1", "' Accuracy and recall are reported.'")
            + " || " + _when("d % 6 = 0", f"' Code: https://github.com/lab/x' || {_s('d')}")
            + f" || {NL} || {NL}",
        ),
        _when(
            "d % 13 <> 12",
            "CASE WHEN d % 4 = 1 THEN "
            f"{_head(4, 'IV', 'Experiments')} ELSE {_head(4, 'IV', 'Results')} END"
            " || substr(t, q * 2 + 1, q)"
            " || " + _when("d % 7 = 3", "' We fix the random seed.'")
            + " || " + _when("d % 3 = 2", "' The learning rate is 0.1 with Adam.'")
            + " || " + _when("d % 2 = 1", f"{NL} || '![Overview of run ' || {_s('d')} || '](fig.png)'")
            + " || " + _when("d % 6 = 3", f"{NL} || '![ ](blank.png)'")
            + " || " + _when(
                "d % 4 = 1",
                f"{NL} || {NL} || '**Table 1: Scores of ' || {_s('d')} || '**' || {NL} || {NL}"
                f" || '| a | b |' || {NL} || '|---|:-:|' || {NL} || '| 1 | 2 |' || {NL} || '| 3 | 4 |'",
            )
            + " || " + _when(
                "d % 8 = 5",
                f"{NL} || 'plain line' || {NL} || '| x | y |' || {NL} || '---|---' || {NL} || '| 5 | 6 |'",
            )
            + f" || {NL} || {NL}",
        ),
        _when(
            "d % 17 <> 16",
            "CASE WHEN d % 9 = 4 THEN "
            f"{_head(5, 'V', 'Discussion')} ELSE {_head(5, 'V', 'Conclusion')} END"
            " || substr(t, q * 3 + 1)"
            " || " + _when("d % 3 = 0", "' It cannot scale yet; one caveat is left for future work.'")
            + f" || {NL} || {NL}",
        ),
        _when("d % 4 = 0", f"{_head(6, 'VI', 'Limitations')} || substr(t, q + 1, q) || ' A limitation.' || {NL}"),
        _when("d % 10 = 3", f"{_head(7, 'VII', 'Acknowledgements')} || 'We thank all.' || {NL}"),
        "CASE WHEN d % 12 = 6 THEN "
        f"{_head(8, 'VIII', 'Bibliography')} ELSE {_head(8, 'VIII', 'References')} END",
        _entries(dialect),
        _when("d % 10 = 7", f"{NL} || '### Appendix A' || {NL} || 'Extra notes.' || {NL}"),
    ]
    return "\n || ".join(parts)


def papers_sql(dialect: str) -> str:
    return f"""
SELECT concat('doc-', CAST(d AS STRING)) AS paper_id, d AS doc_id, {paper_markdown(dialect)} AS md
FROM (
  SELECT doc_id AS d, text AS t, source, CAST(floor(length(text) / 4) AS INT) AS q FROM documents
) base
"""


# Works per source: (source, prefix, condition on c, title, doi, arxiv, abstract).
_SHORT = (
    "('Adaptive ' || substr(md5(CAST(c AS STRING)), 1, 6) || ' model ' "
    "|| substr(md5(CAST(c AS STRING)), 7, 6) || ' with')"
)
_DOI = "('10.5555/work.' || CAST(c AS STRING))"
_YEAR = f"({work_year('c')} + CASE WHEN c % 9 = 4 THEN 2 ELSE 0 END)"


def catalog_sql(array: str, end: str) -> str:
    """Catalog rows; ``array``/``end`` are the list constructor of the dialect."""
    names = f"{array}'Ann Miller', 'Ben Okafor'{end}"
    none = "CAST(NULL AS STRING)"

    def part(source, rank, prefix, cond, title, doi, arxiv, abstract):
        return (
            f"SELECT '{source}' AS source, {rank} AS source_rank, "
            f"'{prefix}-' || CAST(c AS STRING) AS catalog_id, {title} AS title, {names} AS authors, "
            f"CAST({_YEAR} AS INT) AS year, 'Journal of Tests' AS venue, {doi} AS doi, "
            f"{arxiv} AS arxiv_id, {abstract} AS abstract FROM works WHERE c % 7 <> 5 AND {cond}"
        )

    title = work_title("c")
    drop = f"CASE WHEN c % 4 = 1 THEN {_SHORT} ELSE {title} END"
    return "\nUNION ALL\n".join(
        [
            part("crossref", 0, "cr", "c % 3 = 0", title, _DOI, none, none),
            part(
                "semantic_scholar", 1, "s2", "(c % 3 = 1 OR c % 6 = 0)", drop,
                f"CASE WHEN c % 2 = 0 THEN {_DOI} END", work_arxiv("c"), "t",
            ),
            part("openalex", 2, "oa", "c % 5 = 2", title, _DOI, none, none),
        ]
    )


WORKS_SQL = "SELECT doc_id AS c, text AS t FROM documents"


def register(spark: SparkSession, sf_dir: str) -> None:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    # Behind ``settled`` the filter on blank texts does not build every paper a second time.
    return settled(spark.sql(papers_sql("spark")).select("paper_id", "md"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(f"WITH works AS ({WORKS_SQL}) {catalog_sql('array(', ')')}")


METADATA_SQL = """
SELECT concat('doc-', CAST(doc_id AS STRING)) AS paper_id,
  CAST(CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 2000 + doc_id % 25 END AS INT) AS year,
  CASE WHEN doc_id % 5 = 0 THEN 'Anonymous Author' WHEN doc_id % 5 = 1 THEN 'Jane O''Neil'
    WHEN doc_id % 5 = 2 THEN 'Max Muster' END AS author
FROM documents
"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, year, authors) as a submission system would supply them."""
    register(spark, sf_dir)
    from pyspark.sql import functions as F

    return spark.sql(METADATA_SQL).select(
        "paper_id", "year", F.array_compact(F.array("author")).alias("authors")
    )
