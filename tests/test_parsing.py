from pyspark.sql import functions as F

from peerlight.functions import text as T
from peerlight.operators import parsing, references

PAPER = """# A Title
text under the title is dropped

## Abstract
Short abstract.

## 1. Introduction
Hello\xa0world.

![ a figure ](x.png)

**Table 1: Numbers**

| a | b |
|---|---|
| 1 | 2 |

## II. METHOD
We work.

## VII. REFERENCES
[1] Smith, J., and Lee, K. (2015). A great title. In Proc. of X. doi:10.1234/AbC.9).
   arXiv:1706.03762v5
[2] No year here
[3]\x20
[4] Doe, J. 2019. Other. arXiv hep-th/9901001
"""


def _papers(spark, *texts):
    return spark.createDataFrame(
        [(f"p{i}", t) for i, t in enumerate(texts)], "paper_id string, md string"
    )


def test_sections_titles_and_abstract(spark):
    row = parsing.parse_papers(_papers(spark, PAPER)).first()
    assert row.title == "A Title"
    assert row.abstract == "Short abstract."
    assert [(s.section_id, s.title, s.ord) for s in row.sections] == [
        ("abstract", "Abstract", 0), ("introduction", "Introduction", 1), ("method", "METHOD", 2),
    ]
    assert "dropped" not in " ".join(s.text for s in row.sections)
    # The no-break space separates words; the abstract counts twice.
    words = sum(len(s.text.split()) for s in row.sections) + len(row.abstract.split())
    assert row.word_count == words


def test_headerless_and_title_only_papers(spark):
    rows = parsing.parse_papers(_papers(spark, "just text", "# Only\n## References\n(1) x 2001")).collect()
    assert rows[0].title == "Untitled"
    assert [s.title for s in rows[0].sections] == ["Introduction"]
    assert [s.section_id for s in rows[1].sections] == ["body"]
    assert rows[1].n_refs == 1


def test_last_references_block_wins_and_blank_sections_leave_gaps(spark):
    md = "## Intro\na\n## Empty\n\n## End\nb\n## References\n- one\n## Bibliography\n- two\n- three"
    row = parsing.parse_papers(_papers(spark, md)).first()
    assert [(s.title, s.ord) for s in row.sections] == [("Intro", 0), ("End", 2)]
    assert row.ref_entries == ["- two", "- three"]


def test_empty_papers_are_rejected(spark):
    df = _papers(spark, " \n\t", "x")
    assert [r.paper_id for r in parsing.rejected_papers(df).collect()] == ["p0"]
    assert parsing.parse_papers(df).count() == 1


def test_figures_and_tables(spark):
    df = _papers(spark, PAPER)
    assert [(f.figure_id, f.caption) for f in parsing.figures(df).collect()] == [("fig-1", "a figure")]
    assert [t.caption for t in parsing.pipe_tables(df).collect()] == ["Table 1: Numbers"]


def test_references(spark):
    rows = references.refs(parsing.parse_papers(_papers(spark, PAPER))).orderBy("ref_pos").collect()
    first = rows[0]
    assert first.ref_id == "ref-1" and first.year == 2015
    assert first.doi == "10.1234/AbC.9" and first.arxiv_id == "1706.03762"
    assert first.title == "A great title"
    assert first.authors == ["Smith", "J", "Lee, K"] or first.authors[0] == "Smith"
    assert rows[1].title == "No year here [3]" or rows[1].year is None
    assert rows[-1].arxiv_id == "hep-th/9901001"


def test_reference_styles(spark):
    md = "## References\nFirst entry\nwrapped, 1999\n\nSecond entry, 2001"
    rows = references.reference_entries(parsing.parse_papers(_papers(spark, md))).collect()
    assert [r.entry for r in rows] == ["First entry wrapped, 1999", "Second entry, 2001"]


def test_title_normalisation(spark):
    titles = ["1. Intro", "2.1 Setup", "A.1 Extra", "VII. REFERENCES", "Mix design", "Model"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    out = [r[0] for r in df.select(T.normalize_title(F.col("t"))).collect()]
    assert out == ["Intro", "Setup", "Extra", "REFERENCES", "design", "Model"]


def test_content_ids_change_with_content(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(T.content_id(F.col("t")))
    a, b, c = [r[0] for r in df.collect()]
    assert a == b != c and a.startswith("md:") and len(a) == 19


def test_windows_newlines_and_line_separators(spark):
    md = "## One\r\nline ## Two\r\nmore"
    row = parsing.parse_papers(_papers(spark, md)).first()
    assert [s.title for s in row.sections] == ["One", "Two"]
