"""Registered queries with their SQL twins.

``@query(name, sql)`` registers a function of (spark, sf_dir); columns carry the same names
on both sides. Nested results are flattened to text so that values compare exactly.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus, model
from checks import oracle as O
from checks.oracle import dbl, fx, q, rx, strip, words
from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.numbers import recommendation
from peerlight.operators import authors as AU
from peerlight.operators import citations as C
from peerlight.operators import claims as CL
from peerlight.operators import compliance as CO
from peerlight.operators import contracts, drafts, fairness, inference, parsing, quality, references
from peerlight.operators import depth as DE
from peerlight.operators import entailment as EN
from peerlight.operators import rubric as RU
from peerlight.operators import rubric_requests as RR
from peerlight.operators import scoring, verification, whatif
from peerlight.operators import title_index as TI
from peerlight.plans import review as R
from peerlight.session import shared_folder, stage, stage_buckets
from peerlight.sources import auditlog, compaction, costs, papers as sources, responses
from peerlight.sources.configs import times_configs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O.query(sql)
        return fn

    return add


def _papers(spark, sf_dir):
    return corpus.papers(spark, sf_dir)


def _parsed(spark, sf_dir):
    return parsing.parse_papers(corpus.papers(spark, sf_dir))


def _joined(c, sep=" ## "):
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def _stored(df, name):
    """Stage a table that several joins of a query read, as a run with a run id does."""
    return stage(df, name, "check-" + uuid.uuid4().hex[:12])


def _parsed_once(spark, sf_dir):
    """Parsed papers in buckets of ``paper_id``, for queries that read them several times."""
    return stage_buckets(_parsed(spark, sf_dir), "parsed", "check-" + uuid.uuid4().hex[:12], "paper_id")


def _refs(spark, sf_dir):
    return references.refs(_parsed(spark, sf_dir))


def _docs(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents")


# --- sources ------------------------------------------------------------------


@query(
    "s2_content_ids",
    "SELECT doc_id, 'md:' || substr(sha256(text), 1, 16) AS paper_id FROM documents",
)
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.content_id(F.col("text")).alias("paper_id"))


PAGES = (
    "SELECT concat('c', CAST(conv_id AS STRING)) AS paper_id, CAST(turn AS INT) AS page_no, "
    "CASE WHEN turn % 3 = 0 THEN '1. Introduction' || chr(10) || '  ' || text "
    "WHEN turn % 3 = 1 THEN text || chr(10) || chr(10) || chr(10) || ' II. RELATED WORK ' || chr(10) || 'more' "
    "ELSE text || chr(10) || 'References' END AS text FROM conversations"
)


def _pages(spark, sf_dir):
    corpus.table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(PAGES)


_HEAD = (
    "(regexp_matches(ln, '^([IVX]{1,4})\\.\\s+([A-Z][A-Z\\s\\-&/]{2,60})$') "
    "OR regexp_matches(ln, '^(\\d+(?:\\.\\d+)*\\.?)\\s+([A-Z][A-Za-z0-9\\s\\-:,''&/()]{2,80})$') "
    "OR regexp_matches(ln, '(?i)^(Abstract|Introduction|Related\\s+Work|Background|Method(?:ology|s)?|Approach|Experiments?|Results?|Discussion|Conclusions?|References|Bibliography|Acknowledgm?ents?|Appendix|Limitations?|Broader\\s+Impact|Societal\\s+Impact|Ethics)$'))"
)
_LINES = (
    f"SELECT paper_id, page_no, unnest(range(0, len(ls))) AS line_no, {strip('unnest(ls)')} AS ln "
    f"FROM (SELECT paper_id, page_no, string_split(text, chr(10)) AS ls FROM ({PAGES}))"
)


@query(
    "s3_pages_to_markdown",
    f"""SELECT paper_id, {strip("regexp_replace(string_agg(m, chr(10) || chr(10) ORDER BY page_no), '\\n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS md
    FROM (SELECT paper_id, page_no, string_agg(CASE WHEN {_HEAD} THEN chr(10) || '## ' || ln || chr(10) ELSE ln END, chr(10) ORDER BY line_no) AS m
      FROM ({_LINES}) GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf_dir):
    return sources.pages_to_markdown(_pages(spark, sf_dir))


@query(
    "s4_first_pages",
    f"SELECT paper_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS md FROM ({PAGES}) WHERE page_no < 3 GROUP BY 1",
)
def _(spark, sf_dir):
    return sources.first_pages(_pages(spark, sf_dir), 3)


@query(
    "r10_promoted_headers",
    f"SELECT paper_id, page_no, line_no, '## ' || ln AS header FROM ({_LINES}) WHERE {_HEAD}",
)
def _(spark, sf_dir):
    return sources.promote_headers(_pages(spark, sf_dir))


@query(
    "r11_clean_word_markdown",
    "SELECT doc_id, replace(text, chr(10), chr(10) || '## ') || ' see (a-b)' AS cleaned FROM documents",
)
def _(spark, sf_dir):
    # Anchors before headers and escaped punctuation, as word-processor conversion leaves them.
    raw = F.concat(
        F.replace("text", F.lit("\n"), F.lit('\n  <a id="x1"></a>## ')), F.lit(" see \\(a\\-b)")
    )
    return _docs(spark, sf_dir).select("doc_id", sources.clean_word_markdown(raw).alias("cleaned"))


_STATUS = "CASE d % 6 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 429 ELSE 200 END"
RESPONSES = (
    "SELECT CASE d % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'semantic_scholar' ELSE 'openalex' END AS source, "
    "'doi' AS key_kind, concat('10.5555/work.', CAST(d AS STRING)) AS key, "
    f"concat('https://api.test/', CAST(d AS STRING)) AS url, CAST({_STATUS} AS INT) AS status, "
    "CASE WHEN d % 6 = 3 THEN '  ' WHEN d % 6 = 4 THEN concat('{bad json ', CAST(d AS STRING)) "
    "ELSE concat('{\"id\": ', CAST(d AS STRING), '}') END AS body FROM (SELECT doc_id AS d FROM documents) x"
)


@query(
    "s15_classify_responses",
    f"""SELECT source, key, status, sha256(url) AS url_hash, CASE WHEN status = 404 THEN 'miss' WHEN status >= 400 THEN 'error'
      WHEN trim(body) = '' THEN 'miss' WHEN contains(body, 'bad') THEN 'error' ELSE 'hit' END AS outcome FROM ({RESPONSES})""",
)
def _(spark, sf_dir):
    corpus.register(spark, sf_dir)
    return responses.classify_responses(spark.sql(RESPONSES)).select(
        "source", "key", "status", "url_hash", "outcome"
    )


@query(
    "j4_failed_lookups",
    f"""SELECT DISTINCT source, key_kind, key FROM ({RESPONSES})
    WHERE status <> 404 AND (status >= 400 OR (trim(body) <> '' AND contains(body, 'bad')))""",
)
def _(spark, sf_dir):
    corpus.register(spark, sf_dir)
    return responses.failed_lookups(spark.sql(RESPONSES))


def _bodies(spark, sf_dir, body):
    """One API body per document, as (catalog_id, body)."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("d"), "text", "source")
    return d.select(F.concat(F.lit("w-"), F.col("d").cast("string")).alias("catalog_id"), F.to_json(body).alias("body"))


def _flat_catalog(df):
    return df.select("source", "catalog_id", "title", _joined("authors").alias("authors"), "year", "venue", "doi")


_D = "(SELECT doc_id AS d, text, source AS src FROM documents)"


@query(
    "s16a_normalize_crossref",
    f"""SELECT 'crossref' AS source, 'w-' || d AS catalog_id, CASE WHEN d % 5 <> 0 THEN text END AS title,
      CASE WHEN d % 2 = 0 THEN 'Ann Miller' || ' ## ' || src ELSE 'Okafor' || ' ## ' || src END AS authors,
      CASE WHEN d % 4 <> 0 THEN CAST(1990 + d % 30 AS INT) END AS year, CASE WHEN d % 3 <> 0 THEN 'J ' || src END AS venue,
      '10.1/' || d AS doi FROM {_D}""",
)
def _(spark, sf_dir):
    c = F.col
    person = lambda g, f: F.struct(g.alias("given"), f.alias("family"))
    body = F.struct(
        F.struct(
            F.concat(F.lit("10.1/"), c("d").cast("string")).alias("DOI"),
            F.when(c("d") % 5 != 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("title"),
            F.array(
                person(F.when(c("d") % 2 == 0, F.lit("Ann")), F.when(c("d") % 2 == 0, F.lit("Miller")).otherwise(F.lit("Okafor"))),
                person(F.lit(None).cast("string"), c("source")),
                person(F.lit(None).cast("string"), F.lit(None).cast("string")),
            ).alias("author"),
            F.struct(
                F.when(c("d") % 4 != 0, F.array(F.array((1990 + c("d") % 30).cast("int"), F.lit(3)))).alias("date-parts")
            ).alias("issued"),
            F.when(c("d") % 3 != 0, F.array(F.concat(F.lit("J "), c("source")))).alias("container-title"),
        ).alias("message")
    )
    return _flat_catalog(responses.normalize_crossref(_bodies(spark, sf_dir, body)))


@query(
    "s16b_normalize_s2",
    f"""SELECT 'semantic_scholar' AS source, 'w-' || d AS catalog_id, text AS title, 'Ann Miller ## ' || src AS authors,
      CASE WHEN d % 4 <> 0 THEN CAST(1990 + d % 30 AS INT) END AS year, CASE WHEN d % 3 <> 0 THEN 'J ' || src END AS venue,
      CASE WHEN d % 2 = 0 THEN '10.1/' || d END AS doi FROM {_D}""",
)
def _(spark, sf_dir):
    c = F.col
    body = F.struct(
        c("text").alias("title"),
        F.array(F.struct(F.lit("Ann Miller").alias("name")), F.struct(F.lit("").alias("name")), F.struct(c("source").alias("name"))).alias("authors"),
        F.when(c("d") % 4 != 0, (1990 + c("d") % 30).cast("int")).alias("year"),
        F.when(c("d") % 3 != 0, F.concat(F.lit("J "), c("source"))).otherwise(F.lit("")).alias("venue"),
        F.struct(F.when(c("d") % 2 == 0, F.concat(F.lit("10.1/"), c("d").cast("string"))).alias("DOI")).alias("externalIds"),
    )
    return _flat_catalog(responses.normalize_s2(_bodies(spark, sf_dir, body)))


@query(
    "s16c_normalize_openalex",
    f"""SELECT 'openalex' AS source, 'w-' || d AS catalog_id, CASE WHEN d % 2 = 0 THEN text ELSE 'Shown ' || d END AS title,
      'Ann Miller ## ' || src AS authors, CAST(1990 + d % 30 AS INT) AS year,
      CASE WHEN d % 3 = 0 THEN 'Host ' || src WHEN d % 3 = 1 THEN 'Place ' || src END AS venue, '10.1/' || d AS doi FROM {_D}""",
)
def _(spark, sf_dir):
    c = F.col
    named = lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))
    body = F.struct(
        F.when(c("d") % 2 == 0, c("text")).alias("title"),
        F.concat(F.lit("Shown "), c("d").cast("string")).alias("display_name"),
        F.array(named(F.lit("Ann Miller")), named(F.lit(None).cast("string")), named(c("source"))).alias("authorships"),
        (1990 + c("d") % 30).cast("int").alias("publication_year"),
        F.when(c("d") % 3 == 0, F.struct(F.concat(F.lit("Host "), c("source")).alias("display_name"))).alias("host_venue"),
        F.struct(
            F.when(c("d") % 3 == 1, F.struct(F.concat(F.lit("Place "), c("source")).alias("display_name"))).alias("source")
        ).alias("primary_location"),
        F.concat(F.when(c("d") % 2 == 0, F.lit("https://doi.org/")).otherwise(F.lit("")), F.lit("10.1/"), c("d").cast("string")).alias("doi"),
    )
    return _flat_catalog(responses.normalize_openalex(_bodies(spark, sf_dir, body)))


PEOPLE = "(SELECT s_suppkey AS k, 'Ann Lee ' || chr(CAST(97 + s_suppkey % 26 AS INT)) || 'son' AS name FROM supplier)"


# A name of its own for every supplier.
SUPPLIERS = "(SELECT s_suppkey AS k, 'Ann Lee ' || translate(CAST(s_suppkey AS VARCHAR(20)), '0123456789', 'abcdefghij') || 'son' AS name FROM supplier)"


@query(
    "s18_author_candidates",
    f"""SELECT name AS queried_name, h AS hit_rank,
      CASE WHEN k % 3 <> 0 THEN '0000-0002-1825-009' || CASE WHEN k % 2 = 0 THEN 'X' ELSE '7' END END AS orcid_id,
      CASE WHEN h = 0 THEN 'Ann Lee' WHEN h = 1 THEN name ELSE 'Credit ' || k END AS candidate,
      CASE WHEN k % 4 = 0 THEN 'MIT' WHEN k % 4 = 1 THEN 'ETH' END AS institution
    FROM {PEOPLE}, (SELECT unnest([0, 1, 2]) AS h)""",
)
def _(spark, sf_dir):
    return responses.normalize_orcid(_orcid_bodies(spark, sf_dir)).drop("k")


def _orcid_bodies(spark, sf_dir, named=PEOPLE):
    """A search result of three hits per supplier name."""
    c = F.col
    corpus.table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    people = spark.sql(f"SELECT k, name FROM {named}")
    orcid = F.when(
        c("k") % 3 != 0,
        F.concat(F.lit("0000-0002-1825-009"), F.when(c("k") % 2 == 0, F.lit("X")).otherwise(F.lit("7"))),
    ).otherwise(F.lit("bad-id"))
    place = (
        F.when(c("k") % 4 == 0, F.lit('["MIT", "other"]'))
        .when(c("k") % 4 == 1, F.lit('[{"value": "ETH"}]'))
        .otherwise(F.lit("[]"))
    )

    def hit(given, family, credit):
        return F.concat(
            F.lit('{"orcid-id": "'), orcid, F.lit('", "given-names": "'), given, F.lit('", "family-names": "'), family,
            F.lit('", "credit-name": "'), credit, F.lit('", "institution-name": '), place, F.lit("}"),
        )

    hits = [
        hit(F.lit("Ann"), F.lit("Lee"), F.lit("ignored")),
        hit(F.lit(""), c("name"), F.lit("")),
        hit(F.lit(""), F.lit(""), F.concat(F.lit("Credit "), c("k").cast("string"))),
    ]
    return people.select(
        c("name").alias("queried_name"),
        F.concat(F.lit('{"expanded-result": ['), F.concat_ws(",", *hits), F.lit("]}")).alias("body"),
    )


# --- parsing -----------------------------------------------------------------


@query("r1_header_blocks", "SELECT paper_id, pos, level, title, body FROM blocks")
def _(spark, sf_dir):
    return parsing.header_blocks(_papers(spark, sf_dir))


@query("r2_paper_titles", "SELECT paper_id, title FROM titles")
def _(spark, sf_dir):
    return parsing.paper_titles(_papers(spark, sf_dir))


@query("r3_sections", "SELECT paper_id, section_id, title, text, ord FROM secs")
def _(spark, sf_dir):
    return parsing.sections(_parsed(spark, sf_dir))


@query(
    "r4_normalized_titles",
    f"SELECT paper_id, pos, {strip(f'regexp_replace(title, {q(O.NUM)}, chr(32))')} AS clean FROM blocks",
)
def _(spark, sf_dir):
    return parsing.header_blocks(_papers(spark, sf_dir)).select(
        "paper_id", "pos", T.normalize_title(F.col("title")).alias("clean")
    )


@query(
    "r5_slugs",
    """SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64) AS slug,
      coalesce(nullif(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), ''), 'untitled') AS report_slug FROM documents""",
)
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", T.slug(F.col("text")).alias("slug"), T.report_slug(F.col("text")).alias("report_slug")
    )


@query(
    "r6_rejected_papers",
    f"""SELECT 'doc-' || doc_id AS paper_id, 'empty markdown' AS reason FROM documents
    WHERE {strip("regexp_replace(text, '[^ \\n]{4,}', '', 'g')")} = ''""",
)
def _(spark, sf_dir):
    # Dropping every longer word leaves some documents blank.
    md = F.regexp_replace("text", r"[^ \n]{4,}", "")
    p = _docs(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("paper_id"), md.alias("md"))
    return parsing.rejected_papers(p).select("paper_id", "reason")


@query(
    "r7_figures",
    f"""SELECT paper_id, 'fig-' || i AS figure_id, nullif({strip('c')}, '') AS caption FROM (
      SELECT paper_id, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS i FROM (
        SELECT paper_id, regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1) AS cs FROM papers))""",
)
def _(spark, sf_dir):
    return parsing.figures(_papers(spark, sf_dir))


_ROW = "regexp_matches(ln, '^\\s*\\|.+\\|\\s*$')"
_RULE = "regexp_matches(ln, '^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)+\\|?\\s*$')"


@query(
    "r8_pipe_tables",
    f"""SELECT paper_id, 'table-' || row_number() OVER (PARTITION BY paper_id ORDER BY n) AS table_id,
      CASE WHEN regexp_matches(above, '(?i)^\\s*\\*?\\*?Table\\s+\\d+[:.]') THEN trim(trim(above), '*') END AS caption
    FROM (
      SELECT *, last_value(CASE WHEN trim(ln) <> '' THEN ln END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
        lead(is_rule) OVER (PARTITION BY paper_id ORDER BY n) AS next_rule, lag(is_row) OVER (PARTITION BY paper_id ORDER BY n) AS prev_row
      FROM (SELECT paper_id, n, ln, {_ROW} AS is_row, {_RULE} AS is_rule
        FROM (SELECT paper_id, unnest(ls) AS ln, unnest(range(0, len(ls))) AS n FROM (SELECT paper_id, string_split(md, chr(10)) AS ls FROM papers)))
    ) WHERE is_row AND next_rule""",
)
def _(spark, sf_dir):
    return parsing.pipe_tables(_papers(spark, sf_dir))


@query("r9_abstracts", "SELECT paper_id, abstract FROM abst")
def _(spark, sf_dir):
    return parsing.abstracts(_parsed(spark, sf_dir))


@query("r12_reference_entries", "SELECT paper_id, ref_pos, entry FROM entries")
def _(spark, sf_dir):
    return references.reference_entries(_parsed(spark, sf_dir))


@query("r13_references", "SELECT paper_id, ref_id, ref_pos, raw FROM refraw")
def _(spark, sf_dir):
    return _refs(spark, sf_dir).select("paper_id", "ref_id", "ref_pos", "raw")


@query("r14_dois", "SELECT paper_id, ref_id, doi FROM refs")
def _(spark, sf_dir):
    return _refs(spark, sf_dir).select("paper_id", "ref_id", "doi")


@query("r15_arxiv_ids", "SELECT paper_id, ref_id, arxiv_id FROM refs")
def _(spark, sf_dir):
    return _refs(spark, sf_dir).select("paper_id", "ref_id", "arxiv_id")


@query("r16_years", "SELECT paper_id, ref_id, year FROM refs")
def _(spark, sf_dir):
    return _refs(spark, sf_dir).select("paper_id", "ref_id", "year")


@query("r17_reference_titles", "SELECT paper_id, ref_id, title FROM refs")
def _(spark, sf_dir):
    return _refs(spark, sf_dir).select("paper_id", "ref_id", "title")


@query("r18_reference_authors", "SELECT paper_id, ref_id, array_to_string(authors, ' ## ') AS authors FROM refs")
def _(spark, sf_dir):
    return _refs(spark, sf_dir).select("paper_id", "ref_id", _joined("authors").alias("authors"))


@query("r26_detect_venue", f"""
SELECT paper_id, CASE WHEN roman >= 3 THEN 'ieee' WHEN ax THEN 'arxiv' WHEN imp THEN 'neurips' WHEN w < 3000 THEN 'ieee' WHEN w > 15000 THEN 'arxiv' ELSE 'neurips' END AS recommended,
  CASE WHEN roman >= 3 THEN least({dbl(0.95)}, {dbl(0.5)} + {dbl(0.05)} * roman) WHEN ax THEN {dbl(0.85)} WHEN imp THEN {dbl(0.75)} WHEN w < 3000 OR w > 15000 THEN {dbl(0.55)} ELSE {dbl(0.5)} END AS confidence,
  CASE WHEN roman >= 3 THEN roman || ' Roman-numeral section headers detected (I., II., III., …).' WHEN ax THEN 'arXiv ID detected in paper body.'
    WHEN imp THEN 'Broader-impact / checklist language detected (NeurIPS convention).' WHEN w < 3000 THEN 'Short paper (' || w || ' words) — matches IEEE conference format.'
    WHEN w > 15000 THEN 'Long paper (' || w || ' words) — matches arXiv preprint norms.' ELSE 'No strong signal; defaulting to NeurIPS (generic ML venue).' END AS rationale
FROM (SELECT paper_id, len(regexp_extract_all(md, '(?m)^\\s*[IVX]+\\.\\s+[A-Z][A-Z \\-]{{2,}}\\s*$')) AS roman, regexp_matches(md, {O.re2(P.ARXIV_MENTION)}) AS ax,
  regexp_matches(md, {O.re2(P.IMPACT_LANGUAGE)}) AS imp, {words('md')} AS w FROM (SELECT paper_id, replace(md, '## I', 'I') AS md FROM papers))
""")
def _(spark, sf_dir):
    # Roman headers without the markdown marks, as extracted pages have them.
    p = _papers(spark, sf_dir).withColumn("md", F.replace("md", F.lit("## I"), F.lit("I")))
    return CO.detect_venue(p)


@query("r29_word_counts", f"SELECT doc_id, {words('text')} AS word_count FROM documents")
def _(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query("r29_paper_word_counts", "SELECT paper_id, word_count FROM facts")
def _(spark, sf_dir):
    return parsing.word_counts(_parsed(spark, sf_dir))


@query(
    "r30_anonymized",
    "SELECT paper_id, (author IS NULL OR contains(lower(author), 'anon')) AS anonymized FROM meta",
)
def _(spark, sf_dir):
    return corpus.metadata(spark, sf_dir).select(
        "paper_id", CO.looks_anonymized(F.col("authors")).alias("anonymized")
    )


@query(
    "r31_section_categories",
    "SELECT paper_id, ord, title, is_intro, is_method, is_results, is_conclusion, is_limited AS is_limitations FROM cats",
)
def _(spark, sf_dir):
    return DE.section_categories(parsing.sections(_parsed(spark, sf_dir)))


@query(
    "r32_depth",
    "SELECT paper_id, methodology, limitations, reproducibility, logical_soundness, why_methodology, why_limitations, why_reproducibility, why_logical FROM dep",
)
def _(spark, sf_dir):
    why = lambda k: F.try_element_at("rationales", F.lit(k))
    return DE.depth(_parsed(spark, sf_dir)).select(
        "paper_id", "methodology", "limitations", "reproducibility", "logical_soundness",
        why("methodology").alias("why_methodology"), why("limitations").alias("why_limitations"),
        why("reproducibility").alias("why_reproducibility"), why("logical_soundness").alias("why_logical"),
    )


# --- compliance ---------------------------------------------------------------


def _parsed_meta(spark, sf_dir):
    return R.with_metadata(_parsed(spark, sf_dir), corpus.metadata(spark, sf_dir))


@query(
    "r27_compliance_checks",
    "SELECT paper_id, config_id, check_seq, block, name, passed, detail, issue, critical FROM checks",
)
def _(spark, sf_dir):
    return CO.compliance_checks(_parsed_meta(spark, sf_dir)).drop("config_ord")


@query("a3_compliance", "SELECT paper_id, config_id, triage, n_passed, n_checks, issues FROM comp")
def _(spark, sf_dir):
    return CO.compliance(_parsed_meta(spark, sf_dir)).select(
        "paper_id", "config_id", "triage", "n_passed", "n_checks", _joined("issues").alias("issues")
    )


@query("a3_compliance_from_checks", "SELECT paper_id, config_id, triage, n_passed, n_checks, issues FROM comp")
def _(spark, sf_dir):
    return CO.roll_up_checks(CO.compliance_checks(_parsed_meta(spark, sf_dir))).select(
        "paper_id", "config_id", "triage", "n_passed", "n_checks", _joined("issues").alias("issues")
    )


@query("r28_live_papers", "SELECT DISTINCT paper_id FROM comp WHERE triage <> 'FAIL'")
def _(spark, sf_dir):
    return CO.live_papers(_parsed(spark, sf_dir)).select("paper_id")


# --- rubric, composite -----------------------------------------------------------


def _signals(spark, sf_dir):
    rows = R.with_ledger(R.triaged(_parsed_meta(spark, sf_dir)), None)
    return rows.select(
        "paper_id", "config_id", "word_count", "total_claims", "verified_count", "hallucination_count",
        "methodology", "limitations", "reproducibility", "logical_soundness",
    )


@query("r33a_heuristic_dims", "SELECT paper_id, config_id, dim_pos, name, score, max_score, weight, rationale FROM dims")
def _(spark, sf_dir):
    return RU.rubric_dims(RU.rubric(_signals(spark, sf_dir)))


@query("a7_rubric_totals", "SELECT paper_id, config_id, raw_total, bias_adjusted_total, note FROM rub")
def _(spark, sf_dir):
    return RU.rubric(_signals(spark, sf_dir)).select(
        "paper_id", "config_id", "raw_total", "bias_adjusted_total", _joined("adjustment_notes").alias("note")
    )


_LONG = (
    "SELECT 'doc-' || doc_id AS paper_id, CASE doc_id % 3 WHEN 0 THEN 'neurips' WHEN 1 THEN 'ieee' ELSE 'arxiv' END AS config_id, "
    f"{words('text')} * 9 AS wc, doc_id % 100 / {dbl(100)} AS raw FROM documents"
)


@query("r33b_bias_adjust", f"""
SELECT paper_id, config_id, CASE WHEN wc > ps THEN greatest({dbl(0)}, raw - pen) ELSE raw END AS adjusted,
  CASE WHEN wc > ps THEN 'Length bias: word_count=' || wc || ', penalty=' || {fx('pen', 3)} || ' (x of ' || {fx('mp', 2)} || ')' ELSE '' END AS note
FROM (SELECT *, least({dbl(1)}, {dbl('wc - ps')} / (pf - ps)) * mp AS pen FROM (SELECT *,
  CASE config_id WHEN 'neurips' THEN 10000 WHEN 'ieee' THEN 7000 ELSE 15000 END AS ps,
  CASE config_id WHEN 'neurips' THEN 20000 WHEN 'ieee' THEN 12000 ELSE 30000 END AS pf,
  CASE config_id WHEN 'neurips' THEN {dbl(0.3)} ELSE {dbl(0.2)} END AS mp FROM ({_LONG})))
""")
def _(spark, sf_dir):
    c = F.col
    base = _docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("paper_id"),
        (T.word_count(c("text")) * 9).alias("word_count"),
        ((c("doc_id") % 100) / F.lit(100.0)).alias("raw"),
        F.when(c("doc_id") % 3 == 0, F.lit("neurips")).when(c("doc_id") % 3 == 1, F.lit("ieee")).otherwise(F.lit("arxiv")).alias("mine"),
    )
    return RU.bias_adjust(times_configs(base).filter("mine = config_id")).select(
        "paper_id", "config_id", "adjusted", _joined("adjustment_notes").alias("note")
    )


def _heuristic(spark, sf_dir, meta=True):
    parsed = _parsed_meta(spark, sf_dir) if meta else _parsed(spark, sf_dir)
    return R.heuristic_review(parsed, options=R.Options(created_at="2024-01-01 00:00:00"))


def _sub(evaluations):
    return scoring.subscores(evaluations)


@query("a4_subscores", "SELECT paper_id, config_id, compliance, verification, depth, rubric FROM sub")
def _(spark, sf_dir):
    return _sub(_heuristic(spark, sf_dir))


@query("a8_composites", "SELECT paper_id, config_id, composite, recommendation FROM compo")
def _(spark, sf_dir):
    return scoring.composite(_sub(_heuristic(spark, sf_dir))).select(
        "paper_id", "config_id", "composite", "recommendation"
    )


_TOT = " + ".join(f"(CASE WHEN {k} IS NULL THEN {dbl(0)} ELSE {O.W[k]} END)" for k in P.SCORING_KEYS)
_STAGES = " UNION ALL ".join(
    f"SELECT paper_id, config_id, {i} AS stage_pos, '{k}' AS name, {rx(k)} AS value, {O.W[k]} AS weight, "
    f"{rx(f'coalesce({k} * ({O.W[k]} / ({_TOT})), {dbl(0)})')} AS contribution FROM sub"
    for i, k in enumerate(P.SCORING_KEYS)
)


@query("a9_stage_breakdown", f"SELECT * FROM ({_STAGES})")
def _(spark, sf_dir):
    return scoring.subscores_long(scoring.composite(_sub(_heuristic(spark, sf_dir))))


@query(
    "v1_banners",
    "SELECT paper_id, config_id, CASE WHEN triage <> 'PASS' THEN '⚠️  Compliance ' || triage || ': ' || banner_issues || '. The composite score below does not force a recommendation — review these issues manually before accepting or rejecting.' END AS banner FROM comp",
)
def _(spark, sf_dir):
    return _heuristic(spark, sf_dir).select("paper_id", "config_id", "banner")


@query("w7_triage_queue", """
SELECT config_id, rank() OVER (PARTITION BY config_id ORDER BY CASE WHEN triage = 'FAIL' THEN 0 ELSE 1 END, composite DESC) AS queue_rank,
  paper_id, triage, composite, recommendation FROM compo JOIN comp USING (paper_id, config_id)
""")
def _(spark, sf_dir):
    return scoring.triage_queue(_heuristic(spark, sf_dir))


# --- citations -----------------------------------------------------------------


def _ref_catalog(spark, sf_dir, parsed=None):
    refs = _refs(spark, sf_dir) if parsed is None else references.refs(parsed)
    return _stored(refs, "refs"), corpus.catalog(spark, sf_dir)


def _flat_lookups(df):
    return df.select(
        "paper_id", "ref_id", "status", "source",
        F.col("meta.title").alias("m_title"), _joined("meta.authors").alias("m_authors"),
        F.col("meta.year").alias("m_year"), F.col("meta.venue").alias("m_venue"), F.col("meta.doi").alias("m_doi"),
    )


_FLAT = "SELECT paper_id, ref_id, status, source, m_title, coalesce(array_to_string(m_authors, ' ## '), '') AS m_authors, m_year, m_venue, m_doi FROM "


@query("j1_lookup_refs", _FLAT + "look")
def _(spark, sf_dir):
    return _flat_lookups(C.lookup_refs(*_ref_catalog(spark, sf_dir)))


@query("j1_lookup_refs_hot_keys", _FLAT + "look")
def _(spark, sf_dir):
    # The same lookups with every key above 20 references treated as hot and split.
    return _flat_lookups(C.lookup_refs(*_ref_catalog(spark, sf_dir), hot_rows=20))


@query("j1_lookup_refs_key_major", _FLAT + "look_key")
def _(spark, sf_dir):
    return _flat_lookups(C.lookup_refs(*_ref_catalog(spark, sf_dir), key_major=True))


@query("j1a_doi_hits", "SELECT paper_id, ref_id, source, source_rank FROM all_hits WHERE key_rank = 0")
def _(spark, sf_dir):
    return C.exact_lookup(*_ref_catalog(spark, sf_dir), "doi").select("paper_id", "ref_id", "source", "source_rank")


@query("j2_arxiv_hits", "SELECT paper_id, ref_id, source, source_rank FROM all_hits WHERE key_rank = 1")
def _(spark, sf_dir):
    return C.exact_lookup(*_ref_catalog(spark, sf_dir), "arxiv").select("paper_id", "ref_id", "source", "source_rank")


@query(
    "j3_title_search",
    "SELECT t.paper_id, t.ref_id, t.source, t.catalog_id, t.sim AS similarity, c.title AS m_title FROM title_hits t JOIN cat c USING (source, catalog_id)",
)
def _(spark, sf_dir):
    return C.title_search(*_ref_catalog(spark, sf_dir)).select(
        "paper_id", "ref_id", "source", "catalog_id", "similarity", F.col("meta.title").alias("m_title")
    )


@query("j3_titles_in_entries", "SELECT paper_id, ref_id, source, catalog_id, sim AS similarity FROM entry_hits")
def _(spark, sf_dir):
    return C.contained_title_search(*_ref_catalog(spark, sf_dir)).select(
        "paper_id", "ref_id", "source", "catalog_id", "similarity"
    )


@query("j3_undated_entries", "SELECT paper_id, ref_id, source, catalog_id, sim AS similarity FROM undated_hits")
def _(spark, sf_dir):
    refs, cat = _ref_catalog(spark, sf_dir)
    title = F.when(
        F.col("ref_pos") % 3 == 0, F.regexp_replace("title", "^[A-Za-z]+", "Otherwise")
    ).otherwise(F.col("title"))
    raw = F.concat(
        F.lit("Miller, A., Okafor, B. and Lee, C. "), title, F.lit(". Journal of Tests, volume 3, pages 4-9, Springer")
    )
    undated = refs.filter("year IS NOT NULL").select(
        "paper_id", "ref_id", F.lit(None).cast("int").alias("year"), raw.alias("raw"), F.substring(raw, 1, 200).alias("title"),
        "doi", "arxiv_id",
    )
    keyed = _stored(C.ref_keys(undated, ["entry"]), "undated")
    keys = C.key_counts(keyed, "key")
    return keyed.join(C.entry_hits(keys, cat, min_share=0.8), "key").select(
        "paper_id", "ref_id", "source", "catalog_id", "similarity"
    )


@query("j3_top_hits", "SELECT paper_id, ref_id, source, catalog_id, score FROM bm_hits")
def _(spark, sf_dir):
    refs, cat = _ref_catalog(spark, sf_dir)
    titles = cat.select("source", "catalog_id", TI.words_in_order(F.col("title")).alias("title_words"))
    index = TI.stored_index(TI.index_titles(titles), "titles", "check-" + uuid.uuid4().hex[:12])
    return C.top_hits(refs, cat, index)


@query("j4_lookup_errors", f"""
SELECT r.paper_id, r.ref_id, CASE WHEN h.source IS NOT NULL THEN 'FOUND' WHEN e.n = 3 THEN 'ERROR' ELSE 'NOT_FOUND' END AS status,
  coalesce(h.source, 'none') AS source
FROM refs r
LEFT JOIN (SELECT paper_id, ref_id, count(DISTINCT source) AS n FROM ref_err GROUP BY 1, 2) e USING (paper_id, ref_id)
LEFT JOIN (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.paper_id, a.ref_id ORDER BY source_rank * 10 + key_rank) AS rn
  FROM all_hits a WHERE NOT EXISTS (SELECT 1 FROM ref_err x WHERE x.paper_id = a.paper_id AND x.ref_id = a.ref_id AND x.source = a.source AND x.key_rank <= a.key_rank)) WHERE rn = 1) h USING (paper_id, ref_id)
""")
def _(spark, sf_dir):
    refs, cat = _ref_catalog(spark, sf_dir)
    errors = spark.sql(f"WITH works AS ({corpus.WORKS_SQL}) {O.CTE['errs']}")
    return C.lookup_refs(refs, cat, errors).select("paper_id", "ref_id", "status", "source")


@query("r36_metadata_match", f"""
SELECT paper_id, ref_id, title_score, author_score, year_score, venue_score, overall,
  concat_ws(',', CASE WHEN title <> '' AND title_score < 0.2 THEN 'title' END, CASE WHEN abs(year - m_year) > 1 THEN 'year' END,
    CASE WHEN len(authors) > 0 AND author_score < 0.2 THEN 'author' END) AS mismatches,
  overall >= {dbl(0.6)} AND NOT (title <> '' AND title_score < 0.2) AS match_ok FROM match
""")
def _(spark, sf_dir):
    refs, cat = _ref_catalog(spark, sf_dir)
    lookups = _stored(C.lookup_refs(refs, cat), "lookups")
    return C.metadata_match(refs, lookups).withColumn(
        "mismatches", F.array_join("mismatches", ",")
    )


@query("r37_surnames", f"SELECT paper_id, ref_id, array_to_string(list_transform(authors, lambda n: {O.SURNAME}), ',') AS surnames FROM refs")
def _(spark, sf_dir):
    return _refs(spark, sf_dir).select(
        "paper_id", "ref_id", F.array_join(F.transform("authors", T.surname), ",").alias("surnames")
    )


def _temporal(spark, sf_dir, refs):
    return C.temporal_issues(refs, corpus.metadata(spark, sf_dir), current_year=2020, max_age=20)


@query("r35_temporal_issues", "SELECT paper_id, ref_id, reason, ref_year, paper_year FROM temporal")
def _(spark, sf_dir):
    return _temporal(spark, sf_dir, _refs(spark, sf_dir))


@query("j9_abstracts", """
SELECT r.paper_id, r.ref_id, coalesce(a.abstract, x.abstract) AS abstract FROM refs r
LEFT JOIN abs_doi a ON a.k = lower(r.doi)
LEFT JOIN (SELECT arxiv_id, arg_min(trim(abstract, chr(32) || chr(10) || chr(9)), catalog_id) AS abstract FROM cat WHERE source = 'semantic_scholar' GROUP BY 1) x USING (arxiv_id)
""")
def _(spark, sf_dir):
    return C.abstracts_by_id(*_ref_catalog(spark, sf_dir))


# --- claims ---------------------------------------------------------------------


@query("r19_claim_sections", "SELECT paper_id, section_id, title, text, ord FROM content")
def _(spark, sf_dir):
    return CL.claim_sections(parsing.sections(_parsed(spark, sf_dir)))


@query("r20_decompose_prompts", """
SELECT c.paper_id, CAST(c.ord AS VARCHAR) AS unit_id, sha256('Section title: ' || c.title || chr(10) || chr(10) || 'Reference ids available in this paper: '
  || coalesce(nullif(array_to_string(k.ids, ', '), ''), '(none)') || chr(10) || chr(10) || 'Section text:' || chr(10) || '---' || chr(10) || c.text
  || chr(10) || '---' || chr(10) || chr(10) || 'Return the JSON array now.') AS prompt_hash
FROM content c LEFT JOIN known k USING (paper_id)
""")
def _(spark, sf_dir):
    return CL.decompose_requests(_parsed(spark, sf_dir)).select(
        "paper_id", "unit_id", F.sha2("prompt", 256).alias("prompt_hash")
    )


def _replies(spark, sf_dir, parsed=None):
    """Model replies to the claim requests, still one row per section."""
    asked = CL.decompose_requests(_parsed(spark, sf_dir) if parsed is None else parsed)
    return asked.select(
        "paper_id", F.col("unit_id").cast("int").alias("ord"), model.claim_reply(F.col("prompt")).alias("text")
    )


@query(
    "r21a_parse_claims",
    "SELECT paper_id, ord, item_pos, text, array_to_string(ref_ids, ',') AS ref_ids FROM raw_claims",
)
def _(spark, sf_dir):
    return CL.parse_claims(_replies(spark, sf_dir)).withColumn("ref_ids", F.array_join("ref_ids", ","))


@query(
    "r22_known_refs",
    "SELECT paper_id, 'claim-' || claim_seq AS claim_id, array_to_string(ref_ids, ',') AS ref_ids FROM claims0",
)
def _(spark, sf_dir):
    raw = CL.number_claims(CL.parse_claims(_replies(spark, sf_dir)))
    return CL.known_refs(raw, _parsed(spark, sf_dir)).select(
        "paper_id", "claim_id", F.array_join("ref_ids", ",").alias("ref_ids")
    )


def _claims(spark, sf_dir, parsed=None):
    parsed = _parsed_once(spark, sf_dir) if parsed is None else parsed
    return _stored(CL.build_claims(CL.parse_claims(_replies(spark, sf_dir, parsed)), parsed), "claims")


@query("r23_claims", """
SELECT paper_id, claim_id, claim_seq, text, claim_type, severity, section_id, char_start, char_end, array_to_string(ref_ids, ',') AS ref_ids FROM claims
""")
def _(spark, sf_dir):
    return _claims(spark, sf_dir).withColumn("ref_ids", F.array_join("ref_ids", ","))


_TURN = "(SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' It improves the mean by 12 points.' WHEN 1 THEN ' As of 2019 it can help.' WHEN 2 THEN ' See Miller et al. (2015).' WHEN 3 THEN ' A novel gain of 4.5 %.' ELSE '' END AS t FROM conversations)"


@query(
    "r24_turn_categories",
    f"SELECT conv_id, turn, claim_type, {O.severity('claim_type', 't')} AS severity FROM (SELECT *, {O.claim_type('t', 'FALSE')} AS claim_type FROM {_TURN})",
)
def _(spark, sf_dir):
    corpus.table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    turns = spark.sql(f"SELECT * FROM {_TURN}")
    typed = turns.withColumn("claim_type", CL.claim_type(F.col("t"), F.lit(False)))
    return typed.select(
        "conv_id", "turn", "claim_type", CL.severity_of(F.col("claim_type"), F.col("t")).alias("severity")
    )


# --- verification ------------------------------------------------------------------


def _verified(spark, sf_dir):
    parsed = _parsed_once(spark, sf_dir)
    refs, cat = _ref_catalog(spark, sf_dir, parsed)
    lookups = _stored(C.lookup_refs(refs, cat), "lookups")
    claims = _claims(spark, sf_dir, parsed)
    results = verification.verify_claims(
        claims, lookups, C.metadata_match(refs, lookups), _temporal(spark, sf_dir, refs)
    )
    return claims, lookups, results


@query("j6_claim_refs", "SELECT paper_id, claim_id, ref_pos, ref_id, status, source FROM crefs")
def _(spark, sf_dir):
    parsed = _parsed_once(spark, sf_dir)
    lookups = C.lookup_refs(*_ref_catalog(spark, sf_dir, parsed))
    return verification.claim_refs(_claims(spark, sf_dir, parsed), lookups).drop("meta")


@query(
    "a2_verify_claims",
    "SELECT paper_id, claim_id, verified, confidence, source, evidence, hallucination_flag, notes FROM verdicts",
)
def _(spark, sf_dir):
    return _verified(spark, sf_dir)[2]


def _pairs(spark, sf_dir, claims=None, lookups=None):
    if claims is None:
        parsed = _parsed_once(spark, sf_dir)
        claims = _claims(spark, sf_dir, parsed)
        lookups = _stored(C.lookup_refs(*_ref_catalog(spark, sf_dir, parsed)), "lookups")
    found = lookups.filter("status = 'FOUND'").select(
        "paper_id", "ref_id", F.col("meta.doi").alias("doi"), F.lit(None).cast("string").alias("arxiv_id")
    )
    abstracts = C.abstracts_by_id(found, corpus.catalog(spark, sf_dir))
    return _stored(EN.entailment_pairs(claims, lookups, abstracts), "pairs")


@query("j8_entailment_pairs", "SELECT paper_id, claim_id, ref_pos, ref_id, claim_text, abstract FROM pairs")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir)


# Benchmark passages as claims against every document that carries the same item number.
_BENCH = "(SELECT b.item_id, d.doc_id, b.text AS claim_text, d.text AS abstract FROM benchmark b JOIN (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item FROM documents) d ON d.item = b.item_id)"


@query(
    "r38_keyword_entailment",
    O.keyword(_BENCH, "item_id, doc_id").replace("k_verdict", "verdict").replace("k_confidence", "confidence").replace("k_rationale", "rationale"),
)
def _(spark, sf_dir):
    corpus.register(spark, sf_dir)
    corpus.table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return EN.keyword_entailment(spark.sql(f"SELECT * FROM {_BENCH}"))


def _verdicts(pairs):
    asked = EN.entailment_requests(pairs)
    said = asked.select(
        "paper_id", "claim_id", "ref_pos", "ref_id", model.entailment_reply(F.col("prompt")).alias("text")
    )
    return EN.entailment(pairs, said)


@query("j9b_entailment", "SELECT paper_id, claim_id, ref_pos, ref_id, verdict, confidence, rationale, method FROM entail")
def _(spark, sf_dir):
    return _verdicts(_pairs(spark, sf_dir))


@query("j9b_entailment_keyword_only", f"""
SELECT paper_id, claim_id, ref_pos, ref_id, CASE WHEN abstract IS NULL THEN 'INSUFFICIENT' ELSE k_verdict END AS verdict,
  CASE WHEN abstract IS NULL THEN {dbl(0)} ELSE k_confidence END AS confidence,
  CASE WHEN abstract IS NULL THEN 'No abstract available for cited paper.' ELSE k_rationale END AS rationale,
  CASE WHEN abstract IS NULL THEN 'no_abstract' ELSE 'keyword' END AS method FROM kw
""")
def _(spark, sf_dir):
    return EN.entailment(_pairs(spark, sf_dir))


def _merged(spark, sf_dir):
    claims, lookups, results = _verified(spark, sf_dir)
    pairs = _pairs(spark, sf_dir, claims, lookups)
    return claims, _stored(verification.merge_entailment(results, _verdicts(pairs)), "results")


@query("j10_merge_entailment", "SELECT paper_id, claim_id, verified, confidence, source, evidence, hallucination_flag, notes FROM merged")
def _(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


@query("a1_ledger", "SELECT paper_id, total_claims, verified_count, hallucination_count, mean_confidence FROM ledger")
def _(spark, sf_dir):
    return verification.ledger(_merged(spark, sf_dir)[1], _papers(spark, sf_dir))


@query("a15_flagged_citations", """
SELECT paper_id, array_to_string(list_sort(list(DISTINCT ref_id)), ',') AS flagged_citations
FROM (SELECT c.paper_id, unnest(c.ref_ids) AS ref_id FROM claims c JOIN merged m USING (paper_id, claim_id) WHERE m.hallucination_flag) GROUP BY 1
""")
def _(spark, sf_dir):
    return verification.flagged_citations(*_merged(spark, sf_dir)).withColumn(
        "flagged_citations", F.array_join("flagged_citations", ",")
    )


@query("v12_unverified_claims", """
SELECT paper_id, claim_id, CASE WHEN m.hallucination_flag THEN 'hallucination' ELSE 'unverified' END AS label, claim_type, severity, confidence, source,
  CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS claim_text, text AS full_text, notes
FROM claims c JOIN merged m USING (paper_id, claim_id) WHERE NOT m.verified OR m.hallucination_flag
""")
def _(spark, sf_dir):
    return verification.unverified_claims(*_merged(spark, sf_dir))


# --- authors, inference, cost --------------------------------------------------------


@query("j16_match_authors", f"""
SELECT paper_id, queried_name, CASE WHEN k % 3 <> 0 THEN '0000-0002-1825-009' || CASE WHEN k % 2 = 0 THEN 'X' ELSE '7' END END AS orcid_id,
  queried_name AS matched_name, CASE WHEN k % 4 = 0 THEN 'MIT' WHEN k % 4 = 1 THEN 'ETH' END AS institution, {dbl(1)} AS confidence
FROM (SELECT 'p-' || p_partkey AS paper_id, p_partkey % (SELECT count(*) FROM supplier) AS r FROM part) a
JOIN (SELECT name AS queried_name, k, k % (SELECT count(*) FROM supplier) AS r FROM {SUPPLIERS}) n USING (r)
""")
def _(spark, sf_dir):
    candidates = responses.normalize_orcid(_orcid_bodies(spark, sf_dir, SUPPLIERS))
    corpus.table(spark, sf_dir, "part").createOrReplaceTempView("part")
    n = "(SELECT count(*) AS n FROM supplier)"
    asked = spark.sql(
        f"""SELECT a.paper_id, b.name AS queried_name FROM (SELECT concat('p-', p_partkey) AS paper_id, p_partkey % {n} AS r FROM part) a
        JOIN (SELECT name, k % {n} AS r FROM {SUPPLIERS}) b ON a.r = b.r"""
    )
    return AU.match_authors(asked, candidates, hot_rows=10)


@query("x1_stub_completions", f"""
SELECT doc_id, 'STUB[' || substr(sha256('sys' || chr(10) || text), 1, 12) || '] ' || substr(text, 1, 120) AS text,
  greatest(1, length(text) // 4) AS prompt_tokens, greatest(1, (19 + least(length(text), 120)) // 4) AS completion_tokens FROM documents
""")
def _(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("cache_key"), F.lit("sys").alias("system"),
        F.col("text").alias("prompt"), F.lit("m").alias("model"),
    )
    return inference.stub_completions(rows).select(
        F.col("cache_key").cast("bigint").alias("doc_id"), "text", "prompt_tokens", "completion_tokens"
    )


_VEC = "list_transform(range(0, 16), lambda i: (CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INT) - CAST(127.5 AS DOUBLE)) / CAST(127.5 AS DOUBLE))"


@query("x2_stub_embeddings", f"""
SELECT doc_id, i AS dim, v[i + 1] / n AS value FROM (
  SELECT doc_id, v, sqrt(list_reduce(list_prepend({dbl(0)}, list_transform(v, lambda x: x * x)), lambda a, b: a + b)) AS n FROM (
    SELECT doc_id, {_VEC} AS v FROM (SELECT doc_id, sha256(text) AS h FROM documents))), (SELECT unnest(range(0, 16)) AS i)
""")
def _(spark, sf_dir):
    v = _docs(spark, sf_dir).select("doc_id", F.array("text").alias("texts"))
    asked = v.select(F.col("doc_id").cast("string").alias("cache_key"), "texts", F.lit("m").alias("model"))
    return inference.stub_embeddings(asked).select(
        F.col("cache_key").cast("bigint").alias("doc_id"),
        F.posexplode(F.get("vectors", F.lit(0))).alias("dim", "value"),
    )


@query("j14_with_cache", """
SELECT doc_id, r.text, k.hit AS cache_hit FROM (SELECT doc_id, text AS prompt, 'STUB[' || substr(sha256('sys' || chr(10) || text), 1, 12) || '] ' || substr(text, 1, 120) AS text FROM documents) r
JOIN (SELECT text AS prompt, bool_or(doc_id % 4 = 0) AS hit FROM documents GROUP BY 1) k USING (prompt)
""")
def _(spark, sf_dir):
    # Every fourth document was answered before; exact copies share one answer.
    asked = inference.request_rows(
        _docs(spark, sf_dir).select(
            F.col("doc_id").cast("string").alias("unit_id"), F.lit("p").alias("paper_id"), F.col("text").alias("prompt")
        ),
        kind="check", system="sys", model="m", max_tokens=10,
    )
    cache = inference.stub_completions(
        inference.distinct_requests(asked.filter(F.col("unit_id").cast("bigint") % 4 == 0))
    )
    answers, _ = inference.with_cache(asked, cache, inference.stub_completions, hot_rows=3)
    return answers.select(F.col("unit_id").cast("bigint").alias("doc_id"), "text", "cache_hit")


def _usage(spark, sf_dir):
    """Events as model calls: the event type picks the model, the id the token counts."""
    c = F.col
    name = (
        F.when(c("event_type") == "click", F.lit("claude-sonnet-4-6"))
        .when(c("event_type") == "view", F.lit("gpt-4o-mini"))
        .when(c("event_type") == "purchase", F.lit("claude-opus-4-6"))
        .otherwise(c("event_type"))
    )
    return corpus.table(spark, sf_dir, "events").select(
        "event_id", c("ts").alias("timestamp"), F.lit("check").alias("provider"), name.alias("model"),
        (c("event_id") % 977).alias("prompt_tokens"), (c("event_id") % 313).alias("completion_tokens"),
        c("value").alias("cost_usd"), F.lit("complete").alias("kind"),
    )


@query("j15_estimate_cost", f"""
SELECT event_id, (event_id % 977) * pin / {dbl(1000000)} + (event_id % 313) * pout / {dbl(1000000)} AS cost_usd FROM (
  SELECT event_id, CASE event_type WHEN 'click' THEN {dbl(3)} WHEN 'view' THEN {dbl(0.15)} WHEN 'purchase' THEN {dbl(15)} ELSE {dbl(0)} END AS pin,
    CASE event_type WHEN 'click' THEN {dbl(15)} WHEN 'view' THEN {dbl(0.6)} WHEN 'purchase' THEN {dbl(75)} ELSE {dbl(0)} END AS pout FROM events)
""")
def _(spark, sf_dir):
    return costs.estimate_cost(_usage(spark, sf_dir).drop("cost_usd")).select("event_id", "cost_usd")


_NAMED = "CASE event_type WHEN 'click' THEN 'claude-sonnet-4-6' WHEN 'view' THEN 'gpt-4o-mini' WHEN 'purchase' THEN 'claude-opus-4-6' ELSE event_type END"


@query("a10_cost_totals", f"""
SELECT {_NAMED} AS model, CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE) AS cost_usd, sum(event_id % 977) AS prompt_tokens,
  sum(event_id % 313) AS completion_tokens, count(*) AS n_calls, 0 AS is_total FROM events GROUP BY 1
UNION ALL SELECT NULL, CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE), sum(event_id % 977), sum(event_id % 313), count(*), 1 FROM events
""")
def _(spark, sf_dir):
    return costs.cost_totals(_usage(spark, sf_dir))


_WINDOWED = f"""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {_NAMED} AS model, CAST(sum(CAST(value AS DECIMAL(28, 10))) AS DOUBLE) AS cost_usd,
  sum(event_id % 977 + event_id % 313) AS tokens, count(*) AS n_calls FROM events GROUP BY 1, 2
"""


@query("t2_windowed_costs", _WINDOWED)
def _(spark, sf_dir):
    from peerlight.streaming.costs import windowed_costs

    return windowed_costs(_usage(spark, sf_dir)).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "model", "cost_usd", "tokens", "n_calls"
    )


@query("t2_windowed_costs_stream", _WINDOWED)
def _(spark, sf_dir):
    """The same aggregation driven as a stream over the events files to completion."""
    from peerlight.streaming.costs import windowed_costs

    raw = corpus.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream.createOrReplaceTempView("event_stream")
    usage = spark.sql(
        f"SELECT CAST(ts AS TIMESTAMP) AS timestamp, {_NAMED} AS model, event_id % 977 AS prompt_tokens, event_id % 313 AS completion_tokens, value AS cost_usd FROM event_stream"
    )
    out = _folder(spark, "costs")

    def keep(batch, batch_id):
        # The whole result of the last batch replaces the one before.
        batch.write.mode("overwrite").parquet(out)

    run = (
        windowed_costs(usage).writeStream.foreachBatch(keep).outputMode("complete")
        .option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "model", "cost_usd", "tokens", "n_calls"
    )


@query("r39_name_similarity", f"""
SELECT p_partkey, k, CASE WHEN len(a) = 0 OR len(b) = 0 THEN {dbl(0)} ELSE greatest(len(list_intersect(a, b)) / {dbl('len(a)')},
  len(list_intersect(a, b)) / {dbl('len(list_distinct(list_concat(a, b)))')}) END AS score
FROM (SELECT p_partkey, k, list_distinct(regexp_extract_all(lower(p_name), '[A-Za-z][A-Za-z\\-'']+')) AS a,
  list_distinct(regexp_extract_all(lower(name || ' ' || p_name2), '[A-Za-z][A-Za-z\\-'']+')) AS b
  FROM (SELECT p.p_partkey, n.k, p.p_name, n.name, r.p_name AS p_name2 FROM part p JOIN {PEOPLE} n ON n.k = p.p_partkey % 100 JOIN part r ON r.p_partkey = n.k))
""")
def _(spark, sf_dir):
    for name in ("part", "supplier"):
        corpus.table(spark, sf_dir, name).createOrReplaceTempView(name)
    pairs = spark.sql(
        f"SELECT p.p_partkey, n.k, p.p_name, concat(n.name, ' ', r.p_name) AS other FROM part p JOIN {PEOPLE} n ON n.k = p.p_partkey % 100 JOIN part r ON r.p_partkey = n.k"
    )
    return pairs.select(
        "p_partkey", "k", AU.name_similarity(T.name_words(F.col("p_name")), T.name_words(F.col("other"))).alias("score")
    )


# --- fairness ---------------------------------------------------------------------


def _scored(spark, sf_dir):
    """Documents as records: quality is the adjusted total, language the group."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", "source", T.word_count(F.col("text")).alias("word_count"))
    lab = corpus.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("rubric_adjusted_total"))
    return d.join(lab, "doc_id", "left")


_RATES = "SELECT lang AS label, count(*) AS n, count(*) FILTER (WHERE quality >= 0.55) AS positive FROM scored GROUP BY 1"
_DI = f"""SELECT n_groups, reference_group, {rx(f"CASE WHEN hi > 0 THEN lo / hi ELSE {dbl(1)} END")} AS di_ratio,
  (CASE WHEN hi > 0 THEN lo / hi ELSE {dbl(1)} END) < 0.8 AS flagged_4_5ths_rule, '' AS notes, rates
FROM (SELECT count(*) AS n_groups, arg_min(label, {{'a': -r, 'b': label}}) AS reference_group, max(r) AS hi, min(r) AS lo,
  string_agg(label || ':' || positive || '/' || n, ',' ORDER BY label) AS rates FROM (SELECT *, positive / {dbl('n')} AS r FROM ({{src}})))"""


def _rates_text(c):
    return F.array_join(
        F.transform(c, lambda g: F.concat(g["label"], F.lit(":"), g["positive"].cast("string"), F.lit("/"), g["n"].cast("string"))), ","
    )


@query("a11_disparate_impact", _DI.replace("{src}", _RATES))
def _(spark, sf_dir):
    out = fairness.disparate_impact(
        _scored(spark, sf_dir), F.col("lang"), F.col("rubric_adjusted_total"), 0.55, list_rates=True
    )
    return out.withColumn("rates", _rates_text(F.col("group_rates"))).drop("group_rates")


_PEARSON = f"SELECT {rx('corr(word_count, quality)')} AS length_score_pearson, 'Pearson over ' || count(quality) || ' records.' AS length_score_rationale FROM scored"


@query("a12_length_score_corr", _PEARSON)
def _(spark, sf_dir):
    return fairness.length_score_corr(_scored(spark, sf_dir))


_LANGS = """SELECT lang, count(quality) AS n, CASE WHEN min(quality) = max(quality) THEN 0 ELSE corr(word_count, quality) END AS cor FROM
  (SELECT lang, word_count, CASE WHEN lang = 'es' THEN 0.5 WHEN lang = 'fr' AND doc_id <> first THEN NULL ELSE quality END AS quality
   FROM scored, (SELECT min(doc_id) AS first FROM scored WHERE lang = 'fr' AND quality IS NOT NULL) x) GROUP BY 1"""


@query(
    "a12_length_score_corr_edges",
    f"""SELECT lang, CASE WHEN n >= 3 THEN {rx('cor')} END AS length_score_pearson,
      CASE WHEN n >= 3 THEN 'Pearson over ' || n || ' records.' ELSE 'Too few records with rubric scores for correlation.' END AS length_score_rationale
    FROM ({_LANGS})""",
)
def _(spark, sf_dir):
    """Each language alone: one with a constant score, one with a single scored record."""
    rec, score = _scored(spark, sf_dir), F.col("rubric_adjusted_total")
    first = rec.filter("lang = 'fr' AND rubric_adjusted_total IS NOT NULL").agg(F.min("doc_id").alias("f"))
    rec = rec.withColumn(
        "rubric_adjusted_total",
        F.when(F.col("lang") == "es", 0.5).when((F.col("lang") == "fr") & (F.col("doc_id") != first.scalar()), None).otherwise(score),
    )
    parts = [
        fairness.length_score_corr(rec.filter(F.col("lang") == lang)).withColumn("lang", F.lit(lang))
        for lang in ("de", "en", "es", "fr")
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_MEDIAN = "(SELECT wcs[n // 2 + 1] AS median FROM (SELECT list(word_count ORDER BY word_count) AS wcs, count(*) AS n FROM scored))"


@query("a13_length_groups", f"SELECT doc_id, word_count, CASE WHEN word_count > median THEN 'long' ELSE 'short' END AS length_group FROM scored, {_MEDIAN}")
def _(spark, sf_dir):
    return fairness.length_groups(_scored(spark, sf_dir)).select("doc_id", "word_count", "length_group")


_LRATES = f"SELECT CASE WHEN word_count > median THEN 'long' ELSE 'short' END AS label, count(*) AS n, count(*) FILTER (WHERE quality >= 0.55) AS positive FROM scored, {_MEDIAN} GROUP BY 1"


@query("a14_fairness_report", f"""
SELECT s.n AS n_records, p.length_score_pearson, p.length_score_rationale, d.reference_group, d.di_ratio, d.flagged_4_5ths_rule, d.rates, {dbl(0.55)} AS accept_threshold
FROM (SELECT count(*) AS n FROM scored) s, ({_PEARSON}) p, ({_DI.replace('{src}', _LRATES)}) d
""")
def _(spark, sf_dir):
    d = lambda n: F.col(f"length_disparate_impact.{n}")
    return fairness.fairness_report(_scored(spark, sf_dir)).select(
        "n_records", "length_score_pearson", "length_score_rationale", d("reference_group").alias("reference_group"),
        d("di_ratio").alias("di_ratio"), d("flagged_4_5ths_rule").alias("flagged_4_5ths_rule"),
        _rates_text(d("group_rates")).alias("rates"), "accept_threshold",
    )


# --- quality ----------------------------------------------------------------------


@query("a17_reference_recall", f"""
SELECT count(*) AS n_gold, count(k.key) AS n_found, count(k.key) / {dbl('count(*)')} AS recall
FROM (SELECT 'doc-' || d AS paper_id, CASE WHEN abs(c) % 5 = 1 THEN {corpus.work_arxiv('c')} ELSE '10.5555/work.' || c END AS key
  FROM (SELECT d, unnest(list_transform(range(1, d % 13 + 1), lambda i: {corpus.CITED})) AS c FROM (SELECT doc_id AS d FROM documents))
  WHERE abs(c) % 5 IN (0, 1, 4)) g
LEFT JOIN (SELECT DISTINCT paper_id, unnest([lower(doi), lower(arxiv_id)]) AS key FROM refs) k USING (paper_id, key)
""")
def _(spark, sf_dir):
    corpus.register(spark, sf_dir)
    gold = spark.sql(f"""
      SELECT concat('doc-', d) AS paper_id, CASE WHEN abs(c) % 5 <> 1 THEN concat('10.5555/work.', c) END AS doi,
        CASE WHEN abs(c) % 5 = 1 THEN {corpus.work_arxiv('c')} END AS arxiv_id
      FROM (SELECT doc_id AS d, explode(transform(sequence(1, CAST(doc_id % 13 AS INT)), i -> {corpus.CITED.replace('d ', 'doc_id ')})) AS c
            FROM documents WHERE doc_id % 13 > 0)
      WHERE abs(c) % 5 IN (0, 1, 4)""")
    return quality.keyed_reference_recall(_refs(spark, sf_dir), gold)


@query("a17_entailment_accuracy", f"""
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE (verdict = 'SUPPORTED') = supported) AS n_right,
  count(*) FILTER (WHERE (verdict = 'SUPPORTED') = supported) / {dbl('count(*)')} AS accuracy
FROM (SELECT verdict, doc_id % 2 = 0 AS supported FROM ({ORACLES['r38_keyword_entailment']}))
""")
def _(spark, sf_dir):
    verdicts = QUERIES["r38_keyword_entailment"](spark, sf_dir)
    return quality.entailment_accuracy(verdicts.withColumn("supported", F.col("doc_id") % 2 == 0))


@query("a17_fabrication_catch", """
SELECT count(*) FILTER (WHERE fake) AS n_fake, count(*) FILTER (WHERE fake AND status = 'NOT_FOUND') AS n_caught,
  count(*) FILTER (WHERE NOT fake) AS n_real, count(*) FILTER (WHERE NOT fake AND status = 'NOT_FOUND') AS n_false_alarms
FROM (SELECT l.status, NOT EXISTS (SELECT 1 FROM cat c WHERE lower(c.doi) = lower(r.doi)) AS fake FROM refs r JOIN look l USING (paper_id, ref_id) WHERE r.doi IS NOT NULL)
""")
def _(spark, sf_dir):
    refs, cat = _ref_catalog(spark, sf_dir)
    real = cat.filter("doi is not null").select(F.lower("doi").alias("k")).distinct()
    gold = refs.filter("doi is not null").withColumn("k", F.lower("doi")).join(
        real.withColumn("real", F.lit(True)), "k", "left"
    ).select("paper_id", "ref_id", F.col("real").isNull().alias("fake"))
    return quality.catch_rate(C.lookup_refs(refs, cat), gold)


# --- contracts --------------------------------------------------------------------


@query("r34_contract_violations", """
SELECT doc_id, unnest(list_filter([CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_in_unit_range' END,
  CASE WHEN severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN 'severity_domain' END, CASE WHEN char_start < 0 THEN 'span_start_non_negative' END,
  CASE WHEN char_end < char_start THEN 'span_ordered' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT doc_id, (doc_id % 13) / 10.0 AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'SEVERE' ELSE 'HIGH' END AS severity,
  doc_id % 4 - 1 AS char_start, n_chars % 3 AS char_end FROM documents)
""")
def _(spark, sf_dir):
    c = F.col
    rows = _docs(spark, sf_dir).select(
        "doc_id", ((c("doc_id") % 13) / 10.0).alias("confidence"),
        F.when(c("doc_id") % 5 == 0, F.lit("SEVERE")).otherwise(F.lit("HIGH")).alias("severity"),
        (c("doc_id") % 4 - 1).alias("char_start"), (c("n_chars") % 3).alias("char_end"),
    )
    return contracts.contract_violations(rows).select("doc_id", "rule")


_UNITS = [
    "confidence", "overall", "mean_confidence", "methodology", "limitations", "reproducibility", "logical_soundness",
    "raw_total", "bias_adjusted_total", "composite", "overall_score", "reviewer_confidence", "max_penalty",
]
_DOMAINS = ["claim_type", "severity", "source", "triage", "recommendation", "status", "verdict"]
_SIGNED = ["compliance", "verification", "depth", "rubric", "cost_usd"]
# Columns of one wide table that every rule applies to, by residues of the id; SQL of both dialects.
_ALL_COLS = ", ".join(
    [f"((d + {i}) % 13) / CAST(10.0 AS DOUBLE) AS {n}" for i, n in enumerate(_UNITS)]
    + [f"CASE WHEN d % {i + 5} = 0 THEN 'other' ELSE '{P.ENUMS[n][0]}' END AS {n}" for i, n in enumerate(_DOMAINS)]
    + [f"CAST(d % {i + 7} AS DOUBLE) - 1 AS {n}" for i, n in enumerate(_SIGNED)]
    + [
        "'w' AS weight_set", "d % 4 - 1 AS char_start", "d % 3 AS char_end", "d % 5 AS score", "d % 7 - 1 AS max_score",
        "d % 6 AS total_claims", "d % 7 AS verified_count", "d % 5 AS hallucination_count", "d % 9 AS penalty_start", "d % 8 AS penalty_full",
    ]
)
_ALL_RULES = [f"CASE WHEN {n} < 0 OR {n} > 1 THEN '{n}_in_unit_range' END" for n in _UNITS]
_ALL_RULES += [f"CASE WHEN {n} NOT IN ({', '.join(q(x) for x in P.ENUMS[n])}) THEN '{n}_domain' END" for n in _DOMAINS]
_ALL_RULES += [f"CASE WHEN {n} < 0 THEN 'weight_{n}_non_negative' END" for n in _SIGNED[:4]]
_ALL_RULES += [
    "CASE WHEN cost_usd < 0 THEN 'cost_non_negative' END", "CASE WHEN char_start < 0 THEN 'span_start_non_negative' END",
    "CASE WHEN char_end < char_start THEN 'span_ordered' END", "CASE WHEN max_score <= 0 THEN 'max_score_positive' END",
    "CASE WHEN score < 0 OR score > max_score THEN 'score_in_range' END",
    "CASE WHEN verified_count > total_claims OR hallucination_count > total_claims THEN 'claim_counts_consistent' END",
    "CASE WHEN penalty_full <= penalty_start THEN 'penalty_bounds_ordered' END",
]


@query(
    "r34_all_rules",
    f"""SELECT d AS doc_id, unnest(list_filter([{', '.join(_ALL_RULES)}], lambda x: x IS NOT NULL)) AS rule
    FROM (SELECT d, {_ALL_COLS} FROM (SELECT doc_id AS d FROM documents))""",
)
def _(spark, sf_dir):
    corpus.register(spark, sf_dir)
    rows = spark.sql(f"SELECT d AS doc_id, {_ALL_COLS} FROM (SELECT doc_id AS d FROM documents)")
    return contracts.contract_violations(rows).select("doc_id", "rule")


# --- evaluation and what-if ---------------------------------------------------------


@query("v14_evaluate_papers", f"""
SELECT c.paper_id, c.config_id, h.config_hash, f.title, f.word_count, f.n_refs, c.triage, c.n_passed, c.n_checks, c.issues,
  d.methodology, d.limitations, d.reproducibility, d.logical_soundness, r.raw_total, r.bias_adjusted_total, o.composite, o.recommendation, 0 AS total_claims
FROM comp c JOIN facts f USING (paper_id) JOIN dep d USING (paper_id) JOIN rub r USING (paper_id, config_id)
JOIN hashes h USING (config_id) JOIN compo o USING (paper_id, config_id)
""")
def _(spark, sf_dir):
    review = R.evaluate_papers(_papers(spark, sf_dir), metadata=corpus.metadata(spark, sf_dir))
    return review.evaluations.select(
        "paper_id", "config_id", "config_hash", "title", "word_count", "n_refs", "triage", "n_passed", "n_checks",
        _joined("issues").alias("issues"), "methodology", "limitations", "reproducibility", "logical_soundness",
        "raw_total", "bias_adjusted_total", "composite", "recommendation", "total_claims",
    )


def _full(spark, sf_dir, **switches):
    return R.evaluate_papers(
        _papers(spark, sf_dir), catalog=corpus.catalog(spark, sf_dir), infer=model.replies,
        metadata=corpus.metadata(spark, sf_dir),
        options=R.Options(
            current_year=2020, max_age=20, provider="check", run_id="check-" + uuid.uuid4().hex[:12],
            created_at="2024-01-01 00:00:00", **switches,
        ),
    )


_FULL_COLS = "paper_id, config_id, triage, total_claims, verified_count, hallucination_count, mean_confidence, raw_total, bias_adjusted_total, composite, recommendation"


@query("v14_full_review", f"""
SELECT {_FULL_COLS} FROM led_cfg JOIN rub_full USING (paper_id, config_id) JOIN compo_full USING (paper_id, config_id)
""")
def _(spark, sf_dir):
    return _full(spark, sf_dir).evaluations.select(*_FULL_COLS.split(", "))


@query("x6_review_without_entailment", f"""
SELECT {_FULL_COLS} FROM led_cfg_plain JOIN rub_full_plain USING (paper_id, config_id) JOIN compo_full_plain USING (paper_id, config_id)
""")
def _(spark, sf_dir):
    return _full(spark, sf_dir, include_entailment=False).evaluations.select(*_FULL_COLS.split(", "))


@query("j17_scored_dims", "SELECT paper_id, config_id, dim_pos, name, score, max_score, weight, rationale FROM dims_full")
def _(spark, sf_dir):
    return RU.rubric_dims(_full(spark, sf_dir).evaluations)


@query("r21b_parse_entailment", f"""
SELECT conv_id, turn, CASE WHEN r = 2 THEN NULL WHEN r = 1 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict,
  CASE r WHEN 0 THEN {dbl(0.9)} WHEN 1 THEN {dbl(0.5)} WHEN 3 THEN {dbl(1)} WHEN 4 THEN {dbl(0.65)} END AS confidence,
  CASE r WHEN 0 THEN 'it says no' WHEN 4 THEN 'weak' WHEN 2 THEN NULL ELSE '' END AS rationale
FROM (SELECT conv_id, turn, length(text) % 5 AS r FROM conversations)
""")
def _(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    prompt = F.concat(F.lit("Claim: "), F.col("text"), F.lit("\n\nAbstract of cited paper:"))
    said = turns.select("conv_id", "turn", model.entailment_reply(prompt).alias("text"))
    return EN.parse_entailment(said).select("conv_id", "turn", "parsed.verdict", "parsed.confidence", "parsed.rationale")


@query("r20_rubric_prompts", f"""
SELECT c.paper_id, c.config_id, sha256('Paper title: ' || f.title || chr(10) || chr(10) || 'Abstract:' || chr(10) || substr(coalesce(f.abstract, ''), 1, 1500)
  || chr(10) || chr(10) || 'Key signals (from earlier pipeline stages):' || chr(10) || '- Total claims extracted: 0' || chr(10) || '- Verified claim fraction: 0.00'
  || chr(10) || '- Hallucination flag count: 0' || chr(10) || '- Mean verification confidence: 0.00' || chr(10) || '- Methodology score: ' || {fx('d.methodology', 2)}
  || chr(10) || '- Limitations score: ' || {fx('d.limitations', 2)} || chr(10) || '- Reproducibility score: ' || {fx('d.reproducibility', 2)} || chr(10) || chr(10)
  || 'Section excerpts (each truncated to 500 chars):' || chr(10) || coalesce(e.ex, '(no key sections found)') || chr(10) || chr(10) || 'Dimensions to score:' || chr(10)
  || CASE c.config_id {' '.join('WHEN ' + q(n) + ' THEN ' + q(chr(10).join('- "' + x['name'] + '" (max ' + str(x['max_score']) + '): ' + x['description'] for x in O.SHIPPED[n]['rubric']['dimensions'])) for n in O.VENUES)} END
  || chr(10) || chr(10) || 'Return the JSON now.') AS prompt_hash
FROM comp c JOIN facts f USING (paper_id) JOIN dep d USING (paper_id)
LEFT JOIN (SELECT paper_id, string_agg('### ' || title || chr(10) || replace(substr(text, 1, 500), chr(10), ' '), chr(10) || chr(10) ORDER BY ord) AS ex
  FROM secs WHERE {O.has_any('tl', RR.KEY_SECTIONS)} GROUP BY 1) e USING (paper_id)
""")
def _(spark, sf_dir):
    parsed = _parsed_meta(spark, sf_dir)
    rows = R.with_ledger(R.triaged(parsed), None).drop("title", "abstract")
    return RR.rubric_requests(parsed, rows).select("paper_id", "config_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query("r20_entailment_prompts", """
SELECT paper_id, claim_id, ref_pos, sha256('Claim: ' || claim_text || chr(10) || chr(10) || 'Abstract of cited paper:' || chr(10) || '---' || chr(10) || abstract
  || chr(10) || '---' || chr(10) || chr(10) || 'Return JSON now.') AS prompt_hash FROM pairs WHERE abstract IS NOT NULL
""")
def _(spark, sf_dir):
    return EN.entailment_requests(_pairs(spark, sf_dir)).select(
        "paper_id", "claim_id", "ref_pos", F.sha2("prompt", 256).alias("prompt_hash")
    )


def _scores(spark, sf_dir):
    return _sub(_heuristic(spark, sf_dir))


def _w(weights: dict) -> dict:
    return {k: dbl(v) for k, v in weights.items()}


_PRE = whatif.preset_sets()


@query("v6_reweight", " UNION ALL ".join(
    f"""SELECT *, {rx('new_composite - original_composite')} AS delta, {O.recommendation('original_composite')} AS recommendation_before,
    {O.recommendation('new_composite')} AS recommendation_after FROM (SELECT paper_id, config_id, '{n}' AS weight_set, composite AS original_composite,
    {rx(O.composite(O.V, _w(w)))} AS new_composite FROM compo)"""
    for n, w in [("heavy", {**P.DEFAULT_WEIGHTS, "depth": 0.9}), ("content-only", _PRE["content-only"])]
))
def _(spark, sf_dir):
    out = whatif.reweight(_scores(spark, sf_dir), {"heavy": {"depth": 0.9}, "content-only": _PRE["content-only"]})
    return out.drop("set_ord", "breakdown", "weights")


@query("v8_sweep", f"""
SELECT paper_id, config_id, step, weight, composite, recommendation,
  coalesce(recommendation <> lag(recommendation) OVER (PARTITION BY paper_id, config_id ORDER BY step), FALSE) AS flips
FROM (SELECT *, {O.recommendation('composite')} AS recommendation FROM (
  SELECT paper_id, config_id, step, {dbl(0)} + step * {dbl(0.1)} AS weight,
    {rx(O.composite(O.V, {**O.W, 'compliance': f'({dbl(0)} + step * {dbl(0.1)})'}))} AS composite
  FROM sub, (SELECT unnest(range(0, 5)) AS step)))
""")
def _(spark, sf_dir):
    return whatif.sweep(_scores(spark, sf_dir), "compliance", 0.0, 0.4, 0.1)


_TRY = ", ".join(f"{rx(O.composite(O.V, _w(_PRE[n])))} AS t{i}" for i, n in enumerate(P.TIPPING_ORDER))
_FIRST = " ".join(f"WHEN t{i} >= {dbl(0.55)} THEN {i}" for i in range(5))
_BEST = " ".join(f"WHEN t{i} = greatest(t0, t1, t2, t3, t4) THEN {i}" for i in range(5))


@query("v9_tipping_point", f"""
SELECT paper_id, config_id, reached, [{', '.join(q(n) for n in P.TIPPING_ORDER)}][pick + 1] AS preset, [t0, t1, t2, t3, t4][pick + 1] AS composite,
  {O.recommendation('[t0, t1, t2, t3, t4][pick + 1]')} AS recommendation
FROM (SELECT *, greatest(t0, t1, t2, t3, t4) >= {dbl(0.55)} AS reached, CASE {_FIRST} ELSE CASE {_BEST} END END AS pick FROM (SELECT paper_id, config_id, {_TRY} FROM sub))
""")
def _(spark, sf_dir):
    return whatif.tipping_point(_scores(spark, sf_dir), "WEAK_ACCEPT")


_EXPL = " UNION ALL ".join(
    f"""SELECT paper_id, config_id, {i} AS stage_pos, '{k}' AS stage, {rx(k)} AS value, {O.W[k]} AS weight, {rx(f'{k} * {O.W[k]}')} AS weighted,
    coalesce(repeat('█', CAST(floor({k} * 10 + {dbl(1e-9)}) AS INT)) || repeat('░', 10 - CAST(floor({k} * 10 + {dbl(1e-9)}) AS INT)), '──────────') AS bar,
    weakest = '{k}' AS is_weakest, composite FROM expl"""
    for i, k in enumerate(P.SCORING_KEYS)
)


@query("v10_explain", f"""
SELECT * FROM ({_EXPL.replace('FROM expl', '''FROM (SELECT *, CASE WHEN compliance = least(compliance, depth, rubric) THEN 'compliance'
  WHEN depth = least(compliance, depth, rubric) THEN 'depth' ELSE 'rubric' END AS weakest FROM compo)''')})
""")
def _(spark, sf_dir):
    return whatif.explain(_scores(spark, sf_dir))


_SIDE = " UNION ALL ".join(
    [f"SELECT paper_id, config_id, {i} AS row_ord, '{k}' AS stage, coalesce({fx(k, 2)}, '_skipped_') AS value_a, coalesce({fx(k, 2)}, '_skipped_') AS value_b FROM sub" for i, k in enumerate(P.SCORING_KEYS)]
    + [f"SELECT paper_id, config_id, 4, 'composite', {fx(rx(O.composite(O.V, O.W)), 2)}, {fx(rx(O.composite(O.V, _w(_PRE['rubric-heavy']))), 2)} FROM sub",
       f"SELECT paper_id, config_id, 5, 'recommendation', {O.recommendation('a')}, {O.recommendation('b')} FROM (SELECT paper_id, config_id, {rx(O.composite(O.V, O.W))} AS a, {rx(O.composite(O.V, _w(_PRE['rubric-heavy'])))} AS b FROM sub)"]
)


@query("v11_side_by_side", _SIDE)
def _(spark, sf_dir):
    return whatif.side_by_side(_scores(spark, sf_dir), "defaults", "rubric-heavy")


_CONF = rx(f"greatest({dbl(0)}, least({dbl(1)}, {dbl(0.35)} * coalesce((l.verified_count + l.hallucination_count) / {dbl('nullif(l.total_claims, 0)')}, {dbl(0)}) + {dbl(0.35)} * ((d.methodology + d.limitations + d.reproducibility + d.logical_soundness) / {dbl(4)}) + {dbl(0.3)} * (CASE WHEN l.triage = 'PASS' THEN {dbl(1)} ELSE {dbl(0.5)} END)))")


@query("a16_reviewer_confidence", f"SELECT l.paper_id, l.config_id, {_CONF} AS reviewer_confidence FROM led_cfg l JOIN dep d USING (paper_id)")
def _(spark, sf_dir):
    return drafts.review_drafts(_full(spark, sf_dir).evaluations).select("paper_id", "config_id", "reviewer_confidence")


def _dim_line(label):
    return f"'{label} ' || name || ': ' || {fx('score', 2)} || '/' || CAST(max_score AS VARCHAR) || CASE WHEN rationale <> '' THEN ' — ' || rationale ELSE '' END"


_DRAFT = f"""
SELECT l.paper_id, l.config_id,
  f.title || '. ' || CASE WHEN coalesce(f.abstract, '') = '' THEN 'Abstract not available.' WHEN length(f.abstract) < 600 THEN f.abstract
    ELSE regexp_replace(substr(f.abstract, 1, 600), ' [^ ]*$', '') || '...' END AS summary,
  concat_ws(' ## ', top.t, CASE WHEN d.reproducibility >= 0.75 THEN 'Reproducibility signals are strong (code/data/hyperparameter references present).' END,
    CASE WHEN l.triage = 'PASS' THEN 'All compliance checks pass (sections, references, ethics).' END) AS strengths,
  concat_ws(' ## ', c.weak_issues, CASE WHEN l.hallucination_count > 0 THEN l.hallucination_count || ' claim(s) reference citations that could not be verified or were found to contradict the cited abstract.' END,
    low.t, CASE WHEN d.limitations < 0.3 THEN 'Limitations / broader-impact discussion is thin or missing.' END) AS weaknesses,
  CASE WHEN l.triage = 'FAIL' THEN '' ELSE coalesce(qs.q, '') END AS questions,
  CASE WHEN l.triage = 'FAIL' THEN '' ELSE coalesce(fl.ids, '') END AS flagged_citations
FROM led_cfg l JOIN facts f USING (paper_id) JOIN dep d USING (paper_id)
JOIN (SELECT paper_id, config_id, string_agg('Compliance: ' || issue, ' ## ' ORDER BY check_seq) AS weak_issues FROM checks GROUP BY 1, 2) c USING (paper_id, config_id)
LEFT JOIN (SELECT paper_id, config_id, string_agg({_dim_line('Strong')}, ' ## ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, config_id ORDER BY score / max_score DESC, dim_pos) AS rn FROM dims_full) WHERE rn <= 2 AND score / max_score >= 0.6 GROUP BY 1, 2) top USING (paper_id, config_id)
LEFT JOIN (SELECT paper_id, config_id, {_dim_line('Weak')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, config_id ORDER BY score / max_score, dim_pos) AS rn FROM dims_full) WHERE rn = 1 AND score / max_score < 0.4) low USING (paper_id, config_id)
LEFT JOIN (SELECT paper_id, string_agg(q, ' ## ' ORDER BY kind, rn) AS q FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, kind ORDER BY claim_seq) AS rn FROM (
    SELECT paper_id, claim_seq, 0 AS kind, 3 AS most, 'Claim ' || claim_id || ': can the authors point to concrete evidence supporting "' || text || '"?' AS q FROM claims JOIN merged USING (paper_id, claim_id) WHERE severity = 'CRITICAL' AND NOT verified
    UNION ALL SELECT paper_id, claim_seq, 1, 2, 'How was "' || text || '" measured? (confidence interval / variance over runs?)' FROM claims JOIN merged USING (paper_id, claim_id) WHERE claim_type = 'STATISTICAL' AND confidence < 0.3
  )) WHERE rn <= most GROUP BY 1) qs USING (paper_id)
LEFT JOIN (SELECT paper_id, array_to_string(list_sort(list(DISTINCT ref_id)), ',') AS ids FROM (SELECT c.paper_id, unnest(c.ref_ids) AS ref_id FROM claims c JOIN merged m USING (paper_id, claim_id) WHERE m.hallucination_flag) GROUP BY 1) fl USING (paper_id)
"""


def _drafts(spark, sf_dir):
    rev = _full(spark, sf_dir)
    flagged = verification.flagged_citations(rev.claims, rev.results)
    return rev, drafts.review_drafts(rev.evaluations, rev.claims, rev.results, flagged)


@query("v2_review_drafts", _DRAFT)
def _(spark, sf_dir):
    return _drafts(spark, sf_dir)[1].select(
        "paper_id", "config_id", "summary", _joined("strengths").alias("strengths"), _joined("weaknesses").alias("weaknesses"),
        _joined("questions").alias("questions"), _joined("flagged_citations", ",").alias("flagged_citations"),
    )


_BUL = lambda c, none: f"CASE WHEN {c} = '' THEN '- {none}' ELSE '- ' || replace({c}, ' ## ', chr(10) || '- ') END"
def _stage_md(table: str) -> str:
    """Subscores as the record holds them, to four places, printed to two."""
    return " || chr(10) || ".join(f"'| {k} | ' || coalesce({fx(rx(table + k), 2)}, '_skipped_') || ' |'" for k in P.SCORING_KEYS)


_BANNER = "CASE WHEN c.triage <> 'PASS' THEN '⚠️  Compliance ' || c.triage || ': ' || c.banner_issues || '. The composite score below does not force a recommendation — review these issues manually before accepting or rejecting.' END"
_MD = f"""
SELECT s.paper_id, s.config_id, coalesce('> ' || {_BANNER} || chr(10) || chr(10), '') || '## Summary' || chr(10) || v.summary || chr(10) || chr(10)
  || '## Composite breakdown' || chr(10) || '| Stage | Subscore |' || chr(10) || '|---|---|' || chr(10) || {_stage_md('s.')} || chr(10) || chr(10)
  || '## Strengths' || chr(10) || {_BUL('v.strengths', '_None identified._')} || chr(10) || chr(10) || '## Weaknesses' || chr(10) || {_BUL('v.weaknesses', '_None identified._')}
  || chr(10) || chr(10) || '## Questions for the authors' || chr(10) || {_BUL('v.questions', '_No questions._')} || chr(10) || chr(10)
  || '## Overall score' || chr(10) || '- Score: **' || {fx('s.composite', 2)} || '** (0..1 scale)' || chr(10) || '- Reviewer confidence: ' || {fx('k.reviewer_confidence', 2)}
  || chr(10) || '- Recommendation: **' || s.recommendation || '**' || CASE WHEN v.flagged_citations <> '' THEN chr(10) || chr(10) || '## Flagged citations' || chr(10)
    || '- ' || replace(v.flagged_citations, ',', chr(10) || '- ') ELSE '' END || chr(10) AS markdown
FROM compo_full s JOIN comp c USING (paper_id, config_id) JOIN ({_DRAFT}) v USING (paper_id, config_id)
JOIN (SELECT l.paper_id, l.config_id, {_CONF} AS reviewer_confidence FROM led_cfg l JOIN dep d USING (paper_id)) k USING (paper_id, config_id)
"""


@query("v3_draft_markdown", _MD)
def _(spark, sf_dir):
    return drafts.render_markdown(_drafts(spark, sf_dir)[1])


_VIEW = f"""
SELECT s.paper_id, s.config_id, 0 AS seq, 'Score card' AS section_title, '- **Paper**: ' || f.title || chr(10) || '- **Recommendation**: **' || s.recommendation || '**' || chr(10)
  || '- **Composite score** (0..1): ' || {fx('s.composite', 2)} || chr(10) || '- **Reviewer confidence** (0..1): ' || {fx('k.reviewer_confidence', 2)} || chr(10)
  || '- **Hallucination flags**: ' || l.hallucination_count || ' / ' || l.total_claims || ' claims' || coalesce(chr(10) || chr(10) || '> ' || {_BANNER} || chr(10), '') AS body_md
FROM compo_full s JOIN comp c USING (paper_id, config_id) JOIN facts f USING (paper_id) JOIN led_cfg l USING (paper_id, config_id)
JOIN (SELECT l.paper_id, l.config_id, {_CONF} AS reviewer_confidence FROM led_cfg l JOIN dep d USING (paper_id)) k USING (paper_id, config_id)
UNION ALL SELECT paper_id, config_id, 1, 'Composite breakdown', '| Stage | Subscore |' || chr(10) || '|---|---|' || chr(10) || {_stage_md('')} || chr(10) || chr(10)
  || '**Composite (weighted): ' || {fx('composite', 3)} || '**' FROM compo_full
UNION ALL SELECT paper_id, config_id, 2, 'Compliance', '**Triage**: ' || r.triage || CASE WHEN r.n_issues > 0 THEN chr(10) || chr(10) || '**Issues:**' || chr(10) || '- ' || replace(r.issues, ' ## ', chr(10) || '- ') ELSE '' END
  || chr(10) || chr(10) || '**Section checks:**' || chr(10) || k.sec || chr(10) || chr(10) || '**Format checks:**' || chr(10) || k.fmt
  FROM comp r JOIN (SELECT paper_id, config_id, string_agg(ln, chr(10) ORDER BY check_seq) FILTER (WHERE block = 'section') AS sec, string_agg(ln, chr(10) ORDER BY check_seq) FILTER (WHERE block = 'format') AS fmt
    FROM (SELECT *, '- ' || CASE WHEN passed THEN '✓' ELSE '✗' END || ' ' || name || coalesce(' — ' || detail, '') AS ln FROM checks) GROUP BY 1, 2) k USING (paper_id, config_id)
UNION ALL SELECT l.paper_id, l.config_id, 3, 'Flagged citations', CASE WHEN l.triage = 'FAIL' OR x.md IS NULL THEN '_No flagged citations._' ELSE x.md END
  FROM led_cfg l LEFT JOIN (SELECT paper_id, string_agg('### Claim `' || claim_id || '` — severity ' || severity || chr(10) || '> ' || text || chr(10)
    || CASE WHEN len(ref_ids) > 0 THEN '- **Cited refs**: ' || array_to_string(ref_ids, ', ') || chr(10) ELSE '' END
    || coalesce('- **Evidence**: ' || nullif(m.evidence, '') || chr(10), '') || coalesce('- **Notes**: ' || nullif(m.notes, '') || chr(10), ''), chr(10) ORDER BY claim_seq) AS md
    FROM claims JOIN merged m USING (paper_id, claim_id) WHERE m.hallucination_flag GROUP BY 1) x USING (paper_id)
UNION ALL SELECT c.paper_id, c.config_id, 4, 'Depth scores', '| Dimension | Score | Rationale |' || chr(10) || '|---|---|---|'
  || chr(10) || '| Methodology | ' || {fx('methodology', 2)} || ' | ' || why_methodology || ' |' || chr(10) || '| Limitations | ' || {fx('limitations', 2)} || ' | ' || why_limitations || ' |'
  || chr(10) || '| Reproducibility | ' || {fx('reproducibility', 2)} || ' | ' || why_reproducibility || ' |' || chr(10) || '| Logical soundness | ' || {fx('logical_soundness', 2)} || ' | ' || why_logical || ' |'
  FROM comp c JOIN dep USING (paper_id)
UNION ALL SELECT r.paper_id, r.config_id, 5, 'Rubric scores', '**Rubric**: `' || CASE r.config_id WHEN 'neurips' THEN 'neurips-reviewer-v1' WHEN 'ieee' THEN 'ieee-tpc-v1' ELSE 'arxiv-generic-v1' END || '`' || chr(10)
  || '- Raw total (0..1): ' || {fx('r.raw_total', 3)} || chr(10) || '- Bias-adjusted total (0..1): ' || {fx('r.bias_adjusted_total', 3)} || CASE WHEN r.note <> '' THEN chr(10) || '- ' || r.note ELSE '' END
  || chr(10) || chr(10) || '| Dimension | Score | Max | Rationale |' || chr(10) || '|---|---|---|---|' || d.t
  FROM rub_full r JOIN (SELECT paper_id, config_id, string_agg(chr(10) || '| ' || name || ' | ' || {fx('score', 2)} || ' | ' || CAST(max_score AS VARCHAR) || ' | ' || coalesce(nullif(rationale, ''), '—') || ' |', '' ORDER BY dim_pos) AS t FROM dims_full GROUP BY 1, 2) d USING (paper_id, config_id)
UNION ALL SELECT paper_id, config_id, 6, 'Review draft (copy-paste)', '```markdown' || chr(10) || markdown || '```' || chr(10) FROM ({_MD})
"""


@query("v4_report_sections", _VIEW)
def _(spark, sf_dir):
    rev, d = _drafts(spark, sf_dir)
    return drafts.report_sections(rev.evaluations, d, drafts.flagged_sections(rev.claims, rev.results))


_CMP = [
    ("Compliance triage", "triage"), ("Total claims", "'0'"), ("Hallucinations", "'0'"), ("Rubric bias-adjusted", fx("bias_adjusted_total", 3)),
    ("Composite (recomputed)", fx("composite", 3)), ("Recommendation", "recommendation"),
    *[(k, fx(k, 2)) for k in ("methodology", "limitations", "reproducibility", "logical_soundness")],
]
_CMP_SQL = " UNION ALL ".join(
    f"SELECT paper_id, {i} AS metric_ord, '{m}' AS metric, " + ", ".join(f"max(CASE WHEN config_id = '{v}' THEN {e} END) AS {v}" for v in ("ieee", "arxiv", "neurips"))
    + " FROM compo JOIN comp USING (paper_id, config_id) JOIN rub USING (paper_id, config_id) JOIN dep USING (paper_id) GROUP BY 1"
    for i, (m, e) in enumerate(_CMP)
)


@query("v5_compare_configs", _CMP_SQL)
def _(spark, sf_dir):
    return drafts.compare_configs(_heuristic(spark, sf_dir), ["ieee", "arxiv", "neurips"])


@query("v13_provenance", "SELECT paper_id, config_id, '0.1.0' AS engine_version, config_hash, 'decompose=m' AS llm_models, 'decompose=0,entailment=0,rubric=0' AS seeds, CAST(0 AS DOUBLE) AS cost_usd FROM papers CROSS JOIN hashes")
def _(spark, sf_dir):
    p = R.provenance(_heuristic(spark, sf_dir), {"decompose": "m"})
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return p.select(
        "paper_id", "config_id", "provenance.engine_version", "provenance.config_hash",
        flat(F.col("provenance.llm_models")).alias("llm_models"), flat(F.col("provenance.seeds")).alias("seeds"), "provenance.cost_usd",
    )


# --- audit log ---------------------------------------------------------------------


def _log(spark, sf_dir):
    return auditlog.log_rows(_heuristic(spark, sf_dir), "run-1")


_LOG_ID = "sha256(paper_id || '|' || config_hash || '|run-1')"


@query("s10_query_scores", f"""
SELECT {_LOG_ID} AS evaluation_id, paper_id, '2024-01-01 00:00:00' AS created, raw_total AS rubric_raw_total, bias_adjusted_total AS rubric_adjusted_total,
  triage AS compliance_triage, 0 AS total_claims, 0 AS hallucination_count, CAST(0 AS DOUBLE) AS cost_usd FROM comp JOIN rub USING (paper_id, config_id) JOIN hashes USING (config_id)
""")
def _(spark, sf_dir):
    return auditlog.query_scores(_log(spark, sf_dir)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    ).withColumnRenamed("created_at", "created")


@query("s8_scan_records", f"""
SELECT {_LOG_ID} AS evaluation_id, paper_id, config_id, title, abstract, triage, issues, composite, recommendation, methodology, {dbl('n_passed')} AS passed
FROM comp JOIN facts f USING (paper_id) JOIN dep USING (paper_id) JOIN compo USING (paper_id, config_id) JOIN hashes USING (config_id)
""")
def _(spark, sf_dir):
    # Appended to a log, read back and restored from the JSON text of the whole record.
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex[:12]}"
    auditlog.append_log(_log(spark, sf_dir), path)
    return auditlog.scan_records(auditlog.read_log(spark, path)).select(
        "evaluation_id", "paper_id", "config_id", "title", "abstract", "triage", _joined("issues").alias("issues"), "composite",
        "recommendation", "methodology", F.col("n_passed").cast("double").alias("passed"),
    )


@query("s9_count_records", "SELECT count(*) AS n_records FROM papers CROSS JOIN hashes")
def _(spark, sf_dir):
    return auditlog.count_records(auditlog.once(_log(spark, sf_dir)))


@query("w8_latest_records", "SELECT c.c_custkey AS paper, max(o_orderdate) AS newest, arg_max(o_orderkey, {'a': o_orderdate, 'b': sha256(CAST(o_orderkey AS VARCHAR))}) AS total_claims FROM customer c JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf_dir):
    # Orders stand for log rows: the customer is the paper, the order date the creation time.
    c = F.col
    rows = corpus.table(spark, sf_dir, "orders").select(
        c("o_custkey").cast("string").alias("paper_id"), F.lit("h").alias("config_hash"), c("o_orderdate").alias("created_at"),
        F.sha2(c("o_orderkey").cast("string"), 256).alias("evaluation_id"), c("o_orderkey").alias("total_claims"),
    )
    return auditlog.latest_records(rows).select(
        c("paper_id").cast("bigint").alias("paper"), c("created_at").alias("newest"), "total_claims"
    )


# --- files, sinks and hooks -----------------------------------------------------------


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _paper_files(spark, rows, key):
    """One text file per row, as a folder of papers; each ends with a line feed.

    Tasks write the files themselves, in 64 folders. Spark's writer makes a folder and a checksum for
    every file, sets their modes by a process each, and the driver moves them one by one.
    """
    path = _folder(spark, "papers")
    uri = path if "://" in path else f"file://{path}"

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(uri)
        made = set()
        for batch in batches:
            for name, text, folder in zip(batch["name"], batch["text"], batch["folder"]):
                if folder not in made:
                    files.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                # A task that runs again writes the same files again.
                with files.open_output_stream(f"{base}/{folder}/{name}.txt") as out:
                    out.write(f"{text or ''}\n".encode())
            yield pd.DataFrame({"n": [len(batch)]})

    (text,) = [c for c in rows.columns if c != key]
    named = rows.select(
        F.col(key).cast("string").alias("name"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(key), F.lit(64)).alias("folder"),
    )
    named.repartition(64, "name").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


@query(
    "s1_read_papers",
    "SELECT 'md:' || substr(sha256(text || chr(10)), 1, 16) AS paper_id, count(*) AS n_paths, 1 AS n_rows FROM documents GROUP BY 1",
)
def _(spark, sf_dir):
    path = _paper_files(spark, _docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    read = _stored(sources.read_papers(spark, path), "read")  # each small file is opened once
    paths = sources.paper_paths(read).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_paths"))
    rows = sources.distinct_papers(read).groupBy("paper_id").agg(F.count(F.lit(1)).cast("int").alias("n_rows"))
    return paths.join(rows, "paper_id")


@query(
    "t1_review_stream",
    """SELECT DISTINCT 'md:' || substr(sha256(md || chr(10)), 1, 16) AS paper_id, config_id, c.triage, f.word_count
    FROM comp c JOIN papers p USING (paper_id) JOIN facts f USING (paper_id) WHERE config_id IN ('ieee', 'arxiv')""",
)
def _(spark, sf_dir):
    """Every paper as a file, reviewed by a stream into a log, and the log read as a table."""
    from peerlight.streaming.intake import review_stream

    path = _paper_files(spark, _papers(spark, sf_dir).select("paper_id", "md"), "paper_id")
    log = _folder(spark, "log")
    review_stream(spark, path, ["ieee", "arxiv"], log, _folder(spark, "stream")).awaitTermination()
    return auditlog.read_log(spark, log).select(
        "paper_id", "config_id", F.col("compliance_triage").alias("triage"), "word_count"
    )


_SAVED = f"""
SELECT {_LOG_ID} AS evaluation_id, paper_id, config_id, triage, issues, composite, recommendation
FROM comp JOIN compo USING (paper_id, config_id) JOIN hashes USING (config_id)
"""


def _stored_log(spark, sf_dir):
    path = _folder(spark, "log")
    auditlog.append_log(_log(spark, sf_dir), path)
    return auditlog.read_log(spark, path)


@query("s5_saved_records", f"SELECT * EXCLUDE (evaluation_id) FROM ({_SAVED})")
def _(spark, sf_dir):
    out = _folder(spark, "records")
    auditlog.export_jsonl(_stored_log(spark, sf_dir), out)
    return auditlog.read_records(spark, out).select(
        "paper_id", "config_id", "triage", _joined("issues").alias("issues"), "composite", "recommendation"
    )


@query("s7_load_record", f"SELECT * FROM ({_SAVED}) ORDER BY evaluation_id LIMIT 1")
def _(spark, sf_dir):
    log = _stored_log(spark, sf_dir)
    asked = log.select("evaluation_id", "paper_id", "config_hash").orderBy("evaluation_id").first()
    return auditlog.load_record(log, asked.evaluation_id, asked.paper_id, asked.config_hash).select(
        "evaluation_id", "paper_id", "config_id", "triage", _joined("issues").alias("issues"), "composite", "recommendation"
    )


@query("s7_load_record_by_id", f"SELECT * FROM ({_SAVED}) ORDER BY evaluation_id DESC LIMIT 1")
def _(spark, sf_dir):
    # By the id alone, from a compacted log: Bloom filters of the ids skip row groups.
    log = _compacted_log(spark, sf_dir)
    asked = log.agg(F.max("evaluation_id").alias("id")).first().id
    return auditlog.load_record(log, asked).select(
        "evaluation_id", "paper_id", "config_id", "triage", _joined("issues").alias("issues"), "composite", "recommendation"
    )


def _compacted_log(spark, sf_dir):
    """The log written by runs of ten parts of the papers, compacted between them."""
    path = _folder(spark, "log")
    rows = _stored(_log(spark, sf_dir), "log")
    part = F.split_part("paper_id", F.lit("-"), F.lit(2)).cast("bigint") % 10
    for k in range(10):
        # The id says nothing of the folder: rows keep the id of the run that made them.
        auditlog.append_log(rows.filter(part == k).withColumn("run_id", F.lit(f"run-{k}")), path)
        if k in (3, 4, 8):
            compaction.compact(spark, path, most_folders=2)
    compaction.remove_replaced(spark, path)
    return auditlog.read_log(spark, path)


@query("s6_compacted_log", f"SELECT evaluation_id, paper_id, config_id, triage, 'run-' || CAST(split_part(paper_id, '-', 2) AS BIGINT) % 10 AS run_id FROM ({_SAVED})")
def _(spark, sf_dir):
    return _compacted_log(spark, sf_dir).select(
        "evaluation_id", "paper_id", "config_id", F.col("compliance_triage").alias("triage"), "run_id"
    )


@query("s12_record_fields", f"SELECT evaluation_id, paper_id, composite, recommendation, CAST(NULL AS BIGINT) AS later FROM ({_SAVED})")
def _(spark, sf_dir):
    fields = {
        "paper_id": "$.paper_id string", "composite": "$.composite double", "recommendation": "$.recommendation string",
        "later": "$.field_of_a_later_version bigint",
    }
    return auditlog.record_fields(_stored_log(spark, sf_dir), fields)


@query("s11_export_jsonl", "SELECT paper_id, count(*) AS n_lines FROM papers CROSS JOIN hashes GROUP BY 1")
def _(spark, sf_dir):
    out = _folder(spark, "jsonl")
    auditlog.export_jsonl(_stored_log(spark, sf_dir), out)
    lines = spark.read.text(out)
    return lines.groupBy(F.get_json_object("value", "$.paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "s13_artifacts",
    """SELECT paper_id, config_id, '2024-01-01' AS day,
      coalesce(nullif(substr(trim(regexp_replace(lower(f.title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), ''), 'untitled') AS slug, composite
    FROM compo JOIN facts f USING (paper_id)""",
)
def _(spark, sf_dir):
    ev, out = _heuristic(spark, sf_dir), _folder(spark, "artifacts")
    drafts.write_artifacts(ev, drafts.review_drafts(ev), out, "2024-01-01")
    reviews = spark.read.parquet(f"{out}/reviews").filter("value LIKE '%## Summary%'").select("paper_id", "config_id", "slug")
    saved = spark.read.parquet(f"{out}/records")
    return saved.join(reviews, ["paper_id", "config_id", "slug"]).select(
        "paper_id", "config_id", F.col("day").cast("string").alias("day"), "slug",
        F.get_json_object("value", "$.composite").cast("double").alias("composite"),
    )


@query("s14_cost_log", ORACLES["a10_cost_totals"])
def _(spark, sf_dir):
    path = _folder(spark, "costs")
    costs.append_costs(_usage(spark, sf_dir), path)
    return costs.cost_totals(costs.read_costs(spark, path))


@query(
    "u4_build_catalog",
    f"""SELECT 'crossref' AS source, 0 AS source_rank, sha256('c-' || d) AS catalog_id, text AS title, 'Ann ' || src AS authors, '10.1/' || d AS doi FROM {_D} WHERE d % 7 <> 3
    UNION ALL SELECT 'semantic_scholar', 1, sha256('s-' || d), text, 'Ann ' || src, '10.1/' || d FROM {_D} WHERE d % 7 <> 3
    UNION ALL SELECT 'openalex', 2, sha256('o-' || d), text, 'Ann ' || src, '10.1/' || d FROM {_D} WHERE d % 7 <> 3""",
)
def _(spark, sf_dir):
    """Raw answers of three sources, a seventh of them misses or errors, to one catalog."""
    c = F.col
    d = _docs(spark, sf_dir).select(c("doc_id").alias("d"), "text", "source")
    doi, ann = F.concat(F.lit("10.1/"), c("d").cast("string")), F.lit("Ann")
    full = F.concat(F.lit("Ann "), c("source"))
    bodies = {
        "crossref": F.struct(F.struct(doi.alias("DOI"), F.array("text").alias("title"), F.array(F.struct(ann.alias("given"), c("source").alias("family"))).alias("author")).alias("message")),
        "semantic_scholar": F.struct(c("text").alias("title"), F.array(F.struct(full.alias("name"))).alias("authors"), F.struct(doi.alias("DOI")).alias("externalIds")),
        "openalex": F.struct(c("text").alias("title"), F.array(F.struct(F.struct(full.alias("display_name")).alias("author"))).alias("authorships"), doi.alias("doi")),
    }
    parts = [
        d.select(
            F.lit(name).alias("source"), F.lit("doi").alias("key_kind"), doi.alias("key"),
            F.concat(F.lit(f"{name[0]}-"), c("d").cast("string")).alias("url"),
            F.when(c("d") % 7 != 3, 200).when(c("d") % 2 == 0, 404).otherwise(500).alias("status"), F.to_json(body).alias("body"),
        )
        for name, body in bodies.items()
    ]
    built = responses.build_catalog(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return built.select("source", "source_rank", "catalog_id", "title", _joined("authors").alias("authors"), "doi")


def _prompts(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("cache_key"), F.col("text").alias("prompt"), F.lit("m").alias("model"))


def _joiner():
    """A caller's model: one function per task, from a batch of requests to answers."""

    def answer(batch):
        size = batch["prompt"].str.len().astype("int64")
        return batch[["cache_key"]].assign(
            text=batch["prompt"].str.replace(" ", "_"), model=batch["model"], provider="mine", prompt_tokens=size,
            completion_tokens=size, cost_usd=0.5, finish_reason="stop",
        )

    return answer


def _again():
    """A model that must not be asked: all answers are in the journal."""

    def answer(batch):
        raise RuntimeError(f"asked again for {len(batch)} requests")

    return answer


@query("x1_journaled_model", "SELECT doc_id, replace(text, ' ', '_') AS text, 'mine' AS provider, length(text) AS prompt_tokens FROM documents")
def _(spark, sf_dir):
    # A first run leaves its answers in the journal; the second one, as after a lost executor,
    # reads them, and a third takes them for its cache.
    journal = os.path.join(shared_folder(spark), "journal-" + uuid.uuid4().hex[:12])
    asked = _prompts(spark, sf_dir)
    inference.run_model(asked, _joiner, journal=journal).count()
    second = inference.run_model(asked, _again, journal=journal)
    kept = inference.journal_responses(spark, journal)
    left = asked.join(kept.select("cache_key"), "cache_key", "left_anti")
    second = second.unionByName(inference.run_model(left, _again))  # nothing is left to ask
    return second.select(F.col("cache_key").cast("bigint").alias("doc_id"), "text", "provider", "prompt_tokens")


@query("j14_missing_requests", """
SELECT unit_id AS doc_id, prompt FROM (SELECT min(doc_id) AS unit_id, text AS prompt, bool_or(doc_id % 4 = 0) AS hit FROM documents GROUP BY 2) WHERE NOT hit
""")
def _(spark, sf_dir):
    # Prompts that no fourth document holds: what a Bloom filter of missing keys lets through.
    asked = inference.request_rows(
        _docs(spark, sf_dir).select(
            F.col("doc_id").cast("string").alias("unit_id"), F.lit("p").alias("paper_id"), F.col("text").alias("prompt")
        ),
        kind="check", system="sys", model="m", max_tokens=10,
    )
    cache = asked.filter(F.col("unit_id").cast("bigint") % 4 == 0).select("cache_key")
    missing = inference.missing_requests(asked, cache.limit(0), cache)
    first = asked.groupBy("cache_key").agg(F.min(F.col("unit_id").cast("bigint")).alias("doc_id"))
    return missing.join(first, "cache_key").select("doc_id", "prompt")


@query("r23_bucketed_claims", """
SELECT paper_id, claim_id, claim_seq, text, claim_type, severity, section_id, char_start, char_end, array_to_string(ref_ids, ',') AS ref_ids FROM claims
""")
def _(spark, sf_dir):
    # Parsed papers in buckets: section texts are read where they lie.
    parsed = _parsed_once(spark, sf_dir)
    claims = CL.build_claims(CL.parse_claims(_replies(spark, sf_dir, parsed)), parsed)
    return claims.withColumn("ref_ids", F.array_join("ref_ids", ","))


@query("x1_run_model", "SELECT doc_id, replace(text, ' ', '_') AS text, 'mine' AS provider, length(text) AS prompt_tokens FROM documents")
def _(spark, sf_dir):
    return inference.run_model(_prompts(spark, sf_dir), _joiner).select(
        F.col("cache_key").cast("bigint").alias("doc_id"), "text", "provider", "prompt_tokens"
    )


@query(
    "x2_run_embedder",
    "SELECT doc_id, length(text) AS letters, length(text) - length(replace(text, ' ', '')) AS blanks, 1 AS n_vectors FROM documents",
)
def _(spark, sf_dir):
    def factory():
        def embed(batch):
            vectors = [[[float(len(t)), float(t.count(" "))] for t in texts] for texts in batch["texts"]]
            return batch[["cache_key", "model"]].assign(vectors=vectors, provider="mine", prompt_tokens=0, cost_usd=0.0)

        return embed

    rows = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("cache_key"), F.array("text").alias("texts"), F.lit("m").alias("model"))
    v = F.col("vectors")[0]
    return inference.run_embedder(rows, factory).select(
        F.col("cache_key").cast("bigint").alias("doc_id"), v[0].cast("bigint").alias("letters"), v[1].cast("bigint").alias("blanks"),
        F.size("vectors").alias("n_vectors"),
    )


@query(
    "x7_run_chain",
    "SELECT doc_id, replace(text, ' ', '_') AS text, 'mine' AS provider, 'downgraded: first: RuntimeError' AS finish_reason FROM documents",
)
def _(spark, sf_dir):
    def broken():
        raise RuntimeError("no key")

    return inference.run_chain(_prompts(spark, sf_dir), [("first", broken), ("mine", _joiner)]).select(
        F.col("cache_key").cast("bigint").alias("doc_id"), "text", "provider", "finish_reason"
    )


@query("x4_custom_config", "SELECT paper_id, 'mine' AS config_id, triage, composite FROM comp JOIN compo USING (paper_id, config_id) WHERE config_id = 'neurips'")
def _(spark, sf_dir):
    """A config saved as a JSON file under another name, read back and used."""
    import json

    from peerlight.sources.configs import SHIPPED, complete_config, read_configs

    path, mine = _folder(spark, "configs"), {**complete_config(SHIPPED["neurips"]), "venue": "mine"}
    spark.createDataFrame([(json.dumps(mine),)], "value string").coalesce(1).write.text(path)
    review = R.evaluate_papers(
        _papers(spark, sf_dir), read_configs(spark, path), metadata=corpus.metadata(spark, sf_dir), options=R.Options(distinct_ids=True)
    )
    return review.evaluations.select("paper_id", "config_id", "triage", "composite")


@query("x5_price_overrides", f"""
SELECT event_id, (event_id % 977) * pin / {dbl(1000000)} + (event_id % 313) * pout / {dbl(1000000)} AS cost_usd FROM (
  SELECT event_id, CASE event_type WHEN 'click' THEN {dbl(1)} WHEN 'view' THEN {dbl(0.15)} WHEN 'purchase' THEN {dbl(15)} ELSE {dbl(7)} END AS pin,
    CASE event_type WHEN 'click' THEN {dbl(2)} WHEN 'view' THEN {dbl(0.6)} WHEN 'purchase' THEN {dbl(75)} ELSE {dbl(9)} END AS pout FROM events)
""")
def _(spark, sf_dir):
    """A caller's price table: one model repriced, and every other event type priced."""
    from peerlight.sources.configs import model_prices

    usage = _usage(spark, sf_dir).drop("cost_usd")
    known = ("claude-sonnet-4-6", "gpt-4o-mini", "claude-opus-4-6")
    other = usage.filter(~F.col("model").isin(*known)).select("model").distinct().select(
        "model", F.lit(7.0).alias("input_per_mtok"), F.lit(9.0).alias("output_per_mtok")
    )
    mine = spark.createDataFrame([("claude-sonnet-4-6", 1.0, 2.0)], "model string, input_per_mtok double, output_per_mtok double")
    return costs.estimate_cost(usage, model_prices(spark, mine.unionByName(other))).select("event_id", "cost_usd")


ORACLES["v14_copies_count_once"] = ORACLES["v14_evaluate_papers"]


@query("v14_copies_count_once")
def _(spark, sf_dir):
    """Every paper given twice gives what it gives once."""
    papers = _papers(spark, sf_dir)
    review = R.evaluate_papers(papers.unionByName(papers), metadata=corpus.metadata(spark, sf_dir))
    return review.evaluations.select(
        "paper_id", "config_id", "config_hash", "title", "word_count", "n_refs", "triage", "n_passed", "n_checks",
        _joined("issues").alias("issues"), "methodology", "limitations", "reproducibility", "logical_soundness",
        "raw_total", "bias_adjusted_total", "composite", "recommendation", "total_claims",
    )


@query("a5_verification_subscores", f"""
SELECT paper_id, config_id, {rx('verification')} AS verification, {rx('compliance')} AS compliance, {rx('rubric')} AS rubric FROM sub_full
""")
def _(spark, sf_dir):
    """Subscores of a review with claims: supported, refuted and absent ones."""
    b = lambda n: F.col("breakdown")[n].alias(n)
    return _full(spark, sf_dir).evaluations.select("paper_id", "config_id", b("verification"), b("compliance"), b("rubric"))


@query(
    "s0_whole_texts",
    "SELECT doc_id, TRUE AS whole FROM documents",
)
def _(spark, sf_dir):
    """The check papers hold every quarter of their document, so no query reads cut texts."""
    d = _docs(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("paper_id"))
    both = d.join(_papers(spark, sf_dir), "paper_id")
    q = F.floor(F.length("text") / 4).cast("int")
    quarters = [F.substr("text", q * i + 1, q if i < 3 else F.length("text")) for i in range(4)]
    held = [F.contains("md", x) for x in quarters]
    return both.select("doc_id", (held[0] & held[1] & held[2] & held[3]).alias("whole"))
