"""Snapshots of bibliographic API responses to catalog and author-candidate rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T

_NAME = "struct<given:string,family:string>"
CROSSREF_WORK = (
    "struct<DOI:string,title:string,author:array<string>,"
    "issued:struct<`date-parts`:string>,`container-title`:string>"
)
S2_PAPER = (
    "struct<title:string,authors:array<string>,year:string,venue:string,"
    "externalIds:struct<DOI:string,ArXiv:string>,abstract:string>"
)
OPENALEX_WORK = (
    "struct<title:string,display_name:string,authorships:array<string>,publication_year:string,"
    "host_venue:string,primary_location:struct<source:string>,doi:string>"
)


def parse_json(c: Column, schema: str) -> Column:
    """Strict parse; NULL when the text is not one JSON value of that shape."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})


def classify_responses(responses: DataFrame) -> DataFrame:
    """Adds ``outcome``: hit, miss (404 or blank) or error (other 4xx/5xx, bad JSON)."""
    body = F.col("body")
    valid = F.try_parse_json(body).isNotNull()
    return responses.select(
        "*",
        F.when(F.col("status") == 404, F.lit("miss"))
        .when(F.col("status") >= 400, F.lit("error"))
        .when(F.coalesce(T.strip(body), F.lit("")) == "", F.lit("miss"))
        .when(valid, F.lit("hit"))
        .otherwise(F.lit("error"))
        .alias("outcome"),
        F.sha2("url", 256).alias("url_hash"),
    )


def _first_of(c: Column) -> Column:
    """First element of a JSON string array, or the plain string itself."""
    as_list = parse_json(c, "array<string>")
    return F.when(F.startswith(c, F.lit("[")), F.get(as_list, F.lit(0))).otherwise(c)


def _whole_number(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"^-?\d+$")), c.try_cast("int"))


def _names(raw: Column, schema: str, name) -> Column:
    people = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda j: parse_json(j, schema))
    return F.filter(F.transform(people, name), lambda n: F.coalesce(n, F.lit("")) != "")


def _catalog_row(df: DataFrame, source: str, cols: dict[str, Column]) -> DataFrame:
    out = {
        "catalog_id": F.col("catalog_id"),
        "title": None, "authors": None, "year": None, "venue": None, "doi": None,
        "arxiv_id": F.lit(None).cast("string"), "abstract": F.lit(None).cast("string"),
    }
    out.update(cols)
    return df.select(
        F.lit(source).alias("source"),
        F.lit(P.SOURCE_RANKS[source]).alias("source_rank"),
        *[c.alias(k) for k, c in out.items()],
    )


def normalize_crossref(raw: DataFrame) -> DataFrame:
    """(catalog_id, body) with a work under ``message`` to catalog rows."""
    message = F.get_json_object("body", "$.message")
    item = F.coalesce(F.get_json_object(message, "$.items[0]"), message)
    w = raw.select("catalog_id", parse_json(item, CROSSREF_WORK).alias("w"))
    parts = parse_json(F.col("w.issued.date-parts"), "array<array<string>>")
    return _catalog_row(
        w,
        "crossref",
        {
            "title": _first_of(F.col("w.title")),
            "authors": _names(
                F.col("w.author"),
                _NAME,
                lambda a: T.strip(F.concat_ws(" ", T.blank_to_null(a["given"]), T.blank_to_null(a["family"]))),
            ),
            "year": _whole_number(F.get(F.get(parts, F.lit(0)), F.lit(0))),
            "venue": _first_of(F.col("w.container-title")),
            "doi": F.col("w.DOI"),
        },
    )


def normalize_s2(raw: DataFrame) -> DataFrame:
    item = F.coalesce(F.get_json_object("body", "$.data[0]"), F.col("body"))
    w = raw.select("catalog_id", parse_json(item, S2_PAPER).alias("w"))
    return _catalog_row(
        w,
        "semantic_scholar",
        {
            "title": F.col("w.title"),
            "authors": _names(F.col("w.authors"), "struct<name:string>", lambda a: a["name"]),
            "year": _whole_number(F.col("w.year")),
            "venue": T.blank_to_null(F.col("w.venue")),
            "doi": F.col("w.externalIds.DOI"),
            "arxiv_id": F.col("w.externalIds.ArXiv"),
            "abstract": T.blank_to_null(T.strip(F.col("w.abstract"))),
        },
    )


def normalize_openalex(raw: DataFrame) -> DataFrame:
    item = F.coalesce(F.get_json_object("body", "$.results[0]"), F.col("body"))
    w = raw.select("catalog_id", parse_json(item, OPENALEX_WORK).alias("w"))
    host = F.coalesce(
        F.when(F.col("w.host_venue") != "{}", F.col("w.host_venue")),
        F.col("w.primary_location.source"),
    )
    return _catalog_row(
        w,
        "openalex",
        {
            "title": F.coalesce(T.blank_to_null(F.col("w.title")), F.col("w.display_name")),
            "authors": _names(
                F.col("w.authorships"),
                "struct<author:struct<display_name:string>>",
                lambda a: a["author"]["display_name"],
            ),
            "year": _whole_number(F.col("w.publication_year")),
            "venue": F.get_json_object(host, "$.display_name"),
            "doi": F.regexp_replace(F.col("w.doi"), r"^https://doi\.org/", ""),
        },
    )


NORMALIZERS = {
    "crossref": normalize_crossref,
    "semantic_scholar": normalize_s2,
    "openalex": normalize_openalex,
}


def build_catalog(responses: DataFrame) -> DataFrame:
    """Union of the normalised hits of all three sources (columns as ``schemas.CATALOG``)."""
    hits = classify_responses(responses).filter("outcome = 'hit'")
    named = hits.select("source", F.col("url_hash").alias("catalog_id"), "body")
    return reduce(
        lambda a, b: a.unionByName(b),
        [fn(named.filter(F.col("source") == src)) for src, fn in NORMALIZERS.items()],
    )


def failed_lookups(responses: DataFrame) -> DataFrame:
    """(source, key_kind, key) of responses that were errors."""
    return (
        classify_responses(responses)
        .filter("outcome = 'error'")
        .select("source", "key_kind", "key")
        .distinct()
    )


def normalize_orcid(raw: DataFrame) -> DataFrame:
    """(queried_name, body) search results to candidate rows in hit order."""
    hits = parse_json(F.get_json_object("body", "$.expanded-result"), "array<string>")
    schema = (
        "struct<`orcid-id`:string,`given-names`:string,`family-names`:string,"
        "`credit-name`:string,`institution-name`:string>"
    )
    h = raw.select("queried_name", F.posexplode(hits).alias("hit_rank", "j")).select(
        "queried_name", "hit_rank", parse_json(F.col("j"), schema).alias("h")
    )
    place = _first_of(F.col("h.institution-name"))
    return h.select(
        "queried_name",
        "hit_rank",
        F.when(F.rlike(F.col("h.orcid-id"), F.lit(P.ORCID_ID)), F.col("h.orcid-id")).alias("orcid_id"),
        candidate_name(F.col("h.given-names"), F.col("h.family-names"), F.col("h.credit-name")).alias(
            "candidate"
        ),
        F.when(F.startswith(place, F.lit("{")), F.get_json_object(place, "$.value"))
        .otherwise(place)
        .alias("institution"),
    )


def candidate_name(given: Column, family: Column, credit: Column) -> Column:
    full = T.strip(F.concat_ws(" ", F.coalesce(given, F.lit("")), F.coalesce(family, F.lit(""))))
    return F.coalesce(T.blank_to_null(full), T.blank_to_null(credit))
