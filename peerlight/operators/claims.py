"""Claims: extraction requests, response parsing, numbering, spans, type and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.rows import each, settled
from peerlight.operators.inference import request_rows
from peerlight.operators.parsing import clean_entry
from peerlight.operators.parsing import sections as sections_of

# The prompt texts.
SYSTEM = """You are a rigorous scientific-paper auditor.
Your job is to extract ATOMIC, VERIFIABLE claims from a section of a paper.
A claim is atomic if it states exactly one fact. It is verifiable if a
reviewer could in principle check it against evidence (a cited source, a
statistical result, a capability demonstration, or a temporal assertion).

Output rules:
- Return ONLY a JSON array. No prose, no fences, no trailing commentary.
- Each element is an object with these keys:
    "text"    : the claim, rewritten as a single sentence
    "ref_ids" : list of reference ids mentioned in the claim (may be [])
- Return at most {max_claims} claims. Prefer the most load-bearing ones.
- If the section contains no verifiable claims, return [].
"""


def claim_sections(sections: DataFrame) -> DataFrame:
    """Sections that can carry claims: not blank, not references, thanks, appendix, funding."""
    return sections.filter(
        ~T.is_blank(F.col("text")) & ~F.rlike("title", F.lit(P.SKIP_SECTION))
    )


def ref_lists(parsed: DataFrame) -> DataFrame:
    """Known reference ids per paper in order, straight from the parsed row."""
    return parsed.select("paper_id", known_ids().alias("known_ids"))


def known_ids() -> Column:
    numbered = F.transform(
        "ref_entries",
        lambda e, i: F.when(
            clean_entry(e) != "", F.concat(F.lit("ref-"), (i + 1).cast("string"))
        ),
    )
    return F.array_compact(numbered)


def decompose_requests(
    parsed: DataFrame,
    model: str = P.DEFAULT_MODEL,
    max_claims: int = P.MAX_CLAIMS_PER_SECTION,
    provider: str = "stub",
) -> DataFrame:
    """One claim-extraction request per content section; ``unit_id`` is the section's ord.
    Narrow: sections and reference ids come from the same parsed row."""
    rows = each(
        parsed.select("paper_id", known_ids().alias("known_ids"), "sections"),
        ["paper_id", "known_ids"], "sections", "s",
    )
    listed = claim_sections(rows.select("paper_id", "known_ids", "s.*"))
    ids = F.coalesce(T.blank_to_null(F.array_join("known_ids", ", ")), F.lit("(none)"))
    # The wording of the prompt.
    prompt = F.concat(
        F.lit("Section title: "), F.col("title"),
        F.lit("\n\nReference ids available in this paper: "), ids,
        F.lit("\n\nSection text:\n---\n"), F.col("text"),
        F.lit("\n---\n\nReturn the JSON array now."),
    )
    return request_rows(
        listed.select(
            "paper_id",
            F.col("ord").cast("string").alias("unit_id"),
            prompt.alias("prompt"),
        ),
        kind="decompose",
        system=SYSTEM.replace("{max_claims}", str(max_claims)),
        model=model,
        max_tokens=1024,
        provider=provider,
    )


def strip_fences(c: Column) -> Column:
    return T.strip(F.regexp_replace(c, P.CODE_FENCE, ""))


def json_array(c: Column) -> Column:
    """Items of a JSON array as JSON texts; NULL unless the whole text is one array.

    Wrapping the text in an object makes trailing garbage a syntax error.
    """
    wrapped = F.concat(F.lit('{"v":'), c, F.lit("}"))
    parsed = F.from_json(wrapped, "struct<v:array<string>>", {"allowSingleQuotes": "false"})
    return F.when(F.startswith(c, F.lit("[")), parsed["v"])


def json_object(c: Column) -> Column:
    """Fields of a JSON object as JSON texts; NULL unless the whole text is one object."""
    wrapped = F.concat(F.lit('{"v":'), c, F.lit("}"))
    parsed = F.from_json(wrapped, "struct<v:map<string,string>>", {"allowSingleQuotes": "false"})
    return F.when(F.startswith(c, F.lit("{")), parsed["v"])


def embedded(c: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket."""
    return F.regexp_extract(c, f"(?s)(\\{opening}.*\\{closing})", 1)


def _item_type(item: Column, path: str) -> Column:
    """JSON type of a field: NULL when absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), path, "variant"))


def left_out_items(responses: DataFrame, limit: int = P.MAX_CLAIMS_PER_SECTION) -> DataFrame:
    """(paper_id, ord, n_left_out) of responses with more items than ``limit`` lets through."""
    body = strip_fences(F.col("text"))
    items = F.coalesce(json_array(body), json_array(embedded(body, "[", "]")))
    return responses.select(
        "paper_id", "ord", (F.size(items) - limit).alias("n_left_out")
    ).filter(F.col("n_left_out") > 0)


def parse_claims(
    responses: DataFrame, limit: int = P.MAX_CLAIMS_PER_SECTION
) -> DataFrame:
    """Responses (paper_id, ord, text) to raw claims (paper_id, ord, item_pos, text, ref_ids).

    At most ``limit`` items are considered; items that are not objects with a non-empty
    text and a list of string ids are dropped one by one.
    """
    body = responses.select("paper_id", "ord", strip_fences(F.col("text")).alias("body"))
    items = body.select(
        "paper_id",
        "ord",
        F.coalesce(
            json_array(F.col("body")), json_array(embedded(F.col("body"), "[", "]"))
        ).alias("items"),
    )
    objects = each(
        items, ["paper_id", "ord"], F.slice("items", 1, limit), "item", "item_pos"
    ).filter(F.startswith("item", F.lit("{")))
    typed = objects.select(
        "*",
        _item_type(F.col("item"), "$.text").alias("text_type"),
        _item_type(F.col("item"), "$.ref_ids").alias("ids_type"),
        F.from_json("item", "struct<text:string,ref_ids:array<string>>").alias("v"),
    )
    ok = (
        (F.col("text_type") == "STRING")
        & (F.col("v.text") != "")
        & F.coalesce(F.col("ids_type").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
    )
    return typed.filter(ok).select(
        "paper_id",
        "ord",
        "item_pos",
        F.col("v.text").alias("text"),
        F.coalesce("v.ref_ids", F.array().cast("array<string>")).alias("ref_ids"),
    )


def known_refs(claims: DataFrame, parsed: DataFrame) -> DataFrame:
    """Drop reference ids the paper does not have; order and duplicates stay."""
    return (
        claims.join(ref_lists(parsed), "paper_id", "left")
        .withColumn(
            "ref_ids",
            F.filter(
                "ref_ids", lambda r: F.coalesce(F.array_contains("known_ids", r), F.lit(False))
            ),
        )
        .drop("known_ids")
    )


def span_of(claim: Column, text: Column) -> Column:
    """(char_start, char_end) of the claim in its section, end exclusive.

    Tries the whole claim, then a prefix of max(40, half), then 40 characters, all case
    insensitive; else the whole section.
    """
    needle = F.lower(T.strip(claim))
    nowhere = F.struct(F.lit(0).alias("char_start"), F.length(text).alias("char_end"))

    def located(v: Column) -> Column:
        n, lowered = v["n"], v["t"]
        size = F.length(n)
        lengths = [size, F.greatest(F.lit(40), F.floor(size / 2).cast("int")), F.lit(40)]
        out = None
        for length in lengths:
            at = F.when(
                (length > 0) & (length <= size),
                F.position(F.substr(n, F.lit(1), length), lowered),
            ).otherwise(F.lit(0))
            hit = F.struct(
                (at - 1).alias("char_start"),
                F.least(at - 1 + length, F.length(text)).alias("char_end"),
            )
            out = F.when(at > 0, hit) if out is None else out.when(at > 0, hit)
        # All that is tried begins with these characters; a text without them is not searched again.
        start = F.substr(n, F.lit(1), F.least(size, F.lit(40)))
        return F.when(F.contains(lowered, start), out.otherwise(nowhere)).otherwise(nowhere)

    return T.let(F.struct(needle.alias("n"), F.lower(text).alias("t")), located)


def locate_span(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_id, char_start, char_end to claims keyed by (paper_id, ord)."""
    placed = claims.join(
        sections.select("paper_id", "ord", "section_id", F.col("text").alias("section_text")),
        ["paper_id", "ord"],
    )
    return (
        placed.withColumn("span", span_of(F.col("text"), F.col("section_text")))
        .drop("section_text")
        .select("*", "span.char_start", "span.char_end")
        .drop("span")
    )


def claim_type(text: Column, has_refs: Column) -> Column:
    hit = lambda p: F.rlike(text, F.lit(p))
    return (
        F.when(has_refs | hit(P.INLINE_CITATION), F.lit("CITATION"))
        .when(hit(P.STAT_STRONG), F.lit("STATISTICAL"))
        .when(hit(P.STAT_NUMBER) & hit(P.STAT_CUE), F.lit("STATISTICAL"))
        .when(hit(P.TEMPORAL), F.lit("TEMPORAL"))
        .when(hit(P.CAPABILITY), F.lit("CAPABILITY"))
        .otherwise(F.lit("EMPIRICAL"))
    )


def severity_of(kind: Column, text: Column) -> Column:
    base = None
    for name, level in P.BASE_SEVERITY.items():
        base = (
            F.when(kind == name, F.lit(level)) if base is None else base.when(kind == name, F.lit(level))
        )
    base = base.otherwise(F.lit("MEDIUM"))
    return F.when(
        (base == "HIGH") & F.rlike(text, F.lit(P.NOVELTY)), F.lit("CRITICAL")
    ).otherwise(base)


def categorize(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_type", claim_type(F.col("text"), F.size("ref_ids") > 0))


def severity(claims: DataFrame) -> DataFrame:
    return claims.withColumn("severity", severity_of(F.col("claim_type"), F.col("text")))


def number_claims(claims: DataFrame) -> DataFrame:
    """``claim-{n}`` over a paper's claims in document order (bounded by one paper)."""
    order = Window.partitionBy("paper_id").orderBy("ord", "item_pos")
    return claims.withColumn("claim_seq", F.row_number().over(order)).withColumn(
        "claim_id", F.concat(F.lit("claim-"), F.col("claim_seq").cast("string"))
    )


def place_claims(claims: DataFrame, parsed: DataFrame) -> DataFrame:
    """Numbered claims with the section they are in, their span there and their known references.

    One join by paper: section texts stay in the parsed row, so a table of parsed papers that is
    stored in buckets of ``paper_id`` (``session.stage_buckets``) is read in place and only claims
    are exchanged. Claims of sections that the paper does not have are left out.
    """
    papers = parsed.select("paper_id", "sections", known_ids().alias("known_ids"))
    joined = claims.join(papers, "paper_id")
    home = F.get(F.filter("sections", lambda s: s["ord"] == F.col("ord")), F.lit(0))
    found = joined.select(*claims.columns, "known_ids", home.alias("home")).filter("home IS NOT NULL")
    span = span_of(F.col("text"), F.col("home.text"))
    known = F.filter("ref_ids", lambda r: F.coalesce(F.array_contains("known_ids", r), F.lit(False)))
    kept = [c for c in claims.columns if c != "ref_ids"]
    return settled(
        found.select(*kept, known.alias("ref_ids"), F.col("home.section_id").alias("section_id"), span.alias("span"))
    ).select(*kept, "ref_ids", "section_id", "span.char_start", "span.char_end")


def build_claims(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Raw parsed claims to finished claims."""
    rows = severity(categorize(place_claims(number_claims(raw), parsed)))
    return rows.select(
        "paper_id", "claim_id", "claim_seq", T.strip(F.col("text")).alias("text"), "claim_type",
        "severity", "section_id", "char_start", "char_end", "ref_ids",
    )
