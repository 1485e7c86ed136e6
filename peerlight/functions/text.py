"""String expressions: trimming, words, tokens, names, numbers as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerlight.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(P.WHITESPACE))


def is_blank(c: Column) -> Column:
    """Nothing but whitespace. Looks at the start only: trimming the end walks the whole text."""
    return F.ltrim(c, F.lit(P.WHITESPACE)) == ""


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First regex group, NULL when there is no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def unify_newlines(c: Column) -> Column:
    """All line separators as newlines. Most texts have no other separator, which a cheap
    scan finds out, and pass through unchanged."""
    odd = F.rlike(c, F.lit(P.LATIN_BREAK))
    for wide in P.WIDE_BREAKS:
        odd = odd | F.contains(c, F.lit(wide))
    return F.when(odd, F.regexp_replace(c, P.LINE_BREAKS, "\n")).otherwise(c)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words; 0 for NULL."""
    return F.coalesce(F.regexp_count(c, F.lit(P.WORD)), F.lit(0))


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{P.WS}+", " "))


def fold_lines(c: Column) -> Column:
    """Join the non-blank lines of a block with single spaces."""
    return strip(F.regexp_replace(c, f"{P.INLINE_WS}*\\n{P.WS}*", " "))


def normalize_title(c: Column) -> Column:
    """Drop a leading section number such as ``2.1``, ``A.1`` or ``VII.``."""
    return strip(F.regexp_replace(strip(c), P.SECTION_NUMBER, ""))


def slug(c: Column, limit: int = 64) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.btrim(dashed, F.lit("-")), 1, limit)


def report_slug(c: Column) -> Column:
    return F.coalesce(blank_to_null(slug(strip(c), 60)), F.lit("untitled"))


def content_id(c: Column, prefix: str = "md:") -> Column:
    """Content-stable paper id."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 16))


def title_words(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def content_words(c: Column) -> Column:
    """Distinct content tokens: longer than two letters, stopwords removed."""
    stop = F.array(*[F.lit(w) for w in P.STOPWORDS])
    found = F.regexp_extract_all(c, F.lit(P.CONTENT_TOKEN), F.lit(0))
    lowered = F.transform(F.filter(found, lambda t: F.length(t) > 2), lambda t: F.lower(t))
    return F.array_except(lowered, stop)


def name_words(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(P.NAME_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def surname(c: Column) -> Column:
    """Family name of ``First Last`` or ``Last, F.``."""
    s = strip(c)
    last = F.coalesce(F.regexp_extract(s, f"({P.NOT_WS}+)$", 1), F.lit(""))
    part = F.when(F.contains(s, F.lit(",")), F.substring_index(s, ",", 1)).otherwise(last)
    return F.lower(F.regexp_replace(part, r"(?U)[^\w]", ""))


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two distinct-token arrays, 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def join_parts(parts: Column, sep: str, empty: str = "") -> Column:
    """``sep``-joined array, or ``empty`` when nothing is in it."""
    return F.when(F.size(parts) == 0, F.lit(empty)).otherwise(F.array_join(parts, sep))


def quoted_list(items: Column) -> Column:
    """``['a', 'b']`` as it appears in check details."""
    quoted = F.transform(
        items,
        lambda s: F.when(
            F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"')),
            F.concat(F.lit('"'), s, F.lit('"')),
        ).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def optional_list(pairs: list[tuple[Column, Column]]) -> Column:
    """Array of the texts whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))
