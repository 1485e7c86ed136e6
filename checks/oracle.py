"""DuckDB side of the checks: common table expressions that recompute every stage.

Written independently of the Spark operators (set-oriented SQL over long tables), and joined
into one statement per query by ``query``.
"""

from __future__ import annotations

import re

from checks import corpus
from peerlight.functions import patterns as P
from peerlight.sources.configs import SHIPPED, complete_config, config_hash

WS = "chr(32) || chr(9) || chr(10) || chr(13)"
VENUES = ["neurips", "ieee", "arxiv"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def words(e: str) -> str:
    return f"coalesce(len(regexp_extract_all({e}, '\\S+')), 0)"


def rx(e: str, digits: int = 4) -> str:
    """Round the exact binary value, ties to even."""
    s, k = dbl(10**digits), dbl(134217729)
    return (
        f"list_transform(list_transform(list_transform([{dbl(e)}], "
        f"lambda x: {{'x': x, 'p': x * {s}, 'h': x * {k} - (x * {k} - x)}}), "
        f"lambda r: {{'p': r.p, 'f': floor(r.p), 'e': (r.h * {s} - r.p) + (r.x - r.h) * {s}}}), "
        f"lambda r: (CASE WHEN r.p - r.f > 0.5 OR (r.p - r.f = 0.5 AND (r.e > 0 OR "
        f"(r.e = 0 AND abs(r.f) % 2 = 1))) THEN r.f + 1 ELSE r.f END) / {s})[1]"
    )


def fx(e: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rx(e, digits)})"


def has_any(e: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in items) + ")"


def re2(pattern: str) -> str:
    """A Java pattern as an RE2 literal (no look-around in it)."""
    return q(pattern.replace("(?U)", "").replace("(?Ui)", "(?i)").replace("(?Um)", "(?m)"))


CTE: dict[str, str] = {}

CTE["papers"] = corpus.papers_sql("duckdb")
CTE["works"] = corpus.WORKS_SQL
CTE["cat"] = corpus.catalog_sql("[", "]")
CTE["meta"] = corpus.METADATA_SQL
CTE["pieces"] = (
    "SELECT paper_id, string_split(regexp_replace(md, '(?m)^(#{1,6}[ \\t][^\\n])', "
    "chr(1) || '\\1', 'g'), chr(1)) AS ps FROM papers"
)
CTE["blocks"] = f"""
SELECT paper_id, i - 1 AS pos,
  CASE WHEN i = 1 THEN 0 ELSE length(regexp_extract(p, '^(#+)', 1)) END AS level,
  CASE WHEN i = 1 THEN '' ELSE {strip("substr(split_part(p, chr(10), 1), length(regexp_extract(p, '^(#+)', 1)) + 1)")} END AS title,
  CASE WHEN i = 1 THEN {strip('p')} ELSE {strip("substr(p, length(split_part(p, chr(10), 1)) + 2)")} END AS body
FROM (SELECT paper_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM pieces)
"""
NUM = r"(?i)^(?:[A-Z]\.?\s*\d+(?:\.\d+)*\.?\s+|\d+(?:\.\d+)*\.?\s+|[IVXLCDM]{1,5}\.?\s+)"
REFS = "('references', 'bibliography', 'works cited', 'citations')"
CTE["named"] = f"""
SELECT *, lower(title) IN {REFS} OR lower(clean) IN {REFS} AS is_refs
FROM (
  SELECT *, coalesce(nullif({strip(f"regexp_replace(title, {q(NUM)}, '')")}, ''), 'Introduction') AS clean
  FROM blocks WHERE title <> '' OR body <> ''
)
"""
CTE["kept"] = """
SELECT * FROM (
  SELECT *, min(CASE WHEN level <> 1 AND NOT is_refs THEN pos END) OVER (PARTITION BY paper_id) AS first_pos
  FROM named
) WHERE level <> 1 OR pos > first_pos
"""
CTE["secs0"] = """
SELECT paper_id, clean AS title, body AS text,
  row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS ord
FROM kept WHERE NOT is_refs
"""
CTE["secs"] = """
SELECT paper_id, coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), ''),
  'section-' || ord) AS section_id, title, text, ord, lower(title) AS tl
FROM secs0 WHERE text <> ''
"""
CTE["titles"] = """
SELECT p.paper_id, coalesce(arg_min(b.title, b.pos) FILTER (WHERE b.level = 1 AND b.title <> ''), 'Untitled') AS title
FROM papers p LEFT JOIN blocks b USING (paper_id) GROUP BY 1
"""
CTE["abst"] = f"""
SELECT p.paper_id, nullif({strip("arg_min(s.text, s.ord) FILTER (WHERE s.tl = 'abstract')")}, '') AS abstract
FROM papers p LEFT JOIN secs s USING (paper_id) GROUP BY 1
"""
MARK = r"(?:\[\d+\]|\(\d+\)|\d+\.|\*|-)"
CTE["refbody"] = "SELECT paper_id, arg_max(body, pos) AS body FROM kept WHERE is_refs GROUP BY 1"
CTE["entries"] = f"""
SELECT paper_id, i - 1 AS ref_pos,
  {strip("regexp_replace(e, '[ \\t]*\\n\\s*', ' ', 'g')")} AS entry
FROM (
  SELECT paper_id, unnest(es) AS e, unnest(range(1, len(es) + 1)) AS i FROM (
    SELECT paper_id, CASE WHEN regexp_matches(body, '(?m)^{MARK}[ \\t]+\\S')
      THEN list_filter(string_split(regexp_replace(body, '(?m)^({MARK}[ \\t]+\\S)', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '')
      ELSE regexp_split_to_array(body, '\\n[ \\t]*\\n\\s*') END AS es
    FROM refbody WHERE body <> ''
  )
)
"""
CTE["refraw"] = f"""
SELECT paper_id, 'ref-' || (ref_pos + 1) AS ref_id, ref_pos, raw,
  CAST(nullif(regexp_extract(raw, '\\b(?:19|20)\\d{{2}}\\b'), '') AS INT) AS year
FROM (SELECT *, {strip(f"regexp_replace(entry, '^{MARK}\\s+', '')")} AS raw FROM entries)
WHERE raw <> ''
"""
ENDS = r"^(.*?)\.\s+(?:[A-Z]|In\b|arXiv\b|Proceedings\b|Advances\b|https?:)"
WHOLE = "nullif(substr(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 1, 200), '')"
CTE["reftitle"] = f"""
SELECT *, CASE WHEN year IS NULL THEN {WHOLE} ELSE coalesce(nullif(trim(
  CASE WHEN regexp_matches(after, '{ENDS}') THEN regexp_extract(after, '{ENDS}', 1) ELSE after END, ' .'), ''), {WHOLE}) END AS title
FROM (SELECT *, regexp_replace(substr(raw, instr(raw, CAST(year AS VARCHAR)) + 4), '^[).,\\s]*', '') AS after FROM refraw)
"""
CTE["refs"] = """
SELECT paper_id, ref_id, ref_pos, raw, title, year, CAST(NULL AS VARCHAR) AS venue,
  CASE WHEN prefix = '' OR prefix IS NOT DISTINCT FROM title THEN CAST([] AS VARCHAR[]) ELSE
    list_filter(list_transform(regexp_split_to_array(regexp_replace(prefix, ',\\s+([A-Z])', chr(1) || '\\1', 'g'),
      chr(1) || '|\\s+and\\s+'), lambda x: trim(x, ' .,')), lambda x: x <> '') END AS authors,
  nullif(rtrim(regexp_extract(raw, '(?i)\\b10\\.\\d{4,9}/[-._;()/:A-Z0-9]+'), '.,;)'), '') AS doi,
  coalesce(nullif(regexp_replace(regexp_extract(raw, '(?i)arxiv[:\\s]+((?:\\d{4}\\.\\d{4,5})(?:v\\d+)?|(?:[a-z\\-]+(?:\\.[A-Z]{2})?/\\d{7})(?:v\\d+)?)', 1), '(?i)v\\d+$', ''), ''),
    nullif(regexp_extract(raw, '\\b(\\d{4}\\.\\d{4,5})(v\\d+)?\\b', 1), ''),
    nullif(regexp_extract(raw, '(?i)\\b([a-z\\-]+(?:\\.[A-Z]{2})?/\\d{7})(v\\d+)?\\b', 1), '')) AS arxiv_id
FROM (SELECT *, CASE WHEN year IS NULL THEN '' ELSE
  trim(trim(regexp_extract(raw, '^(.*?)\\b(?:19|20)\\d{2}\\b', 1)), '(.,') END AS prefix FROM reftitle)
"""
CTE["facts"] = f"""
SELECT p.paper_id, p.doc_id AS d, t.title, a.abstract, coalesce(r.n, 0) AS n_refs,
  {words('a.abstract')} + coalesce(s.wc, 0) AS word_count, coalesce(s.titles, '') AS titles
FROM papers p JOIN titles t USING (paper_id) JOIN abst a USING (paper_id)
LEFT JOIN (SELECT paper_id, count(*) AS n FROM refraw GROUP BY 1) r USING (paper_id)
LEFT JOIN (SELECT paper_id, sum({words('text')}) AS wc, string_agg(tl, chr(10) ORDER BY ord) AS titles FROM secs GROUP BY 1) s USING (paper_id)
"""

# --- compliance ---------------------------------------------------------------


def quoted(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _checks() -> str:
    parts = []
    for name in VENUES:
        c = SHIPPED[name]["compliance"]
        seq = 0

        def add(block, check, passed, detail, issue, critical, config=name):
            nonlocal seq
            parts.append(
                f"SELECT paper_id, '{config}' AS config_id, {seq} AS check_seq, '{block}' AS block, "
                f"{q(check)} AS name, {passed} AS passed, {detail} AS detail, "
                f"CASE WHEN NOT ({passed}) THEN {issue} END AS issue, {critical} AS critical FROM facts_meta"
            )
            seq += 1

        for aliases in c["required_sections"]:
            ok = has_any("titles", aliases)
            add("section", f"section_present:{aliases[0]}", ok,
                f"CASE WHEN NOT {ok} THEN {q('No section matches any of ' + quoted(aliases))} END",
                q(f"Missing required section: {aliases[0]}"), "TRUE")
        m = c["min_references"]
        add("section", "references_present", f"n_refs >= {m}", f"n_refs || ' references found (min {m})'",
            f"'Too few references: ' || n_refs || ' < required {m}'", "TRUE")
        lo, hi = c["word_count_min"], c["word_count_max"]
        add("format", "word_count", f"(word_count >= {lo} AND word_count <= {hi})",
            f"word_count || ' words (min {lo}, max {hi})'",
            f"'Word count ' || word_count || ' outside [{lo}, {hi}]'", "FALSE")
        if c["require_ethics"]:
            ok = has_any("titles", c["ethics_aliases"])
            add("section", "ethics_section", ok,
                f"CASE WHEN NOT {ok} THEN {q('None of ' + quoted(c['ethics_aliases']) + ' found')} END",
                q("Ethics / broader-impact section missing"), "FALSE")
        if c["require_anonymization"]:
            ok = "(author IS NULL OR contains(lower(author), 'anon'))"
            shown = "CASE WHEN contains(author, chr(39)) THEN '[\"' || author || '\"]' ELSE '[''' || author || ''']' END"
            add("format", "anonymization", ok, f"CASE WHEN NOT {ok} THEN 'Authors present: ' || {shown} END",
                q("Paper does not appear to be anonymized"), "FALSE")
    return "\nUNION ALL\n".join(parts)


CTE["facts_meta"] = "SELECT f.*, m.author FROM facts f JOIN meta m USING (paper_id)"
CTE["facts_anon"] = "SELECT f.*, CAST(NULL AS VARCHAR) AS author FROM facts f"
CTE["checks"] = _checks()
CTE["checks_anon"] = _checks().replace("facts_meta", "facts_anon")
_ROLL = """
SELECT paper_id, config_id,
  CASE WHEN bool_or(NOT passed AND critical) THEN 'FAIL' WHEN bool_or(NOT passed) THEN 'CONDITIONAL' ELSE 'PASS' END AS triage,
  count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n_checks,
  coalesce(string_agg(issue, ' ## ' ORDER BY check_seq), '') AS issues,
  coalesce(string_agg(issue, '; ' ORDER BY check_seq), '') AS banner_issues,
  count(issue) AS n_issues
FROM {src} GROUP BY 1, 2
"""
CTE["comp"] = _ROLL.format(src="checks")
CTE["comp_anon"] = _ROLL.format(src="checks_anon")

# --- depth ------------------------------------------------------------------
CATS = {
    "intro": P.INTRO_TITLES, "method": P.METHOD_TITLES, "results": P.RESULT_TITLES,
    "conclusion": P.CONCLUSION_TITLES, "limited": P.LIMITATION_TITLES,
}
CTE["cats"] = "SELECT *, " + ", ".join(
    f"{has_any('tl', w)} AS is_{c}" for c, w in CATS.items()
) + ", tl IN (" + ", ".join(q(w) for w in P.CONCLUSION_TITLES + P.LIMITATION_TITLES) + ") AS closing FROM secs"
_txt = lambda f: f"coalesce(string_agg(text, ' ' ORDER BY ord) FILTER (WHERE {f}), '')"
CTE["deptext"] = (
    "SELECT paper_id, "
    + ", ".join(f"bool_or(is_{c}) AS {c}" for c in CATS)
    + f", {_txt('is_method')} AS mt, {_txt('is_limited')} AS lt, {_txt('closing')} AS ct, {_txt('TRUE')} AS ft"
    + f", substr(lower({_txt('is_results')}), 1, 2000) AS rt, substr(lower({_txt('is_conclusion')}), 1, 2000) AS kt"
    + " FROM cats GROUP BY 1"
)
_cue = lambda c, p: f"CAST(regexp_matches({c}, {re2(p)}) AS INT)"
CTE["cues"] = f"""
SELECT paper_id, intro, method, results, conclusion, limited, mt = '' AS no_method,
  {_cue('mt', P.DATASET_CUE)} AS m1, {_cue('mt', P.BASELINE_CUE)} AS m2, {_cue('mt', P.ABLATION_CUE)} AS m3,
  {_cue('mt', P.METRIC_CUE)} AS m4, CAST({words('mt')} >= 150 AS INT) AS m5,
  {words('lt')} AS lw, len(regexp_extract_all(ct, {re2(P.LIMITATION_WORDS)})) AS lh,
  {_cue('ft', P.CODE_URL)} AS r1, {_cue('ft', P.SEED_CUE)} AS r2, {_cue('ft', P.HYPERPARAM_CUE)} AS r3, {_cue('ft', P.DATASET_CUE)} AS r4,
  len(list_intersect(list_distinct(regexp_extract_all(rt, '[a-z]{{5,}}')), list_distinct(regexp_extract_all(kt, '[a-z]{{5,}}')))) AS shared
FROM deptext
"""
_skel = "(CAST(intro AS INT) + CAST(method AS INT) + CAST(results AS INT) + CAST(conclusion AS INT))"
_names = lambda pairs, sep=", ": f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {q(n)} END' for n, c in pairs)}], lambda x: x IS NOT NULL), {q(sep)})"
_msig = [("dataset_mentioned", "m1 = 1"), ("baseline_mentioned", "m2 = 1"), ("ablation_discussed", "m3 = 1"), ("metric_named", "m4 = 1"), ("substantive_length", "m5 = 1")]
_rsig = [("code_url", "r1 = 1"), ("seed_mentioned", "r2 = 1"), ("hyperparameters", "r3 = 1"), ("dataset_named", "r4 = 1")]
_miss = [("introduction", "NOT intro"), ("method", "NOT method"), ("results", "NOT results"), ("conclusion", "NOT conclusion")]
CTE["dep"] = f"""
SELECT paper_id,
  {rx(f"CASE WHEN no_method THEN 0 ELSE (m1 + m2 + m3 + m4 + m5) / {dbl(5)} END")} AS methodology,
  {rx(f"CASE WHEN limited THEN greatest(least({dbl(1)}, lw / {dbl(200)}), {dbl(0.5)}) WHEN lh = 0 THEN 0 ELSE least({dbl(0.5)}, lh * {dbl(0.1)}) END")} AS limitations,
  {rx(f"(r1 + r2 + r3 + r4) / {dbl(4)}")} AS reproducibility,
  {rx(f"CASE WHEN shared >= 5 THEN least({dbl(1)}, {_skel} / {dbl(4)} + {dbl(0.1)}) ELSE {_skel} / {dbl(4)} END")} AS logical_soundness,
  CASE WHEN no_method THEN 'No methodology section found.' ELSE 'Methodology signals present: ' || coalesce(nullif({_names(_msig)}, ''), 'none') END AS why_methodology,
  CASE WHEN limited THEN 'Dedicated limitations/discussion section (' || lw || ' words)' WHEN lh = 0 THEN 'No limitations section and no limitation-flavored language.'
    ELSE 'Limitations language mentioned ' || lh || ' time(s) in conclusion-adjacent sections.' END AS why_limitations,
  'Reproducibility cues: ' || coalesce(nullif({_names(_rsig)}, ''), 'none') AS why_reproducibility,
  CASE WHEN intro AND method AND results AND conclusion THEN 'All skeleton parts present.' ELSE 'Missing skeleton parts: ' || {_names(_miss)} END AS why_logical
FROM cues
"""

# --- rubric and composite ---------------------------------------------------


def _dims(ledger: str) -> str:
    """Long dimension rows from signal columns ``vf`` (verified fraction), ``hc`` and depth."""
    parts = []
    for name in VENUES:
        for i, dim in enumerate(SHIPPED[name]["rubric"]["dimensions"]):
            n = dim["name"]
            if "sound" in n:
                base = f"{dbl(0.5)} * vf + {dbl(0.3)} * methodology + {dbl(0.2)} * (CASE WHEN hc = 0 THEN {dbl(1)} ELSE greatest({dbl(0)}, {dbl(1)} - {dbl(0.2)} * hc) END)"
                why = f"'Heuristic: verified=' || {fx('vf', 2)} || ', methodology=' || {fx('methodology', 2)} || ', hallucinations=' || hc || '.'"
            elif "present" in n or "clarity" in n:
                base = f"{dbl(0.6)} * logical_soundness + {dbl(0.4)} * limitations"
                why = f"'Heuristic: logical_soundness=' || {fx('logical_soundness', 2)} || ', limitations=' || {fx('limitations', 2)} || '.'"
            elif "contribution" in n or "original" in n:
                base = f"{dbl(0.5)} * methodology + {dbl(0.5)} * reproducibility"
                why = f"'Heuristic: methodology=' || {fx('methodology', 2)} || ', reproducibility=' || {fx('reproducibility', 2)} || '.'"
            elif "significance" in n or "impact" in n:
                base = f"{dbl(0.5)} * methodology + {dbl(0.3)} * logical_soundness + {dbl(0.2)} * limitations"
                why = f"'Heuristic: methodology=' || {fx('methodology', 2)} || ', logical=' || {fx('logical_soundness', 2)} || ', limitations=' || {fx('limitations', 2)} || '.'"
            else:
                base = dbl(0.5)
                why = f"'Heuristic: unknown dimension ''{n}''; defaulting to neutral 0.5.'"
            parts.append(
                f"SELECT paper_id, '{name}' AS config_id, {i} AS dim_pos, '{n}' AS name, "
                f"greatest({dbl(0)}, least({dbl(1)}, {base})) * {dbl(dim['max_score'])} AS h_score, "
                f"{dbl(dim['max_score'])} AS max_score, {dbl(dim['weight'])} AS weight, {why} AS h_why "
                f"FROM {ledger} WHERE config_id = '{name}'"
            )
    return "\nUNION ALL\n".join(parts)


def _rubric_total(dims: str, sig: str) -> str:
    cases = []
    for name in VENUES:
        b = SHIPPED[name]["rubric"]["bias_adjustment"]
        cases.append(
            f"SELECT '{name}' AS config_id, {b['length_penalty_start']} AS ps, {b['length_penalty_full']} AS pf, {dbl(b['max_penalty'])} AS mp"
        )
    return f"""
SELECT paper_id, config_id, {rx('raw')} AS raw_total,
  {rx(f"CASE WHEN wc > ps THEN greatest({dbl(0)}, raw - pen) ELSE raw END")} AS bias_adjusted_total,
  CASE WHEN wc > ps THEN 'Length bias: word_count=' || wc || ', penalty=' || {fx('pen', 3)} || ' (x of ' || {fx('mp', 2)} || ')' ELSE '' END AS note
FROM (
  SELECT t.paper_id, t.config_id, t.raw, c.ps, c.pf, c.mp, s.word_count AS wc,
    least({dbl(1)}, {dbl('s.word_count - c.ps')} / (c.pf - c.ps)) * c.mp AS pen
  FROM (
    SELECT paper_id, config_id,
      list_reduce(list_prepend({dbl(0)}, list(weight * (score / max_score) ORDER BY dim_pos)), lambda a, b: a + b)
      / list_reduce(list_prepend({dbl(0)}, list(weight ORDER BY dim_pos)), lambda a, b: a + b) AS raw
    FROM {dims} GROUP BY 1, 2
  ) t JOIN ({' UNION ALL '.join(cases)}) c USING (config_id) JOIN {sig} s USING (paper_id, config_id)
)
"""


CTE["sig"] = """
SELECT f.paper_id, c.config_id, f.word_count, d.*  EXCLUDE (paper_id), CAST(0 AS DOUBLE) AS vf, 0 AS hc
FROM facts f JOIN dep d USING (paper_id) JOIN comp c USING (paper_id)
"""
CTE["dims"] = f"SELECT paper_id, config_id, dim_pos, name, {rx('h_score')} AS score, max_score, weight, h_why AS rationale FROM ({_dims('sig')})"
CTE["rub"] = _rubric_total("dims", "sig")


def composite(values: dict[str, str], weights: dict[str, str]) -> str:
    """Unrounded weighted composite; NULL values give up their weight."""
    total = " + ".join(
        f"(CASE WHEN {values[k]} IS NULL THEN {dbl(0)} ELSE {weights[k]} END)" for k in P.SCORING_KEYS
    )
    parts = " + ".join(
        f"coalesce({values[k]} * ({weights[k]} / nullif({total}, 0)), {dbl(0)})" for k in P.SCORING_KEYS
    )
    return f"{dbl(0)} + {parts}"


W = {k: dbl(v) for k, v in P.DEFAULT_WEIGHTS.items()}
V = {k: k for k in P.SCORING_KEYS}


def recommendation(e: str) -> str:
    out = " ".join(f"WHEN {e} >= {dbl(b)} THEN '{n}'" for b, n in P.RECOMMENDATION_BANDS)
    return f"CASE {out} ELSE '{P.LOWEST_BAND}' END"


CTE["sub"] = f"""
SELECT c.paper_id, c.config_id, {dbl('c.n_passed')} / c.n_checks AS compliance, CAST(NULL AS DOUBLE) AS verification,
  (d.methodology + d.limitations + d.reproducibility + d.logical_soundness) / {dbl(4)} AS depth,
  r.bias_adjusted_total AS rubric
FROM comp c JOIN dep d USING (paper_id) JOIN rub r USING (paper_id, config_id)
"""
CTE["compo"] = (
    f"SELECT *, {recommendation('composite')} AS recommendation FROM "
    f"(SELECT *, {rx(composite(V, W))} AS composite FROM sub)"
)

# --- citations --------------------------------------------------------------
CTE["cat_tokens"] = """
SELECT DISTINCT source, catalog_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS tok FROM cat
"""
CTE["cat_n"] = "SELECT source, catalog_id, count(*) AS n FROM cat_tokens GROUP BY 1, 2"
CTE["ref_tokens"] = """
SELECT DISTINCT paper_id, ref_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS tok FROM refs
"""
CTE["ref_n"] = "SELECT paper_id, ref_id, count(*) AS n FROM ref_tokens GROUP BY 1, 2"
CTE["title_hits"] = f"""
SELECT paper_id, ref_id, source, catalog_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, ref_id, source ORDER BY sim DESC, catalog_id) AS rn FROM (
    SELECT o.paper_id, o.ref_id, o.source, o.catalog_id, o.k / {dbl('r.n + c.n - o.k')} AS sim
    FROM (SELECT r.paper_id, r.ref_id, c.source, c.catalog_id, count(*) AS k
          FROM ref_tokens r JOIN cat_tokens c USING (tok) GROUP BY 1, 2, 3, 4) o
    JOIN ref_n r USING (paper_id, ref_id) JOIN cat_n c USING (source, catalog_id)
  ) WHERE sim >= {dbl(0.6)}
) WHERE rn = 1
"""
# Titles inside undated entries: all places of all titles, no index.
CTE["cat_words"] = """
SELECT source, catalog_id, len(w) AS k, unnest(w) AS tok, unnest(range(len(w))) AS pos
FROM (SELECT source, catalog_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM cat)
"""
CTE["dated"] = "SELECT * FROM refs WHERE year IS NOT NULL"


def entry_hits(refs: str, share: float) -> str:
    return f"""
SELECT paper_id, ref_id, source, catalog_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, ref_id, source ORDER BY sim DESC, k DESC, catalog_id) AS rn FROM (
    SELECT paper_id, ref_id, source, catalog_id, k, max(n) / {dbl('k')} AS sim FROM (
      SELECT r.paper_id, r.ref_id, c.source, c.catalog_id, c.k, r.pos - c.pos AS place, count(*) AS n
      FROM (SELECT paper_id, ref_id, unnest(w) AS tok, unnest(range(len(w))) AS pos
            FROM (SELECT paper_id, ref_id, regexp_extract_all(lower(raw), '[a-z0-9]+') AS w FROM {refs} WHERE year IS NULL)) r
      JOIN cat_words c USING (tok) WHERE c.k >= 3 GROUP BY ALL)
    WHERE n >= ceil(k * {dbl(share)} - {dbl("1e-9")}) GROUP BY paper_id, ref_id, source, catalog_id, k)
) WHERE rn = 1
"""


CTE["entry_hits"] = entry_hits("refs", 0.9)
# Dated entries told without their year, between authors and venue; some with a word changed.
CTE["undated"] = """
SELECT paper_id, ref_id, CAST(NULL AS INT) AS year, 'Miller, A., Okafor, B. and Lee, C. '
  || CASE WHEN ref_pos % 3 = 0 THEN regexp_replace(title, '^[A-Za-z]+', 'Otherwise') ELSE title END
  || '. Journal of Tests, volume 3, pages 4-9, Springer' AS raw FROM dated
"""
CTE["undated_hits"] = entry_hits("undated", 0.8)
# BM25 of all titles that share a word with a reference, in thousandths rounded down.
CTE["bm_query"] = """
SELECT DISTINCT paper_id, ref_id, unnest(regexp_extract_all(lower(CASE WHEN year IS NULL THEN raw
  ELSE title || ' ' || coalesce(authors[1], '') END), '[a-z0-9]+')) AS tok FROM refs
"""
CTE["bm_share"] = f"""
SELECT source, catalog_id, tok, greatest(1, CAST(floor(1000 * ln((n_titles - df + {dbl('0.5')}) / (df + {dbl('0.5')}) + {dbl('1.0')})
  * tf * {dbl('2.2')} / (tf + {dbl('1.2')} * ({dbl('0.25')} + {dbl('0.75')} * k * n_titles / all_words))) AS BIGINT)) AS share
FROM (SELECT source, catalog_id, tok, any_value(k) AS k, count(*) AS tf FROM cat_words GROUP BY ALL)
JOIN (SELECT source, tok, count(DISTINCT catalog_id) AS df FROM cat_words GROUP BY ALL) USING (source, tok)
JOIN (SELECT source, {dbl('count(DISTINCT catalog_id)')} AS n_titles, {dbl('count(*)')} AS all_words FROM cat_words GROUP BY source) USING (source)
"""
CTE["bm_hits"] = """
SELECT paper_id, ref_id, source, catalog_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, ref_id, source ORDER BY score DESC, catalog_id) AS rn FROM (
    SELECT paper_id, ref_id, source, catalog_id, CAST(sum(share) AS BIGINT) AS score
    FROM bm_query JOIN bm_share USING (tok) GROUP BY ALL)
) WHERE rn = 1
"""
CTE["errs"] = " UNION ALL ".join(
    f"SELECT '{s}' AS source, '{k}' AS key_kind, {e} AS key FROM works WHERE {cond}"
    for s, k, e, cond in [
        ("crossref", "doi", corpus._DOI, "c % 5 = 0"),
        ("semantic_scholar", "doi", corpus._DOI, "c % 5 = 0 AND c % 2 = 0"),
        ("openalex", "doi", corpus._DOI, "c % 10 = 0"),
        ("semantic_scholar", "arxiv", corpus.work_arxiv("c"), "c % 3 = 1 AND c % 4 = 0"),
    ]
)
CTE["ref_err"] = """
SELECT r.paper_id, r.ref_id, e.source, 0 AS key_rank FROM refs r JOIN errs e ON e.key_kind = 'doi' AND lower(e.key) = lower(r.doi)
UNION ALL SELECT r.paper_id, r.ref_id, e.source, 1 FROM refs r JOIN errs e ON e.key_kind = 'arxiv' AND lower(e.key) = lower(r.arxiv_id)
"""
CTE["all_hits"] = """
SELECT r.paper_id, r.ref_id, c.source, c.source_rank, 0 AS key_rank, min(c.catalog_id) AS catalog_id
FROM refs r JOIN cat c ON lower(r.doi) = lower(c.doi) GROUP BY 1, 2, 3, 4
UNION ALL
SELECT r.paper_id, r.ref_id, c.source, c.source_rank, 1, min(c.catalog_id)
FROM refs r JOIN cat c ON lower(r.arxiv_id) = lower(c.arxiv_id) AND c.source = 'semantic_scholar' GROUP BY 1, 2, 3, 4
UNION ALL
SELECT t.paper_id, t.ref_id, t.source, c.source_rank, 2, t.catalog_id
FROM title_hits t JOIN cat c USING (source, catalog_id)
UNION ALL
SELECT t.paper_id, t.ref_id, t.source, c.source_rank, 3, t.catalog_id
FROM entry_hits t JOIN cat c USING (source, catalog_id)
"""
_LOOK = """
SELECT r.paper_id, r.ref_id, CASE WHEN h.source IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status,
  coalesce(h.source, 'none') AS source, c.title AS m_title, c.authors AS m_authors, c.year AS m_year,
  c.venue AS m_venue, c.doi AS m_doi
FROM refs r
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, ref_id ORDER BY {order}) AS rn FROM all_hits) WHERE rn = 1) h USING (paper_id, ref_id)
LEFT JOIN cat c ON c.source = h.source AND c.catalog_id = h.catalog_id
"""
CTE["look"] = _LOOK.format(order="source_rank * 10 + key_rank")
CTE["look_key"] = _LOOK.format(order="key_rank * 10 + source_rank")
_toks = lambda e: f"list_distinct(regexp_extract_all(lower({e}), '[a-z0-9]+'))"
_jac = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN {dbl(0)} ELSE len(list_intersect({a}, {b})) / {dbl(f'len(list_distinct(list_concat({a}, {b})))')} END)"
SURNAME = "lower(regexp_replace(CASE WHEN contains(n, ',') THEN split_part(n, ',', 1) ELSE regexp_extract(n, '(\\S+)$', 1) END, '[^\\w]', '', 'g'))"
_sur = lambda e: f"list_distinct(list_transform({e}, lambda n: {SURNAME}))"
CTE["match"] = f"""
SELECT *, {dbl(0.5)} * title_score + {dbl(0.25)} * author_score + {dbl(0.15)} * year_score + {dbl(0.10)} * venue_score AS overall
FROM (
  SELECT r.paper_id, r.ref_id, r.ref_pos, r.title, r.authors, r.year, l.m_year,
    {_jac(_toks('r.title'), _toks('l.m_title'))} AS title_score,
    CASE WHEN len(r.authors) = 0 THEN {dbl(0)} ELSE {_jac(_sur('r.authors'), _sur('l.m_authors'))} END AS author_score,
    CASE WHEN r.year IS NULL THEN {dbl(0)} WHEN abs(r.year - l.m_year) = 0 THEN {dbl(1)} WHEN abs(r.year - l.m_year) = 1 THEN {dbl(0.8)}
      WHEN abs(r.year - l.m_year) <= 3 THEN {dbl(0.4)} ELSE {dbl(0)} END AS year_score,
    {dbl(0)} AS venue_score
  FROM refs r JOIN look l USING (paper_id, ref_id) WHERE l.status = 'FOUND'
)
"""
CTE["temporal"] = """
SELECT r.paper_id, r.ref_id, r.year AS ref_year, coalesce(m.year, 2020) AS paper_year,
  CASE WHEN r.year > coalesce(m.year, 2020) THEN 'Citation year ' || r.year || ' is after paper year ' || coalesce(m.year, 2020)
    ELSE 'Citation year ' || r.year || ' is more than 20 years older than paper year ' || coalesce(m.year, 2020) END AS reason
FROM refs r JOIN meta m USING (paper_id)
WHERE r.year IS NOT NULL AND (r.year > coalesce(m.year, 2020) OR r.year < coalesce(m.year, 2020) - 20)
"""

# --- claims -----------------------------------------------------------------
STOCK = (
    "CASE length(text) % 7 WHEN 0 THEN 'We reach 95.3% accuracy, the first to do so.' WHEN 1 THEN 'Since 2015 the field has grown.' "
    "WHEN 2 THEN 'The method can scale to large inputs.' WHEN 3 THEN 'Scores improve by 12 points on average.' "
    "WHEN 4 THEN 'Prior work [3] outperforms all baselines.' WHEN 5 THEN 'A plain observation.' "
    "ELSE 'Our novel model beats (Smith, 2019).' END"
)
CTE["content"] = f"""
SELECT s.*, p.doc_id AS d FROM secs s JOIN papers p USING (paper_id)
WHERE NOT regexp_matches(s.title, {re2(P.SKIP_SECTION)})
"""
CTE["raw_claims"] = f"""
SELECT paper_id, ord, unnest(items).pos AS item_pos, unnest(items).t AS text, unnest(items).r AS ref_ids
FROM (
  SELECT paper_id, ord, CASE n % 6
    WHEN 0 THEN [{{'pos': 0, 't': a, 'r': ['ref-1', 'ref-2', 'ref-99']}}, {{'pos': 1, 't': b, 'r': CAST([] AS VARCHAR[])}}]
    WHEN 1 THEN [{{'pos': 0, 't': a, 'r': ['ref-1', 'ref-2', 'ref-99']}}]
    WHEN 2 THEN [{{'pos': 0, 't': b, 'r': CAST([] AS VARCHAR[])}}, {{'pos': 1, 't': c, 'r': ['ref-3', 'ref-3', 'ref-1']}}]
    WHEN 4 THEN [{{'pos': 3, 't': b, 'r': CAST([] AS VARCHAR[])}}]
    WHEN 5 THEN list_transform(range(0, 10), lambda i: {{'pos': i, 't': 'Item ' || i || ': ' || b, 'r': ['ref-' || (i + 1)]}})
    ELSE [] END AS items
  FROM (SELECT paper_id, ord, length(text) AS n, substr(text, 1, 90) AS a, {STOCK} AS b, 'Reported under ' || title AS c FROM content)
) WHERE len(items) > 0
"""
CTE["known"] = "SELECT paper_id, list(ref_id ORDER BY ref_pos) AS ids FROM refs GROUP BY 1"
CTE["claims0"] = """
SELECT c.paper_id, c.ord, c.item_pos, c.text,
  row_number() OVER (PARTITION BY c.paper_id ORDER BY c.ord, c.item_pos) AS claim_seq,
  list_filter(c.ref_ids, lambda r: list_contains(coalesce(k.ids, CAST([] AS VARCHAR[])), r)) AS ref_ids
FROM raw_claims c LEFT JOIN known k USING (paper_id)
"""


def claim_type(t: str, refs: str) -> str:
    m = lambda p: f"regexp_matches({t}, {re2(p)})"
    return (
        f"CASE WHEN {refs} OR {m(P.INLINE_CITATION)} THEN 'CITATION' WHEN {m(P.STAT_STRONG)} THEN 'STATISTICAL' "
        f"WHEN {m(P.STAT_NUMBER)} AND {m(P.STAT_CUE)} THEN 'STATISTICAL' WHEN {m(P.TEMPORAL)} THEN 'TEMPORAL' "
        f"WHEN {m(P.CAPABILITY)} THEN 'CAPABILITY' ELSE 'EMPIRICAL' END"
    )


def severity(kind: str, t: str) -> str:
    return (
        f"CASE WHEN {kind} IN ('CITATION', 'STATISTICAL') THEN (CASE WHEN regexp_matches({t}, {re2(P.NOVELTY)}) THEN 'CRITICAL' ELSE 'HIGH' END) "
        f"WHEN {kind} IN ('CAPABILITY', 'EMPIRICAL') THEN 'MEDIUM' ELSE 'LOW' END"
    )


def _span(part: str) -> str:
    """Start (part='s') or end of the claim in its section text."""
    n = f"lower({strip('c.text')})"
    ls = [f"length({n})", f"greatest(40, length({n}) // 2)", "40"]
    cases = []
    for ln in ls:
        at = f"instr(lower(s.text), substr({n}, 1, {ln}))"
        cond = f"{ln} > 0 AND {ln} <= length({n}) AND {at} > 0"
        out = f"{at} - 1" if part == "s" else f"least({at} - 1 + {ln}, length(s.text))"
        cases.append(f"WHEN {cond} THEN {out}")
    return f"CASE {' '.join(cases)} ELSE {'0' if part == 's' else 'length(s.text)'} END"


CTE["claims"] = f"""
SELECT paper_id, 'claim-' || claim_seq AS claim_id, claim_seq, {strip('text')} AS text, claim_type,
  {severity('claim_type', 'text')} AS severity, section_id, char_start, char_end, ref_ids
FROM (
  SELECT c.*, s.section_id, {claim_type('c.text', 'len(c.ref_ids) > 0')} AS claim_type, {_span('s')} AS char_start, {_span('e')} AS char_end
  FROM claims0 c JOIN secs s USING (paper_id, ord)
)
"""
CTE["crefs"] = """
SELECT c.paper_id, c.claim_id, c.ref_pos, c.ref_id, coalesce(l.status, 'NOT_FOUND') AS status, l.source, l.m_title, l.m_year, l.m_doi
FROM (SELECT paper_id, claim_id, unnest(ref_ids) AS ref_id, unnest(range(0, len(ref_ids))) AS ref_pos FROM claims) c
LEFT JOIN look l USING (paper_id, ref_id)
"""
CTE["verdicts0"] = f"""
SELECT c.paper_id, c.claim_id, count(*) AS n_refs,
  count(*) FILTER (WHERE c.status = 'NOT_FOUND') AS n_missing,
  string_agg(c.ref_id, ', ' ORDER BY c.ref_pos) FILTER (WHERE c.status = 'NOT_FOUND') AS missing,
  string_agg(c.ref_id, ', ' ORDER BY c.ref_pos) FILTER (WHERE t.ref_id IS NOT NULL) AS late,
  list_reduce(list_prepend({dbl(0)}, list(m.overall ORDER BY c.ref_pos) FILTER (WHERE m.overall IS NOT NULL)), lambda a, b: a + b)
    / count(m.overall) AS mean_overall,
  arg_min(c.source, c.ref_pos) FILTER (WHERE c.status = 'FOUND') AS dominant,
  string_agg(c.ref_id || ': ' || coalesce(nullif(c.m_title, ''), '?') || ' (' || coalesce(CAST(c.m_year AS VARCHAR), '?') || ') via ' || c.source, ' | ' ORDER BY c.ref_pos)
    FILTER (WHERE c.status = 'FOUND') AS evidence
FROM crefs c LEFT JOIN match m USING (paper_id, ref_id) LEFT JOIN temporal t USING (paper_id, ref_id)
GROUP BY 1, 2
"""
CTE["verdicts"] = f"""
SELECT c.paper_id, c.claim_id,
  coalesce(v.n_missing = 0 AND v.late IS NULL AND v.mean_overall >= {dbl(0.6)}, FALSE) AS verified,
  CASE WHEN v.n_refs IS NULL OR v.n_missing > 0 THEN {dbl(0)}
    ELSE {rx(f"CASE WHEN v.late IS NOT NULL THEN least(v.mean_overall, {dbl(0.3)}) ELSE v.mean_overall END")} END AS confidence,
  CASE WHEN v.n_refs IS NULL THEN 'none' ELSE coalesce(v.dominant, 'none') END AS source,
  CASE WHEN v.n_missing > 0 THEN 'Unresolvable citations: ' || v.missing WHEN v.n_refs IS NOT NULL THEN coalesce(v.evidence, '') END AS evidence,
  coalesce(v.n_missing > 0 OR v.late IS NOT NULL, FALSE) AS hallucination_flag,
  CASE WHEN v.n_refs IS NULL AND c.claim_type = 'CITATION' THEN 'Categorized CITATION but no referenced citation ids; check extraction.'
    WHEN v.n_missing > 0 THEN v.n_missing || '/' || v.n_refs || ' citations unresolved'
    WHEN v.late IS NOT NULL THEN 'Temporal issue on refs: ' || v.late END AS notes
FROM claims c LEFT JOIN verdicts0 v USING (paper_id, claim_id)
"""

# --- entailment -------------------------------------------------------------
CTE["abs_doi"] = "SELECT lower(doi) AS k, arg_min(trim(abstract, chr(32) || chr(10) || chr(9)), catalog_id) AS abstract FROM cat WHERE source = 'semantic_scholar' AND doi IS NOT NULL GROUP BY 1"
CTE["pairs"] = """
SELECT c.paper_id, c.claim_id, c.ref_pos, c.ref_id, k.text AS claim_text, a.abstract, p.doc_id AS d
FROM crefs c JOIN claims k USING (paper_id, claim_id) JOIN papers p USING (paper_id)
LEFT JOIN abs_doi a ON a.k = lower(c.m_doi)
WHERE c.status = 'FOUND'
"""
_stop = "[" + ", ".join(q(w) for w in P.STOPWORDS) + "]"
content_words = lambda e: f"list_filter(list_distinct(list_transform(list_filter(regexp_extract_all({e}, '[A-Za-z][A-Za-z0-9\\-]+'), lambda w: length(w) > 2), lambda w: lower(w))), lambda w: NOT list_contains({_stop}, w))"


def keyword(src: str, keep: str) -> str:
    """Keyword verdicts of rows with claim_text and abstract."""
    return f"""
SELECT {keep}, CASE WHEN n1 = 0 OR n2 = 0 THEN 'INSUFFICIENT' WHEN k / {dbl('n1')} >= {dbl(0.25)} THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS k_verdict,
  CASE WHEN n1 = 0 OR n2 = 0 THEN {dbl(0)} ELSE {rx(f"least({dbl(1)}, greatest(k / {dbl('n1 + n2 - k')}, k / {dbl('n1')} / 2))")} END AS k_confidence,
  CASE WHEN n1 = 0 OR n2 = 0 THEN 'Keyword fallback: empty tokenization.' ELSE 'Keyword fallback: ' || k || '/' || n1 || ' claim tokens found in abstract (recall=' || {fx(f"k / {dbl('n1')}", 2)} || ')' END AS k_rationale
FROM (SELECT {keep}, len(w1) AS n1, len(w2) AS n2, len(list_intersect(w1, w2)) AS k
  FROM (SELECT *, {content_words('claim_text')} AS w1, {content_words('abstract')} AS w2 FROM {src}))
"""


CTE["kw"] = keyword("pairs", "paper_id, claim_id, ref_pos, ref_id, claim_text, abstract")
CTE["entail"] = f"""
SELECT paper_id, claim_id, ref_pos, ref_id,
  CASE WHEN abstract IS NULL THEN 'INSUFFICIENT' WHEN r IN (0, 3, 4) THEN 'NOT_SUPPORTED' WHEN r = 1 THEN 'SUPPORTED' ELSE k_verdict END AS verdict,
  CASE WHEN abstract IS NULL THEN {dbl(0)} WHEN r = 0 THEN {dbl(0.9)} WHEN r = 1 THEN {dbl(0.5)} WHEN r = 3 THEN {dbl(1)} WHEN r = 4 THEN {dbl(0.65)} ELSE k_confidence END AS confidence,
  CASE WHEN abstract IS NULL THEN 'No abstract available for cited paper.' WHEN r = 0 THEN 'it says no' WHEN r IN (1, 3) THEN '' WHEN r = 4 THEN 'weak' ELSE k_rationale END AS rationale,
  CASE WHEN abstract IS NULL THEN 'no_abstract' WHEN r = 2 THEN 'keyword' ELSE 'llm' END AS method
FROM (SELECT *, length(claim_text) % 5 AS r FROM kw)
"""
CTE["merged"] = f"""
SELECT v.paper_id, v.claim_id, v.verified AND r.c IS NULL AS verified,
  CASE WHEN r.c IS NOT NULL THEN least(v.confidence, r.c) ELSE v.confidence END AS confidence,
  CASE WHEN r.c IS NOT NULL AND v.source = 'none' THEN 'llm' ELSE v.source END AS source, v.evidence,
  v.hallucination_flag OR r.c IS NOT NULL AS hallucination_flag,
  CASE WHEN r.c IS NOT NULL THEN concat_ws(' | ', v.notes, 'Entailment: ' || r.lines) ELSE v.notes END AS notes
FROM verdicts v LEFT JOIN (
  SELECT paper_id, claim_id, min(confidence) AS c,
    string_agg(ref_id || ' NOT_SUPPORTED (' || {fx('confidence', 2)} || ')', '; ' ORDER BY ref_pos) AS lines
  FROM entail WHERE verdict = 'NOT_SUPPORTED' AND confidence >= {dbl(0.7)} GROUP BY 1, 2
) r USING (paper_id, claim_id)
"""
CTE["ledger"] = f"""
SELECT p.paper_id, coalesce(l.n, 0) AS total_claims, coalesce(l.v, 0) AS verified_count, coalesce(l.h, 0) AS hallucination_count,
  coalesce({rx(f"CAST(l.c AS DOUBLE) / l.n")}, {dbl(0)}) AS mean_confidence
FROM papers p LEFT JOIN (
  SELECT paper_id, count(*) AS n, count(*) FILTER (WHERE verified) AS v, count(*) FILTER (WHERE hallucination_flag) AS h,
    sum(CAST(confidence AS DECIMAL(28, 18))) AS c FROM merged GROUP BY 1
) l USING (paper_id)
"""
# Full review with model and catalog: ledger only where the triage let the paper through.
CTE["led_cfg"] = """
SELECT c.paper_id, c.config_id, c.triage, CASE WHEN c.triage <> 'FAIL' THEN l.total_claims ELSE 0 END AS total_claims,
  CASE WHEN c.triage <> 'FAIL' THEN l.verified_count ELSE 0 END AS verified_count,
  CASE WHEN c.triage <> 'FAIL' THEN l.hallucination_count ELSE 0 END AS hallucination_count,
  CASE WHEN c.triage <> 'FAIL' THEN l.mean_confidence ELSE 0 END AS mean_confidence
FROM comp c JOIN ledger l USING (paper_id)
"""
CTE["sig_full"] = f"""
SELECT f.paper_id, c.config_id, c.triage, length(f.title) AS tn, f.word_count, d.* EXCLUDE (paper_id),
  CASE WHEN c.total_claims > 0 THEN c.verified_count / {dbl('c.total_claims')} ELSE {dbl(0)} END AS vf, c.hallucination_count AS hc
FROM facts f JOIN dep d USING (paper_id) JOIN led_cfg c USING (paper_id)
"""
NOTE = " (LLM output unparseable; fell back to heuristics.)"
# Model replies by title length % 4: 0 soundness 9 and clarity 2.5, 1 all of presentation and significance, else unusable.
CTE["dims_full"] = f"""
SELECT paper_id, config_id, dim_pos, name, weight, max_score, {rx("least(greatest(coalesce(m, h_score), 0), max_score)")} AS score,
  CASE WHEN m IS NOT NULL THEN why WHEN triage <> 'FAIL' THEN h_why || {q(NOTE)} ELSE h_why END AS rationale
FROM (
  SELECT x.*, s.triage,
    CASE WHEN s.triage = 'FAIL' THEN NULL WHEN s.tn % 4 = 0 AND name = 'soundness' THEN {dbl(9)} WHEN s.tn % 4 = 0 AND name = 'clarity' THEN {dbl(2.5)}
      WHEN s.tn % 4 = 1 AND name = 'presentation' THEN {dbl(3)} WHEN s.tn % 4 = 1 AND name = 'significance' THEN {dbl(1.25)} END AS m,
    CASE name WHEN 'soundness' THEN 'solid' WHEN 'clarity' THEN '' WHEN 'presentation' THEN 'fine' ELSE 'meh' END AS why
  FROM ({_dims('sig_full')}) x JOIN sig_full s USING (paper_id, config_id)
)
"""
CTE["rub_full"] = _rubric_total("dims_full", "sig_full")
CTE["sub_full"] = f"""
SELECT c.paper_id, c.config_id, {dbl('c.n_passed')} / c.n_checks AS compliance,
  CASE WHEN l.total_claims > 0 THEN greatest({dbl(0)}, {dbl(1)} - {dbl('l.hallucination_count')} / l.total_claims) END AS verification,
  (d.methodology + d.limitations + d.reproducibility + d.logical_soundness) / {dbl(4)} AS depth, r.bias_adjusted_total AS rubric
FROM comp c JOIN led_cfg l USING (paper_id, config_id) JOIN dep d USING (paper_id) JOIN rub_full r USING (paper_id, config_id)
"""
CTE["compo_full"] = (
    f"SELECT *, {recommendation('composite')} AS recommendation FROM "
    f"(SELECT *, {rx(composite(V, W))} AS composite FROM sub_full)"
)
# The same review without entailment: the ledger counts plain verdicts.
_PLAIN = ["ledger", "led_cfg", "sig_full", "dims_full", "rub_full", "sub_full", "compo_full"]
for _name in _PLAIN:
    CTE[f"{_name}_plain"] = re.sub(
        r"\b(FROM|JOIN) (" + "|".join(_PLAIN) + r")\b", r"\1 \2_plain", CTE[_name]
    ).replace("FROM merged", "FROM verdicts")
CTE["hashes"] = " UNION ALL ".join(
    f"SELECT '{n}' AS config_id, {i} AS config_ord, '{config_hash(complete_config(SHIPPED[n]))}' AS config_hash"
    for i, n in enumerate(VENUES)
)
CTE["scored"] = f"""
SELECT d.doc_id, d.lang, d.source, {words('d.text')} AS word_count, {dbl('l.quality')} AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def query(final: str) -> str:
    """``final`` with the expressions it needs, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in needed) + "\n" + final
