"""Building blocks of the oracle SQL. Each returns text for DuckDB."""

from __future__ import annotations

from hazlake.functions import lookups as L
from hazlake.functions.stopwords import ENGLISH
from hazlake.functions.taxonomy import (
    ACTIVE_DAMAGE, COMPOUNDS, HEADER_PATTERN, MITIGATED, NEGATION_PREFIXES, NEGATION_SUFFIX, TAXONOMY,
)
from hazlake.plans.derived import VIEWS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        return q(v) if isinstance(v, str) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


def case_map(table: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {default} END"


def round_even(x: str, digits: int) -> str:
    """Half to even on the exact binary value: split the factor so that both products are exact."""
    k = float(10**digits)
    hi = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    whole = f"floor({x} * {k}::DOUBLE)"
    side = f"(({hi} * {k}::DOUBLE - ({whole} + 0.5::DOUBLE)) + ({x} - {hi}) * {k}::DOUBLE)"
    even = f"CASE WHEN {whole} % 2 = 0 THEN {whole} ELSE {whole} + 1 END"
    return f"(CASE WHEN {side} > 0 THEN {whole} + 1 WHEN {side} < 0 THEN {whole} ELSE {even} END / {k}::DOUBLE)"


# Decompositions of the accented letters of the given texts.
ACCENTS = {"\u0300": "ÀÈÌÒÙàèìòù", "\u0301": "ÁÉÍÓÚáéíóú", "\u0302": "ÂÊÎÔÛâêîôû", "\u0303": "ÃÑÕãñõ", "\u0308": "ÄËÏÖÜäëïöü", "\u0327": "Çç"}


def nfkd(x: str) -> str:
    import unicodedata

    for letters in ACCENTS.values():
        for ch in letters:
            x = f"replace({x}, {q(ch)}, {q(unicodedata.normalize('NFKD', ch))})"
    return x


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def clean(x: str) -> str:
    flat = f"regexp_replace({nfkd(x)}, '[\\r\\n\\t]+', ' ', 'g')"
    return strip(f"regexp_replace({flat}, '\\s{{2,}}', ' ', 'g')")


def title(x: str) -> str:
    parts = f"regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def unknown(x: str) -> str:
    t = strip(x)
    return f"CASE WHEN {x} IS NULL OR {t} IN ('nan', 'None', '') THEN 'Unknown' ELSE {t} END"


RAW = f"raw AS ({VIEWS['raw_reports']})"

NORMAL = f"""{RAW},
normal AS (
  SELECT source_dataset || ':' || CAST(row_index AS VARCHAR) AS incident_id,
    description AS raw_text,
    {clean('description')} AS cleaned_text,
    {case_map(L.SEVERITY, f"lower({strip('potential_accident_level')})", "'I'")} AS severity_level,
    {case_map(L.CRITICAL_RISK, f"lower(coalesce({strip('critical_risk')}, 'Others'))", f"coalesce({strip('critical_risk')}, 'Others')")} AS critical_risk,
    coalesce({strip('critical_risk')}, 'Others') AS raw_critical_risk,
    {case_map(L.SEVERITY, f"lower({strip('accident_level')})", strip('accident_level'))} AS actual_accident_level,
    CASE WHEN nullif({strip('industry_sector')}, '') IS NULL THEN 'General Industrial' ELSE
      {case_map(L.SECTOR, f"lower({strip('industry_sector')})", title(strip('industry_sector')))} END AS industry_sector,
    {case_map(L.WORKER, f"lower(coalesce(nullif({strip('worker_type')}, ''), 'Employee'))", "'Employee (Direct)'")} AS worker_type,
    CASE WHEN lower({strip('Gender')}) = 'male' THEN 'Male' WHEN lower({strip('Gender')}) = 'female' THEN 'Female' ELSE 'Unknown' END AS gender,
    {unknown('location')} AS location,
    'Unknown' AS country,
    {unknown('date')} AS date_logged,
    source_dataset, row_index
  FROM raw
  WHERE length({strip("coalesce(description, '')")}) >= 5
),
reports AS (SELECT *, {case_map(L.SEVERITY_RANKS, 'severity_level', 'NULL')} AS severity_rank FROM normal)"""


def shadow(x: str) -> str:
    s = f"regexp_replace(lower({x}), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '~', 'g')"
    return f"regexp_replace({s}, '[^\\x00-\\x7F]', '_', 'g')"


def sentence_ctes(source: str, key: str, text: str) -> str:
    """CTE ``sents(key, spos, s)``: sentences with their position."""
    return f"""
low AS MATERIALIZED (SELECT {key}, {shadow(text)} AS low FROM {source}),
split AS (SELECT {key}, unnest(regexp_split_to_array(low, '[.\\n;!?]+')) AS piece,
  generate_subscripts(regexp_split_to_array(low, '[.\\n;!?]+'), 1) AS spos FROM low),
sents AS MATERIALIZED (SELECT {key}, spos, {strip('piece')} AS s FROM split WHERE length({strip('piece')}) > 3)"""


def detection_ctes(source: str, key: str, text: str) -> str:
    """CTEs up to ``found(key, position, factor, label, weight, evidence, hits)``."""
    blocks = []
    for pos, entry in enumerate(TAXONOMY, 1):
        for r, pattern in enumerate(entry.patterns):
            blocks.append(
                f"SELECT {key}, spos, s, {pos} AS position, {r} AS rule, false AS kw, "
                f"unnest(regexp_extract_all(s, {q(pattern)})) AS txt, "
                f"generate_subscripts(regexp_extract_all(s, {q(pattern)}), 1) AS mpos FROM unsafe"
            )
        for k, word in enumerate(entry.keywords):
            blocks.append(
                f"SELECT {key}, spos, s, {pos}, {100 + k}, true, {q(word)}, 1 FROM unsafe "
                f"WHERE contains(s, {q(word)}) AND regexp_matches(s, {q(chr(92) + 'b' + word + chr(92) + 'b')})"
            )
    union = "\n  UNION ALL ".join(blocks)
    meta = values([(i, e.code, e.factor, e.label, e.weight) for i, e in enumerate(TAXONOMY, 1)])
    words = " OR ".join(
        f"contains(regexp_replace(low, {q(HEADER_PATTERN)}, '', 'g'), {q(k)})"
        for e in TAXONOMY if e.factor == "maintenance" for k in e.keywords
    )
    esc = "regexp_escape(txt)"
    return sentence_ctes(source, key, text) + f""",
unsafe AS MATERIALIZED (SELECT * FROM sents
  WHERE NOT (regexp_matches(s, {q(MITIGATED)}) AND NOT regexp_matches(s, {q(ACTIVE_DAMAGE)}))),
hits AS MATERIALIZED ({union}),
kept AS (SELECT * FROM hits WHERE NOT (
    (regexp_matches(s, {q(NEGATION_PREFIXES[0])}) AND regexp_matches(s, {q(NEGATION_PREFIXES[0])} || {esc}))
 OR (regexp_matches(s, {q(NEGATION_PREFIXES[1])}) AND regexp_matches(s, {q(NEGATION_PREFIXES[1])} || {esc}))
 OR (regexp_matches(s, {q(NEGATION_SUFFIX)}) AND regexp_matches(s, {esc} || {q(NEGATION_SUFFIX)})))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {key}, position ORDER BY spos, rule, mpos) AS ord FROM kept),
firsts AS (SELECT {key}, position, txt, min(ord) AS ord, arg_min(kw, ord) AS first_kw, sum(CASE WHEN kw THEN 0 ELSE 2 END) AS pat
  FROM ordered GROUP BY {key}, position, txt),
folded AS (SELECT {key}, position, string_agg(txt, '|' ORDER BY ord) AS evidence,
    CAST(sum(pat) + sum(CASE WHEN first_kw THEN 1 ELSE 0 END) AS BIGINT) AS hits,
    array_to_string(list_transform(list_slice(list(txt ORDER BY ord), 1, 3), lambda e: '''' || e || ''''), ', ') AS quoted
  FROM firsts GROUP BY {key}, position),
header_only AS (SELECT {key} FROM low WHERE regexp_matches(low, {q(HEADER_PATTERN)}) AND NOT ({words})),
taxonomy(position, code, factor, label, weight) AS (SELECT * FROM {meta}),
found AS MATERIALIZED (SELECT f.{key}, f.position, t.code, t.factor, t.label, t.weight, f.evidence, f.hits, f.quoted
  FROM folded f JOIN taxonomy t USING (position)
  WHERE NOT (t.factor = 'maintenance' AND f.{key} IN (SELECT {key} FROM header_only)))"""


def score_ctes(source: str, key: str, severity: str | None = None) -> str:
    """CTE ``scored``: all columns of the source with scores, from ``found``."""
    conditions = []
    for required, any_of, reason in COMPOUNDS:
        other = " OR ".join(f"list_contains(factors, {q(f)})" for f in any_of)
        conditions.append((f"(list_contains(factors, {q(required)}) AND ({other}))", reason))
    boost = " + ".join(f"CASE WHEN {c} THEN 10 ELSE 0 END" for c, _ in conditions)
    reasons = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for c, r in conditions) + ")"
    sev = "0" if severity is None else (
        f"CASE WHEN base_score > 0 THEN CASE {severity} WHEN 'II' THEN 5 WHEN 'III' THEN 10 WHEN 'IV' THEN 15 WHEN 'V' THEN 20 ELSE 0 END ELSE 0 END"
    )
    return f"""
agg AS (SELECT {key}, CAST(sum(weight) AS BIGINT) AS base_score, list(factor ORDER BY position) AS factors,
   string_agg(label, ', ' ORDER BY position) AS labels, count(*) AS n_precursors FROM found GROUP BY {key}),
based AS (SELECT r.*, coalesce(a.base_score, 0) AS base_score, coalesce(a.factors, []) AS factors,
   coalesce(a.labels, '') AS labels, coalesce(a.n_precursors, 0) AS n_precursors FROM {source} r LEFT JOIN agg a USING ({key})),
boosted AS (SELECT *, {boost} AS compound_boost, {reasons} AS reasons, {sev} AS severity_part FROM based),
totalled AS (SELECT *, least(100, greatest(0, base_score + compound_boost + severity_part)) AS score FROM boosted),
scored AS MATERIALIZED (SELECT *, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM totalled)"""


HISTORY = f"WITH {NORMAL},{detection_ctes('reports', 'row_index', 'cleaned_text')},{score_ctes('reports', 'row_index')}"

STOP_LIST = "[" + ", ".join(q(w) for w in ENGLISH) + "]"


def terms_list(x: str) -> str:
    """Words without stop words, then pairs of neighbours."""
    words = f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP_LIST}, w))"
    return words
