"""Oracle SQL of detection, scoring and severity."""

from __future__ import annotations

from hazlake.functions.lookups import LEVELS, SEVERITY_LABELS
from hazlake.functions.taxonomy import EMERGENCY_ACTION, TAXONOMY
from hazlake.operators.score import EMPTY_ADVICE, EMPTY_FORMULA, EMPTY_SUMMARY, ROUTINE_ADVICE
from hazlake.operators.screening import SCREEN_RULES
from oracle.intake import FIT, TEXT
from oracle.parts import (
    HISTORY, NORMAL, RAW, case_map, detection_ctes, q, round_even, score_ctes, sentence_ctes, strip, terms_list, values,
)

TOLD = values([(i, e.description, "|".join(e.hazards), e.consequence, "|".join(e.controls)) for i, e in enumerate(TAXONOMY, 1)])
PROTOTYPES = values([(i, e.prototype) for i, e in enumerate(TAXONOMY, 1)])


def alignment_ctes(source: str, key: str, text: str) -> str:
    """CTE ``aligned(key, position, alignment)`` for every document and prototype."""

    def terms(src: str, k: str, x: str, out: str) -> str:
        return f"""
{out}_w AS MATERIALIZED (SELECT {k}, {terms_list(x)} AS w FROM {src}),
{out}_t AS (SELECT {k}, unnest(w) AS term FROM {out}_w
  UNION ALL SELECT {k}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {out}_w),
{out} AS MATERIALIZED (SELECT {k}, term, 1 + ln(count(*)) AS tf FROM {out}_t GROUP BY {k}, term)"""

    return f"""
protos(position, body) AS (SELECT * FROM {PROTOTYPES}),{terms('protos', 'position', 'body', 'pt')},
pidf AS (SELECT term, ln({len(TAXONOMY) + 1}.0::DOUBLE / (1 + count(*))) + 1 AS idf FROM pt GROUP BY term),
pw AS (SELECT position, term, tf * idf AS w FROM pt JOIN pidf USING (term)),
pn AS (SELECT position, sqrt(sum(w * w)) AS norm FROM pw GROUP BY position),{terms(source, key, text, 'dt')},
dw AS (SELECT {key}, term, tf * idf AS w FROM dt JOIN pidf USING (term)),
dn AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM dw GROUP BY {key}),
dots AS (SELECT d.{key}, p.position, sum(d.w * p.w) AS dot FROM dw d JOIN pw p USING (term) GROUP BY ALL),
cosines AS (SELECT r.{key}, p.position, coalesce(dot / (dn.norm * pn.norm), 0.0) AS c
  FROM {source} r CROSS JOIN protos p LEFT JOIN dots USING ({key}, position) LEFT JOIN dn USING ({key}) LEFT JOIN pn USING (position)),
aligned AS (SELECT {key}, position, {round_even('c', 3)} AS alignment FROM cosines)"""


ACCEPTED = f"""accepted AS (SELECT row_index + 1 AS row_number, {TEXT} AS report_text, coalesce({strip('industry_sector')}, 'Mining') AS sector,
  coalesce({strip('location')}, '') AS location FROM raw WHERE {FIT})"""


def analysed(raw_level: str = "'II'", raw_confidence: str = "0.85::DOUBLE", more: str = "") -> str:
    """CTE ``scored`` for the accepted batch rows, with the calibrated level; ``more`` CTEs may follow ``accepted``."""
    base = f"""{RAW}, {ACCEPTED},{more + ',' if more else ''}{detection_ctes('accepted', 'row_number', 'report_text')},
bsum AS (SELECT row_number, sum(weight) AS b FROM found GROUP BY row_number),
judged AS (SELECT a.*, CASE WHEN b IS NULL THEN 'I' WHEN b < 25 THEN CASE WHEN {raw_level} IN ('I', 'II') THEN 'I' ELSE 'II' END ELSE {raw_level} END AS predicted_level,
  CASE WHEN b IS NULL THEN 0.95::DOUBLE WHEN b < 25 THEN greatest({raw_confidence}, 0.80::DOUBLE) ELSE {raw_confidence} END AS confidence,
  CASE WHEN b IS NULL THEN 'Rule: no precursor, so level I' WHEN b < 25 THEN 'Rule: low base score, so level II at most'
    ELSE 'Severity model' END AS calibration_note
  FROM accepted a LEFT JOIN bsum USING (row_number)),{score_ctes('judged', 'row_number', 'predicted_level')}"""
    return f"WITH {base}"


ANALYSED = analysed()
ROTATING = analysed(
    "['I','II','III','IV','V'][row_number % 5 + 1]", "(0.5::DOUBLE + (row_number % 50)::DOUBLE / 100::DOUBLE)"
)

wording = values(
    [
        (i, e.priority, f"{e.immediate_control} Then {e.verification_step}", e.responsible_role, e.immediate_control)
        for i, e in enumerate(TAXONOMY, 1)
    ]
)
ACTIONS = f"""wording(position, priority, action, role, control) AS (SELECT * FROM {wording}),
acts AS (
  SELECT row_number, 0 AS ord, 'SIF-COMPOUND' AS precursor_id, 'IMMEDIATE' AS priority,
    'Hazards act together: ' || reasons || '.' AS reason, {q(EMERGENCY_ACTION['action'])} AS action,
    {q(EMERGENCY_ACTION['responsible_safety_role'])} AS role, {q(EMERGENCY_ACTION['immediate_control'])} AS control
  FROM scored WHERE compound_boost > 0
  UNION ALL SELECT f.row_number, f.position, f.code, w.priority,
    'Called for by ' || f.label || ' evidence: [' || f.quoted || '].', w.action, w.role, w.control
  FROM found f JOIN wording w USING (position)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY row_number ORDER BY ord) AS position FROM acts)"""

screen_points = " + ".join(
    f"CASE WHEN {' OR '.join(f'contains(t, {q(w)})' for w in words)} THEN {points} ELSE 0 END"
    for _, _, points, words in SCREEN_RULES
)
screen_labels = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(t, {q(w)})' for w in words)} THEN {q(label)} END" for _, label, _, words in SCREEN_RULES
) + ")"

ORACLES = {
    "report_sentences": f"WITH {NORMAL},{sentence_ctes('reports', 'row_index', 'cleaned_text')} "
    "SELECT row_index, row_number() OVER (PARTITION BY row_index ORDER BY spos) - 1 AS position, s AS sentence FROM sents",
    "precursor_hits": f"{HISTORY} SELECT row_index, code AS precursor_id, factor, label, CAST(weight AS BIGINT) AS contribution, evidence, hits FROM found",
    "prototype_alignment": f"WITH {NORMAL},{alignment_ctes('reports', 'row_index', 'cleaned_text')} SELECT row_index, CAST(position AS BIGINT) AS position, alignment FROM aligned",
    "precursor_confidence": f"""WITH {NORMAL},{detection_ctes('reports', 'row_index', 'cleaned_text')},{alignment_ctes('reports', 'row_index', 'cleaned_text')}
SELECT row_index, factor, hits, alignment AS semantic_alignment,
  CAST(CASE WHEN hits >= 4 OR (hits >= 2 AND alignment > 0.15) THEN 0.95 WHEN hits >= 2 OR alignment > 0.12 THEN 0.88 ELSE 0.78 END AS DOUBLE) AS confidence
FROM found JOIN aligned USING (row_index, position)""",
    "precursor_records": f"""WITH {NORMAL},{detection_ctes('reports', 'row_index', 'cleaned_text')},{alignment_ctes('reports', 'row_index', 'cleaned_text')},
told(position, description, related_hazards, possible_consequence, recommended_controls) AS (SELECT * FROM {TOLD})
SELECT row_index, code AS precursor_id, factor, label, label AS precursor, label AS name, evidence, CAST(weight AS BIGINT) AS contribution,
  CAST(CASE WHEN hits >= 4 OR (hits >= 2 AND alignment > 0.15) THEN 0.95 WHEN hits >= 2 OR alignment > 0.12 THEN 0.88 ELSE 0.78 END AS DOUBLE) AS confidence,
  'hybrid_contextual_semantic' AS confidence_type, alignment AS semantic_alignment_score, description, related_hazards, possible_consequence, recommended_controls
FROM found JOIN aligned USING (row_index, position) JOIN told USING (position)""",
    "blank_reports": f"""WITH {RAW} SELECT row_index, CAST(0 AS BIGINT) AS score, 'LOW' AS tier, 'I' AS predicted_level, {q(EMPTY_FORMULA)} AS formula, {q(EMPTY_SUMMARY)} AS summary,
  {q(EMPTY_ADVICE)} AS recommended_actions, CAST(0 AS BIGINT) AS precursors, CAST(0 AS BIGINT) AS components, CAST(0 AS BIGINT) AS corrective_actions
FROM raw WHERE trim(coalesce(description, '')) = ''""",
    "risk_scores": f"{HISTORY} SELECT row_index, base_score, CAST(compound_boost AS BIGINT) AS compound_boost, reasons, CAST(score AS BIGINT) AS score, tier FROM scored",
    "risk_text": f"""{ANALYSED} SELECT row_number, CAST(score AS BIGINT) AS score, tier,
  concat_ws(' + ', 'Base Precursors (' || base_score || ')', CASE WHEN compound_boost > 0 THEN 'Compound Synergy (+' || compound_boost || ')' END,
    CASE WHEN severity_part > 0 THEN 'Severity Level ' || predicted_level || ' (+' || severity_part || ')' END) || ' = ' || score || '/100' AS formula,
  CASE WHEN compound_boost > 0 THEN 'Several hazards act together (' || labels || '), which raises the risk to ' || score || '/100 (' || tier || ' Tier).'
    WHEN n_precursors >= 2 THEN 'More than one precursor was found (' || labels || '); the score is ' || score || '/100 (' || tier || ' Tier).'
    WHEN n_precursors = 1 THEN 'One precursor was found: ' || labels || ', which adds ' || base_score || ' points (' || tier || ' Tier).'
    ELSE 'No precursor was found in this report.' END AS summary,
  CASE WHEN n_precursors > 0 THEN 'The rules found ' || labels || '. Together they make the risk ' || tier || '.'
    ELSE 'The rules found no known precursor in this report.' END AS explanation
FROM scored""",
    "risk_components": f"""{ANALYSED}, parts AS (
  SELECT row_number, position AS ord, factor, label, weight AS contribution, 'Precursor' AS category, evidence FROM found
  UNION ALL SELECT row_number, 100, 'compound_hazard_synergy', 'Hazards in combination', compound_boost, 'Combination', replace(reasons, ', ', '|') FROM scored WHERE compound_boost > 0
  UNION ALL SELECT row_number, 101, 'severity_model_alignment', 'Predicted severity ' || predicted_level || ' of the report', severity_part, 'Severity',
    'The severity model predicts level ' || predicted_level FROM scored WHERE severity_part > 0)
SELECT row_number, row_number() OVER (PARTITION BY row_number ORDER BY ord) AS position, factor, label, CAST(contribution AS BIGINT) AS contribution, category, evidence FROM parts""",
    "corrective_actions": f"{ANALYSED}, {ACTIONS} SELECT row_number, position, precursor_id, priority, reason, action, role AS responsible_safety_role FROM numbered",
    "recommended_actions": f"""{ANALYSED}, {ACTIONS} SELECT s.row_number, greatest(count(n.action), 1) AS n,
  coalesce(arg_min(n.action, n.position), {q(ROUTINE_ADVICE)}) AS first_action FROM scored s LEFT JOIN numbered n USING (row_number) GROUP BY s.row_number""",
    "severity_calibration": f"""{ROTATING} SELECT row_number, predicted_level, confidence, {case_map(SEVERITY_LABELS, 'predicted_level', "'Level ' || predicted_level")} AS severity_label,
  calibration_note, CAST(severity_part AS BIGINT) AS severity_part, CAST(score AS BIGINT) AS score, tier FROM scored""",
    "batch_summary_report": f"""{ANALYSED} SELECT (SELECT count(*) FROM raw) AS total_reports, count(*) AS successfully_analyzed,
  (SELECT count(*) FROM raw WHERE NOT {FIT}) AS failed_rows, count(*) FILTER (WHERE tier = 'CRITICAL') AS critical_risk_count,
  count(*) FILTER (WHERE tier = 'HIGH') AS high_risk_count, count(*) FILTER (WHERE tier = 'MEDIUM') AS medium_risk_count, count(*) FILTER (WHERE tier = 'LOW') AS low_risk_count,
  {", ".join(f"count(*) FILTER (WHERE predicted_level = '{lv}') AS severity_{lv.lower()}" for lv in LEVELS)} FROM scored""",
    "fallback_screening": f"""WITH {RAW}, l AS (SELECT row_index, lower(coalesce({strip('description')}, '')) AS t FROM raw),
p AS (SELECT row_index, {screen_labels} AS labels, CASE WHEN t = '' THEN 0 WHEN ({screen_points}) = 0 THEN 15 ELSE least(100, {screen_points}) END AS s FROM l)
SELECT row_index, labels, CAST(s AS BIGINT) AS score, CASE WHEN s >= 70 THEN 'CRITICAL' WHEN s >= 45 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  CASE WHEN s >= 70 THEN 'IV' WHEN s >= 45 THEN 'III' WHEN s >= 25 THEN 'II' ELSE 'I' END AS level FROM p""",
}
