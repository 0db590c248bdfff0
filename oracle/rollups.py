"""Oracle SQL of the reporting queries."""

from __future__ import annotations

from hazlake.functions import lookups as L
from hazlake.functions.taxonomy import TAXONOMY
from oracle.parts import HISTORY, round_even, values

KNOWN = "CASE WHEN upper(trim(severity_level)) IN ('I','II','III','IV','V') THEN upper(trim(severity_level)) ELSE 'I' END"


def group_ctes(key: str, default: str) -> str:
    sev = ", ".join(f"count(*) FILTER (WHERE {KNOWN} = '{lv}') AS severity_{lv.lower()}" for lv in L.LEVELS)
    return f"""{HISTORY},
keyed AS (SELECT *, coalesce(nullif(trim({key}), ''), '{default}') AS gkey FROM scored),
rolled AS (SELECT gkey, count(*) AS total_reports, count(*) FILTER (WHERE score >= 50) AS high_risk_reports,
  count(*) FILTER (WHERE score >= 75) AS critical_risk_reports, CAST(sum(score) AS DOUBLE) AS total_score, {sev}
  FROM keyed GROUP BY gkey),
rates AS (SELECT *, (high_risk_reports::DOUBLE / total_reports::DOUBLE) * 100 AS hp,
  (critical_risk_reports::DOUBLE / total_reports::DOUBLE) * 100 AS cp, total_score / total_reports::DOUBLE AS av FROM rolled),
pcounts AS (SELECT k.gkey, f.position, f.label, count(*) AS n, min(k.row_index) AS first_row
  FROM keyed k JOIN found f USING (row_index) GROUP BY k.gkey, f.position, f.label),
pranked AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY n DESC, first_row, position) AS rk FROM pcounts),
tops AS (SELECT gkey, string_agg(label || '=' || CAST(n AS VARCHAR), '; ' ORDER BY rk) AS top_precursors FROM pranked WHERE rk <= 4 GROUP BY gkey)"""


def group_rollup(key: str, default: str, extra: str = "") -> str:
    return group_ctes(key, default) + f"""
SELECT gkey AS {key}{extra}, total_reports, high_risk_reports, critical_risk_reports,
  {round_even('hp', 1)} AS high_risk_percentage, {round_even('cp', 1)} AS critical_risk_percentage,
  {round_even('av', 1)} AS average_risk_score, severity_i, severity_ii, severity_iii, severity_iv, severity_v,
  coalesce(top_precursors, '') AS top_precursors
FROM rates LEFT JOIN tops USING (gkey)"""


TREND = f"""{HISTORY},
dated AS (SELECT *, replace(nullif(regexp_extract(trim(date_logged), '\\d{{4}}[-/]\\d{{2}}'), ''), '/', '-') AS period FROM scored),
rolled AS (SELECT period, count(*) AS total_reports, count(*) FILTER (WHERE score >= 50) AS high_risk_count,
  count(*) FILTER (WHERE score >= 75) AS critical_risk_count, CAST(sum(score) AS DOUBLE) / count(*)::DOUBLE AS av
  FROM dated WHERE period IS NOT NULL GROUP BY period),
pcounts AS (SELECT d.period, f.position, f.label, count(*) AS n, min(d.row_index) AS first_row
  FROM dated d JOIN found f USING (row_index) WHERE d.period IS NOT NULL GROUP BY ALL),
tops AS (SELECT period, label FROM pcounts QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, first_row, position) = 1)"""

monthly_trend = TREND + f"""
SELECT period, total_reports, high_risk_count, critical_risk_count, {round_even('av', 1)} AS average_risk_score,
  coalesce(label, 'None') AS top_precursor FROM rolled LEFT JOIN tops USING (period)"""

trend_ratios = TREND + """
SELECT period, total_reports, high_risk_count,
  CAST(floor(high_risk_count::DOUBLE / total_reports::DOUBLE * 100 + 0.5) AS BIGINT) AS high_risk_percent,
  CAST(floor(total_reports::DOUBLE / (SELECT max(total_reports) FROM rolled)::DOUBLE * 100 + 0.5) AS BIGINT) AS bar_percent
FROM rolled"""

top_precursors = group_ctes("location", "Unknown") + """
SELECT gkey AS location, rk AS rank, label AS precursor, n AS count FROM pranked WHERE rk <= 4"""

dashboard_ratios = group_ctes("location", "Unknown") + """
SELECT gkey AS location, total_reports,
  CAST(floor(total_reports::DOUBLE / (SELECT sum(total_reports) FROM rolled)::DOUBLE * 100 + 0.5) AS BIGINT) AS corpus_percent,
  CAST(floor(total_reports::DOUBLE / (SELECT max(total_reports) FROM rolled)::DOUBLE * 100 + 0.5) AS BIGINT) AS bar_percent
FROM rolled"""

PRECURSORS = values([(e.factor, e.label) for e in TAXONOMY])

global_distributions = f"""{HISTORY}
SELECT 'reports' AS dimension, 'total' AS key, count(*) AS n FROM scored
UNION ALL SELECT 'reports', 'distinct_texts', count(DISTINCT cleaned_text) FROM scored
UNION ALL SELECT 'severity', l.k, count(s.row_index) FROM {values([(lv,) for lv in L.LEVELS])} l(k)
  LEFT JOIN scored s ON {KNOWN} = l.k GROUP BY l.k
UNION ALL SELECT 'tier', l.k, count(s.row_index) FROM {values([(t,) for t in L.TIERS])} l(k) LEFT JOIN scored s ON s.tier = l.k GROUP BY l.k
UNION ALL SELECT 'precursor', l.label, count(f.row_index) FROM {PRECURSORS} l(factor, label)
  LEFT JOIN found f ON f.factor = l.factor GROUP BY l.label
UNION ALL SELECT 'sector', industry_sector, count(*) FROM scored GROUP BY industry_sector"""

distribution_ratios = f"""WITH d AS ({global_distributions}),
b AS (SELECT max(n) FILTER (WHERE dimension = 'reports' AND key = 'total') AS total, max(n) FILTER (WHERE dimension = 'precursor') AS largest FROM d)
SELECT dimension, key, n, CAST(floor(n::DOUBLE / greatest(CASE WHEN dimension = 'precursor' THEN largest ELSE total END, 1)::DOUBLE * 100 + 0.5) AS BIGINT) AS percent
FROM d CROSS JOIN b WHERE dimension <> 'reports'"""

ORACLES = {
    "distribution_ratios": distribution_ratios,
    "location_rollup": group_rollup("location", "Unknown"),
    "department_rollup": group_rollup("industry_sector", "General Industrial", ", gkey AS department"),
    "monthly_trend": monthly_trend,
    "trend_ratios": trend_ratios,
    "top_precursors_by_location": top_precursors,
    "dashboard_ratios": dashboard_ratios,
    "global_distributions": global_distributions,
}
