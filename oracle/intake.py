"""Oracle SQL of the intake queries."""

from __future__ import annotations

from hazlake.functions.lookups import ACRONYMS
from oracle.parts import NORMAL, RAW, q, round_even, strip

REPORT_COLUMNS = (
    "incident_id, raw_text, cleaned_text, severity_level, severity_rank, critical_risk, raw_critical_risk, "
    "actual_accident_level, industry_sector, worker_type, gender, location, country, date_logged, source_dataset"
)
STATUS = f"CASE WHEN length({strip(chr(99) + 'oalesce(description, ' + chr(39) * 2 + ')')}) >= 5 THEN 'valid' ELSE 'missing' END"

expanded = "lower(cleaned_text)"
for short, full in ACRONYMS:
    # no foreign letter touches an acronym in these texts, so the ASCII boundary will do
    expanded = f"regexp_replace({expanded}, {q(chr(92) + 'b' + short + chr(92) + 'b')}, {q(full)}, 'g')"

DISTINCT = "SELECT cleaned_text, max(severity_rank) AS r FROM reports GROUP BY cleaned_text"
severities = ", ".join(
    f"(SELECT count(*) FROM d WHERE r = {i}) AS severity_{lv}" for i, lv in enumerate(("i", "ii", "iii", "iv", "v"), 1)
)


def counts(statistic: str, column: str, limit: int | None = None) -> str:
    inner = f"SELECT '{statistic}' AS statistic, {column} AS key, count(*) AS n FROM reports WHERE {column} IS NOT NULL GROUP BY {column}"
    if limit:
        inner += f" ORDER BY n DESC, key LIMIT {limit}"
    return f"SELECT * FROM ({inner})"


missing = " UNION ALL ".join(
    f"SELECT 'missing', '{c}', count(*) - count({c}) FROM reports"
    for c in (REPORT_COLUMNS + ", is_synthetic").split(", ")
)
nulls = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows FROM raw"
    for c in (
        "row_index", "description", "potential_accident_level", "accident_level", "critical_risk", "industry_sector",
        "worker_type", "location", "Gender", "date", "source_dataset",
    )
)
TEXT = f"coalesce({strip('description')}, '')"
FIT = f"(length({TEXT}) >= 4 AND lower({TEXT}) <> 'nan')"

ORACLES = {
    "normalize_reports": f"WITH {NORMAL} SELECT {REPORT_COLUMNS}, false AS is_synthetic, row_index FROM reports",
    "row_classification": f"WITH {RAW} SELECT row_index, {STATUS} AS row_status FROM raw",
    "dedup_highest_severity": f"""WITH {NORMAL} SELECT incident_id, cleaned_text, severity_level, severity_rank, source_dataset, row_index
FROM reports QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY severity_rank DESC, source_dataset, row_index) = 1""",
    "duplicate_texts": f"WITH {NORMAL} SELECT cleaned_text, count(*) AS copies, max(severity_rank) AS severity_rank FROM reports GROUP BY 1",
    "ingestion_report": f"""WITH {NORMAL}, d AS ({DISTINCT}),
t AS (SELECT (SELECT count(*) FROM raw) AS total_rows, (SELECT count(*) FROM d) AS valid_rows, (SELECT count(*) FROM reports) AS parsed),
u AS (SELECT *, valid_rows::DOUBLE / total_rows::DOUBLE * 100 AS score FROM t)
SELECT total_rows, valid_rows, total_rows - parsed AS invalid_rows, parsed - valid_rows AS duplicates, total_rows - parsed AS missing_descriptions,
  {severities}, {round_even('score', 2)} AS quality_score_percentage FROM u""",
    "dataset_statistics": f"""WITH {NORMAL.replace('FROM normal)', ', false AS is_synthetic FROM normal)')}
SELECT 'records' AS statistic, 'total' AS key, count(*) AS n FROM reports
UNION ALL SELECT 'records', 'unique', count(DISTINCT cleaned_text) FROM reports
UNION ALL SELECT 'records', 'duplicates', count(*) - count(DISTINCT cleaned_text) FROM reports
UNION ALL {counts('severity', 'severity_level')} UNION ALL {counts('sector', 'industry_sector')} UNION ALL {counts('worker', 'worker_type')}
UNION ALL {counts('critical_risk', 'critical_risk', 10)} UNION ALL {counts('location', 'location', 10)}
UNION ALL {missing}""",
    "null_profile": f"WITH {RAW} {nulls}",
    "raw_value_counts": f"""WITH {RAW} SELECT 'potential_accident_level' AS "column", potential_accident_level AS key, count(*) AS n FROM raw
WHERE potential_accident_level IS NOT NULL GROUP BY 2
UNION ALL SELECT 'critical_risk', critical_risk, count(*) FROM raw WHERE critical_risk IS NOT NULL GROUP BY 2""",
    "batch_accept": f"""WITH {RAW} SELECT row_index + 1 AS row_number, {TEXT} AS report_text, coalesce({strip('industry_sector')}, 'Mining') AS sector,
  coalesce({strip('worker_type')}, 'Employee') AS worker, coalesce({strip('Gender')}, 'Male') AS gender, coalesce({strip('location')}, '') AS location,
  'Observation' AS report_type FROM raw WHERE {FIT}""",
    "batch_reject": f"""WITH {RAW} SELECT row_index + 1 AS row_number, 'FAILED' AS status, 'The description has fewer than four characters.' AS error,
  coalesce(description, '') AS raw_description, coalesce(location, '') AS raw_location, coalesce(date, '') AS raw_date FROM raw WHERE NOT {FIT}""",
    "text_features": f"""WITH {NORMAL} SELECT row_index, {expanded} AS expanded,
  {strip('left(raw_text, 220)')} || CASE WHEN length(raw_text) > 220 THEN '...' ELSE '' END AS excerpt,
  len(list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda w: w <> '')) AS words, length(raw_text) AS characters,
  'Description: ' || cleaned_text || ' Industry Sector: ' || industry_sector || ' Worker Type: ' || worker_type || ' Gender: ' || gender AS model_text
FROM reports""",
    "source_union": """SELECT 'documents' AS origin, count(*) AS n, count(*) - count(lang) AS no_language, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents
UNION ALL SELECT 'benchmark', count(*), count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark""",
    "shared_texts": "SELECT sha256(text) AS digest FROM documents INTERSECT SELECT sha256(text) FROM conversations",
    "parquet_scan": "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000",
    "score_display": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda a: CAST(a AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT *, list_max(v) AS top FROM e),
s AS (SELECT *, 1.0::DOUBLE / list_sum(list_transform(v, lambda a: exp(a - top))) AS c FROM m),
p AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS component, v[i] AS x, c FROM s, unnest(range(1, len(v) + 1)) AS r(i)),
d AS (SELECT *, CASE WHEN x > 0 AND x <= 1 THEN x * 100 ELSE x END AS d FROM p)
SELECT vec_id, component, {round_even('d', 3)} AS display, least(1.0, greatest(0.0, x)) AS clamped, {round_even('c', 3)} AS confidence FROM d""",
}
