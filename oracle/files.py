"""Oracle SQL of the file and evidence queries."""

from __future__ import annotations

from oracle.workflow import ORACLES as WORKFLOW

ORACLES = {
    "csv_round_trip": """SELECT doc_id, source, lang, CAST(n_chars AS BIGINT) AS n_chars, sha256(nullif(text, '')) AS text_sha256, true AS numbered FROM documents""",
    "event_log_state": WORKFLOW["alert_state"],
    "numbered_rows": """SELECT 'benchmark.parquet' AS source_dataset, count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS distinct_rows FROM benchmark
UNION ALL SELECT 'labels.parquet', count(*), 0, count(*) - 1, count(*) FROM labels""",
    "evidence_audit": """WITH d AS (SELECT *, doc_id % 6 AS k, printf('REP-%08d', doc_id) AS report_id, encode(text) AS body FROM documents),
b AS (SELECT *, CASE WHEN k = 4 THEN unhex('FFD8FFE0') || body WHEN k = 3 THEN body ELSE unhex('89504E470D0A1A0A') || body END AS bytes FROM d),
c AS (SELECT *, CASE WHEN k = 3 AND octet_length(bytes) > 0 AND (left(text, 2) = 'BM') THEN 'BMP' WHEN k = 3 OR k = 2 OR k = 0 THEN NULL WHEN k = 4 THEN 'JPEG' ELSE 'PNG' END AS fmt FROM b),
i AS (SELECT *, CASE WHEN fmt IS NOT NULL THEN 'IMG-' || upper(left(sha256(report_id || chr(31) || sha256(bytes)), 32)) END AS image_id,
  CASE fmt WHEN 'JPEG' THEN 'jpg' WHEN 'PNG' THEN 'png' WHEN 'BMP' THEN 'bmp' END AS ext FROM c)
SELECT report_id, fmt IS NOT NULL AS image_attached, image_id,
  CASE WHEN fmt IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'photo' || doc_id ELSE 'evidence.' || ext END END AS original_filename,
  report_id || '_' || image_id || '.' || ext AS stored_filename,
  CASE fmt WHEN 'JPEG' THEN 'image/jpeg' WHEN 'PNG' THEN 'image/png' WHEN 'BMP' THEN 'image/bmp' END AS content_type, fmt AS format,
  CASE WHEN fmt IS NOT NULL THEN octet_length(bytes) ELSE 0 END AS file_size_bytes, '/evidence/' || image_id AS url_reference,
  CASE WHEN k = 0 THEN 'No image came with the report.' ELSE 'The image is kept with the report.' END AS status_note,
  CASE WHEN k = 2 THEN 'The payload is not base64.' WHEN k = 3 AND fmt IS NULL THEN CASE WHEN octet_length(bytes) = 0 THEN 'The image is empty.' ELSE 'No known image format.' END END AS error_message FROM i""",
}
