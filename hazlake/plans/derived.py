"""Report, event and evaluation tables derived from the given tables.

The SQL text runs unchanged in Spark and in DuckDB. A derived report keeps the whole text of its
document, so work grows with the documents, and opens with a hazard sentence, because the given
prose has none. The sentence depends on the text alone, so copies of a document stay copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazlake.session import spread

RAW_REPORTS = """
SELECT doc_id AS row_index,
  CASE WHEN doc_id % 50 = 0 THEN NULL
       WHEN doc_id % 50 = 1 THEN 'Hi'
       WHEN doc_id % 50 = 2 THEN '     '
       ELSE concat(
         CASE CAST(n_chars % 16 AS INT)
           WHEN 0 THEN 'High pressure hose burst at 250 bar while the pump was running'
           WHEN 1 THEN 'Strong gas leak at the separator flange; detector read 30% LEL'
           WHEN 2 THEN 'Round finished and no gas leak found near the skid'
           WHEN 3 THEN 'Rigger stood under suspended load and a shackle dropped'
           WHEN 4 THEN 'Painter on scaffold without harness, ladder not tied'
           WHEN 5 THEN 'Frayed cable sparking beside the mcc panel! Gas smell nearby'
           WHEN 6 THEN 'Entry into tank without gas test. H2S alarm sounded at 20 ppm'
           WHEN 7 THEN 'Floor swept and tools put back on the board'
           WHEN 8 THEN 'Chain drive guard missing on the mud pump'
           WHEN 9 THEN 'Panel was isolated and de-energized via LOTO prior to maintenance'
           WHEN 10 THEN 'Acid splash on forearm during servicing of the dosing line'
           WHEN 11 THEN 'Department: Maintenance. Housekeeping walk, all clear'
           WHEN 12 THEN 'Crew wearing full PPE on the rig floor'
           WHEN 13 THEN 'Untethered wrench fell from derrick; worker had no helmet'
           WHEN 14 THEN 'High pressure line near a leaking valve and an open flame'
           ELSE 'Visitor signed in at the gate' END,
         '.  Unit ', CAST(n_chars % 40 AS STRING), '. ', coalesce(text, '')) END AS description,
  CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'I' WHEN 1 THEN 'level 2' WHEN 2 THEN ' III ' WHEN 3 THEN 'critical'
       WHEN 4 THEN 'Fatal' WHEN 5 THEN 'VI' WHEN 6 THEN 'level vi' WHEN 7 THEN '4.0' ELSE NULL END AS potential_accident_level,
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'Minor' WHEN 1 THEN 'ii' WHEN 2 THEN 'unrated' ELSE NULL END AS accident_level,
  CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'Pressed' WHEN 1 THEN 'power lock' WHEN 2 THEN 'Bees' WHEN 3 THEN 'Fall'
       WHEN 4 THEN 'Unlisted hazard' ELSE NULL END AS critical_risk,
  CASE lang WHEN 'en' THEN 'mining' WHEN 'de' THEN 'Oil & Gas' WHEN 'fr' THEN 'rig o''neil r&d' ELSE NULL END AS industry_sector,
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'Third Party' WHEN 1 THEN 'employee' ELSE 'visitor' END AS worker_type,
  CASE WHEN doc_id % 23 = 0 THEN 'nan' ELSE concat('Site_', CAST(doc_id % 12 AS STRING)) END AS location,
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'male' WHEN 1 THEN 'FEMALE' ELSE 'n/a' END AS Gender,
  CASE WHEN doc_id % 29 = 0 THEN NULL
       WHEN doc_id % 2 = 0 THEN concat('2024/', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '/05')
       ELSE concat('2023-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-17 00:00:00') END AS date,
  source AS source_dataset
FROM documents
"""

GOVERNANCE_EVENTS = """
SELECT event_id, ts, concat('ALT-', lpad(CAST(user_id AS STRING), 6, '0')) AS alert_id,
  CASE event_type WHEN 'view' THEN 'NEW' WHEN 'click' THEN ' acknowledged ' WHEN 'signup' THEN 'ACKNOWLEDGED'
       WHEN 'purchase' THEN 'RESOLVED' ELSE 'BOGUS' END AS status,
  CASE event_type WHEN 'view' THEN 'OPEN' WHEN 'click' THEN 'in_progress' WHEN 'signup' THEN 'COMPLETED'
       WHEN 'purchase' THEN 'VERIFIED' ELSE 'BOGUS' END AS action_status,
  CASE WHEN event_id % 5 = 0 THEN 'employee' WHEN event_id % 7 = 0 THEN NULL ELSE ' Officer ' END AS role,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('Name', CAST(event_id % 9 AS STRING)) END AS officer_name,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('HSE-', CAST(event_id % 9 AS STRING)) END AS officer_id,
  CASE WHEN event_id % 3 = 0 THEN concat('note ', CAST(event_id AS STRING)) ELSE NULL END AS notes
FROM events
"""

EVAL_PAIRS = """
SELECT doc_id,
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' WHEN 3 THEN 'IV' ELSE 'V' END AS y_true,
  CASE CAST((doc_id + CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END) % 4 AS INT) WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' ELSE 'IV' END AS y_pred
FROM documents
"""

# Review submissions: the prediction under review varies with the event, and so does what the
# officer sent along.
REVIEW_EVENTS = """
SELECT event_id, ts, concat('RPT-', lpad(CAST(user_id AS STRING), 6, '0')) AS report_id,
  CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN ' MODIFIED ' WHEN 'signup' THEN 'Reject'
       WHEN 'purchase' THEN 'ACCEPTED' ELSE 'BOGUS' END AS review_status,
  CASE WHEN event_id % 11 = 0 THEN '  ' ELSE concat('Name', CAST(event_id % 9 AS STRING)) END AS officer_name,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('HSE-', CAST(event_id % 9 AS STRING)) END AS officer_id,
  CASE WHEN event_id % 3 = 0 THEN concat('comment ', CAST(event_id AS STRING)) WHEN event_id % 3 = 1 THEN ' x ' ELSE NULL END AS comment,
  CASE WHEN event_id % 17 = 0 THEN false ELSE true END AS has_prediction,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'IV' WHEN 1 THEN 'II' ELSE NULL END AS ai_level_nested,
  CASE WHEN event_id % 5 = 0 THEN 'III' ELSE NULL END AS ai_level_flat,
  CAST(CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 6 = 1 THEN NULL ELSE event_id % 101 END AS INT) AS ai_score_nested,
  CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 89 END AS INT) AS ai_score_flat,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'HIGH' END AS ai_risk_level,
  concat('Hazard ', CAST(event_id % 7 AS STRING)) AS ai_precursor,
  concat('Action ', CAST(event_id % 19 AS STRING)) AS ai_action,
  CASE WHEN event_id % 2 = 0 THEN 'V' ELSE NULL END AS human_severity,
  CAST(CASE WHEN event_id % 10 < 3 THEN event_id % 100 ELSE NULL END AS INT) AS human_score,
  CASE WHEN event_id % 9 = 0 THEN 'CRITICAL' ELSE NULL END AS human_level,
  CASE WHEN event_id % 15 = 0 THEN 'Drill' ELSE NULL END AS human_action
FROM events
"""

VIEWS = {
    "raw_reports": RAW_REPORTS,
    "governance_events": GOVERNANCE_EVENTS,
    "eval_pairs": EVAL_PAIRS,
    "review_events": REVIEW_EVENTS,
}


#: Time of a report's analysis: uploads arrive one a minute.
ANALYSED_AT = """timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(row_number DIV 1440 AS INT), 0, CAST(row_number % 1440 AS INT))"""

KEYS = {"documents": "doc_id", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(base: DataFrame, name: str) -> DataFrame:
    """A derived view over any batch or stream of the base table."""
    source = "documents" if "FROM documents" in VIEWS[name] else "events"
    return base.sparkSession.sql(VIEWS[name].replace(f"FROM {source}", "FROM {src}"), src=base)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = "documents" if "FROM documents" in VIEWS[name] else "events"
    base = table(spark, sf_dir, source)
    if source == "documents":
        base = spread(base, KEYS[source])
    return project(base, name)
