"""Oracle SQL of the workflow queries."""

from __future__ import annotations

from hazlake.functions.taxonomy import EMERGENCY_ACTION, TAXONOMY
from hazlake.operators.governance import CONTEXT_FIELDS, DEFAULT_COMMENT, DEFAULT_REJECTION
from hazlake.plans.derived import VIEWS
from oracle.assessment import ACTIONS, ANALYSED
from oracle.parts import q, round_even, strip, values

EVENTS = f"ev AS ({VIEWS['governance_events']})"
OFFICER = f"coalesce(lower({strip('role')}) = 'officer', false)"
ALLOWED = f"{EVENTS}, ok AS (SELECT * FROM ev WHERE {OFFICER})"


def cid(prefix: str, *keys: str) -> str:
    joined = " || chr(31) || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"'{prefix}' || upper(left(sha256({joined}), 32))"


ANALYSED_AT = "(TIMESTAMP '2024-01-01 00:00:00' + row_number * INTERVAL 1 MINUTE)"
REPORT = f"({cid('REP-', 'row_number')})"
ALERTS = f"""{ANALYSED}, {ACTIONS},
reported AS (SELECT *, {REPORT} AS report_id FROM scored),
first_act AS (SELECT row_number, control FROM numbered WHERE position = 1),
alerts AS (SELECT {cid('ALT-', 'report_id', 'report_text', "'alert'")} AS alert_id, report_id, tier AS risk_level, CAST(score AS BIGINT) AS risk_score,
  replace(labels, ', ', '|') AS detected_precursors, predicted_level AS severity_level, control AS recommended_immediate_action, 'NEW' AS alert_status,
  coalesce(nullif(location, ''), 'Field Site') AS location, coalesce(nullif(sector, ''), 'Mining') AS department,
  {strip('left(report_text, 220)')} || CASE WHEN length(report_text) > 220 THEN '...' ELSE '' END AS observation_excerpt,
  {ANALYSED_AT} AS "timestamp", {ANALYSED_AT} AS updated_at, CAST(NULL AS VARCHAR) AS acknowledged_by, CAST(NULL AS VARCHAR) AS resolved_by, CAST(NULL AS VARCHAR) AS reviewer_notes
  FROM reported JOIN first_act USING (row_number) WHERE tier IN ('HIGH', 'CRITICAL'))"""

TAG = """CASE WHEN nullif(officer_name, '') IS NOT NULL AND nullif(officer_id, '') IS NOT NULL THEN officer_name || ' (' || officer_id || ')'
  ELSE coalesce(nullif(officer_name, ''), nullif(officer_id, ''), 'Safety Officer') END"""
# the state is folded step by step here, by looking back from the last event of each kind
STATE = f"""{ALLOWED},
mv AS (SELECT *, upper({strip('status')}) AS st, {TAG} AS tag, row_number() OVER (PARTITION BY alert_id ORDER BY ts, event_id) AS rn FROM ok
  WHERE upper({strip('status')}) IN ('NEW', 'ACKNOWLEDGED', 'RESOLVED')),
state AS (SELECT alert_id, arg_max(st, rn) AS alert_status, max(ts) AS updated_at, arg_max(notes, rn) FILTER (WHERE notes IS NOT NULL) AS reviewer_notes,
  arg_max(tag, rn) FILTER (WHERE st = 'RESOLVED') AS resolved_by,
  coalesce(arg_max(tag, rn) FILTER (WHERE st = 'ACKNOWLEDGED'), arg_min(tag, rn) FILTER (WHERE st = 'RESOLVED')) AS acknowledged_by FROM mv GROUP BY alert_id)"""
CREATED = f"{ALLOWED}, created AS (SELECT DISTINCT alert_id FROM ok WHERE upper(trim(status)) = 'NEW')"

RAW_STATUS = f"upper({strip('review_status')})"
COMMENT = strip("coalesce(comment, '')")
REVIEWS = f"""rv AS ({VIEWS['review_events']}),
st AS (SELECT *, CASE WHEN {RAW_STATUS} IN ('ACCEPT', 'ACCEPTED') THEN 'ACCEPTED' WHEN {RAW_STATUS} IN ('MODIFY', 'MODIFIED') THEN 'MODIFIED'
  WHEN {RAW_STATUS} IN ('REJECT', 'REJECTED') THEN 'REJECTED' END AS decision, {COMMENT} AS c FROM rv),
checked AS (SELECT *, CASE WHEN {strip("coalesce(officer_name, '')")} = '' THEN 'A review needs an officer name.'
   WHEN {strip("coalesce(officer_id, '')")} = '' THEN 'A review needs an officer id.'
   WHEN NOT has_prediction THEN 'There is no prediction to review.'
   WHEN decision IS NULL THEN 'Unknown decision ''' || review_status || ''': use ACCEPTED, MODIFIED or REJECTED.'
   WHEN decision IN ('MODIFIED', 'REJECTED') AND length(c) < 3 THEN 'A comment is needed where the officer has ' || decision || ' the prediction.' END AS error,
  CASE WHEN decision = 'ACCEPTED' AND c = '' THEN {q(DEFAULT_COMMENT)} ELSE c END AS officer_comment FROM st),
snap AS (SELECT *, coalesce(ai_level_nested, ai_level_flat, 'I') AS ai_severity, coalesce(nullif(ai_score_nested, 0), nullif(ai_score_flat, 0), 0) AS ai_risk_score
  FROM checked WHERE error IS NULL),
decided AS (SELECT *,
  CASE decision WHEN 'ACCEPTED' THEN ai_severity WHEN 'REJECTED' THEN coalesce(human_severity, 'I') ELSE coalesce(human_severity, ai_severity) END AS final_severity,
  CASE decision WHEN 'ACCEPTED' THEN ai_risk_score WHEN 'REJECTED' THEN coalesce(human_score, 0) ELSE coalesce(human_score, ai_risk_score) END AS final_risk_score,
  CASE decision WHEN 'ACCEPTED' THEN coalesce(ai_risk_level, 'LOW') WHEN 'REJECTED' THEN coalesce(human_level, 'LOW') ELSE coalesce(human_level, ai_risk_level, 'LOW') END AS final_risk_level,
  CASE WHEN decision = 'ACCEPTED' THEN ai_precursor WHEN human_level IS NOT NULL THEN ai_precursor || '|Reviewed' WHEN decision = 'REJECTED' THEN '' ELSE ai_precursor END AS final_precursors,
  CASE WHEN decision = 'ACCEPTED' THEN ai_action WHEN human_action IS NOT NULL THEN human_action WHEN decision = 'REJECTED' THEN {q(DEFAULT_REJECTION)} ELSE ai_action END AS final_actions
  FROM snap)"""

CONTEXT = values(
    [(e.code, e.label, e.immediate_control, e.verification_step, e.escalation_condition, e.follow_up_action) for e in TAXONOMY]
    + [tuple(EMERGENCY_ACTION[k] for k in (
        "precursor_id", "related_precursor", "immediate_control", "verification_step", "escalation_condition", "follow_up_action"))]
)
FRESH = """CAST(NULL AS TIMESTAMP) AS completed_at, CAST(NULL AS TIMESTAMP) AS verified_at, CAST(NULL AS VARCHAR) AS verified_by_officer,
  CAST(NULL AS VARCHAR) AS officer_id, CAST(NULL AS VARCHAR) AS tracking_notes"""
ACTS = f"""{ANALYSED}, {ACTIONS},
context(precursor_id, related_precursor, immediate_control, verification_step, escalation_condition, follow_up_action) AS (SELECT * FROM {CONTEXT}),
tracked AS (SELECT {REPORT} AS report_id, position - 1 AS position, action AS action_description, priority, role AS responsible_role, reason,
  {ANALYSED_AT} AS created_at, {ANALYSED_AT} AS updated_at, strftime({ANALYSED_AT} + INTERVAL 14 DAY, '%Y-%m-%d') AS due_date, context.* FROM numbered JOIN context USING (precursor_id)),
ided AS (SELECT *, {cid('ACT-', 'report_id', 'position', 'action_description')} AS action_id FROM tracked)"""

ACTION_STATE = f"""{ALLOWED},
mv AS (SELECT *, upper({strip('action_status')}) AS st, row_number() OVER (PARTITION BY alert_id ORDER BY ts, event_id) AS rn FROM ok
  WHERE upper({strip('action_status')}) IN ('OPEN', 'IN_PROGRESS', 'COMPLETED', 'VERIFIED')),
op AS (SELECT *, coalesce(max(rn) FILTER (WHERE st = 'OPEN') OVER (PARTITION BY alert_id), 0) AS last_open FROM mv),
state AS (SELECT alert_id AS action_id, arg_max(st, rn) AS status, max(ts) AS updated_at,
  min(ts) FILTER (WHERE st IN ('COMPLETED', 'VERIFIED') AND rn > last_open) AS completed_at,
  max(ts) FILTER (WHERE st = 'VERIFIED' AND rn > last_open) AS verified_at,
  arg_max(notes, rn) FILTER (WHERE notes <> '') AS tracking_notes,
  arg_max(officer_name, rn) FILTER (WHERE officer_name <> '') AS verified_by_officer,
  arg_max(officer_id, rn) FILTER (WHERE officer_id <> '') AS officer_id FROM op GROUP BY alert_id),
full_state AS (SELECT *, CASE status WHEN 'COMPLETED' THEN 'PENDING_VERIFICATION' WHEN 'VERIFIED' THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verification_status FROM state)"""
STATUS_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}_count" for s in ("OPEN", "IN_PROGRESS", "COMPLETED", "VERIFIED")
)
PRIORITY_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE priority = '{p}') AS priority_{p.lower()}" for p in ("IMMEDIATE", "HIGH", "MEDIUM", "ROUTINE")
)
# the same folds over events that name their report, or one of its actions
TARGET = cid("REP-", "(CAST(substr(alert_id, 5) AS BIGINT) + 1)")


def retarget(ctes: str, target: str) -> str:
    return ctes.replace(EVENTS, f"ev AS (SELECT * EXCLUDE (alert_id), {target} AS alert_id FROM ({VIEWS['governance_events']}))")


ALERT_FIELDS = ("alert_status", "updated_at", "reviewer_notes", "resolved_by", "acknowledged_by")
ACTION_FIELDS = (
    "status", "verification_status", "updated_at", "completed_at", "verified_at", "tracking_notes", "verified_by_officer", "officer_id",
)
CURRENT_ALERTS = f"""{ALERTS}, {retarget(STATE, TARGET)},
now_alerts AS (SELECT a.* EXCLUDE ({', '.join(ALERT_FIELDS)}),
  {', '.join(f'CASE WHEN s.alert_id IS NULL THEN a.{c} ELSE s.{c} END AS {c}' for c in ALERT_FIELDS)}
  FROM alerts a LEFT JOIN state s ON s.alert_id = a.report_id)"""
action_target = f"{TARGET} || '#' || CAST(event_id % 2 AS VARCHAR)"
CURRENT_ACTIONS = f"""{ACTS}, fresh AS (SELECT *, 'OPEN' AS status, 'UNVERIFIED' AS verification_status, {FRESH} FROM ided), {retarget(ACTION_STATE, action_target)},
now_actions AS (SELECT a.* EXCLUDE (position, {', '.join(ACTION_FIELDS)}),
  {', '.join(f'CASE WHEN s.action_id IS NULL THEN a.{c} ELSE s.{c} END AS {c}' for c in ACTION_FIELDS)}
  FROM fresh a LEFT JOIN full_state s ON s.action_id = a.report_id || '#' || CAST(position AS VARCHAR))"""
controls = " OR ".join(
    f"precursor_id = '{e.code}'" for e in TAXONOMY
    if any("breathing" in v.lower() for v in (e.immediate_control, e.verification_step, e.label, e.responsible_role))
)

ORACLES = {
    "role_gate": f"WITH {EVENTS} SELECT event_id, {OFFICER} AS accepted, CASE WHEN NOT {OFFICER} THEN 'Only safety officers may do this.' END AS rejection FROM ev",
    "alert_generation": f"{ALERTS} SELECT * FROM alerts",
    "alert_search": f"""{ALERTS} SELECT alert_id, report_id, risk_score, location FROM alerts WHERE risk_level = 'CRITICAL' AND (
  contains(lower(alert_id), 'h2s') OR contains(lower(location), 'h2s') OR contains(lower(department), 'h2s') OR contains(lower(observation_excerpt), 'h2s')
  OR contains(lower(recommended_immediate_action), 'h2s') OR contains(lower(detected_precursors), 'h2s'))""",
    "alert_state": f"WITH {STATE} SELECT * FROM state",
    "alert_counters": f"""WITH {STATE} SELECT count(*) AS total_store_count, count(*) FILTER (WHERE alert_status = 'RESOLVED') AS matching,
  count(*) FILTER (WHERE alert_status = 'NEW') AS new_count, count(*) FILTER (WHERE alert_status = 'ACKNOWLEDGED') AS acknowledged_count,
  count(*) FILTER (WHERE alert_status = 'RESOLVED') AS resolved_count FROM state""",
    "latest_alerts": f"WITH {STATE} SELECT alert_id, alert_status, updated_at FROM state ORDER BY updated_at DESC, alert_id LIMIT 50",
    "unknown_alert_events": f"WITH {CREATED} SELECT event_id, alert_id FROM ev WHERE alert_id NOT IN (SELECT alert_id FROM created)",
    "known_alert_events": f"WITH {CREATED} SELECT alert_id, count(*) AS n FROM ev JOIN created USING (alert_id) GROUP BY alert_id",
    "alert_lookup": f"""WITH {STATE} SELECT w.alert_id, s.resolved_by, s.alert_id IS NOT NULL AS found
FROM (SELECT DISTINCT alert_id FROM ev) w LEFT JOIN (SELECT * FROM state WHERE alert_status = 'RESOLVED') s USING (alert_id)""",
    "review_validation": f"WITH {REVIEWS} SELECT event_id, decision, officer_comment, error FROM checked",
    "review_decisions": f"""WITH {REVIEWS} SELECT event_id, report_id, decision, ai_severity, CAST(ai_risk_score AS BIGINT) AS ai_risk_score, final_severity,
  CAST(final_risk_score AS BIGINT) AS final_risk_score, final_risk_level, final_precursors, final_actions,
  CASE WHEN decision <> 'ACCEPTED' THEN final_severity END AS officer_modified_severity FROM decided""",
    "latest_reviews": f"WITH {REVIEWS} SELECT event_id, report_id, ts, decision, final_severity FROM decided ORDER BY ts DESC, event_id LIMIT 50",
    "action_registration": f"""{ACTS} SELECT * REPLACE (CAST(position AS BIGINT) AS position), 'OPEN' AS status,
  'UNVERIFIED' AS verification_status, CAST(NULL AS VARCHAR) AS error, {FRESH} FROM ided""",
    "current_alerts": f"{CURRENT_ALERTS} SELECT * FROM now_alerts",
    "closed_alerts": f"""{CURRENT_ALERTS} SELECT * FROM now_alerts WHERE alert_status = 'RESOLVED' ORDER BY "timestamp" DESC, alert_id LIMIT 50""",
    "events_without_alert": f"""{ALERTS}, {EVENTS}, about AS (SELECT event_id, {TARGET} AS report_id, status FROM ev)
SELECT * FROM about WHERE NOT EXISTS (SELECT 1 FROM alerts WHERE alerts.report_id = about.report_id)""",
    "current_actions": f"{CURRENT_ACTIONS} SELECT * FROM now_actions",
    "current_action_statistics": f"""{CURRENT_ACTIONS}, s AS (SELECT count(*) AS total_actions, {STATUS_COUNTS}, {PRIORITY_COUNTS} FROM now_actions),
r AS (SELECT *, (completed_count + verified_count)::DOUBLE / total_actions::DOUBLE * 100 AS x FROM s) SELECT * EXCLUDE (x), {round_even('x', 1)} AS resolution_rate FROM r""",
    "action_search": f"{ACTS} SELECT action_id, report_id, responsible_role FROM ided WHERE priority = 'IMMEDIATE' AND ({controls or 'false'})",
    "tracked_actions": f"{ACTS} SELECT report_id, CAST(position AS BIGINT) AS position, precursor_id, action_id, 'OPEN' AS status FROM ided",
    "action_creation": f"""WITH {EVENTS}, rq AS (SELECT event_id, ts, CASE WHEN event_id % 31 = 0 THEN '  ' ELSE ' ' || alert_id END AS report_id, notes AS action_description,
  CASE event_id % 4 WHEN 0 THEN 'MEDIUM' ELSE 'HIGH' END AS priority, officer_name FROM ev),
judged AS (SELECT event_id, ts, trim(report_id) AS report_id, action_description, priority, coalesce(officer_name, 'Safety Officer') AS responsible_role,
  CASE WHEN trim(report_id) = '' THEN 'An action needs a report id.' WHEN action_description IS NULL THEN 'An action needs a description.' END AS error FROM rq)
SELECT * EXCLUDE (ts), ts AS created_at, ts AS updated_at, CASE WHEN event_id % 2 = 0 THEN '2024-12-31' END AS due_date,
  CASE WHEN error IS NULL THEN {cid('ACT-', 'report_id', 'action_description')} END AS action_id, 'OPEN' AS status, 'UNVERIFIED' AS verification_status, {FRESH},
  {', '.join(f'CAST(NULL AS VARCHAR) AS {f}' for f in CONTEXT_FIELDS)} FROM judged""",
    "action_state": f"WITH {ACTION_STATE} SELECT * FROM full_state",
    "action_statistics": f"""WITH {ACTION_STATE}, s AS (SELECT count(*) AS total_actions, {STATUS_COUNTS} FROM full_state),
r AS (SELECT *, (completed_count + verified_count)::DOUBLE / total_actions::DOUBLE * 100 AS x FROM s) SELECT * EXCLUDE (x), {round_even('x', 1)} AS resolution_rate FROM r""",
    "action_priorities": f"{ACTS} SELECT count(*) AS total_actions, count(*) AS open_count, 0::BIGINT AS in_progress_count, 0::BIGINT AS completed_count, 0::BIGINT AS verified_count, {PRIORITY_COUNTS}, 0.0::DOUBLE AS resolution_rate FROM ided",
    "latest_actions": f"WITH {ACTION_STATE} SELECT action_id, status, verification_status, updated_at FROM full_state ORDER BY updated_at DESC, action_id LIMIT 100",
}
