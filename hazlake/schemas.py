"""Schemas of the tables that cross a file or stream boundary."""

from __future__ import annotations

REPORT = (
    "incident_id string, raw_text string, cleaned_text string, severity_level string, severity_rank int, "
    "critical_risk string, raw_critical_risk string, actual_accident_level string, industry_sector string, "
    "worker_type string, gender string, location string, country string, date_logged string, "
    "source_dataset string, is_synthetic boolean, row_index bigint"
)
ALERT = (
    "alert_id string, report_id string, timestamp string, risk_level string, risk_score int, "
    "detected_precursors array<string>, severity_level string, recommended_immediate_action string, "
    "alert_status string, location string, department string, observation_excerpt string, "
    "acknowledged_by string, resolved_by string, reviewer_notes string, updated_at string"
)
ACTION_CONTEXT = (
    "struct<precursor_id:string,related_precursor:string,immediate_control:string,verification_step:string,"
    "escalation_condition:string,follow_up_action:string,reason:string>"
)
ACTION = (
    "action_id string, report_id string, action_description string, priority string, responsible_role string, "
    "status string, created_at string, due_date string, completed_at string, verification_status string, "
    f"verified_at string, verified_by_officer string, officer_id string, tracking_notes string, "
    f"ai_generated_context {ACTION_CONTEXT}, updated_at string"
)
_PREDICTION = (
    "struct<overall_risk:struct<score:int,level:string,summary:string>,"
    "severity_prediction:struct<potential_accident_level:string,model:string>,"
    "severity_level:string,risk_score:int,"
    "detected_precursors:array<struct<factor:string,label:string,contribution:int,evidence:array<string>>>,"
    "recommended_actions:array<string>>"
)
_HUMAN = "struct<severity:string,risk_score:int,risk_level:string,precursors:array<string>,actions:array<string>>"
_FINAL = (
    "struct<potential_accident_level:string,overall_risk_score:int,overall_risk_level:string,"
    "confirmed_precursors:array<string>,authorized_corrective_actions:array<string>,review_status:string,"
    "verified_by_officer:string,officer_id:string,verification_timestamp:string>"
)
REVIEW = (
    "review_id string, report_id string, timestamp string, ai_severity string, ai_risk_score int, "
    "detected_precursors array<string>, recommended_actions array<string>, officer_name string, officer_id string, "
    "officer_decision string, officer_modified_severity string, officer_comments string, "
    f"ai_prediction {_PREDICTION}, human_decision {_HUMAN}, final_decision {_FINAL}, "
    "review_status string, reviewer_comment string"
)
