"""Queries over alerts, reviews and corrective actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazlake.functions.ids import content_id
from hazlake.operators import governance as gov
from hazlake.operators.batch import accept_rows
from hazlake.plans.analysis import analyze_reports
from hazlake.plans.derived import ANALYSED_AT, derived
from hazlake.session import cut


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accept_rows(derived(spark, sf_dir, "raw_reports"))
    return analyze_reports(rows, report_id=content_id("REP-", F.col("row_number")), align=False)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysed = _analysed(spark, sf_dir)
    return gov.generate_alerts(analysed, "report_text", "predicted_level", "location", "sector", F.expr(ANALYSED_AT))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "governance_events")


def _allowed(events: DataFrame) -> DataFrame:
    return gov.role_gate(events).filter("accepted").drop("accepted", "rejection")


def _flat_alerts(df: DataFrame) -> DataFrame:
    return df.withColumn("detected_precursors", F.array_join("detected_precursors", "|")).withColumn(
        "risk_score", F.col("risk_score").cast("bigint")
    )


def role_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.role_gate(_events(spark, sf_dir)).select("event_id", "accepted", "rejection")


def alert_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_alerts(_alerts(spark, sf_dir))


def alert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    critical = gov.where_equal(_alerts(spark, sf_dir), alert_status=" new ", risk_level="critical")
    found = gov.search(critical, " H2S ", gov.ALERT_SEARCH, ["detected_precursors"])
    return _flat_alerts(found).select("alert_id", "report_id", "risk_score", "location")


def alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.alert_state(_allowed(_events(spark, sf_dir)))


def alert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.alert_counters(gov.alert_state(_allowed(_events(spark, sf_dir))), "resolved")


def latest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = gov.alert_state(_allowed(_events(spark, sf_dir)))
    return gov.newest_first(state.select("alert_id", "alert_status", "updated_at"), "updated_at", "alert_id", 50)


def unknown_alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of alerts whose first event is not an accepted one."""
    events = _events(spark, sf_dir)
    created = _allowed(events).filter("upper(trim(status)) = 'NEW'").select("alert_id").distinct()
    return gov.unknown_targets(events, created, "alert_id").select("event_id", "alert_id")


def known_alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    created = _allowed(events).filter("upper(trim(status)) = 'NEW'").select("alert_id").distinct()
    return gov.known_targets(events, created, "alert_id").groupBy("alert_id").agg(F.count("*").alias("n"))


def alert_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts looked up by the ids of the customers' events; many have none."""
    wanted = _events(spark, sf_dir).select("alert_id").distinct()
    resolved = gov.alert_state(_allowed(_events(spark, sf_dir))).filter("alert_status = 'RESOLVED'")
    return gov.lookup_ids(resolved.select("alert_id", "resolved_by"), wanted, "alert_id")


def _report_of() -> Column:
    """The report that an event is about: users report under their own row."""
    return content_id("REP-", F.substring("alert_id", 5, 20).cast("bigint") + 1)


def _current_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _allowed(_events(spark, sf_dir)).withColumn("alert_id", _report_of())
    # folded by report first: one row per id meets the alerts
    state = gov.alert_state(events).withColumnRenamed("alert_id", "report_id")
    return gov.current_records(_alerts(spark, sf_dir), state, "report_id")


def current_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts as whole records, as their status events have left them."""
    return _flat_alerts(_current_alerts(spark, sf_dir))


def closed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest alerts that are resolved by now, in a store where most are still new."""
    closed = gov.where_equal(_current_alerts(spark, sf_dir), alert_status=" resolved ")
    return _flat_alerts(gov.newest_first(closed, "timestamp", "alert_id", 50))


def events_without_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events about reports that never became an alert."""
    events = _events(spark, sf_dir).withColumn("report_id", _report_of())
    return gov.unknown_targets(events, _alerts(spark, sf_dir), "report_id").select("event_id", "report_id", "status")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.validate_reviews(derived(spark, sf_dir, "review_events"))


def review_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("event_id", "decision", "officer_comment", "error")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = gov.prediction_snapshot(
        _reviews(spark, sf_dir).filter("error IS NULL"),
        ["ai_level_nested", "ai_level_flat"],
        ["ai_score_nested", "ai_score_flat"],
    )
    shaped = valid.withColumns(
        {
            "ai_precursors": F.array("ai_precursor"),
            "ai_actions": F.array("ai_action"),
            "human_precursors": F.when(F.col("human_level").isNotNull(), F.array("ai_precursor", F.lit("Reviewed"))),
            "human_actions": F.when(F.col("human_action").isNotNull(), F.array("human_action")),
        }
    )
    return gov.decide_reviews(shaped)


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select(
        "event_id", "report_id", "decision", "ai_severity", F.col("ai_risk_score").cast("bigint"),
        "final_severity", F.col("final_risk_score").cast("bigint"), "final_risk_level",
        F.array_join("final_precursors", "|").alias("final_precursors"),
        F.array_join("final_actions", "|").alias("final_actions"), "officer_modified_severity",
    )


def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decided(spark, sf_dir).select("event_id", "report_id", "ts", "decision", "final_severity")
    return gov.newest_first(decided, "ts", "event_id", 50)


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.date_add(F.expr(ANALYSED_AT).cast("date"), 14)
    return gov.register_actions(_analysed(spark, sf_dir), created=F.expr(ANALYSED_AT), due=due)


def _flat_actions(df: DataFrame, *more: str) -> DataFrame:
    record = (
        "action_id", "report_id", "action_description", "priority", "responsible_role", "status", "created_at", "due_date",
        "verification_status", "updated_at", "completed_at", "verified_at", "verified_by_officer", "officer_id",
        "tracking_notes", *more,
    )
    return df.select(*record, *[f"ai_generated_context.{f}" for f in gov.CONTEXT_FIELDS])


def action_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = _actions(spark, sf_dir).withColumn("position", F.col("position").cast("bigint"))
    return _flat_actions(actions, "position", "error")


def _current_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions as their events have left them; an event is about the first or second action of its report."""
    target = F.concat(_report_of(), F.lit("#"), (F.col("event_id") % 2).cast("string"))
    events = _allowed(_events(spark, sf_dir)).select(
        "event_id", "ts", target.alias("target"), F.col("action_status").alias("status"), "officer_name", "officer_id", "notes",
    )
    actions = _actions(spark, sf_dir).withColumn("target", F.concat("report_id", F.lit("#"), F.col("position").cast("string")))
    return gov.current_records(actions, gov.action_state(events, "target"), "target")


def current_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_actions(_current_actions(spark, sf_dir))


def current_action_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and priority of the same records."""
    return gov.action_statistics(_current_actions(spark, sf_dir))


def action_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = gov.where_equal(_actions(spark, sf_dir), status="open", priority=" immediate ")
    found = gov.search(urgent, "breathing", gov.ACTION_SEARCH)
    return found.select("action_id", "report_id", "responsible_role")


def tracked_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read twice, so detection runs once and its result is written
    analysed = cut(_analysed(spark, sf_dir).select("report_id", "corrective_actions"))
    beside = gov.attach_tracking(analysed, gov.register_actions(analysed))
    return beside.select(
        "report_id", F.col("position").cast("bigint"), F.col("a.precursor_id").alias("precursor_id"), "action_id", "status"
    )


def action_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made requests: blank ids and descriptions are turned down, odd priorities become HIGH."""
    requests = _events(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_id") % 31 == 0, "  ").otherwise(F.concat(F.lit(" "), "alert_id")).alias("report_id"),
        F.col("notes").alias("action_description"),
        F.when(F.col("event_id") % 4 == 0, " medium ").when(F.col("event_id") % 4 == 1, "urgent").alias("priority"),
        F.col("officer_name").alias("responsible_role"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 2 == 0, "2024-12-31").alias("due_date"),
    )
    return _flat_actions(gov.create_actions(requests), "event_id", "error")


def action_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _allowed(_events(spark, sf_dir)).select(
        "event_id", "ts", F.col("alert_id").alias("action_id"), F.col("action_status").alias("status"),
        "officer_name", "officer_id", "notes",
    )
    return gov.action_state(events)


def action_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.action_statistics(action_state(spark, sf_dir), priority=None)


def action_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.action_statistics(_actions(spark, sf_dir))


def latest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = action_state(spark, sf_dir).select("action_id", "status", "verification_status", "updated_at")
    return gov.newest_first(state, "updated_at", "action_id", 100)


QUERIES = {
    f.__name__: f
    for f in (
        role_gate, alert_generation, alert_search, alert_state, alert_counters, latest_alerts, unknown_alert_events,
        known_alert_events, alert_lookup, review_validation, review_decisions, latest_reviews, action_registration,
        action_search, tracked_actions, action_creation, action_state, action_statistics, action_priorities, latest_actions,
        current_alerts, closed_alerts, events_without_alert, current_actions, current_action_statistics,
    )
}
