"""Streaming queries driven to completion over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hazlake.operators import governance as gov
from hazlake.plans.derived import ANALYSED_AT, project, table
from hazlake.session import shared_dir
from hazlake.streaming import live


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, source: str, view: str) -> DataFrame:
    """The files of a table as a stream, whether it is one file or a folder of them."""
    schema = table(spark, sf_dir, source).schema
    # a stream takes a single file only where its path is a pattern
    return project(live.watch(spark, f"{sf_dir}/{{{source}}}.parquet", schema, "*"), view)


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _run_folder(spark)
    alerts = live.alert_stream(_stream(spark, sf_dir, "documents", "raw_reports"), F.expr(ANALYSED_AT))
    live.write_appended(alerts, f"{folder}/alerts", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema(alerts.schema).parquet(f"{folder}/alerts")
    return out.withColumn("detected_precursors", F.array_join("detected_precursors", "|")).withColumn(
        "risk_score", F.col("risk_score").cast("bigint")
    )


def _run_in_waves(spark: SparkSession, sf_dir: str, folder: str, waves: int, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a stream over the accepted events, which arrive in waves of time; between waves it stops and starts again."""
    base = table(spark, sf_dir, "events")
    first, last = base.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        first = last = datetime(1970, 1, 1)
    cuts = [first + (last - first) * i / waves for i in range(1, waves)]
    wave = sum(((F.col("ts") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for i in range(waves):
        # an event without a time is in the first wave
        base.filter(F.coalesce(wave, F.lit(0)) == i).write.mode("append").parquet(f"{folder}/events")
        arriving = project(live.watch(spark, f"{folder}/events", base.schema), "governance_events")
        run(gov.role_gate(arriving).filter("accepted").drop("accepted", "rejection")).awaitTermination()


def stream_alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _run_folder(spark)
    _run_in_waves(spark, sf_dir, folder, 3, lambda events: live.fold_stream(
        events, f"{folder}/kept", gov.compact_alert_events, "alert_id", f"{folder}/checkpoint"))
    return live.read_state(spark, f"{folder}/kept", "alert_id", gov.alert_state)


def stream_action_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _run_folder(spark)

    def run(events: DataFrame) -> StreamingQuery:
        moves = events.select(
            "event_id", "ts", F.col("alert_id").alias("action_id"), F.col("action_status").alias("status"),
            "officer_name", "officer_id", "notes",
        )
        return live.fold_stream(moves, f"{folder}/kept", gov.compact_action_events, "action_id", f"{folder}/checkpoint")

    _run_in_waves(spark, sf_dir, folder, 3, run)
    return live.read_state(spark, f"{folder}/kept", "action_id", gov.action_state)


def stream_monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _run_folder(spark)
    reports = _stream(spark, sf_dir, "documents", "raw_reports")
    live.fold_trend(reports, f"{folder}/trend", f"{folder}/checkpoint").awaitTermination()
    return live.live_trend(spark, f"{folder}/trend")


QUERIES = {f.__name__: f for f in (stream_alerts, stream_alert_state, stream_action_state, stream_monthly_trend)}
