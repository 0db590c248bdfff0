"""Continuous scoring, running state and live trend, built from the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hazlake.functions.ids import content_id
from hazlake.operators import governance as gov
from hazlake.operators.batch import accept_rows
from hazlake.operators.rollup import merge_trends, read_trend, trend_summary
from hazlake.plans.analysis import analyze_reports, scored_history
from hazlake.sources.stores import merge_buckets, read_buckets


def watch(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def alert_stream(reports: DataFrame, created: Column | None = None) -> DataFrame:
    """Alerts for a stream or table of uploaded reports; one narrow stage, so nothing is held back."""
    rows = accept_rows(reports)
    analysed = analyze_reports(rows, report_id=content_id("REP-", F.col("row_number")), align=False)
    return gov.generate_alerts(analysed, "report_text", "predicted_level", "location", "sector", created)


def write_appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold_stream(
    events: DataFrame, store: str, compact: Callable[[DataFrame], DataFrame], key: str, checkpoint: str, buckets: int = 64
) -> StreamingQuery:
    """Keep, for every id, the few events that decide its state, in buckets of ids that are rewritten where touched.

    A batch reads and rewrites the buckets of its own ids (``stores.merge_buckets``); a repeated batch replaces itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_buckets(batch, store, compact, key, number, number - 1 if number else None, buckets)

    return (
        events.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_state(
    spark: SparkSession, store: str, key: str, fold: Callable[[DataFrame], DataFrame], schema: StructType | str | None = None
) -> DataFrame:
    """Current state of every id from the newest version of every bucket."""
    return fold(read_buckets(spark, store, schema))


def fold_trend(reports: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """The monthly trend of a stream of raw reports, with all its columns.

    Report dates are free text and a month is no fixed-length window, so the state is a table of one row of counters per
    month ever seen. Each batch adds its own counters to those of the batch before and writes them under its own number;
    a repeated batch changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        summary = trend_summary(scored_history(batch))
        if number:
            earlier = batch.sparkSession.read.schema(summary.schema).parquet(f"{store}/batch={number - 1}")
            summary = merge_trends(summary.unionByName(earlier))
        summary.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return (
        reports.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_trend(spark: SparkSession, store: str) -> DataFrame:
    """The trend as of the newest batch."""
    summaries = spark.read.parquet(store)
    newest = summaries.agg(F.max("batch")).first()[0]
    return read_trend(summaries.filter(F.col("batch") == newest))
