"""Queries over files and evidence payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hazlake.operators import governance as gov
from hazlake.operators.evidence import evidence_records
from hazlake.plans.derived import derived, table
from hazlake.session import shared_dir
from hazlake.sources.audit import audit_files, audit_uploads, list_files
from hazlake.sources.readers import read_csv, read_parquet
from hazlake.sources.stores import append_batch, fold_log, read_buckets


def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_files(spark, sf_dir).select("file", "length", "is_valid", "reason")


def upload_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_uploads(list_files(spark, sf_dir))


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two files with file name and row number, every column as text."""
    rows = read_parquet(spark, [f"{sf_dir}/benchmark.parquet", f"{sf_dir}/labels.parquet"])
    return rows.groupBy("source_dataset").agg(
        F.count("*").alias("n"), F.min("row_index").alias("first"), F.max("row_index").alias("last"),
        F.count_distinct("row_index").alias("distinct_rows"),
    )


def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of the documents: data URLs, plain base64, text that is neither, and none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.col("doc_id") % 6
    head = F.when(kind == 4, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    image = F.base64(F.concat(head, F.encode("text", "UTF-8")))
    payload = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.concat(F.lit("data:image/png;base64,"), image))
        .when(kind == 2, F.concat(F.lit("!!"), image))
        .when(kind == 3, F.base64(F.encode("text", "UTF-8")))
        .otherwise(image)
    )
    asked = docs.select(
        F.format_string("REP-%08d", "doc_id").alias("report_id"),
        F.regexp_replace(payload, r"[\r\n]", "").alias("payload"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("photo"), F.col("doc_id").cast("string"))).alias("filename"),
    )
    return evidence_records(asked)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as CSV, whole texts with quotes and line breaks, and read back by the report reader."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    writer = docs.write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    back = read_csv(spark, [folder])
    rows = Window.partitionBy("source_dataset")
    # digests are taken before rows meet by file, so that whole texts are not moved
    narrow = back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"), "source_dataset", "row_index",
    )
    return narrow.select(
        "doc_id", "source", "lang", "n_chars", "text_sha256",
        # every file numbers its rows from zero without a gap
        (F.max("row_index").over(rows) + 1 == F.count("*").over(rows)).alias("numbered"),
    )


def event_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert state kept beside an event log: two appended batches, each folded into the buckets it touches."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events = gov.role_gate(derived(spark, sf_dir, "governance_events")).filter("accepted").drop("accepted", "rejection")
    for number in range(2):
        append_batch(events.filter(F.col("event_id") % 2 == number), f"{folder}/log", number)
        fold_log(spark, f"{folder}/log", f"{folder}/state", gov.compact_alert_events, "alert_id")
    return gov.alert_state(read_buckets(spark, f"{folder}/state", events.schema))


QUERIES = {f.__name__: f for f in (file_audit, upload_audit, numbered_rows, evidence_audit, csv_round_trip, event_log_state)}
