"""Queries over raw and normalised reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazlake.functions import numbers, text
from hazlake.operators import batch, quality
from hazlake.operators.normalize import classify_rows, normalize
from hazlake.plans.derived import derived, table
from hazlake.session import spread


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(derived(spark, sf_dir, "raw_reports"))


def normalize_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)


def row_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_rows(derived(spark, sf_dir, "raw_reports")).select("row_index", "row_status")


def dedup_highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.deduplicate(_reports(spark, sf_dir)).select(
        "incident_id", "cleaned_text", "severity_level", "severity_rank", "source_dataset", "row_index"
    )


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_split(_reports(spark, sf_dir))


def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived(spark, sf_dir, "raw_reports")
    return quality.ingestion_report(raw, normalize(raw))


def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dataset_statistics(_reports(spark, sf_dir).drop("row_index"))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_profile(derived(spark, sf_dir, "raw_reports"))


def raw_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived(spark, sf_dir, "raw_reports")
    parts = [
        quality.value_counts(raw, c).select(F.lit(c).alias("column"), "key", "n")
        for c in ("potential_accident_level", "critical_risk")
    ]
    return parts[0].unionByName(parts[1])


def batch_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.accept_rows(derived(spark, sf_dir, "raw_reports"))


def batch_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = batch.reject_rows(derived(spark, sf_dir, "raw_reports"))
    return rejected.select(
        "row_number", "status", "error",
        F.col("raw_data")["description"].alias("raw_description"),
        F.col("raw_data")["location"].alias("raw_location"),
        F.col("raw_data")["date"].alias("raw_date"),
    )


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text with acronyms spelled out, excerpt, word and character counts, model input."""
    reports = _reports(spark, sf_dir)
    cleaned = F.col("cleaned_text")
    return reports.select(
        "row_index",
        text.expand_acronyms(cleaned).alias("expanded"),
        text.excerpt(F.col("raw_text")).alias("excerpt"),
        text.word_count(F.col("raw_text")).alias("words"),
        F.length("raw_text").cast("bigint").alias("characters"),
        text.model_text(cleaned, F.col("industry_sector"), F.col("worker_type"), F.col("gender")).alias("model_text"),
    )


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items stacked with their origin, columns matched by name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    stacked = docs.withColumn("origin", F.lit("documents")).unionByName(
        items.withColumn("origin", F.lit("benchmark")), allowMissingColumns=True
    )
    return stacked.groupBy("origin").agg(
        F.count("*").alias("n"), F.count_if(F.col("lang").isNull()).alias("no_language"),
        F.sum(F.length("text")).alias("characters"),
    )


def shared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts found both in the given documents and in the conversations."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    talk = table(spark, sf_dir, "conversations").select(F.sha2("text", 256).alias("digest"))
    return docs.intersect(talk)


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned and filtered scan: two columns, one predicate, both pushed to the files."""
    return table(spark, sf_dir, "documents").filter("n_chars >= 1000").select("doc_id", "n_chars")


def score_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display percent and clamp of every component, and the softmax confidence of every whole vector."""
    base = spread(table(spark, sf_dir, "embeddings"), "vec_id")
    v = base.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scored = v.select("vec_id", "v", numbers.round_even(F.array_max(numbers.softmax(F.col("v"))), 3).alias("confidence"))
    e = scored.select("vec_id", "confidence", F.posexplode("v").alias("component", "x"))
    return e.select(
        "vec_id",
        "component",
        numbers.round_even(numbers.display_percent(F.col("x")), 3).alias("display"),
        numbers.clamp(F.col("x"), 0.0, 1.0).alias("clamped"),
        "confidence",
    )


QUERIES = {
    f.__name__: f
    for f in (
        normalize_reports, row_classification, dedup_highest_severity, duplicate_texts, ingestion_report,
        dataset_statistics, null_profile, raw_value_counts, batch_accept, batch_reject, text_features,
        source_union, shared_texts, parquet_scan, score_display,
    )
}
