"""Queries over the scored history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazlake.operators import rollup
from hazlake.operators.normalize import normalize
from hazlake.plans.analysis import scored_history
from hazlake.plans.derived import derived
from hazlake.session import cut


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_history(derived(spark, sf_dir, "raw_reports"))


def _flat(tops: str) -> Column:
    return F.array_join(
        F.transform(tops, lambda t: F.concat(t["precursor"], F.lit("="), t["count"].cast("string"))), "; "
    )


def location_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rollup.location_rollup(history(spark, sf_dir))
    return rollup.largest_first(rolled.withColumn("top_precursors", _flat("top_precursors")), "location")


def department_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rollup.department_rollup(history(spark, sf_dir))
    return rollup.largest_first(rolled.withColumn("top_precursors", _flat("top_precursors")), "department")


def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.monthly_trend(history(spark, sf_dir)).orderBy("period")


def trend_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = rollup.with_high_share(cut(rollup.monthly_trend(history(spark, sf_dir))))
    return rollup.with_shares(trend).select(
        "period", "total_reports", "high_risk_count", "high_risk_percent", "bar_percent"
    )


def top_precursors_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rollup.location_rollup(history(spark, sf_dir))
    return rolled.select("location", F.posexplode("top_precursors").alias("pos", "t")).select(
        "location", (F.col("pos") + 1).cast("bigint").alias("rank"), "t.precursor", "t.count"
    )


def dashboard_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = cut(rollup.location_rollup(history(spark, sf_dir)).select("location", "total_reports"))
    return rollup.with_shares(rolled).select("location", "total_reports", "corpus_percent", "bar_percent")


def global_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived(spark, sf_dir, "raw_reports")
    return rollup.global_distributions(scored_history(raw), normalize(raw)).select("dimension", "key", "n")


def distribution_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical, severity, sector and precursor shares as a dashboard shows them."""
    shares = rollup.with_display_ratios(cut(global_distributions(spark, sf_dir)))
    return shares.filter("dimension <> 'reports'")


QUERIES = {
    f.__name__: f
    for f in (
        location_rollup, department_rollup, monthly_trend, trend_ratios, top_precursors_by_location,
        dashboard_ratios, distribution_ratios, global_distributions,
    )
}
