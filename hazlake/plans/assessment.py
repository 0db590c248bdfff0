"""Queries over detection, scoring and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazlake.operators.batch import accept_rows, batch_summary, reject_rows
from hazlake.operators.detect import detect_precursors, precursor_records as whole_records, precursor_rows, with_sentences
from hazlake.operators.normalize import normalize
from hazlake.operators.prototype import with_alignment
from hazlake.operators.screening import screen
from hazlake.plans.analysis import analyze_reports, scored_history
from hazlake.plans.derived import derived


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(derived(spark, sf_dir, "raw_reports"))


def _analysed(spark: SparkSession, sf_dir: str, align: bool = False) -> DataFrame:
    rows = accept_rows(derived(spark, sf_dir, "raw_reports"))
    return analyze_reports(rows, align=align)


def report_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = with_sentences(_reports(spark, sf_dir).select("row_index", "cleaned_text"))
    return split.select("row_index", F.posexplode("sentences").alias("position", "sentence")).select(
        "row_index", F.col("position").cast("bigint"), "sentence"
    )


def precursor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_precursors(_reports(spark, sf_dir).select("row_index", "cleaned_text"), align=False)
    return precursor_rows(found, "row_index").select(
        "row_index", "precursor_id", "factor", "label", F.col("contribution").cast("bigint"),
        F.array_join("evidence", "|").alias("evidence"), F.col("hits").cast("bigint"),
    )


def prototype_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = with_alignment(_reports(spark, sf_dir).select("row_index", "cleaned_text"))
    return aligned.select("row_index", F.posexplode("alignment").alias("pos", "alignment")).select(
        "row_index", (F.col("pos") + 1).cast("bigint").alias("position"), "alignment"
    )


def precursor_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_precursors(_reports(spark, sf_dir).select("row_index", "cleaned_text"))
    return precursor_rows(found, "row_index").select(
        "row_index", "factor", F.col("hits").cast("bigint"), "semantic_alignment", "confidence"
    )


def precursor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detected precursor with all fields of its record."""
    found = whole_records(detect_precursors(_reports(spark, sf_dir).select("row_index", "cleaned_text")), "row_index")
    lists = {c: F.array_join(c, "|") for c in ("evidence", "related_hazards", "recommended_controls")}
    return found.withColumns({**lists, "contribution": F.col("contribution").cast("bigint")})


def blank_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analysis says of reports without any text."""
    raw = derived(spark, sf_dir, "raw_reports").select("row_index", F.col("description").alias("report_text"))
    blank = raw.filter(F.trim(F.coalesce("report_text", F.lit(""))) == "")
    return analyze_reports(blank, align=False).select(
        "row_index", F.col("score").cast("bigint").alias("score"), "tier", "predicted_level", "formula", "summary",
        F.array_join("recommended_actions", "|").alias("recommended_actions"), F.size("precursors").cast("bigint").alias("precursors"),
        F.size("components").cast("bigint").alias("components"), F.size("corrective_actions").cast("bigint").alias("corrective_actions"),
    )


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_history(derived(spark, sf_dir, "raw_reports")).select(
        "row_index",
        F.col("base_score").cast("bigint"),
        F.col("compound_boost").cast("bigint"),
        F.array_join("compound_reasons", ", ").alias("reasons"),
        F.col("score").cast("bigint"),
        "tier",
    )


def risk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select(
        "row_number", F.col("score").cast("bigint"), "tier", "formula", "summary", "explanation"
    )


def risk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _analysed(spark, sf_dir).select("row_number", F.posexplode("components").alias("pos", "c"))
    return parts.select(
        "row_number", (F.col("pos") + 1).cast("bigint").alias("position"), "c.factor", "c.label",
        F.col("c.contribution").cast("bigint").alias("contribution"), "c.category",
        F.array_join("c.evidence", "|").alias("evidence"),
    )


def corrective_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _analysed(spark, sf_dir).select("row_number", F.posexplode("corrective_actions").alias("pos", "a"))
    return acts.select(
        "row_number", (F.col("pos") + 1).cast("bigint").alias("position"), "a.precursor_id", "a.priority",
        "a.reason", "a.action", "a.responsible_safety_role",
    )


def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select(
        "row_number", F.size("recommended_actions").cast("bigint").alias("n"),
        F.element_at("recommended_actions", 1).alias("first_action"),
    )


def severity_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of a stand-in model output that varies by row."""
    rows = accept_rows(derived(spark, sf_dir, "raw_reports"))
    n = F.col("row_number")
    level = F.element_at(F.array(*[F.lit(v) for v in ("I", "II", "III", "IV", "V")]), (n % 5 + 1).cast("int"))
    judged = analyze_reports(rows, raw_level=level, raw_confidence=0.5 + (n % 50) / 100, align=False)
    return judged.select(
        "row_number", "predicted_level", "confidence", "severity_label", "calibration_note",
        F.col("severity_part").cast("bigint"), F.col("score").cast("bigint"), "tier",
    )


def batch_summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived(spark, sf_dir, "raw_reports")
    return batch_summary(analyze_reports(accept_rows(raw), align=False), reject_rows(raw))


def fallback_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived(spark, sf_dir, "raw_reports").select("row_index", F.col("description").alias("report_text"))
    return screen(raw).select(
        "row_index", F.array_join("screen_labels", ", ").alias("labels"),
        F.col("screen_score").cast("bigint").alias("score"), F.col("screen_tier").alias("tier"),
        F.col("screen_level").alias("level"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        report_sentences, precursor_hits, prototype_alignment, precursor_confidence, risk_scores, risk_text,
        risk_components, corrective_actions, recommended_actions, severity_calibration, batch_summary_report,
        fallback_screening, precursor_records, blank_reports,
    )
}
