"""Queries over retrieval, evaluation, splits and severity models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazlake.functions.lookups import LEVELS
from hazlake.functions.numbers import round_even
from hazlake.functions.ids import content_id
from hazlake.functions.text import clean, model_text
from hazlake.operators import governance as gov, metrics, severity, splits
from hazlake.operators.batch import accept_rows
from hazlake.operators.normalize import normalize
from hazlake.operators.quality import deduplicate
from hazlake.operators.similar import build_index, find_similar, incident_records
from hazlake.plans.analysis import analyze_reports
from hazlake.plans.derived import derived, table
from hazlake.session import cut, kept, spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return docs.withColumn("cleaned_text", clean(F.col("text")))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), clean(F.col("text")).alias("report_text"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(_documents(spark, sf_dir).select("doc_id", "cleaned_text"))
    rows = index.vectors.select(F.col("key").alias("doc_id"), F.inline(F.arrays_zip("idx", "val")).alias("i", "w"))
    # the names are the vocabulary, bounded by its limit
    named = rows.join(F.broadcast(index.vocabulary.select("i", "term")), "i")
    return named.select("doc_id", "term", round_even(F.col("w"), 6).alias("weight"))


def similar_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three most similar documents for every benchmark text."""
    docs = _documents(spark, sf_dir)
    matches = find_similar(_benchmark(spark, sf_dir), docs)
    found = incident_records(matches, docs.select("doc_id", "lang", "source"))
    return found.select(
        "query_id", F.col("rank").cast("bigint"), "doc_id", "source_id", "similarity_score", "similarity_percentage",
        "lang", "source", "retrieval_method",
    )


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(derived(spark, sf_dir, "eval_pairs"))


def confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_wide(metrics.confusion_matrix(derived(spark, sf_dir, "eval_pairs")))


def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class_metrics(metrics.confusion_matrix(derived(spark, sf_dir, "eval_pairs")))


def per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = metrics.confusion_matrix(derived(spark, sf_dir, "eval_pairs"))
    return metrics.per_class_metrics(matrix, rounded_inputs=True)


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.overall_metrics(metrics.confusion_matrix(derived(spark, sf_dir, "eval_pairs")))
    return out.select("samples", *[round_even(F.col(c), 6).alias(c) for c in out.columns if c != "samples"])


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unique reports, written once with what splits and models read of them: splits and folds read them several times."""
    reports = normalize(derived(spark, sf_dir, "raw_reports"))
    return kept(deduplicate(reports.select(
        "row_index", "cleaned_text", "severity_level", "severity_rank", "source_dataset", "industry_sector", "worker_type", "gender")))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(_unique(spark, sf_dir)).select("row_index", "severity_level", "split")


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(_unique(spark, sf_dir)).select("row_index", "severity_level", "fold")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaked = splits.split_leakage(splits.stratified_split(_unique(spark, sf_dir)))
    return leaked.agg(F.count("*").alias("leaked_texts"))


def _split_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports split row by row, as one must not: copies of a text fall on several sides."""
    place = F.concat(F.col("row_index").cast("string"), F.lit("|"), "cleaned_text").alias("place")
    reports = normalize(derived(spark, sf_dir, "raw_reports")).select("severity_level", "cleaned_text", place)
    return cut(splits.stratified_split(cut(reports), text="place").select("cleaned_text", "split"))


def row_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on more than one side where copies were not removed first, with the number of sides."""
    leaked = splits.split_leakage(_split_by_row(spark, sf_dir))
    return leaked.select(F.lower(F.hex("text")).alias("digest"), "splits")


def train_test_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts found on the training and on the test side of the split by rows."""
    rows = _split_by_row(spark, sf_dir).select(F.sha2("cleaned_text", 256).alias("digest"), "split")
    return rows.filter("split = 'train'").select("digest").intersect(rows.filter("split = 'test'").select("digest"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_index, severity_level, split, model_text of the unique reports: an expression in the rows as ``_unique`` wrote them."""
    rows = severity.with_model_text(splits.stratified_split(_unique(spark, sf_dir)))
    return rows.select("row_index", "severity_level", "split", "model_text")


def severity_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and class probabilities of every report by Naive Bayes, fitted on all rows outside the test split."""
    rows = _split(spark, sf_dir)
    judged = severity.bayes_predictions(rows.withColumn("part", F.when(F.col("split") == "test", 0).otherwise(1)), "row_index")
    out = rows.select("row_index", "split", "severity_level").join(judged, "row_index")
    return out.select(
        "row_index", "split", "severity_level", "raw_level", "raw_confidence",
        *[F.col("class_probabilities")[v].alias(f"p_{v.lower()}") for v in LEVELS],
    )


def bayes_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold cross-validation of Naive Bayes over all terms, on the rows outside the test split."""
    dev = _split(spark, sf_dir).filter("split <> 'test'")
    folded = splits.stratified_folds(dev, 5, text="model_text")
    return metrics.cross_validation_table(severity.bayes_folds(folded.select("row_index", "severity_level", "model_text", "fold"), "row_index"))


def severity_model_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold comparison of all candidates on the rows outside the test split, with the winner marked."""
    dev = _split(spark, sf_dir).filter("split <> 'test'")
    table = cut(metrics.cross_validation_table(severity.compare_models(dev)))
    best = metrics.best_model(table).scalar()
    return table.withColumn("is_best", F.col("model") == best)


def batch_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted report with the severity a fitted model gives it, calibrated, scored, and alerted on.

    The model is Naive Bayes over all terms of the reports outside the test split; its level goes through the rules'
    calibration into the score, and the tier decides on the alert.
    """
    rows = kept(accept_rows(derived(spark, sf_dir, "raw_reports")))
    text = model_text(F.col("report_text"), F.col("sector"), F.col("worker"), F.col("gender"))
    asked = rows.select(F.col("row_number").alias("key"), F.lit(None).cast("string").alias("severity_level"), F.lit(0).alias("part"), text.alias("model_text"))
    known = _split(spark, sf_dir).filter("split <> 'test'")
    known = known.select((-1 - F.col("row_index")).alias("key"), "severity_level", F.lit(1).alias("part"), "model_text")
    judged = severity.bayes_predictions(known.unionByName(asked), "key").filter("key > 0")
    judged = rows.join(judged.withColumnRenamed("key", "row_number"), "row_number")
    report_id = content_id("REP-", F.col("row_number"))
    done = analyze_reports(judged, raw_level=F.col("raw_level"), raw_confidence=F.col("raw_confidence"), report_id=report_id, align=False)
    done = kept(done.select("row_number", "report_id", "report_text", "raw_level", "raw_confidence", "predicted_level", "confidence", "score", "tier",
                           "severity_part", "labels", "corrective_actions", "recommended_actions", "location", "sector"))
    alerts = gov.generate_alerts(done, "report_text", "predicted_level", "location", "sector")
    alerts = alerts.select("report_id", "alert_id", F.col("recommended_immediate_action").alias("immediate_action"))
    return done.join(alerts, "report_id", "left").select(
        "row_number", "report_id", "raw_level", "raw_confidence", "predicted_level", "confidence", F.col("score").cast("bigint").alias("score"), "tier",
        F.col("severity_part").cast("bigint").alias("severity_part"), F.array_join("labels", ", ").alias("precursors"),
        F.size("corrective_actions").cast("bigint").alias("actions"), "alert_id", "immediate_action")


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_weights, similar_incidents, confusion_matrix, confusion_wide, per_class_metrics, per_class_report,
        overall_metrics, stratified_split, stratified_folds, split_leakage, row_split_leakage, train_test_overlap, severity_predictions, bayes_cross_validation, severity_model_cv, batch_analysis,
    )
}
