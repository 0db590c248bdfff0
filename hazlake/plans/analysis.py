"""The analysis of reports end to end, and the scored table the rollups read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.functions.ids import content_id
from hazlake.operators.detect import detect_precursors
from hazlake.operators.normalize import normalize
from hazlake.operators.score import explain_scores, score_reports
from hazlake.operators.screening import calibrate


def scored_history(raw: DataFrame, align: bool = False) -> DataFrame:
    """Normalised reports with precursors and the score used by the rollups (no severity part).

    Every step is a projection, so the result can be written once and read by all rollups.
    """
    return score_reports(detect_precursors(normalize(raw), "cleaned_text", align=align))


def analyze_reports(
    reports: DataFrame,
    text: str = "report_text",
    raw_level: Column | None = None,
    raw_confidence: Column | None = None,
    report_id: Column | None = None,
    align: bool = True,
) -> DataFrame:
    """Detection, severity calibration, scoring with severity, texts and corrective actions.

    ``raw_level`` and ``raw_confidence`` come from a severity model; without one the heuristic
    level stands in. Still one narrow stage. Without ``report_id`` a report's id is a digest of its source, its row and
    its text, as far as these columns exist, so that copies of a text in several rows are several reports.
    """
    found = score_reports(detect_precursors(reports, text, align=align))
    level = F.lit("II") if raw_level is None else raw_level
    sure = F.lit(0.85) if raw_confidence is None else raw_confidence
    judged = calibrate(found, level, sure)
    scored = score_reports(judged, severity="predicted_level")
    out = explain_scores(scored, severity="predicted_level", text=text)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_dataset", "row_index", "row_number") if c in reports.columns]
    identity = report_id if report_id is not None else content_id("REP-", *named, F.col(text))
    return out.withColumn("report_id", identity)
