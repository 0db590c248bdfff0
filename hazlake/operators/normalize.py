"""Raw report tables of any column naming to the unified report schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hazlake.functions.lookups import (
    CANDIDATES,
    CRITICAL_RISK,
    PRESENT_COLUMNS,
    SECTOR,
    SEVERITY,
    SEVERITY_RANKS,
    WORKER,
)
from hazlake.functions.mapping import lookup
from hazlake.functions.text import at_least, clean, filled, strip, title_case

MIN_TEXT = 5


def as_text(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def first_value(df: DataFrame, names: Sequence[str], blank_is_missing: bool) -> Column:
    """Value of the first column that is there and filled. Names are matched case-sensitively."""
    present = [as_text(df, n) for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast("string")
    if blank_is_missing:
        present = [F.when(filled(c), c) for c in present]
    return F.coalesce(*present)


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """Column chosen by its presence alone; a null in it does not fall through to the next."""
    for name in names:
        if name in df.columns:
            return as_text(df, name)
    return F.lit(None).cast("string")


def known_or_unknown(c: Column) -> Column:
    text = strip(c)
    return F.when(text.isNull() | text.isin("nan", "None", ""), "Unknown").otherwise(text)


def severity_level(raw: Column) -> Column:
    return F.coalesce(lookup(SEVERITY, F.lower(strip(raw))), F.lit("I"))


def severity_rank(level: Column) -> Column:
    return lookup(SEVERITY_RANKS, level)


def actual_level(raw: Column) -> Column:
    return F.coalesce(lookup(SEVERITY, F.lower(strip(raw))), strip(raw))


def critical_risk(raw: Column) -> Column:
    return F.coalesce(lookup(CRITICAL_RISK, F.lower(raw)), raw)


def industry_sector(raw: Column) -> Column:
    return F.coalesce(lookup(SECTOR, F.lower(raw)), title_case(raw))


def worker_type(raw: Column) -> Column:
    return F.coalesce(lookup(WORKER, F.lower(raw)), F.lit("Employee (Direct)"))


def classify_rows(df: DataFrame, out: str = "row_status") -> DataFrame:
    """``valid``, ``missing`` (no usable description) or ``invalid`` (the one found is too short).

    The last description name is only used once a row has passed on one of the others.
    """
    names = CANDIDATES["description"]
    has_text = [at_least(as_text(df, n), MIN_TEXT) for n in names[:-1] if n in df.columns]
    passed = has_text[0] if has_text else F.lit(False)
    for test in has_text[1:]:
        passed = passed | test
    chosen = first_value(df, names, blank_is_missing=True)
    long_enough = at_least(chosen, MIN_TEXT)
    return df.withColumn(
        out, F.when(~passed, "missing").when(~long_enough, "invalid").otherwise("valid")
    )


def normalize(
    df: DataFrame, source_col: str = "source_dataset", index_col: str = "row_index"
) -> DataFrame:
    """Valid rows in the unified schema. One projection: no shuffle."""
    rows = classify_rows(df).filter("row_status = 'valid'")
    raw_text = first_value(df, CANDIDATES["description"], True)
    raw_id = F.coalesce(first_value(df, CANDIDATES["incident_id"], False), as_text(df, index_col))
    risk = F.coalesce(strip(first_value(df, CANDIDATES["critical_risk"], False)), F.lit("Others"))
    sector = F.coalesce(strip(first_value(df, CANDIDATES["sector"], True)), F.lit("Others"))
    worker = F.coalesce(strip(first_value(df, CANDIDATES["worker"], True)), F.lit("Employee"))
    level = severity_level(first_value(df, CANDIDATES["severity"], False))
    gender = F.initcap(strip(first_present(df, PRESENT_COLUMNS["gender"])))
    return rows.select(
        F.concat(F.col(source_col), F.lit(":"), raw_id).alias("incident_id"),
        raw_text.alias("raw_text"),
        clean(raw_text).alias("cleaned_text"),
        level.alias("severity_level"),
        severity_rank(level).alias("severity_rank"),
        critical_risk(risk).alias("critical_risk"),
        risk.alias("raw_critical_risk"),
        actual_level(first_value(df, CANDIDATES["actual_level"], False)).alias("actual_accident_level"),
        industry_sector(sector).alias("industry_sector"),
        worker_type(worker).alias("worker_type"),
        F.when(gender.isin("Male", "Female"), gender).otherwise("Unknown").alias("gender"),
        known_or_unknown(first_value(df, CANDIDATES["location"], True)).alias("location"),
        known_or_unknown(first_present(df, PRESENT_COLUMNS["country"])).alias("country"),
        known_or_unknown(first_present(df, PRESENT_COLUMNS["date"])).alias("date_logged"),
        F.col(source_col).alias("source_dataset"),
        F.lit(False).alias("is_synthetic"),
        F.col(index_col).cast("bigint").alias("row_index"),
    )
