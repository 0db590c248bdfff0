"""Identifiers derived from content, so that a rerun or a retried task gives the same id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_id(prefix: str, *keys: Column, size: int = 32) -> Column:
    joined = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(joined, 256), 1, size)))


def incident_ref(number: Column) -> Column:
    return F.format_string("INC-%04d", number.cast("bigint"))
