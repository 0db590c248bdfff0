"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(x: Column, digits: int) -> Column:
    """Round half to even on the exact binary value.

    ``bround`` rounds the printed decimal: 12.35 gives 12.4 there, though the stored number lies
    below the tie. Here ``x`` is split into two halves whose products with a power of ten are
    exact, so the side of the tie is known.
    """
    scale = float(10**digits)
    wide = x * 134217729.0
    high = wide - (wide - x)
    low = x - high
    whole = F.floor(x * scale).cast("double")
    side = (high * scale - (whole + 0.5)) + low * scale
    even = F.when(whole % 2 == 0, whole).otherwise(whole + 1)
    return F.when(side > 0, whole + 1).when(side < 0, whole).otherwise(even) / scale


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("bigint")


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda v: v / total)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    ratio = (part / whole) * 100
    return F.when(whole > 0, round_even(ratio, digits)).otherwise(F.lit(0.0))


def display_percent(similarity: Column) -> Column:
    """Similarities in (0, 1] are shares; anything else is a percentage already."""
    return F.when((similarity > 0) & (similarity <= 1), similarity * 100).otherwise(similarity)
