"""Lookups as expressions over small fixed dictionaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F


def lookup(table: dict, key: Column) -> Column:
    """Value for the key, null when absent. The map is one constant in the plan: no join."""
    kind = "int" if all(isinstance(v, int) for v in table.values()) else "string"
    return F.try_element_at(constant(table, f"map<string,{kind}>"), key)


def constant(value, ddl: str) -> Column:
    """A nested constant; the optimiser folds it to a literal before execution."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions are evaluated once per row.

    A filter on a projected column is pushed below the projection by copying the expression, and
    a copy of a copy grows fast where expressions build on one another. The optimiser does not
    push a filter below a generator that makes the column, so these are made by one that yields
    exactly one row.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.drop(*columns).select("*", F.inline_outer(F.array(made)))
