"""Shared pieces of the corpus operators: words, row keys, stored intermediate tables."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazlake.session import shared_dir

#: Sorts rows without an id behind all ids.
NO_ID = 2**63 - 1
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def lower_az(column: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def words_of(column: Column) -> Column:
    """Runs of characters other than ASCII blanks; null has none."""
    return F.filter(F.split(text_of(column), GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_key(docs: DataFrame, *extra: Column) -> DataFrame:
    """(did, th, text, extra...): did orders the documents, null ids last; (did, th) tells rows of one id apart.

    Rows that repeat both id and text are the same to every operator and share their results.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.col("text")).alias("th"), F.col("text").cast("string").alias("text"), *extra,
    )


def whole_row(docs: DataFrame) -> Column:
    """All columns as a struct ``row``, whatever their names hold (dots, backquotes, names that others have)."""
    return F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]).alias("row")


def doc_id_of(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have."""
    name, taken = f"_{base}", {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, and kept when executors are lost."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Marked for broadcast only when its counted rows are within the limit; else joined by shuffle."""
    return F.broadcast(df) if rows <= limit else df
