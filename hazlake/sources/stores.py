"""Workflow stores, event logs and metrics documents on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hazlake.session import cut


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object of records by id, as one row per record. Unreadable files give no rows."""
    texts = spark.read.text(path, wholetext=True)
    fields = ",".join(_fields(spark, schema))
    records = F.from_json("value", f"map<string,struct<{fields}>>")
    return texts.select(F.explode(records).alias("store_key", "record")).select("store_key", "record.*")


def _fields(spark: SparkSession, schema: str) -> list[str]:
    parsed = spark.createDataFrame([], schema).schema
    return [f"`{f.name}`:{f.dataType.simpleString()}" for f in parsed.fields]


def append_events(events: DataFrame, path: str, time_col: str = "ts") -> None:
    """Append to an event log laid out by day, so that readers of a period open few files."""
    events.withColumn("day", F.to_date(time_col)).write.mode("append").partitionBy("day").parquet(path)


def append_batch(events: DataFrame, log: str, number: int, time_col: str = "ts") -> None:
    """Write a numbered batch of an event log, laid out by day; a repeated batch replaces itself."""
    dated = events.withColumn("day", F.to_date(time_col))
    dated.write.mode("overwrite").partitionBy("day").parquet(f"{log}/batch={number}")


def fold_log(
    spark: SparkSession, log: str, store: str, compact: Callable[[DataFrame], DataFrame], key: str, buckets: int = 64
) -> int:
    """Fold the batches of a log that the store has not seen, whatever days they bring, and give the store's new version."""
    last = newest_version(spark, store)
    batches = spark.read.parquet(log)
    newest = batches.agg(F.max("batch")).first()[0]
    if last is not None and newest <= last:
        return last
    fresh = batches.filter(F.lit(True) if last is None else F.col("batch") > last).drop("batch", "day")
    merge_buckets(fresh, store, compact, key, newest, last, buckets)
    return newest


def merge_buckets(
    events: DataFrame, store: str, compact: Callable[[DataFrame], DataFrame], key: str, number: int, before: int | None,
    buckets: int = 64,
) -> None:
    """Bring events into a store of the few events that decide each id's state, as its version ``number``.

    The events are compacted first, so a busy id brings a few rows. The buckets of their ids are read in their newest
    version, merged, and written under the new number; all others stay where they are. A table beside the store,
    ``<store>_versions``, says for each version which one holds the newest rows of each bucket, so nothing is searched
    for, and a repeated version starts from the one ``before`` it and replaces itself; readers see it once that table is
    written. Versions that newer ones no longer name can be deleted. ``buckets`` is fixed for a store; choose it so that
    one bucket is some 100 MB.
    """
    spark = events.sparkSession
    rows = cut(compact(events))
    # at most as many rows as there are buckets
    touched = sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())
    versions = {} if before is None else _versions(spark, store, before)
    paths = [f"{store}/batch={versions[b]}/bucket={b}" for b in touched if b in versions]
    if paths:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*paths))
    if touched:
        merged = compact(rows).withColumn("bucket", bucket_of(key, buckets))
        merged.write.partitionBy("bucket").mode("overwrite").parquet(f"{store}/batch={number}")
    newest = {**versions, **dict.fromkeys(touched, number)}
    table = spark.createDataFrame(list(newest.items()), "bucket int, version long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{store}_versions/batch={number}")


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("bucket")


def _versions(spark: SparkSession, store: str, number: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{store}_versions/batch={number}").collect()}


def newest_version(spark: SparkSession, store: str) -> int | None:
    """The last version of a store; none if it has never been written."""
    try:
        return spark.read.parquet(f"{store}_versions").agg(F.max("batch")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_buckets(spark: SparkSession, store: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of the newest version of every bucket; ``schema`` is needed where the store may still be empty."""
    last = newest_version(spark, store)
    paths = [] if last is None else [f"{store}/batch={n}/bucket={b}" for b, n in _versions(spark, store, last).items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def write_snapshot(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics rows as JSON documents, one per line."""
    metrics.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", False).json(path)


def read_metrics_document(spark: SparkSession, path: str) -> DataFrame:
    """A nested metrics document written by hand or by other tools."""
    return spark.read.option("multiLine", True).json(path)


def matrix_rows(document: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``confusion_matrix`` of a metrics document in long form."""
    names = F.array(*[F.lit(v) for v in labels])
    rows = document.select(F.posexplode("confusion_matrix").alias("t", "row"))
    cells = rows.select("t", F.posexplode("row").alias("p", "n"))
    return cells.select(
        F.get(names, "t").alias("y_true"), F.get(names, "p").alias("y_pred"), F.col("n").cast("bigint").alias("n")
    )
