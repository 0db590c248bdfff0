"""Session helpers: sane defaults for a local run, shared folder for durable state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "hazlake", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitted session is used as is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hazlake-"))
    return context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by the keys only where the scan has fewer partitions than the cluster has cores.

    Text rules are bound by CPU, and one file with one row group would run on one core. A large
    table already has more partitions than cores and is passed on without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from shared storage, without the plan that made them.

    For tables that many jobs start from: neither the work nor its planning is repeated, and the
    rows outlive the executors that computed them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``cut`` for wide rows: written to shared storage as compressed columns, of which every reader takes what it needs."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
