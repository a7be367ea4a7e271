"""Session helpers: a tuned builder for standalone use and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings the generated code wants. The JVM compiles no method above 8000 bytes; beyond that size Spark had
# better evaluate a projection operator by operator, in methods it can split.
_TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to a session it did not build."""
    for key, value in _TUNING.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "tablesmith", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the library expects.

    Executor counts, memory and shuffle partitions belong to the deployment; pass them as ``conf``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **_TUNING,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local
    folder would be lost with the machine, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tablesmith-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` (used for small aggregates that are read more than once)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the table stays columnar, so later passes read only what they need. ``rows_per_file`` bounds the
    rows of a file, for tables that few tasks write and many shall read.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, tasks: int) -> DataFrame:
    """Deal the rows of a table that fewer than ``tasks`` tasks read over so many, before costly expressions.

    For files that Spark can't split further, such as one with a single row group. A table that has as many parts
    stays as it is, so nothing large is shuffled for it. Hand in the table as it is read: its parts are looked up in its plan.
    """
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
