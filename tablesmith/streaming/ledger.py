"""Files of a folder that are new or have changed, worked on once each, with a ledger of their states.

The file stream of :mod:`.drops` knows names only; here a file that is written anew under its name is read again, and
its new result takes the place of the old one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize

_LEDGER = "source_file string, modified timestamp, size long, run long"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, modified, size) of the files below ``path``, from the listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("size"),
    )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(source_file, modified, size, run) of the newest run that finished each file; empty where there is no ledger yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _LEDGER)
    entries = spark.read.schema(_LEDGER).parquet(f"{ledger}/*")
    return entries.groupBy("source_file").agg(F.max_by(F.struct("modified", "size"), "run").alias("state"), F.max("run").alias("run")).select(
        "source_file", "state.modified", "state.size", "run"
    )


def changed_files(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """(source_file, modified, size) of the files below ``path`` whose time or size is not the one of the ledger."""
    known = read_ledger(spark, ledger).select("source_file", F.struct("modified", "size").alias("known"))
    listed = list_files(spark, path).join(known, "source_file", "left")
    return listed.where(~F.col("known").eqNullSafe(F.struct("modified", "size"))).drop("known")


def refresh_changed(
    spark: SparkSession, path: str, target: str, ledger: str,
    read: Callable[[list[str]], DataFrame], work: Callable[[DataFrame], DataFrame],
) -> int:
    """Work on every new or changed file below ``path``; returns how many there were.

    ``read`` gets their paths and returns their rows with the column ``source_file``; ``work`` makes of them a table that
    still has this column, all files in one job. A run writes its results below ``target/run=<n>`` and then its files
    into the ledger. :func:`current_results` shows what the ledger confirms, so a run that ends between the two
    leaves nothing to be seen, and the next one works on its files again and overwrites them. A file that changes while it is read is
    listed with its old state, so the next run takes it again. One run at a time; files that are gone keep their results.
    A change that keeps size and time (to the millisecond) of a file is not seen.
    """
    run = (read_ledger(spark, ledger).agg(F.max("run")).first()[0] or 0) + 1
    changed = materialize(changed_files(spark, path, ledger), "changed")
    files = [r["source_file"] for r in changed.select("source_file").collect()]  # readers take paths
    if files:
        work(read(files)).write.mode("overwrite").parquet(f"{target}/run={run}")
        _enter(changed, ledger, run)
    return len(files)


def _enter(changed: DataFrame, ledger: str, run: int) -> None:
    changed.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{ledger}/{run}")


def current_results(spark: SparkSession, target: str, ledger: str) -> DataFrame:
    """The results of all files below ``target``, of each file those of the newest run that the ledger confirms."""
    confirmed = read_ledger(spark, ledger).select("source_file", "run")
    results = spark.read.option("mergeSchema", True).parquet(target).withColumn("run", F.col("run").cast("long"))
    return results.join(confirmed, ["source_file", "run"], "left_semi").drop("run")
