"""Whole preparation runs: clean → dedupe → impute → outliers, with a gate before the write."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import level1_clean
from ..operators.dedupe import dedupe
from ..operators.impute import handle_missing_values, parse_impute_rules
from ..operators.kpi import kpi_metrics
from ..operators.outlier import outlier, parse_outlier_rules
from ..operators.validate import gated_write
from ..session import materialize
from ..sources.csv import read_csv_table, write_table


def preprocess(
    df: DataFrame,
    impute: str | Mapping[str, Any] | None = None,
    outliers: str | Sequence[Mapping[str, Any]] | None = None,
    keys: str | Sequence[str] | None = None,
    keep: str = "first",
    order_by: str | Sequence[str] = (),
    drop_threshold: float = 0.5,
    **clean_options: Any,
) -> DataFrame:
    """Clean, dedupe by ``keys`` when given, fill missing values, clip outliers.

    ``impute`` and ``outliers`` take the short text form (``median:amount;zero:quantity`` and
    ``iqr_clip:amount@multiplier=1.5``) or the structured form. Column names follow cleaning.

    Filling and clipping measure the table several times, so the cleaned table is written once to the
    shared folder first and those passes read only the columns they measure.
    """
    out = level1_clean(df, **clean_options)
    if keys:
        out = dedupe(out, keys, keep, order_by)
    if impute or outliers:
        out = materialize(out, "cleaned")
    if impute:
        rules = parse_impute_rules(impute) if isinstance(impute, str) else impute
        out = handle_missing_values(out, rules, drop_threshold, order_by)
    if outliers:
        rules = parse_outlier_rules(outliers) if isinstance(outliers, str) else outliers
        out, _ = outlier(out, rules, count_changes=False)
    return out


def preprocess_file(
    spark: SparkSession,
    source: str,
    target: str | None = None,
    encoding: str | None = None,
    spec: Mapping[str, Any] | None = None,
    threshold: float = 1.0,
    **options: Any,
) -> DataFrame:
    """Read a CSV, prepare it and write it to ``target`` unless ``spec`` fails; returns the table either way."""
    raw = read_csv_table(spark, source, encoding, typed=False)
    out = preprocess(raw, untyped=True, **options)
    if target:
        if spec:
            gated_write(out, spec, lambda table: write_table(table, target), threshold)
        else:
            write_table(out, target)
    return out


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(rows)


def files_by_header(spark: SparkSession, path: str) -> DataFrame:
    """(header, file) for the CSV files below ``path``: one scan of their lines, of which one per file is kept."""
    lines = spark.read.option("lineSep", "\n").text(path)
    first = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    heads = first.where("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    return heads.select(F.regexp_replace("header", "\r$", "").alias("header"), "file")


def run_folder(spark: SparkSession, path: str, target: str, **options: Any) -> DataFrame:
    """Prepare every CSV below ``path``: files that share a header run as one job, written by header group.

    Returns (group, source_file, rows, status, seconds), one row per file, none for an empty folder. A file with rows
    that have more cells than its header is left out and reported as ``ragged``, the others of its group go on without
    it. A group that fails is reported with its error and the run goes on; its seconds are those of its group.
    """
    heads = materialize(files_by_header(spark, path), "headers")
    report = spark.createDataFrame([], "`group` int, source_file string, rows long, status string, seconds double")
    for number, row in enumerate(heads.select("header").distinct().orderBy("header").collect()):
        members = heads.where(F.col("header").eqNullSafe(F.lit(row["header"])))
        files = [r["file"] for r in members.select("file").orderBy("file").collect()]  # the reader takes paths
        started = time.perf_counter()
        try:
            tagged = materialize(read_csv_table(spark, files, typed=False, source_file="source_file", ragged="__ragged"), "group")
            ragged = materialize(tagged.where("__ragged").groupBy("source_file").agg(F.count(F.lit(1)).alias("ragged")), "ragged")
            sound = tagged.drop("__ragged").join(ragged.select("source_file"), "source_file", "left_anti").select(*[c for c in tagged.columns if c != "__ragged"])
            out = preprocess(sound, untyped=True, protect=["source_file"], **options)
            group_target = f"{target}/group={number}"
            write_table(out, group_target, format="parquet")
            counts = spark.read.parquet(group_target).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows")).join(ragged, "source_file", "full")
            status = F.when(F.col("ragged").isNull(), "ok").otherwise(F.format_string("ragged: %d rows have more cells than the header", "ragged"))
        except Exception as error:  # one bad group must not end the run; its error is in the report
            counts = spark.createDataFrame([], "source_file string, rows long")
            status = F.lit(f"{type(error).__name__}: {str(error).splitlines()[0][:300]}")
        seconds = round(time.perf_counter() - started, 3)
        done = members.select(F.col("file").alias("source_file")).join(counts, "source_file", "left")
        report = report.unionByName(done.select(
            F.lit(number).alias("group"), "source_file", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), status.alias("status"), F.lit(seconds).alias("seconds")
        ))
    return report


def batch_kpi(df: DataFrame, **options: Any) -> DataFrame:
    """Figures of a table before and after preparation."""
    before = kpi_metrics(df).select(F.lit("before").alias("stage"), "*")
    return before.unionByName(kpi_metrics(preprocess(df, **options)).select(F.lit("after").alias("stage"), "*"))
