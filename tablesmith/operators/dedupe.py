"""Removal of duplicate rows: whole-row distinct, or one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import col, resolve


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # Ranking with "= 1" lets Spark keep one row per key and task before the shuffle, so a key that
    # holds a large share of the table sends only one row per task.
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def dedupe(
    df: DataFrame,
    keys: str | Sequence[str] | None = None,
    keep: str = "last",
    order_by: str | Sequence[str] = (),
) -> DataFrame:
    """Keep one row per key.

    ``keep`` is ``first``, ``last`` (by ``order_by``, which stands for the row order Spark tables do not
    have) or ``last_by:<column>``: greatest value, nulls last, ties by ``order_by`` ascending. Without
    keys identical rows collapse.
    """
    if not keys:
        return df.dropDuplicates()
    real_keys = resolve(df.columns, keys)
    ordering = resolve(df.columns, order_by)
    if keep.startswith("last_by:"):
        [by] = resolve(df.columns, keep.removeprefix("last_by:"))
        return _one_per_key(df, real_keys, [col(by).desc_nulls_last(), *[col(c).asc() for c in ordering]])
    if not ordering:
        raise ValueError("keep='first' and keep='last' need order_by: a distributed table has no row order")
    if keep == "last":
        return _one_per_key(df, real_keys, [col(c).desc() for c in ordering])
    return _one_per_key(df, real_keys, [col(c).asc() for c in ordering])


def dedupe_report(df: DataFrame, keys: str | Sequence[str] | None = None, keep: str = "last") -> DataFrame:
    """One row: keys, keep, sort column, rows before, rows after and rows removed (one job, no dedupe run)."""
    real_keys = resolve(df.columns, keys) if keys else df.columns
    sorted_by = resolve(df.columns, keep.removeprefix("last_by:"))[0] if keep.startswith("last_by:") else None
    # Grouping on the key keeps nulls as one group and combines copies before the shuffle.
    groups = df.groupBy(*[col(k) for k in real_keys]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("input_rows"), F.count(F.lit(1)).alias("output_rows")
    ).select(
        F.lit(", ".join(real_keys) if keys else "ALL").alias("keys"),
        F.lit(keep).alias("keep"),
        F.lit(sorted_by).cast("string").alias("sorted_by"),
        "input_rows",
        "output_rows",
        (F.col("input_rows") - F.col("output_rows")).alias("removed"),
    )
