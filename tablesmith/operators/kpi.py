"""Data-quality figures of a table, before/after comparison and the report's key figures."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import parse_timestamp
from ..functions.names import col
from .clean import level1_clean, present
from .dedupe import dedupe
from .profile import short_key


def _missing_cells(df: DataFrame) -> Column:
    flags = [F.when(present(df, n), F.lit(0)).otherwise(F.lit(1)) for n in df.columns]
    return F.coalesce(F.sum(sum(flags, F.lit(0)).cast("long")), F.lit(0))


def _distinct_rows(df: DataFrame) -> Column:
    # A struct is never null, so rows with missing values count too. Long texts are shuffled as digests.
    return F.count_distinct(F.struct(*[
        short_key(col(f.name)) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema.fields
    ]))


def _duplicate_rate() -> Column:
    return (F.col("rows") - F.col("distinct_rows")) / F.greatest(F.col("rows"), F.lit(1))


def _missing_rate(df: DataFrame) -> Column:
    return F.coalesce(F.try_divide(F.col("missing"), F.col("rows") * F.lit(len(df.columns))), F.lit(0.0))


def kpi_metrics(df: DataFrame) -> DataFrame:
    """Rows, missing rate, duplicate rate, share of numeric columns and parse rate of text columns as dates.

    One job; rates are rounded to four places.
    """
    numeric = [n for n in df.columns if isinstance(df.schema[n].dataType, (T.NumericType, T.BooleanType))]
    texts = [n for n in df.columns if isinstance(df.schema[n].dataType, T.StringType)]
    parsed = [F.when(parse_timestamp(F.trim(col(n))).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for n in texts]
    date_rate = F.coalesce(F.try_divide(F.col("dates"), F.col("rows") * F.lit(len(texts))), F.lit(0.0)) if texts else F.lit(0.0)
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        _missing_cells(df).alias("missing"),
        _distinct_rows(df).alias("distinct_rows"),
        F.coalesce(F.sum(sum(parsed, F.lit(0)).cast("long")), F.lit(0)).alias("dates"),
    )
    return one.select(
        "rows",
        F.round(_missing_rate(df), 4).alias("missing_rate"),
        F.round(_duplicate_rate(), 4).alias("dup_rate"),
        F.round(F.lit(len(numeric) / max(len(df.columns), 1)), 4).alias("numeric_col_rate"),
        F.round(date_rate, 4).alias("date_parse_rate_guess"),
    )


def kpi_before_after(df: DataFrame, **clean_options) -> DataFrame:
    """Figures before and after cleaning plus whole-row dedupe, with the seconds that the whole clean takes.

    For the clock the cleaned table is computed once into the no-op sink.
    """
    started = time.perf_counter()
    cleaned = level1_clean(df, **clean_options)
    cleaned.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - started
    before = kpi_metrics(df).select(F.lit("before").alias("stage"), "*", F.lit(None).cast("double").alias("clean_seconds"))
    after = kpi_metrics(dedupe(cleaned)).select(F.lit("after").alias("stage"), "*", F.lit(round(seconds, 3)).alias("clean_seconds"))
    return before.unionByName(after)


def diff_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing cells and surplus copies of rows before and after."""
    parts = []
    for stage, df in (("before", before), ("after", after)):
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("rows"),
                _missing_cells(df).alias("missing"),
                _distinct_rows(df).alias("distinct_rows"),
            ).select(F.lit(stage).alias("stage"), F.col("missing").alias("nulls"), (F.col("rows") - F.col("distinct_rows")).alias("duplicates"))
        )
    return parts[0].unionByName(parts[1])


def report_kpi(df: DataFrame, clean_seconds: float | None = None) -> DataFrame:
    """Key figures of a report as (metric, value) rows."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), _missing_cells(df).alias("missing"), _distinct_rows(df).alias("distinct_rows")
    )
    figures = [
        ("rows", F.col("rows").cast("double")),
        ("columns", F.lit(float(len(df.columns)))),
        ("missing_rate", F.round(_missing_rate(df), 4)),
        ("dup_rate", F.round(_duplicate_rate(), 4)),
    ]
    if clean_seconds is not None:
        figures.append(("clean_seconds", F.lit(round(clean_seconds, 3))))
    rows = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in figures]
    return one.select(F.inline(F.array(*rows)))
