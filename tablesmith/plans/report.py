"""The tables behind a report, each written on its own, and an append-only run log."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.kpi import report_kpi
from ..operators.pivot import PivotSpec, pivot_long
from ..operators.profile import profile

# Default report layout.
DEFAULT_PIVOT = PivotSpec(rows=("월", "카테고리"), values=(("금액", "sum"),))


PARTS = ("kpi", "sample", "profile", "pivot")


def build_report(
    df: DataFrame,
    spec: PivotSpec = DEFAULT_PIVOT,
    sample_rows: int = 50,
    profile_sample: int | None = None,
    clean_seconds: float | None = None,
    parts: Sequence[str] = PARTS,
    in_order: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Key figures, first rows, column profile and pivot of a table, or those of them named in ``parts``.

    Each part reads the table anew, so hand in a stored table rather than a long chain of steps. ``in_order`` are its rows
    in the order that the first ones are taken from, where it differs from the table's.
    """
    builders = {
        "kpi": lambda: report_kpi(df, clean_seconds),
        "sample": lambda: (df if in_order is None else in_order).limit(sample_rows),
        "profile": lambda: profile(df, profile_sample, in_order=in_order),
        "pivot": lambda: pivot_long(df, spec),
    }
    return {name: builders[name]() for name in parts}


def write_report(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Write every report table as Parquet below ``path``."""
    written = {}
    for name, table in tables.items():
        written[name] = f"{path}/{name}"
        table.write.mode("overwrite").parquet(written[name])
    return written


def log_run(spark: SparkSession, path: str, kind: str, payload: Mapping[str, Any]) -> None:
    """Append one row (time, kind, payload as JSON) to the run log at ``path``."""
    row = [(kind, json.dumps(dict(payload), ensure_ascii=False, default=str))]
    log = spark.createDataFrame(row, "kind string, payload string")
    log.select(F.current_timestamp().alias("ts"), "kind", "payload").write.mode("append").json(path)


def preprocess_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before and after a preparation run."""
    counts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("stage"), F.col("n").alias("rows"), F.lit(len(d.columns)).alias("columns"))
              for s, d in (("before", before), ("after", after))]
    return counts[0].unionByName(counts[1])
