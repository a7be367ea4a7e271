"""Turn one aggregate row into a small report table without leaving the lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def count_where(test: Column) -> Column:
    """Rows for which ``test`` is true. ``count_if`` would evaluate a costly test twice per row."""
    return F.count(F.when(test, F.lit(1)))


def rows_from_aggregates(
    df: DataFrame, aggregates: Mapping[str, Column], rows: Sequence[Mapping[str, Column]]
) -> DataFrame:
    """Aggregate ``df`` once and emit each mapping of ``rows`` (expressions over the aggregates) as a row."""
    one = df.agg(*[a.alias(name) for name, a in aggregates.items()])
    structs = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return one.select(F.inline(F.array(*structs)))
