"""Grouped pivots: filters, month derivation, aggregates, the full grid of levels, wide layout, subtotals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import month_text, parse_timestamp
from ..functions.lexicon import MONTH_COLUMN, MONTH_SOURCES
from ..functions.names import col, drop_duplicate_columns, resolve, resolve_one, snake
from ..functions.ordered import POSITION, number_rows
from ..functions.quantiles import grouped_quantiles
from ..session import cut_lineage
from .clean import present


@dataclass
class PivotSpec:
    """What to pivot: row keys, ``[(column, aggregate)]``, column keys and ``{column: [values]}`` filters.

    A later aggregate for the same column replaces an earlier one. ``order_by`` is needed by ``first`` and ``last``.
    """

    rows: Sequence[str] = ()
    values: Sequence[tuple[str, str]] | Mapping[str, str] | Sequence[str] = ()
    columns: Sequence[str] = ()
    filters: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    grid: bool = True
    date_col: str | None = None
    order_by: str | None = None

    def value_list(self) -> list[tuple[str, str]]:
        if isinstance(self.values, Mapping):
            return list(self.values.items())
        pairs = []
        for value in self.values:
            if isinstance(value, str):
                name, _, agg = value.partition(":")
                pairs.append((name, agg or "sum"))
            else:
                pairs.append((value[0], value[1]))
        return pairs


def filter_in(df: DataFrame, filters: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Keep rows whose values are listed; several columns must all match, unknown columns are ignored."""
    for wanted, allowed in filters.items():
        name = resolve_one(df.columns, wanted)
        if name is not None:
            df = df.where(col(name).isin(list(allowed)))
    return df


def _as_timestamp(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_timestamp(F.trim(col(name)))
    return col(name)


def month_bucket(
    df: DataFrame, date_col: str | None = None, name: str = MONTH_COLUMN, compat: bool = False
) -> DataFrame:
    """Add a ``yyyy-MM`` column from ``date_col`` or the first known date column.

    Dates that cannot be read give null, or the label ``NaT`` with ``compat``. A table that has the
    column already, or no date column, is returned unchanged.
    """
    if name in df.columns:
        return df
    candidates = [date_col] if date_col else list(MONTH_SOURCES)
    source = next((c for c in (resolve_one(df.columns, w) for w in candidates) if c), None)
    if source is None and date_col is None:
        source = next((c for c in df.columns if "일" in c or "날짜" in c), None)
    if source is None:
        return df
    month = month_text(_as_timestamp(df, source))
    return df.withColumn(name, F.coalesce(month, F.lit("NaT")) if compat else month)


def aggregate(df: DataFrame, name: str, func: str, order_by: str | None = None) -> Column:
    """Aggregate expression for a function name; missing values are left out."""
    value = F.when(present(df, name), col(name))
    simple = {
        "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
        "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
    }
    if func in simple:
        return simple[func](value)
    if func in ("first", "last"):
        if order_by is None:
            raise ValueError(f"{func} needs order_by: a distributed table has no row order")
        position = F.when(value.isNotNull(), col(order_by))
        return (F.min_by if func == "first" else F.max_by)(value, position)
    raise ValueError(f"unknown aggregate {func!r}")


def group_aggregate(
    df: DataFrame, keys: Sequence[str], values: Sequence[tuple[str, str]], order_by: str | None = None
) -> DataFrame:
    """Grouped aggregates named after their columns.

    A median is exact for groups of any size: it comes from a distributed selection and is joined on the
    keys, one row per group on both sides.
    """
    plain = [(c, f) for c, f in values if f != "median"]
    medians = [c for c, f in values if f == "median"]
    exprs = [aggregate(df, c, f, order_by).alias(c) for c, f in plain] or [F.count(F.lit(1)).alias("__rows")]
    out = df.groupBy(*[col(k) for k in keys]).agg(*exprs)
    for i, c in enumerate(medians):
        found = grouped_quantiles(df, keys, c, [0.5]).select(
            *[col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col("quantiles")[0].alias(f"__median{i}")
        )
        same = F.lit(True)
        for j, k in enumerate(keys):
            same = same & col(k).eqNullSafe(F.col(f"__k{j}"))
        out = out.join(found, same, "left").drop(*[f"__k{j}" for j in range(len(keys))])
        out = out.withColumnRenamed(f"__median{i}", c)
    return out.select(*[col(k) for k in keys], *[col(c) for c, _ in values])


def _header_levels(table: DataFrame, key: str) -> list[Any]:
    """Sorted distinct values of a column key, null last. They become column names, so the driver has to know them."""
    found = [r[0] for r in table.select(col(key)).distinct().collect()]
    return sorted((v for v in found if v is not None)) + [None] * (None in found)


def _numbered_levels(table: DataFrame, key: str, place: str) -> DataFrame:
    """The distinct values of a key as ``__level``, numbered from 0 without gaps in ``place``; stored and spread over tasks."""
    levels = table.select(col(key).alias("__level")).distinct()
    return number_rows(levels, "levels").select("__level", F.col(POSITION).alias(place))


def _fill_grid(table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per combination of observed levels, zero where ``table`` has none.

    Cells are numbered, so the grid is a range and every step is an equality join with a numbered level table;
    only the numbers of levels reach the driver.
    """
    levels = [_numbered_levels(table, k, f"__i{i}") for i, k in enumerate(keys)]
    counts = [level.count() for level in levels]
    grid, numbered, stride = table.sparkSession.range(math.prod(counts)), table.withColumn("__cell", F.lit(0).cast("long")), 1
    for i, key in reversed(list(enumerate(keys))):
        lookup = levels[i].withColumnRenamed("__level", f"__k{i}")
        place = (F.floor(F.col("id") / F.lit(stride)) % F.lit(max(counts[i], 1))).cast("long")
        grid = grid.withColumn("__place", place).join(lookup, F.col("__place") == F.col(f"__i{i}")).drop(f"__i{i}", "__place")
        numbered = numbered.join(lookup, col(key).eqNullSafe(F.col(f"__k{i}"))).withColumn(
            "__cell", F.col("__cell") + F.col(f"__i{i}") * F.lit(stride)
        ).drop(f"__i{i}", f"__k{i}")
        stride *= counts[i]
    measured = numbered.select("__cell", *[col(v) for v in values])
    joined = grid.join(measured, F.col("id") == F.col("__cell"), "left")
    return joined.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[_zero_filled(table, v) for v in values]
    )


def _zero_filled(table: DataFrame, name: str) -> Column:
    return F.coalesce(col(name), F.lit(0).cast(table.schema[name].dataType)).alias(name)


def _prepare(df: DataFrame, spec: PivotSpec) -> tuple[DataFrame, list[str], list[str], list[tuple[str, str]]]:
    df = filter_in(drop_duplicate_columns(df), spec.filters)
    wants_month = any(snake(k) == snake(MONTH_COLUMN) for k in [*spec.rows, *spec.columns])
    if wants_month:
        df = month_bucket(df, spec.date_col)
    rows = resolve(df.columns, spec.rows, mode="ignore")
    columns = resolve(df.columns, spec.columns, mode="ignore")
    values: dict[str, str] = {}
    for wanted, func in spec.value_list():
        name = resolve_one(df.columns, wanted)
        if name is not None:
            values[name] = func
    if not values:
        raise ValueError("no value column to aggregate, e.g. ('amount', 'sum')")
    if not rows and not columns:
        rows = [next(iter(values))]
    return df, rows, columns, list(values.items())


def pivot_long(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """One row per combination of row keys. With ``grid`` every combination of observed levels appears
    (a missing key is a level of its own) and absent ones hold zero.

    The aggregate is checkpointed, so finding the levels does not scan the base table again.
    """
    df, rows, _, values = _prepare(df, spec)
    names = [c for c, _ in values if c not in rows]
    table = group_aggregate(df, rows, [(c, f) for c, f in values if c in names], spec.order_by)
    if not spec.grid or len(rows) < 2:
        return table.select(*[col(k) for k in rows], *[_zero_filled(table, v) for v in names])
    return _fill_grid(cut_lineage(table), rows, names)


def _label(value: Any) -> str:
    return "nan" if value is None else str(value)


def pivot_wide(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Row keys down, column keys across; columns are named ``value_level`` and absent cells hold zero."""
    df, rows, columns, values = _prepare(df, spec)
    if not columns:
        return pivot_long(df, spec)
    names = [c for c, _ in values]
    table = cut_lineage(group_aggregate(df, [*rows, *columns], values, spec.order_by))
    labels = [""]
    for key in columns:
        labels = [f"{left}_{_label(v)}" for left in labels for v in _header_levels(table, key)]
    label = F.concat(*[
        part for key in columns for part in (F.lit("_"), F.coalesce(col(key).cast("string"), F.lit("nan")))
    ])
    # The second aggregation sees one row per cell, so "first" only moves values into place.
    cells = [F.first(col(v)).alias(v) for v in names]
    wide = table.withColumn("__label", label).groupBy(*[col(k) for k in rows]).pivot("__label", labels).agg(*cells)
    wide = wide.toDF(*rows, *[f"{v}{level}" for level in labels for v in names])
    measured = [f"{v}{level}" for v in names for level in labels]
    if spec.grid and len(rows) > 1:
        return _fill_grid(cut_lineage(wide), rows, measured)
    return wide.select(*[col(k) for k in rows], *[_zero_filled(wide, m) for m in measured])


def group_sum(df: DataFrame, rows: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums per group; rows with a missing key are left out and no grid is filled."""
    rows, values = resolve(df.columns, rows), resolve(df.columns, values)
    return df.dropna(subset=rows).groupBy(*[col(k) for k in rows]).agg(*[F.sum(col(v)).alias(v) for v in values])


def pivot_subtotals(df: DataFrame, month: str, category: str, values: Sequence[str]) -> DataFrame:
    """Totals per month and totals per category in one pass, rounded to two places; the other key is null."""
    [month, category], values = resolve(df.columns, [month, category]), resolve(df.columns, values)
    sums = [F.round(F.sum(col(v)), 2).alias(v) for v in values]
    level = F.when(F.grouping(col(month)) == 0, F.lit("month")).otherwise(F.lit("category")).alias("level")
    sets = [[col(month)], [col(category)]]
    grouped = df.groupingSets(sets, col(month), col(category)).agg(level, *sums)
    return grouped.select("level", col(month), col(category), *[col(v) for v in values])


def _month_key(table: DataFrame, rows: Sequence[str]) -> str:
    """The row key that holds months: by its name, else the one that is a date."""
    named = [r for r in rows if snake(r) == snake(MONTH_COLUMN)]
    dated = [r for r in rows if isinstance(table.schema[r].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not named and len(dated) != 1:
        raise ValueError(f"none of the row keys {list(rows)} is the month column {MONTH_COLUMN!r} or the only date")
    return (named or dated)[0]


def pivot_report(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Pivot with month-over-month change and running total for every value when rows are a month and a category, in any order."""
    from .timeseries import add_mom, add_running_total

    table = pivot_wide(df, spec) if spec.columns else pivot_long(df, spec)
    rows = resolve(table.columns, spec.rows, mode="ignore")
    if len(rows) == 2:
        month = _month_key(table, rows)
        category = next(r for r in rows if r != month)
        values = [c for c in table.columns if c not in rows]
        table = add_running_total(add_mom(table, values, month, category), values, month, category)
    return table
