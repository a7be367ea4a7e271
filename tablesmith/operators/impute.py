"""Missing values: fill strategies, drop of sparse columns, analysis and suggestions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import col, resolve, resolve_one
from ..functions.ordered import neighbours
from ..functions.quantiles import as_double, exact_quantiles
from ..functions.report import count_where, rows_from_aggregates
from .clean import present

# Accepted spellings of each strategy.
ALIASES = {
    "zero": "zero", "0": "zero",
    "mean": "mean", "avg": "mean",
    "median": "median",
    "mode": "mode", "most_frequent": "mode",
    "forward_fill": "ffill", "ffill": "ffill",
    "backward_fill": "bfill", "bfill": "bfill", "backfill": "bfill",
    "interpolate": "interpolate",
    "drop": "drop",
    "value": "const", "const": "const",
}
_ORDERED = {"ffill", "bfill", "interpolate"}


def parse_impute_rules(text: str) -> dict[str, str]:
    """``median:amount;zero:quantity`` to ``{column: strategy}``."""
    pairs = (part.split(":", 1) for part in text.split(";") if ":" in part)
    return {column.strip(): strategy.strip() for strategy, column in pairs}


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _literal(df: DataFrame, name: str, value: Any) -> Column:
    return F.lit(value).cast(df.schema[name].dataType)


def mode_value(df: DataFrame, name: str) -> Any:
    """Most frequent value, the smallest of equals. Values are counted in parallel, only the top one is fetched."""
    counts = df.where(present(df, name)).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("v")).limit(1).first()
    return None if top is None else top["v"]


def _statistics(df: DataFrame, wanted: dict[str, str], sizes: Mapping[str, int] | None = None) -> dict[str, Any]:
    """Fill value per column for mean, median and mode; means share one job and medians another.

    ``sizes`` holds the numbers of values per column where they are known.
    """
    values: dict[str, Any] = {}
    means = [c for c, s in wanted.items() if s == "mean"]
    if means:
        row = df.agg(*[F.avg(F.when(present(df, c), col(c))).alias(f"m{i}") for i, c in enumerate(means)]).first()
        values.update({c: row[f"m{i}"] for i, c in enumerate(means)})
    medians = [c for c, s in wanted.items() if s == "median"]
    if medians:
        known = [sizes[c] for c in medians] if sizes is not None and all(c in sizes for c in medians) else None
        values.update({c: q[0] for c, q in exact_quantiles(df, medians, [0.5], sizes=known).items()})
    values.update({c: mode_value(df, c) for c, s in wanted.items() if s == "mode"})
    return values


def _fill_ordered(
    df: DataFrame, strategy: str, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str]
) -> DataFrame:
    if not order_by:
        raise ValueError(f"{strategy} needs order_by: a distributed table has no row order")
    both = strategy == "interpolate"
    names = df.columns
    # A NaN must not count as a value to carry.
    source = df.select(*[
        (F.when(present(df, n), col(n)) if n in columns else col(n)).alias(n) for n in names
    ])
    near = neighbours(source, columns, partition_by, order_by, both or strategy == "ffill", both or strategy == "bfill")
    out = []
    for n in names:
        if n not in columns:
            out.append(col(n))
            continue
        i = list(columns).index(n)
        if both:
            before, after = F.col(f"__prev_{i}"), F.col(f"__next_{i}")
            step = (F.col("__pos") - before["pos"]) / (after["pos"] - before["pos"])
            line = F.when(after.isNull(), before["v"].cast("double")).otherwise(
                before["v"].cast("double") + (after["v"].cast("double") - before["v"].cast("double")) * step
            )
            out.append(F.coalesce(col(n).cast("double"), line).alias(n))
        else:
            out.append((F.col(f"__prev_{i}") if strategy == "ffill" else F.col(f"__next_{i}"))["v"].alias(n))
    return near.select(*out)


def fill(
    df: DataFrame,
    strategy: str,
    columns: str | Sequence[str],
    value: Any = None,
    order_by: str | Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
) -> DataFrame:
    """Fill missing values of ``columns`` with one strategy.

    Mean, median and interpolation apply to numeric columns only and leave others unchanged.
    ``order_by`` states the row order that ffill, bfill and interpolate follow; it should end in a unique column.
    """
    kind = ALIASES.get(strategy.lower())
    names = resolve(df.columns, columns)
    if kind is None:
        if value is None:
            return df
        kind = "const"
    if kind in ("mean", "median", "interpolate"):
        names = [n for n in names if _is_numeric(df, n)]
    if not names:
        return df
    if kind == "drop":
        for n in names:
            df = df.where(present(df, n))
        return df
    if kind in _ORDERED:
        return _fill_ordered(df, kind, names, resolve(df.columns, order_by), resolve(df.columns, partition_by))
    if kind in ("mean", "median", "mode"):
        values = _statistics(df, {n: kind for n in names})
    else:
        values = {n: 0 if kind == "zero" else value for n in names}
    return _fill_values(df, {n: v for n, v in values.items() if v is not None}, widen=kind in ("mean", "median"))


def _fill_values(df: DataFrame, values: Mapping[str, Any], widen: bool = False) -> DataFrame:
    out = []
    for n in df.columns:
        if n not in values:
            out.append(col(n))
            continue
        integral = isinstance(df.schema[n].dataType, T.IntegralType)
        current = F.when(present(df, n), col(n))
        if widen and integral:
            out.append(F.coalesce(current.cast("double"), F.lit(values[n])).alias(n))
        else:
            out.append(F.coalesce(current, _literal(df, n, values[n])).alias(n))
    return df.select(*out)


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and missing values per column, one job."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_where(~present(df, n)).alias(f"c{i}") for i, n in enumerate(df.columns)],
    ).first()
    return row["rows"], {n: row[f"c{i}"] for i, n in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose share of missing values exceeds ``threshold``."""
    rows, missing = missing_counts(df)
    return df.select(*[col(n) for n in df.columns if rows == 0 or missing[n] / rows <= threshold])


def handle_missing_values(
    df: DataFrame,
    strategies: Mapping[str, str | Mapping[str, Any]],
    drop_threshold: float = 0.5,
    order_by: str | Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
) -> DataFrame:
    """Drop sparse columns, then apply a strategy per column in the given order.

    Columns not in the table are skipped. Mean, median and mode of neighbouring entries are measured
    together; a ``drop`` entry changes the rows that later entries see, so it ends such a batch.
    """
    rows, missing = missing_counts(df)
    df = df.select(*[col(n) for n in df.columns if rows == 0 or missing[n] / rows <= drop_threshold])
    sizes: dict[str, int] | None = {n: rows - missing[n] for n in df.columns}
    batch: dict[str, str] = {}

    def flush(current: DataFrame) -> DataFrame:
        for group in (("mean", "median"), ("mode",)):
            part = {c: s for c, s in batch.items() if s in group}
            if part:
                values = {c: v for c, v in _statistics(current, part, sizes).items() if v is not None}
                current = _fill_values(current, values, widen=group[0] == "mean")
        for c in batch:
            if sizes is not None:
                sizes.pop(c, None)
        batch.clear()
        return current

    for wanted, config in strategies.items():
        name = resolve_one(df.columns, wanted)
        if name is None:
            continue
        config = {"strategy": config} if isinstance(config, str) else dict(config)
        strategy = config.get("strategy", "mean")
        kind = ALIASES.get(strategy.lower())
        if kind in ("mean", "median", "mode") and name not in batch:
            if kind == "mode" or _is_numeric(df, name):
                batch[name] = kind
            continue
        if kind in ("drop", *_ORDERED) or name in batch:
            df = flush(df)
        df = fill(df, strategy, name, config.get("fill_value"), order_by, partition_by)
        if kind == "drop":
            sizes = None
        elif sizes is not None:
            sizes.pop(name, None)
    return flush(df)


def impute(
    df: DataFrame,
    rules: Iterable[Mapping[str, Any]],
    order_by: str | Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Apply ``{col, method, value}`` rules in order; return the table and a report with one row per rule.

    A rule of this form knows neither ``interpolate`` nor ``drop``; mean and median read text as numbers.
    """
    _, missing = missing_counts(df)
    out, report, order = df, [], 0
    for rule in rules:
        order += 1
        name = resolve_one(out.columns, rule.get("col") or "")
        method = (rule.get("method") or "").lower()
        kind = ALIASES.get(method)
        if name is None:
            report.append((order, rule.get("col"), method, None, "skip:not_found"))
            continue
        if missing[name] == 0:
            report.append((order, name, method, None, "noop"))
            continue
        if kind is None or kind in ("interpolate", "drop"):
            report.append((order, name, method, None, "skip:unknown_method"))
            continue
        if kind in _ORDERED:
            out = fill(out, method, name, None, order_by, partition_by)
            # Leading or trailing gaps may stay open.
            left = missing_counts(out.select(col(name)))[1][name]
        else:
            value = _rule_value(out, name, kind, rule.get("value"))
            left = missing[name] if value is None else 0
            if value is not None:
                out = _fill_values(out, {name: value}, widen=kind in ("mean", "median"))
        report.append((order, name, method, missing[name] - left, "ok"))
        missing[name] = left
    schema = "rule int, col string, method string, filled long, status string"
    return out, df.sparkSession.createDataFrame(report, schema)


def _rule_value(df: DataFrame, name: str, kind: str, value: Any) -> Any:
    if kind == "zero":
        return 0
    if kind == "const":
        return value
    if kind == "mode":
        return mode_value(df, name)
    numbers = df.select(as_double(df, name).alias(name))
    return _statistics(numbers, {name: kind})[name]


def missing_patterns(df: DataFrame) -> DataFrame:
    """One row per column with its missing count and share, and the table-wide pattern figures.

    ``missing_cells``, ``max_missing_in_row`` and ``avg_missing_in_row`` run over columns with gaps.
    """
    in_row = sum((F.when(present(df, n), F.lit(0)).otherwise(F.lit(1)) for n in df.columns), F.lit(0))
    aggregates = {
        "rows": F.count(F.lit(1)),
        "cells": F.coalesce(F.sum(in_row), F.lit(0)),
        "worst": F.max(in_row),
        **{f"c{i}": count_where(~present(df, n)) for i, n in enumerate(df.columns)},
    }
    gaps = sum((F.when(F.col(f"c{i}") > 0, F.lit(1)).otherwise(F.lit(0)) for i in range(len(df.columns))), F.lit(0))
    rows = [
        {
            "column": F.lit(n),
            "missing": F.col(f"c{i}"),
            "missing_ratio": F.try_divide(F.col(f"c{i}"), F.col("rows")),
            "total_rows": F.col("rows"),
            "total_columns": F.lit(len(df.columns)),
            "columns_with_missing": gaps,
            "missing_cells": F.col("cells"),
            "max_missing_in_row": F.col("worst"),
            "avg_missing_in_row": F.try_divide(F.col("cells"), F.col("rows")),
        }
        for i, n in enumerate(df.columns)
    ]
    return rows_from_aggregates(df, aggregates, rows)


def suggest_strategies(df: DataFrame) -> DataFrame:
    """Suggested strategy per column with missing values."""
    aggregates = {
        "rows": F.count(F.lit(1)),
        **{f"c{i}": count_where(~present(df, n)) for i, n in enumerate(df.columns)},
    }
    rows = []
    for i, n in enumerate(df.columns):
        missing, total = F.col(f"c{i}"), F.col("rows")
        if _is_numeric(df, n) or isinstance(df.schema[n].dataType, T.BooleanType):
            advice = F.when(missing < total * 0.3, F.lit("median")).otherwise(F.lit("zero"))
        elif isinstance(df.schema[n].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            advice = F.lit("interpolate")
        else:
            advice = F.when(missing < total * 0.5, F.lit("mode")).otherwise(F.lit("forward_fill"))
        rows.append({"column": F.lit(n), "missing": missing, "strategy": advice})
    return rows_from_aggregates(df, aggregates, rows).where("missing > 0")
