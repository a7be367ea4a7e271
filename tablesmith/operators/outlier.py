"""Outliers by interquartile range or z-score: clip, remove or mark; rule reports and detection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import col, resolve, resolve_one
from ..functions.quantiles import as_double, exact_quantiles
from ..functions.report import count_where

# Accepted spellings of the two methods.
METHODS = {"iqr": "iqr_clip", "iqr_clip": "iqr_clip", "z": "zscore_clip", "zscore": "zscore_clip", "zscore_clip": "zscore_clip"}

REPORT_SCHEMA = (
    "rule int, col string, method string, changed long, q1 double, q3 double, mean double, std double, "
    "lo double, hi double, parameter double, status string"
)


@dataclass
class Bounds:
    column: str
    method: str
    parameter: float
    lo: float | None = None
    hi: float | None = None
    q1: float | None = None
    q3: float | None = None
    mean: float | None = None
    std: float | None = None

    @property
    def active(self) -> bool:
        """False when the spread is unknown or, for z-scores, zero: then nothing is an outlier."""
        if self.lo is None or self.hi is None:
            return False
        return self.method == "iqr_clip" or bool(self.std)


def parse_outlier_rules(text: str) -> list[dict[str, Any]]:
    """``iqr_clip:amount@multiplier=1.5;zscore_clip:quantity@z=3`` to rule dictionaries (``k`` means multiplier)."""
    rules = []
    for part in filter(None, (p.strip() for p in (text or "").split(";"))):
        head, *settings = part.split("@")
        method, found, column = head.partition(":")
        if not found:
            continue
        rule: dict[str, Any] = {"method": method.strip(), "col": column.strip()}
        for setting in ",".join(settings).split(","):
            key, has_value, value = (s.strip() for s in setting.partition("="))
            if has_value:
                rule["multiplier" if key == "k" else key] = _number(value, value)
        rules.append(rule)
    return rules


def _number(value: Any, default: Any) -> Any:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def _parameter(rule: Mapping[str, Any], method: str) -> float:
    if method == "iqr_clip":
        return _number(rule.get("multiplier", rule.get("k", 1.5)), 1.5)
    return _number(rule.get("z", rule.get("threshold", 3.0)), 3.0)


def measure(df: DataFrame, wanted: Sequence[tuple[str, str, float]]) -> list[Bounds]:
    """Bounds for (column, method, parameter) triples: quartiles of all columns together, moments in one job."""
    bounds = [Bounds(c, m, p) for c, m, p in wanted]
    quartile_columns = list(dict.fromkeys(b.column for b in bounds if b.method == "iqr_clip"))
    quartiles = exact_quantiles(df, quartile_columns, [0.25, 0.75]) if quartile_columns else {}
    scored = [b for b in bounds if b.method == "zscore_clip"]
    moments = None
    if scored:
        moments = df.agg(*[
            a for i, b in enumerate(scored)
            for a in (F.avg(as_double(df, b.column)).alias(f"m{i}"), F.stddev_pop(as_double(df, b.column)).alias(f"s{i}"))
        ]).first()
    for b in bounds:
        if b.method == "iqr_clip":
            b.q1, b.q3 = quartiles[b.column]
            if b.q1 is not None:
                spread = b.q3 - b.q1
                b.lo, b.hi = b.q1 - b.parameter * spread, b.q3 + b.parameter * spread
    for i, b in enumerate(scored):
        b.mean, b.std = moments[f"m{i}"], moments[f"s{i}"]
        if b.mean is not None:
            reach = b.parameter * b.std if b.std else 0.0
            b.lo, b.hi = b.mean - reach, b.mean + reach
    return bounds


def _clipped(df: DataFrame, b: Bounds) -> Column:
    value = as_double(df, b.column)
    if b.active:
        value = F.when(value < F.lit(b.lo), F.lit(b.lo)).when(value > F.lit(b.hi), F.lit(b.hi)).otherwise(value)
    if isinstance(df.schema[b.column].dataType, T.IntegralType):
        value = F.bround(value, 0)
    return value


def _outside(df: DataFrame, b: Bounds) -> Column:
    if not b.active:
        return F.lit(False)
    value = as_double(df, b.column)
    return F.coalesce((value < F.lit(b.lo)) | (value > F.lit(b.hi)), F.lit(False))


def apply_bounds(df: DataFrame, bounds: Sequence[Bounds], action: str = "clip") -> DataFrame:
    """Apply measured bounds (no job): ``clip`` values, ``remove`` rows, or ``mark`` them in ``<col>__outlier``."""
    if action == "clip":
        return df.withColumns({b.column: _clipped(df, b) for b in bounds})
    if action == "mark":
        return df.withColumns({f"{b.column}__outlier": _outside(df, b) for b in bounds})
    if action == "remove":
        for b in bounds:
            df = df.where(~_outside(df, b))
        return df
    raise ValueError(f"unknown action {action!r}: use clip, remove or mark")


def iqr_clip(df: DataFrame, columns: str | Sequence[str], multiplier: float = 1.5) -> DataFrame:
    names = resolve(df.columns, columns)
    return apply_bounds(df, measure(df, [(n, "iqr_clip", multiplier) for n in names]))


def zscore_clip(df: DataFrame, columns: str | Sequence[str], z: float = 3.0) -> DataFrame:
    names = resolve(df.columns, columns)
    return apply_bounds(df, measure(df, [(n, "zscore_clip", z) for n in names]))


def _changed(df: DataFrame, bounds: Sequence[Bounds]) -> list[int]:
    row = df.agg(*[
        count_where(_clipped(df, b) != as_double(df, b.column)).alias(f"n{i}") for i, b in enumerate(bounds)
    ]).first()
    return [row[f"n{i}"] for i in range(len(bounds))]


def outlier(
    df: DataFrame, rules: Iterable[Mapping[str, Any]], action: str = "clip", count_changes: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Apply rules in order; return the table and a report with one row per rule.

    Counting the changed values costs a pass over the table; without ``count_changes`` they stay null.

    Rules on different columns cannot influence each other when clipping, so they are measured together;
    a second rule on a column, or any rule after a removal, starts a new round.
    """
    report: list[tuple] = []
    batch: list[tuple[int, str, str, float]] = []
    out = df

    def flush(current: DataFrame) -> DataFrame:
        if not batch:
            return current
        bounds = measure(current, [(c, m, p) for _, c, m, p in batch])
        counts = _changed(current, bounds) if count_changes else [None] * len(bounds)
        for (order, *_), b, changed in zip(batch, bounds, counts):
            report.append((order, b.column, b.method, changed, b.q1, b.q3, b.mean, b.std, b.lo, b.hi, b.parameter, "ok"))
        batch.clear()
        return apply_bounds(current, bounds, action)

    for order, rule in enumerate(rules, start=1):
        name = resolve_one(df.columns, rule.get("col") or "")
        given = (rule.get("method") or "").lower()
        method = METHODS.get(given)
        if name is None or method is None:
            status = "skip:not_found" if name is None else "skip:unknown_method"
            report.append((order, rule.get("col"), given, *[None] * 8, status))
            continue
        if action == "remove" or any(c == name for _, c, _, _ in batch):
            out = flush(out)
        batch.append((order, name, method, float(_parameter(rule, method))))
    out = flush(out)
    return out, df.sparkSession.createDataFrame(sorted(report, key=lambda r: r[0]), REPORT_SCHEMA)


def detect_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", **settings: Any) -> DataFrame:
    """Report only: bounds and number of values outside, one row per column."""
    return outlier(df, [{"col": c, "method": method, **settings} for c in columns])[1]


def handle_outliers(df: DataFrame, info: Mapping[str, Mapping[str, Any]], action: str = "clip") -> DataFrame:
    """Apply ``{column: {method, …}}`` with the chosen action."""
    rules = [{"col": c, **settings} for c, settings in info.items() if "method" in settings]
    return outlier(df, rules, action, count_changes=False)[0] if rules else df
