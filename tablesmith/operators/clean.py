"""Level-1 cleaning in two parts: ``infer_clean`` measures a table once and freezes a ``CleanPlan``;
``apply_clean`` turns the plan into one lazy projection that also works on streams and on other files.

A column's decisions depend on its own values only, so every counter of every column comes from the same
aggregate instead of one scan per stage.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import date_text, parse_timestamp
from ..functions.lexicon import KEEP_TIME_COLUMNS
from ..functions.names import col, resolve, snake, unique_names
from ..functions.report import count_where
from ..functions.text import currency_code, has_currency, has_digit, is_amount, is_number, strict_double, to_amount, to_bool, to_number, trim_spaces


@dataclass
class ColumnPlan:
    """Decision for one column: ``kind`` is keep, text, bool, number, currency or date, or the type
    (long, double, boolean) of a column read as text whose every value has that type."""

    source: str
    name: str
    kind: str
    keep_time: bool = False
    all_null: bool = False
    complete: bool = False
    has_marks: bool = False
    counts: dict = field(default_factory=dict)


@dataclass
class CleanPlan:
    columns: list[ColumnPlan]
    rows: int
    trim: bool = True
    date_fmt: str | None = "YYYY-MM-DD"
    currency_split: bool = True
    currency_mode: str = "detect"
    drop_empty: bool = True
    date_type: str = "string"

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> CleanPlan:
        raw = json.loads(text)
        raw["columns"] = [ColumnPlan(**c) for c in raw["columns"]]
        return cls(**raw)

    def ratios(self) -> list[dict]:
        """Measured hit ratios and the decision, one entry per text column."""
        total = max(self.rows, 1)
        return [
            {
                "column": c.name,
                "kind": c.kind,
                **{f"{k}_ratio": c.counts[k] / total for k in ("bool", "marked", "amount", "number", "date")},
            }
            for c in self.columns
            if c.kind != "keep"
        ]


def present(df: DataFrame, name: str) -> Column:
    """True where the value is neither null nor NaN."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def text_counters(value: Column, digits: Column, date_fmt: str | None) -> dict[str, Column]:
    """Counting conditions for text values; ``digits`` tells cheaply where the costly ones can hold."""
    return {
        "nonnull": value.isNotNull(),
        "bool": to_bool(value).isNotNull(),
        "marked": has_currency(value),
        "amount": digits & is_amount(value),
        "number": digits & is_number(value),
        "date": digits & parse_timestamp(value, date_fmt).isNotNull(),
    }


def type_counters(value: Column, digits: Column) -> dict[str, Column]:
    """Counting conditions for the types a reader would give a text column."""
    return {
        "as_long": digits & value.rlike("^[+-]?[0-9]+$") & value.try_cast("long").isNotNull(),
        "as_double": digits & strict_double(value).isNotNull(),
        "as_boolean": F.upper(value).isin("TRUE", "FALSE"),
    }


def whole_type(counts: dict) -> str | None:
    """Type that every value of a column has, if there is one."""
    values = counts["nonnull"]
    return next((t for t in ("long", "double", "boolean") if values and counts[f"as_{t}"] == values), None)


def decide(counts: dict, rows: int) -> str:
    """Kind of a text column from its counters; the order of the tests is the order of the stages."""
    if rows == 0:
        return "text"
    if "as_long" in counts and whole_type(counts):
        return whole_type(counts)
    share = {k: v / rows for k, v in counts.items()}
    if share["bool"] > 0.9:
        return "bool"
    if share["marked"] > 0.2 or share["number"] > 0.5:
        marked = share["marked"] >= 0.2 and counts["amount"] >= counts["number"]
        return "currency" if marked else "number"
    if share["date"] > 0.6:
        return "date"
    return "text"


def count_per_column(
    df: DataFrame,
    values: Mapping[str, Column],
    tests: Callable[[Column, Column], Mapping[str, Column]],
    prepare: Callable[[Column], Column] = lambda value: value,
) -> dict[str, dict]:
    """Rows for which each test holds, per column, from one scan.

    The columns are stacked as (place, value), so the tests are compiled once however wide the table is,
    and combined per task before the shuffle of one row per column.
    """
    names = list(values)
    if not names:
        return {}
    places = [f"c{i}" for i in range(len(names))]
    stacked = (
        df.select(*[v.alias(p) for v, p in zip(values.values(), places)])
        .unpivot([], places, "place", "value")
        .select("place", prepare(F.col("value")).alias("value"))
        .withColumn("digits", has_digit(F.col("value")))
    )
    conditions = tests(F.col("value"), F.col("digits"))
    counted = stacked.groupBy("place").agg(
        F.count(F.lit(1)).alias("rows"), *[count_where(test).alias(key) for key, test in conditions.items()]
    )
    found = {row["place"]: {key: row[key] for key in ("rows", *conditions)} for row in counted.collect()}
    empty = dict.fromkeys(["rows", *conditions], 0)
    return {name: found.get(place, empty) for name, place in zip(names, places)}


def _measure(df: DataFrame, undecided: set[str], trim: bool, date_fmt: str | None, untyped: bool) -> dict[str, dict]:
    # A column that is not up for decision only needs its non-null count; a blank stands for any value.
    values = {n: col(n) if n in undecided else F.when(present(df, n), F.lit("")) for n in df.columns}

    def tests(value: Column, digits: Column) -> dict[str, Column]:
        types = type_counters(F.trim(value), digits) if untyped else {}
        return text_counters(value, digits, date_fmt) | types

    return count_per_column(df, values, tests, trim_spaces if trim else lambda value: value)


def infer_clean(
    df: DataFrame,
    trim: bool = True,
    date_fmt: str | None = "YYYY-MM-DD",
    currency_split: bool = True,
    drop_empty: bool = True,
    preserve_time_cols: Iterable[str] | None = KEEP_TIME_COLUMNS,
    currency_mode: str = "detect",
    protect: Iterable[str] = (),
    date_cols: Iterable[str] = (),
    date_type: str = "string",
    untyped: bool = False,
) -> CleanPlan:
    """Measure ``df`` in one aggregate and decide per column what it holds.

    ``untyped`` is for a file read as plain text: the types a reader would give its columns are decided in
    the same pass, and columns that get one are left alone otherwise.

    ``protect`` keeps columns text (a text column with many ``원`` would otherwise become money);
    ``date_cols`` forces the date reader, e.g. for all-digit ``YYYYMMDD`` columns that read as numbers.
    """
    protected = set(resolve(df.columns, protect, mode="ignore"))
    forced_dates = set(resolve(df.columns, date_cols, mode="ignore"))
    undecided = {n for n in df.columns if _is_text(df, n) and n not in protected}
    counts = _measure(df, undecided, trim, date_fmt, untyped)
    rows = max((c["rows"] for c in counts.values()), default=0)
    keep_time = {snake(n) for n in (KEEP_TIME_COLUMNS if preserve_time_cols is None else preserve_time_cols)}

    columns = []
    for source, name in zip(df.columns, unique_names(snake(c) for c in df.columns)):
        counted = counts[source]
        if not _is_text(df, source):
            kind = "keep"
        elif source in protected:
            kind = "text"
        elif source in forced_dates:
            kind = "date"
        else:
            kind = decide(counted, rows)
        survivors = {"bool": "bool", "currency": "amount", "number": "number", "date": "date"}.get(kind, "nonnull")
        columns.append(ColumnPlan(
            source=source,
            name=name,
            kind=kind,
            keep_time=snake(name) in keep_time,
            all_null=rows > 0 and counted[survivors] == 0,
            complete=counted[survivors] == rows,
            has_marks=kind == "currency" and counted["marked"] > 0,
            counts=counted,
        ))
    return CleanPlan(columns, rows, trim, date_fmt, currency_split, currency_mode, drop_empty, date_type)


def _convert(plan: CleanPlan, c: ColumnPlan, value: Column) -> Column:
    if c.kind in ("long", "double", "boolean"):
        return F.trim(value).try_cast(c.kind)
    if c.kind == "bool":
        return to_bool(value)
    if c.kind == "currency":
        return to_amount(value)
    if c.kind == "number":
        return to_number(value)
    if c.kind == "date":
        ts = parse_timestamp(value, plan.date_fmt)
        if plan.date_type == "string":
            return date_text(ts, c.keep_time)
        return ts.cast("date") if plan.date_type == "date" else ts
    return value


def apply_clean(df: DataFrame, plan: CleanPlan, measured: bool = False) -> DataFrame:
    """Apply a frozen plan: projections and, with ``drop_empty``, one row filter. Runs no job.

    ``measured`` says that the plan was inferred from this very table: if a column then has a value in
    every row, no row can be empty and the filter is left out.
    """
    kept = [c for c in plan.columns if not (plan.drop_empty and c.all_null)]
    # Trimming is a projection of its own, so that readers of a value share the trimmed text.
    trimmed = df.select(*[
        (trim_spaces(col(c.source)) if plan.trim and c.kind != "keep" else col(c.source)).alias(c.name) for c in kept
    ])
    out = [_convert(plan, c, col(c.name)).alias(c.name) for c in kept]
    codes = [
        currency_code(col(c.name), plan.currency_mode).alias(f"{c.name}__currency")
        for c in kept
        if c.kind == "currency" and plan.currency_split and (c.has_marks or not plan.drop_empty)
    ]
    cleaned = trimmed.select(*out, *codes)
    if not plan.drop_empty or (measured and any(c.complete for c in kept)):
        return cleaned
    return drop_empty_rows(cleaned)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all") if df.columns else df


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows without any value, then columns without any value (one counting job)."""
    row = df.agg(*[count_where(present(df, n)).alias(f"c{i}") for i, n in enumerate(df.columns)]).first()
    kept = [n for i, n in enumerate(df.columns) if row[f"c{i}"] > 0]
    return drop_empty_rows(df).select(*[col(n) for n in kept])


def level1_clean(df: DataFrame, **options) -> DataFrame:
    """Names, blanks, booleans, money and numbers, dates, empty rows and columns, in that order."""
    return apply_clean(df, infer_clean(df, **options), measured=True)


def standardize(df: DataFrame, **options) -> tuple[DataFrame, CleanPlan]:
    """``level1_clean`` that also hands back the decisions it made."""
    plan = infer_clean(df, **options)
    return apply_clean(df, plan, measured=True), plan
