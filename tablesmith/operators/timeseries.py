"""Month-over-month change, running totals and period summaries.

The window operators take a pivot, i.e. one row per (month, category): a window then holds the months of one
category, however many base rows stand behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import col, resolve_one
from ..functions.quantiles import as_double


def add_mom(df: DataFrame, values: Sequence[str], month: str, category: str) -> DataFrame:
    """Add ``<value>_MoM``: relative change against the category's previous month; 0 without one or when it is 0."""
    window = Window.partitionBy(col(category)).orderBy(col(month))
    changes = {}
    for v in values:
        before = F.lag(col(v)).over(window)
        changes[f"{v}_MoM"] = F.coalesce(F.try_divide((col(v) - before).cast("double"), before.cast("double")), F.lit(0.0))
    return df.withColumns(changes)


def add_running_total(
    df: DataFrame, values: Sequence[str], month: str, category: str, reset: str | None = None
) -> DataFrame:
    """Add ``<value>_YTD``: the category's total up to and including the month.

    By default the total runs on across years; ``reset="year"`` starts again every January.
    """
    keys = [col(category)]
    if reset == "year":
        keys.append(F.substring(col(month).cast("string"), 1, 4))
    window = Window.partitionBy(*keys).orderBy(col(month)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{v}_YTD": F.sum(col(v)).over(window) for v in values})


def period_summary(
    df: DataFrame,
    start: str,
    end: str,
    amount: str = "금액",
    quantity: str = "수량",
    date_col: str | None = None,
) -> DataFrame:
    """Amount, quantity and rows with ``start ≤ date ≤ end`` (``end`` is midnight); missing numbers count as 0.

    Without a date column all rows count.
    """
    from .pivot import _as_timestamp

    source = resolve_one(df.columns, date_col) if date_col else next((c for c in df.columns if "일" in c or "날짜" in c), None)
    if source is not None:
        moment = _as_timestamp(df, source).cast("timestamp_ntz")
        df = df.where(moment.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))

    def total(name: str):
        real = resolve_one(df.columns, name)
        return F.lit(0.0) if real is None else F.coalesce(F.sum(as_double(df, real)), F.lit(0.0))

    return df.agg(
        total(amount).alias("amount_total"),
        total(quantity).alias("quantity_total"),
        F.count(F.lit(1)).alias("rows"),
    ).withColumn("period", F.lit(f"{start}~{end}"))
