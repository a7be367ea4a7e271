"""Exact quantiles (linear interpolation between neighbours) without collecting a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. Here that buffer is used
only for a number of rows known to be small; beyond it the search interval around each wanted rank is
narrowed with sketches and verified by exact counts until few enough rows are left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .names import col
from .ordered import CHUNK, POSITION, order_in_chunks
from .report import count_where
from .text import strict_double

# Rows of one column (or group) that one aggregation buffer may hold.
ROWS_IN_ONE_BUFFER = 100_000
_SKETCH_ACCURACY = 10_000


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric value of a column: text is parsed, NaN and other types count as missing."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return strict_double(F.trim(col(name)))
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast("double")
    value = col(name).cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class _Rank:
    """Search state for the value at ``rank`` (0-based) of column ``index``: it lies in [low, high],
    ``below`` rows are less than ``low`` and ``inside`` rows lie in the interval."""

    index: int
    rank: int
    below: int
    inside: int
    low: float
    high: float
    value: float | None = None


def _between(value: Column, low: float, high: float) -> Column:
    return (value >= F.lit(low)) & (value <= F.lit(high))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    buffer_rows: int = ROWS_IN_ONE_BUFFER,
    sizes: Sequence[int] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns over the whole table, all columns per pass.

    ``sizes``, the numbers of values per column, saves a counting pass where they are known already.
    """
    values = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    if sizes is None:
        sizes = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}

    small = [i for i in range(len(columns)) if 0 < sizes[i] <= buffer_rows]
    if small:
        points = F.array(*[F.lit(float(p)) for p in probabilities])
        row = values.agg(*[F.percentile(f"v{i}", points).alias(f"q{i}") for i in small]).first()
        for i in small:
            result[columns[i]] = list(row[f"q{i}"])

    large = [i for i in range(len(columns)) if sizes[i] > buffer_rows]
    if large:
        wanted = {}
        for i in large:
            for p in probabilities:
                place = (sizes[i] - 1) * p
                for rank in (math.floor(place), math.ceil(place)):
                    wanted[i, rank] = _Rank(i, rank, 0, sizes[i], -math.inf, math.inf)
        _select_ranks(values, list(wanted.values()), buffer_rows)
        for i in large:
            for k, p in enumerate(probabilities):
                place = (sizes[i] - 1) * p
                left, right = wanted[i, math.floor(place)].value, wanted[i, math.ceil(place)].value
                share = place - math.floor(place)
                result[columns[i]][k] = left if left == right else left + (right - left) * share
    return result


def _select_ranks(values: DataFrame, ranks: list[_Rank], buffer_rows: int) -> None:
    """Narrow the interval of every rank until its value is found: a sketch pass proposes a narrower interval,
    a counting pass proves where the rank lies. Ranks that share an interval share one sketch."""
    open_ranks = ranks
    while open_ranks:
        intervals: dict[tuple, list[_Rank]] = {}
        for r in open_ranks:
            intervals.setdefault((r.index, r.low, r.high), []).append(r)
        aggregates = []
        for (index, low, high), group in intervals.items():
            value = F.col(f"v{index}")
            inside = F.when(_between(value, low, high), value)
            if group[0].inside <= buffer_rows:
                # Bounded: the interval is known to hold at most buffer_rows values.
                kept = F.sort_array(F.collect_list(inside))
                aggregates.append(F.array(*[F.element_at(kept, r.rank - r.below + 1) for r in group]))
            else:
                points = [p for r in group for p in _bracket(r)]
                aggregates.append(F.percentile_approx(inside, points, F.lit(_SKETCH_ACCURACY)))
        found = values.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggregates)]).first()

        proposed: list[tuple[_Rank, float, float]] = []
        for i, group in enumerate(intervals.values()):
            for j, r in enumerate(group):
                if r.inside <= buffer_rows:
                    r.value = found[i][j]
                else:
                    proposed.append((r, found[i][2 * j], found[i][2 * j + 1]))
        _verify(values, proposed)
        open_ranks = [r for r in open_ranks if r.value is None]


def _bracket(r: _Rank) -> list[float]:
    place, slack = (r.rank - r.below) / (r.inside - 1), 2.0 / _SKETCH_ACCURACY
    return [max(place - slack, 0.0), min(place + slack, 1.0)]


def _verify(values: DataFrame, proposed: list[tuple[_Rank, float, float]]) -> None:
    if not proposed:
        return
    distinct = list(dict.fromkeys((r.index, low, high) for r, low, high in proposed))
    row = values.agg(*[
        F.struct(
            count_where(F.col(f"v{i}") < F.lit(low)), count_where(F.col(f"v{i}") == F.lit(low)),
            count_where(_between(F.col(f"v{i}"), low, high)), count_where(F.col(f"v{i}") == F.lit(high)),
        )
        for i, low, high in distinct
    ]).first()
    counts = dict(zip(distinct, row))
    for r, low, high in proposed:
        below, at_low, inside, at_high = counts[r.index, low, high]
        before = r.inside
        if r.rank < below:
            r.high, r.inside = math.nextafter(low, -math.inf), below - r.below
        elif r.rank < below + at_low:
            r.value = low
        elif r.rank >= below + inside:
            r.inside = r.below + r.inside - below - inside
            r.below, r.low = below + inside, math.nextafter(high, math.inf)
        elif r.rank >= below + inside - at_high:
            r.value = high
        else:
            # Both borders are values of the column, so leaving them out shrinks the interval however it was proposed.
            r.low, r.high = math.nextafter(low, math.inf), math.nextafter(high, -math.inf)
            r.below, r.inside = below + at_low, inside - at_low - at_high
        if r.value is None and r.inside >= before:
            raise RuntimeError(f"the search for rank {r.rank} does not narrow down")


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float], name: str = "quantiles"
) -> DataFrame:
    """Exact quantiles per group as an array column, for groups of any size.

    Equal values are counted first; the distinct values are then ordered by range partitioning, so the
    running count of one group is spread over several tasks and pieced together per (chunk, group).
    """
    value, count = "__v", "__n"
    counted = (
        df.select(*[col(k) for k in keys], as_double(df, column).alias(value))
        .where(F.col(value).isNotNull())
        .groupBy(*[col(k) for k in keys], value)
        .agg(F.count(F.lit(1)).alias(count))
    )
    return quantiles_of_counts(counted, keys, value, count, probabilities, name)


def quantiles_of_counts(
    counted: DataFrame, keys: Sequence[str], value: str, count: str, probabilities: Sequence[float], name: str = "quantiles"
) -> DataFrame:
    """:func:`grouped_quantiles` of a table that has each value of a group once, with its count."""
    chunked = order_in_chunks(counted, keys, [value], "quantiles")
    key_columns = [col(k) for k in keys]
    pieces = chunked.groupBy(CHUNK, *key_columns).agg(F.sum(count).alias("__sum"))
    # At most one row per chunk in each of these windows.
    per_group = Window.partitionBy(*key_columns)
    pieces = pieces.select(
        CHUNK,
        *key_columns,
        F.coalesce(
            F.sum("__sum").over(per_group.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__sum").over(per_group).alias("__total"),
    )
    renamed = pieces.select(
        F.col(CHUNK).alias("__c"), *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before", "__total"
    )
    same = F.col(CHUNK) == F.col("__c")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"__k{i}"))
    running = Window.partitionBy(CHUNK, *key_columns).orderBy(POSITION)
    upto = F.sum(count).over(running.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    placed = chunked.join(renamed, same).withColumn("__upto", upto)

    aggregates = []
    for p in probabilities:
        place = (F.col("__total") - 1) * F.lit(float(p))
        for rank in (F.floor(place), F.ceil(place)):
            holds = (F.col("__upto") > rank) & (F.col("__upto") - F.col(count) <= rank)
            aggregates.append(F.max(F.when(holds, F.col(value))))
    named = [a.alias(f"__r{i}") for i, a in enumerate(aggregates)]
    ranked = placed.groupBy(*key_columns).agg(F.max("__total").alias("__total"), *named)
    results = []
    for i, p in enumerate(probabilities):
        place = (F.col("__total") - 1) * F.lit(float(p))
        left, right = F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}")
        results.append(F.when(left == right, left).otherwise(left + (right - left) * (place - F.floor(place))))
    return ranked.select(*key_columns, F.array(*results).alias(name))
