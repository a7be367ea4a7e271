"""Order-dependent work on tables that have no row order and may have one giant group.

``order_in_chunks`` range-partitions a table on (group, order) columns, so that a group of any size is
spread over as many tasks as it needs, and numbers the rows. Windows then run per (chunk, group) and
only the few values that cross a chunk border are carried over, in a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..session import materialize
from .names import col

CHUNK, POSITION, OFFSET = "__chunk", "__pos", "__rows_before"
# monotonically_increasing_id holds the task in the upper bits and the row within it in the lower 33.
_LOCAL_BITS = 33


def _local(position: Column) -> Column:
    return position.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))


def order_in_chunks(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], label: str) -> DataFrame:
    """Globally ordered copy with ``__chunk`` and ``__pos`` (the position is increasing over the whole order).

    The copy is written to the shared folder once: chunk borders come from a sample, so recomputing them
    in a later stage could give different ones.
    """
    keys = [col(c) for c in [*partition_by, *order_by]]
    numbered = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(POSITION, F.monotonically_increasing_id())
    )
    stored = materialize(numbered, label)
    return stored.withColumn(CHUNK, F.shiftright(F.col(POSITION), _LOCAL_BITS))


def number_rows(df: DataFrame, label: str) -> DataFrame:
    """Stored copy of ``df`` with ``__pos``, numbers from 0 without gaps in no particular order."""
    stored = materialize(df.withColumn(POSITION, F.monotonically_increasing_id()), label)
    chunked = stored.withColumn(CHUNK, F.shiftright(F.col(POSITION), _LOCAL_BITS))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per task that wrote the copy.
    offsets = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("rows")).select(CHUNK, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(OFFSET))
    numbered = chunked.join(F.broadcast(offsets), CHUNK).withColumn(POSITION, _local(F.col(POSITION)) + F.col(OFFSET))
    return numbered.drop(CHUNK, OFFSET)


def _same_group(partition_by: Sequence[str], other: str) -> Column:
    tests = [col(c).eqNullSafe(F.col(f"{other}.k{i}")) for i, c in enumerate(partition_by)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _edge(partition_by: Sequence[str], value: Column) -> Column:
    return F.struct(
        F.col(POSITION).alias("pos"), *[col(c).alias(f"k{i}") for i, c in enumerate(partition_by)], value.alias("v")
    )


def neighbours(
    df: DataFrame,
    columns: Sequence[str],
    partition_by: Sequence[str],
    order_by: Sequence[str],
    previous: bool = True,
    following: bool = False,
) -> DataFrame:
    """Add ``__prev_<i>`` / ``__next_<i>``: struct(pos, v) of the nearest non-null value of ``columns[i]``
    at or before / at or after each row within its group, and ``__pos``, a row number without gaps."""
    chunked = order_in_chunks(df, partition_by, order_by, "ordered")
    carries = _carry_table(chunked, columns, partition_by, previous, following)
    base = Window.partitionBy(CHUNK, *[col(c) for c in partition_by])
    # One row per chunk, and chunks are shuffle partitions: the broadcast side does not grow with the rows.
    joined = chunked.join(F.broadcast(carries), CHUNK, "left").withColumn(
        POSITION, _local(F.col(POSITION)) + F.col(OFFSET)
    )
    order = [F.col(POSITION)]
    return _with_neighbours(joined, columns, base, order, partition_by, previous, following).drop(
        CHUNK, *[c for c in carries.columns if c != CHUNK]
    )


def _carry_table(
    chunked: DataFrame, columns: Sequence[str], partition_by: Sequence[str], previous: bool, following: bool
) -> DataFrame:
    """One row per chunk: rows before it, and the nearest values before and after it."""
    edges = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        edge = F.when(col(name).isNotNull(), _edge(partition_by, col(name)))
        if previous:
            edges.append(F.max(edge).alias(f"last_{i}"))
        if following:
            edges.append(F.min(edge).alias(f"first_{i}"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = (
        chunked.groupBy(CHUNK).agg(*edges)
        .withColumn(OFFSET, F.coalesce(F.sum("rows").over(before), F.lit(0)))
    )
    carried = []
    for i in range(len(columns)):
        for wanted, edge, frame, aggregate, name in (
            (previous, f"last_{i}", before, F.max, f"__carry_prev_{i}"),
            (following, f"first_{i}", after, F.min, f"__carry_next_{i}"),
        ):
            if wanted:
                numbered = F.when(
                    F.col(edge).isNotNull(), F.col(edge).withField("pos", _local(F.col(f"{edge}.pos")) + F.col(OFFSET))
                )
                per_chunk = per_chunk.withColumn(edge, numbered)
                carried.append(aggregate(edge).over(frame).alias(name))
    return per_chunk.select(CHUNK, OFFSET, *carried)


def _with_neighbours(
    df: DataFrame,
    columns: Sequence[str],
    base: WindowSpec,
    order: Sequence[Column],
    partition_by: Sequence[str],
    previous: bool,
    following: bool,
) -> DataFrame:
    up_to_here = base.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is looking back in descending order: a frame that ends unbounded would rescan the rest
    # of the group for every row.
    from_here = base.orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)

    def with_carry(local: Column, carry: str) -> Column:
        kept = F.struct(F.col(f"{carry}.pos").alias("pos"), F.col(f"{carry}.v").alias("v"))
        return F.coalesce(local, F.when(F.col(carry).isNotNull() & _same_group(partition_by, carry), kept))

    added = []
    for i, name in enumerate(columns):
        anchor = F.when(col(name).isNotNull(), F.struct(F.col(POSITION).alias("pos"), col(name).alias("v")))
        if previous:
            added.append(with_carry(F.last(anchor, True).over(up_to_here), f"__carry_prev_{i}").alias(f"__prev_{i}"))
        if following:
            added.append(with_carry(F.last(anchor, True).over(from_here), f"__carry_next_{i}").alias(f"__next_{i}"))
    return df.select("*", *added)
