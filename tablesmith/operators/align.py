"""Bring tables with different headers to one schema and stack them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.names import col, suggest_mapping

# Similarity a name must reach per strategy.
THRESHOLDS = {"auto": 0.6, "fuzzy": 0.7}


def align_to(df: DataFrame, reference: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project ``df`` to the columns of ``reference``; unmapped columns are null, other columns are dropped."""
    return df.select(*[
        col(mapping[f.name]).alias(f.name)
        if mapping.get(f.name) in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in reference.schema.fields
    ])


def align_exact(frames: Sequence[DataFrame], case_sensitive: bool = False) -> list[DataFrame]:
    """Keep the columns all tables share, in the order and spelling of the first table."""
    def key(name: str) -> str:
        return name if case_sensitive else name.lower()

    lookups = [{key(c): c for c in reversed(f.columns)} for f in frames]
    common = [c for c in frames[0].columns if all(key(c) in lookup for lookup in lookups)]
    return [f.select(*[col(lookup[key(c)]).alias(c) for c in common]) for f, lookup in zip(frames, lookups)]


def align_schemas(
    frames: Sequence[DataFrame],
    strategy: str = "auto",
    mapping: Mapping[str, str] | None = None,
    similarity_threshold: float | None = None,
    case_sensitive: bool = False,
) -> list[DataFrame]:
    """Align tables to the first one by ``auto``, ``exact``, ``fuzzy`` or ``manual`` matching of names.

    Fewer than two tables, an unknown strategy, or ``manual`` without a mapping leave the tables as they are.
    """
    frames = list(frames)
    if len(frames) < 2:
        return frames
    first, rest = frames[0], frames[1:]
    if strategy == "exact":
        return align_exact(frames, case_sensitive)
    if strategy in THRESHOLDS:
        threshold = THRESHOLDS[strategy] if similarity_threshold is None else similarity_threshold
        return [first, *[align_to(f, first, suggest_mapping(first.columns, f.columns, threshold)) for f in rest]]
    if strategy == "manual" and mapping is not None:
        return [first, *[align_to(f, first, mapping) for f in rest]]
    return frames


def _common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    numeric = (T.NumericType, T.BooleanType)
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    if isinstance(left, numeric) and isinstance(right, numeric):
        return T.DoubleType()
    return T.StringType()


def merge_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column missing in one is null there. Duplicates stay.

    A column whose type differs between tables takes a type that holds both (text if need be).
    """
    types: dict[str, T.DataType] = {}
    for frame in frames:
        for f in frame.schema.fields:
            types[f.name] = _common_type(types[f.name], f.dataType) if f.name in types else f.dataType
    cast = [
        f.select(*[
            col(x.name) if x.dataType == types[x.name] else col(x.name).cast(types[x.name]).alias(x.name)
            for x in f.schema.fields
        ])
        for f in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def schema_compatibility(frames: Sequence[DataFrame]) -> DataFrame:
    """One row per table with its row and column counts, and the shared figures of the whole set.

    All row counts come from a single job over the union of one constant column per table.
    """
    spark = frames[0].sparkSession
    everything = list(dict.fromkeys(c for f in frames for c in f.columns))
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    score = len(common) / len(everything) if everything else 0.0
    advice = []
    if score < 0.5:
        advice.append("low compatibility: consider a manual mapping")
    if common:
        advice.append(f"{len(common)} common columns can be merged")
    else:
        advice.append("no common column: standardize names or map them by hand")
    counts = reduce(
        DataFrame.unionAll,
        [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("table"), "rows") for i, f in enumerate(frames)],
    )
    widths = F.element_at(F.array(*[F.lit(len(f.columns)) for f in frames]), F.col("table") + 1)
    return counts.select(
        "table",
        "rows",
        widths.alias("columns"),
        F.lit(", ".join(common)).alias("common_columns"),
        F.lit(", ".join(c for c in everything if c not in common)).alias("unique_columns"),
        F.lit(score).alias("compatibility_score"),
        F.lit("; ".join(advice)).alias("recommendations"),
    )
