"""Column profiles: counts, samples, type candidates and numeric statistics, one row per column."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from ..functions.lexicon import MONTH_SOURCES, PROFILE_BOOL, PROFILE_CURRENCY, PROFILE_DATE_HINT, PROFILE_NUMERIC
from ..functions.names import col, snake
from ..functions.quantiles import exact_quantiles, quantiles_of_counts
from ..functions.report import count_where, rows_from_aggregates
from ..functions.text import to_number
from .clean import present

STATISTICS = "count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"


def as_text(df: DataFrame, name: str) -> Column:
    """Value written the way a person would: plain decimals instead of exponents."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(present(df, name), _plain_number(col(name)))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    return col(name).cast("string")


def _plain_number(number: Column) -> Column:
    return F.coalesce(number.try_cast("decimal(38,10)").cast("string"), number.cast("string"))


def _candidate_tests(text: Column) -> dict[str, Column]:
    return {
        "hint": text.rlike(PROFILE_DATE_HINT),
        "boolean": F.lower(text).isin(PROFILE_BOOL),
        "currency": text.rlike(PROFILE_CURRENCY),
        "numeric": text.rlike(PROFILE_NUMERIC),
    }


def _ranked(share: dict[str, Column], compat: bool) -> Column:
    """Top three candidates as ARRAY<STRUCT<type, confidence>>, best first, ties in listing order."""
    hint = share["hint"]
    entries = [
        ("datetime", F.when(hint > 0.1, hint * 0.8)),
        ("boolean", share["boolean"]),
        ("currency", share["currency"]),
        ("numeric", share["numeric"]),
        ("datetime", hint),
    ]
    if not compat:
        best = F.greatest(*[c for _, c in entries])
        entries.insert(0, ("string", F.when(best < 0.5, F.lit(1.0))))
    listed = F.array(*[
        F.when(c.isNotNull(), F.struct((-c).alias("order"), F.lit(i).alias("place"), F.lit(t).alias("type")))
        for i, (t, c) in enumerate(entries)
    ])
    top = F.slice(F.array_sort(F.array_compact(listed)), 1, 3)
    return F.transform(top, lambda s: F.struct(s["type"].alias("type"), (-s["order"]).alias("confidence")))


def profile_types(df: DataFrame, compat: bool = False) -> DataFrame:
    """Type candidates per column with their match ratios over all rows (missing values never match).

    ``string`` leads when nothing else reaches one half; ``compat`` leaves that entry out.
    """
    places = [f"t{i}" for i in range(len(df.columns))]
    stacked = df.select(*[as_text(df, n).alias(p) for n, p in zip(df.columns, places)]).unpivot([], places, "place", "value")
    tests = _candidate_tests(F.col("value"))
    counted = stacked.groupBy("place").agg(
        F.count(F.lit(1)).alias("rows"), *[count_where(test).alias(key) for key, test in tests.items()]
    )
    share = {key: F.col(key) / F.col("rows") for key in tests}
    return counted.select(
        _column_of(places, df.columns),
        share["hint"].alias("datetime_ratio"),
        *[share[key].alias(f"{key}_ratio") for key in ("boolean", "currency", "numeric")],
        _ranked(share, compat).alias("type_candidates"),
    )


def _column_of(places: list[str], names: list[str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in zip(places, names) for x in pair])
    return F.element_at(lookup, F.col("place")).alias("column")


#: Distinct numbers of a column whose counts one aggregation buffer may hold; more are dealt by range.
VALUES_IN_ONE_BUFFER = 250_000
#: Bytes of a value that travel as they are; a longer one is known by a digest of 128 bits.
LONG_VALUE = 64


def short_key(text: Column) -> Column:
    """A text, or the digest of a long one: equal for equal texts and no others."""
    return F.when(F.octet_length(text) > LONG_VALUE, F.concat(F.lit("\x00"), F.md5(text))).otherwise(text)


def value_key(df: DataFrame, name: str) -> Column:
    """Short text that equal values of a column share and others do not; null where the value is missing."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        # Floats keep their shortest exact text here, which tells all values apart; adding zero turns -0.0 into 0.0.
        return F.when(present(df, name), (col(name) + F.lit(0.0)).cast("string"))
    return short_key(as_text(df, name))


def keys_per_place(df: DataFrame, places: list[str]) -> DataFrame:
    """(place, key, n): the values of all columns stacked, equal ones counted before the shuffle; long ones as a digest."""
    stacked = df.select(*[value_key(df, n).alias(p) for n, p in zip(df.columns, places)]).unpivot([], places, "place", "key")
    return stacked.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"))


def _counted_values(df: DataFrame, places: list[str]) -> DataFrame:
    """(place, key, n, text, number, hits): every value of every column once, from one scan and one shuffle.

    Equal values are counted before the shuffle, and numbers are read and type tests run once per distinct value. Long
    values send a digest with what was found in them; their text stays behind.
    """
    floats = [p for p, n in zip(places, df.columns) if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType))]
    texts = [p for p, n in zip(places, df.columns) if isinstance(df.schema[n].dataType, T.StringType)]
    whole = [F.when(present(df, n), (col(n) + F.lit(0.0)).cast("string")) if p in floats else as_text(df, n) for p, n in zip(places, df.columns)]
    stacked = df.select(*[t.alias(p) for t, p in zip(whole, places)]).unpivot([], places, "place", "value")

    def hits(value: Column) -> Column:
        """Results of the type tests, a bit for each."""
        return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(_candidate_tests(value).values())), F.lit(0))

    def number(value: Column) -> Column:
        plain = value.try_cast("double")
        return F.when(F.col("place").isin(texts), to_number(value)).otherwise(F.when(~F.isnan(plain), plain))

    is_long = F.octet_length("value") > LONG_VALUE
    keyed = stacked.select("place", short_key(F.col("value")).alias("key"), F.when(is_long, hits(F.col("value"))).alias("long_hits"), F.when(is_long, number(F.col("value"))).alias("long_number"))
    # Plain numbers in the buffers, so that Spark aggregates by hash; equal values have equal ones.
    counted = keyed.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"), F.max("long_hits").alias("long_hits"), F.max("long_number").alias("long_number"))
    text = F.when(F.col("place").isin(floats), _plain_number(F.col("key").try_cast("double"))).otherwise(F.col("key"))
    return counted.withColumn("text", text).select(
        "place", "key", "n", F.coalesce("long_hits", hits(F.col("text"))).alias("hits"),
        F.when(F.col("long_hits").isNotNull(), F.col("long_number")).otherwise(number(F.col("key"))).alias("number"),
    )


def _count_values(counted: DataFrame, places: list[str], names: list[str], compat: bool) -> DataFrame:
    """Counts, distinct counts, type candidates and numeric figures of all columns, from their counted values."""
    tests = ("hint", "boolean", "currency", "numeric")
    weighed = F.col("number").isNotNull()
    sums = counted.groupBy("place").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("nonnull"),
        F.count("key").alias("nunique"),
        *[F.coalesce(F.sum(F.when(F.col("hits").bitwiseAND(1 << i) > 0, F.col("n"))), F.lit(0)).alias(key) for i, key in enumerate(tests)],
        F.sum(F.when(weighed, F.col("n"))).alias("numbers"), F.count("number").alias("values"),
        F.sum(F.col("number") * F.col("n")).alias("total"), F.min("number").alias("min"), F.max("number").alias("max"),
    )
    share = {key: F.col(key) / F.col("rows") for key in tests}
    return sums.select(
        "place", _column_of(places, names), F.col("rows").alias("n_rows"), "nonnull", (F.col("rows") - F.col("nonnull")).alias("nulls"),
        "nunique", _ranked(share, compat).alias("type_candidates"), "numbers", "values", (F.col("total") / F.col("numbers")).alias("mean"), "min", "max",
    )


def _numeric_figures(counted: DataFrame, found: list) -> dict[str, tuple]:
    """STATISTICS per place, the rest of them from the same counted values: spread around the known mean, and quartiles by
    running counts. Few distinct numbers fit one buffer; more are dealt by range."""
    quarters = [0.25, 0.5, 0.75]
    numbers = counted.where(F.col("number").isNotNull()).select("place", "number", "n")
    means = F.create_map(*[F.lit(x) for r in found for x in (r["place"], r["mean"])])
    apart = F.col("number") - F.element_at(means, F.col("place"))
    buffered = [r["place"] for r in found if r["values"] <= VALUES_IN_ONE_BUFFER]
    in_buffer = F.when(F.col("place").isin(buffered), F.col("number"))
    rows = numbers.where(F.col("place").isin([r["place"] for r in found])).groupBy("place").agg(
        F.sum(F.col("n") * apart * apart).alias("spread"), F.percentile(in_buffer, F.array(*map(F.lit, quarters)), F.col("n")).alias("quartiles")
    ).collect()
    spread, quartiles = {r["place"]: r["spread"] for r in rows}, {r["place"]: r["quartiles"] for r in rows}
    large = [r["place"] for r in found if r["place"] not in buffered]
    if large:
        # Texts of one number, such as 1 and 1.0, are different values there.
        once = numbers.where(F.col("place").isin(large)).groupBy("place", "number").agg(F.sum("n").alias("n"))
        quartiles |= {r["place"]: r["quartiles"] for r in quantiles_of_counts(once, ["place"], "number", "n", quarters, "quartiles").collect()}
    figures = {}
    for r in found:
        p, n = r["place"], r["numbers"]
        deviation = (spread[p] / (n - 1)) ** 0.5 if n > 1 else None
        figures[p] = (n, r["mean"], deviation, r["min"], *quartiles[p], r["max"])
    return figures


def profile_columns(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Rows, non-null, null and distinct counts per column in a single job."""
    if not approx_distinct:
        places = [f"c{i}" for i in range(len(df.columns))]
        counted = keys_per_place(df, places).groupBy("place").agg(
            F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("nonnull"), F.count("key").alias("nunique")
        )
        return counted.select(_column_of(places, df.columns), "n_rows", "nonnull", (F.col("n_rows") - F.col("nonnull")).alias("nulls"), "nunique")
    aggregates = {"rows": F.count(F.lit(1))}
    rows = []
    for i, n in enumerate(df.columns):
        value = F.when(present(df, n), col(n))
        aggregates[f"c{i}"] = F.count(value)
        aggregates[f"d{i}"] = F.approx_count_distinct(value)
        rows.append({
            "column": F.lit(n),
            "n_rows": F.col("rows"),
            "nonnull": F.col(f"c{i}"),
            "nulls": F.col("rows") - F.col(f"c{i}"),
            "nunique": F.col(f"d{i}"),
        })
    return rows_from_aggregates(df, aggregates, rows)


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column after thousands commas are removed."""
    names = columns or df.columns
    numbers = df.select(*[
        (to_number(col(n)) if isinstance(df.schema[n].dataType, T.StringType) else F.when(present(df, n), col(n).cast("double")))
        .alias(n)
        for n in names
    ])
    moments = numbers.agg(*[
        F.struct(F.count(col(n)), F.avg(col(n)), F.stddev_samp(col(n)), F.min(col(n)), F.max(col(n))) for n in names
    ]).first()
    quartiles = exact_quantiles(numbers, names, [0.25, 0.5, 0.75], sizes=[m[0] for m in moments])
    rows = [(n, *m[:4], *quartiles[n], m[4]) for n, m in zip(names, moments)]
    return df.sparkSession.createDataFrame(rows, f"column string, {STATISTICS}")


def _is_numeric(row: Row) -> bool:
    return any(c["type"] == "numeric" and c["confidence"] > 0.5 for c in row["type_candidates"])


def profile(
    df: DataFrame, sample_rows: int | None = None, approx_distinct: bool = False, compat: bool = False, in_order: DataFrame | None = None
) -> DataFrame:
    """Full profile: counts, five sample values, type candidates and, for numeric columns, statistics.

    The whole table is profiled unless ``sample_rows`` asks for a sample; ``n_rows`` always counts the table. Sample values
    are those of the first rows, of ``in_order`` if the table itself is not in order.
    """
    source, total = df, None
    if sample_rows:
        total = df.count()
        if total > sample_rows:
            source = df.sample(fraction=sample_rows / total, seed=42)
    places, stats = [f"c{i}" for i in range(len(df.columns))], {}
    if approx_distinct:
        counts = profile_columns(source, approx_distinct=True).join(profile_types(source, compat), "column")
        found = {r["column"]: r for r in counts.collect()}
        numeric = [n for n in df.columns if n in found and _is_numeric(found[n])]
        stats = {r["column"]: tuple(r)[1:] for r in profile_numeric(source, numeric).collect() if r["count"]} if numeric else {}
    else:
        # Two passes over the counted values; the source is read once.
        counted = _counted_values(source, places).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = {r["column"]: r for r in _count_values(counted, places, df.columns, compat).collect()}
            numeric = [r for r in found.values() if r["numbers"] and _is_numeric(r)]
            by_place = _numeric_figures(counted, numeric) if numeric else {}
            stats = {r["column"]: by_place[r["place"]] for r in numeric}
        finally:
            counted.unpersist()
    first = source if in_order is None or source is not df else in_order
    head = first.select(*[as_text(df, n).alias(f"t{i}") for i, n in enumerate(df.columns)]).limit(5).collect()

    out = []
    for i, n in enumerate(df.columns):
        c = found.get(n)
        out.append((
            n, total if total is not None else (c["n_rows"] if c else 0), *((c["nonnull"], c["nulls"], c["nunique"]) if c else (0, 0, 0)),
            [r[f"t{i}"] for r in head], [(x["type"], x["confidence"]) for x in c["type_candidates"]] if c else [], stats.get(n),
        ))
    schema = (
        "column string, n_rows long, nonnull long, nulls long, nunique long, sample_values array<string>, "
        "type_candidates array<struct<type:string,confidence:double>>, "
        f"stats struct<{STATISTICS}>"
    )
    return df.sparkSession.createDataFrame(out, schema)


def column_diagnostics(df: DataFrame) -> dict:
    """Names, repeated names and date-like columns of a table (metadata only)."""
    names = df.columns
    wanted = {snake(n) for n in MONTH_SOURCES}
    return {
        "columns": names,
        "duplicates": sorted({n for n in names if names.count(n) > 1}),
        "date_candidates": [n for n in names if snake(n) in wanted or "일" in n or "date" in n.lower()],
    }
