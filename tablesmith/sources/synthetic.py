"""Deterministic messy transactions for benchmarks and tests, the same for any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_CITIES = ["서울", "부산", "대구", "인천", "광주", "대전"]


def _pick(salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n))


def messy_transactions(spark: SparkSession, rows: int, duplicate_percent: int = 10) -> DataFrame:
    """``rows`` transactions: repeated ids, three date layouts, three currency styles, Y/N flags, sparse notes."""
    repeated = _pick("repeat", 100) < duplicate_percent
    ident = F.when(repeated, _pick("id", max(rows, 1))).otherwise(F.col("id"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), _pick("day", 200).cast("int")).cast("string")
    layout = _pick("layout", 3)
    date = F.when(layout == 0, day).when(layout == 1, F.translate(day, "-", "/")).otherwise(F.translate(day, "-", "."))
    # The sum of two uniform draws stands in for a bell-shaped amount.
    amount = F.format_number(_pick("amount", 100_000) + _pick("amount2", 100_000), 0)
    style = _pick("style", 4)
    money = (
        F.when(style == 0, F.concat(F.lit("₩ "), amount))
        .when(style == 1, F.concat(F.lit("KRW "), amount))
        .otherwise(F.concat(amount, F.lit("원")))
    )
    seconds = _pick("second", 86_400)
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return spark.range(rows).select(
        ident.alias("거래ID"),
        date.alias("주문일"),
        F.concat_ws(" ", day, clock).alias("업데이트일"),
        money.alias("금액"),
        F.element_at(F.array(*[F.lit(c) for c in _CITIES]), (_pick("city", 6) + 1).cast("int")).alias("도시"),
        F.when(_pick("flag", 2) == 0, F.lit("Y")).otherwise(F.lit("N")).alias("활성"),
        F.when(_pick("note", 10) < 3, F.lit("")).otherwise(F.lit("메모")).alias("메모"),
    )


def sales(spark: SparkSession, rows: int) -> DataFrame:
    """Clean sales rows for pivots: 200 days × 4 categories × 4 cities."""
    return spark.range(rows).select(
        F.col("id").alias("거래ID"),
        F.date_add(F.lit("2024-01-01").cast("date"), _pick("day", 200).cast("int")).cast("string").alias("주문일"),
        F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (_pick("category", 4) + 1).cast("int")).alias("카테고리"),
        F.element_at(F.array(*[F.lit(c) for c in _CITIES[:4]]), (_pick("city", 4) + 1).cast("int")).alias("도시"),
        (_pick("amount", 500_000) + 1000).alias("금액"),
        (_pick("quantity", 9) + 1).alias("수량"),
    )
