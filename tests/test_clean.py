from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import tablesmith as ts
from tablesmith.functions.dates import parse_date
from tablesmith.functions.text import is_amount, is_number, to_amount, to_number, trim_spaces
from tablesmith.sources.synthetic import messy_transactions

from .conftest import plan_of, rows


def test_mixed_currency_table(mixed):
    cleaned = ts.level1_clean(mixed)
    assert cleaned.columns == ["거래id", "주문일", "업데이트일", "금액", "도시", "활성", "금액__currency"]
    assert rows(cleaned.select("금액", "활성", "금액__currency", "주문일", "업데이트일"), "업데이트일") == [
        (1234.0, True, "KRW", "2024-07-01", "2024-07-02 09:00:00"),
        (1234.0, True, "KRW", "2024-07-01", "2024-07-02 10:00:00"),
        (12000.0, False, "KRW", "2024-07-03", "2024-07-04 12:30:00"),
        (-3500.0, False, None, "2024-07-05", "2024-07-06 08:00:00"),
    ]


def test_cleaning_twice_changes_nothing(mixed):
    once = ts.level1_clean(mixed)
    twice = ts.level1_clean(once)
    assert rows(once.drop("금액__currency"), "업데이트일") == rows(twice.drop("금액__currency", "금액_currency"), "업데이트일")


def test_typed_columns_skip_every_stage(spark):
    typed = spark.createDataFrame([(1000, True), (2000, False)], "amount long, active boolean")
    assert ts.level1_clean(typed).schema == ts.snake_columns(typed).schema


DATES = [
    ("2024-01-01", "2024-01-01"), ("2024/12/31", "2024-12-31"), ("2024.06.15", "2024-06-15"), ("20240615", "2024-06-15"),
    ("2024-1-5", "2024-01-05"), ("07/05/2024", "2024-07-05"), ("July 5, 2024", "2024-07-05"), ("5 Jul 2024", "2024-07-05"),
    ("2024-07", "2024-07-01"), ("2024년 7월 03일", "2024-07-03"), ("2024-07-01T10:00:00Z", "2024-07-01"),
    ("invalid", None), ("2024-02-30", None), ("2024", None), ("12345", None), ("2024061", None), ("24-07-02", None),
    ("10:30", None), ("Junk 5, 2024", None), ("", None), (None, None),
]


def test_dates(spark):
    df = spark.createDataFrame(DATES, "s string, expected string")
    wrong = df.select("s", parse_date(F.col("s")).alias("found"), "expected").where(~F.col("found").eqNullSafe(F.col("expected")))
    assert rows(wrong) == []


def test_date_hint_and_time(spark):
    df = spark.createDataFrame([("15.06.2024",), ("20240615",)], "s string")
    assert rows(df.select(parse_date(F.col("s"), "DD.MM.YYYY"))) == [("2024-06-15",), ("2024-06-15",)]
    timed = spark.createDataFrame([("2024-01-01 10:00:00",)], "s string")
    assert timed.select(parse_date(F.col("s"), keep_time=True)).first()[0] == "2024-01-01 10:00:00"
    assert timed.select(parse_date(F.col("s"), as_type="date").cast("string")).first()[0] == "2024-01-01"


def test_amount_test_agrees_with_reading(spark):
    texts = ["₩ 1,234", "-3,500", "1.5.6", "5-", "--5", "-", ".", "abc", "", "1e5", "USD -.5", "5.", "원 12"]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", is_amount(F.col("s")), to_amount(F.col("s")), is_number(F.col("s")), to_number(F.col("s"))
    )
    for text, amount_like, amount, number_like, number in rows(found):
        kept = "".join(ch for ch in text if ch in "0123456789.-")
        try:
            wanted = float(kept)
        except ValueError:
            wanted = None
        assert (amount_like, amount) == (wanted is not None, wanted), text
        assert number_like == (number is not None), text


def test_unicode_blanks(spark):
    df = spark.createDataFrame([("  a　 b\t c ",)], "s string")
    assert df.select(trim_spaces(F.col("s"))).first()[0] == "a b c"


def test_currency_codes(spark):
    df = spark.createDataFrame([("₩1000",), ("1000원",), ("$50",), ("€30",), ("¥100",)], "`금액` string")
    assert [r[1] for r in rows(ts.level1_clean(df))] == ["KRW", "KRW", "USD", "EUR", "JPY"]
    assert {r[1] for r in rows(ts.level1_clean(df, currency_mode="compat"))} == {"KRW"}
    assert ts.level1_clean(df, currency_split=False).columns == ["금액"]


def test_order_of_stages(spark):
    df = spark.createDataFrame([("1", "20240101"), ("0", "20240102")], "flag string, day string")
    cleaned = ts.level1_clean(df)
    assert rows(cleaned) == [(True, 20240101.0), (False, 20240102.0)]
    assert rows(ts.level1_clean(df, date_cols=["day"]).select("day")) == [("2024-01-01",), ("2024-01-02",)]


def test_protect_keeps_place_names(spark):
    df = spark.createDataFrame([("수원",), ("병원",), ("서울",)], "city string")
    assert rows(ts.level1_clean(df, protect=["city"])) == [("수원",), ("병원",), ("서울",)]


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame([("a", None, None), (None, None, None), ("b", 1.5, None)], "x string, y double, z string")
    assert rows(ts.level1_clean(df), "x") == [("a", None), ("b", 1.5)]
    assert ts.drop_empty(df).count() == 2
    kept = ts.level1_clean(df, drop_empty=False)
    assert kept.columns == ["x", "y", "z"] and kept.count() == 3
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert ts.drop_empty(nan).count() == 1


def test_frozen_plan_survives_json(mixed):
    plan = ts.infer_clean(mixed)
    again = ts.CleanPlan.from_json(plan.to_json())
    assert again == plan
    assert rows(ts.apply_clean(mixed, again), "업데이트일") == rows(ts.level1_clean(mixed), "업데이트일")


def test_result_does_not_depend_on_partitions(spark):
    messy = messy_transactions(spark, 3000)
    expected = sorted(rows(ts.level1_clean(messy)), key=repr)
    for n in (1, 7, 64):
        assert sorted(rows(ts.level1_clean(messy.repartition(n))), key=repr) == expected


def test_cleaning_is_one_stage_without_python(spark):
    plan = plan_of(ts.level1_clean(messy_transactions(spark, 1000)))
    assert "Exchange" not in plan and "Python" not in plan


def test_wide_table(spark):
    wide = spark.range(50).select(*[F.concat(F.lit("₩ "), F.col("id")).alias(f"c{i}") for i in range(150)])
    assert all(c.kind == "currency" for c in ts.infer_clean(wide).columns)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Order  ID!", "order-id", "주문 일"])
    assert ts.snake_columns(df).columns == ["order_id", "order_id_2", "주문_일"]
    assert ts.resolve(df.columns, ["ORDER ID"]) == ["order-id"] or ts.resolve(df.columns, ["ORDER ID"]) == ["Order  ID!"]
    with pytest.raises(KeyError):
        ts.resolve(df.columns, ["absent"])
    assert ts.resolve(["total_amount", "city"], ["Amount", "none"], mode="contains") == ["total_amount"]
    doubled = spark.createDataFrame([(1, 2)], ["a", "b"]).toDF("a", "a")
    assert rows(ts.drop_duplicate_columns(doubled)) == [(1,)]
