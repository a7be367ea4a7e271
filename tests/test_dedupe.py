from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import tablesmith as ts

from .conftest import plan_of, rows


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [("B001", "2024-06-01 09:00:00", 1), ("B001", "2024-06-01 11:00:00", 2), ("B002", None, 3), ("B002", "2024-01-01", 4), (None, None, 5), (None, None, 6)],
        "`거래id` string, `업데이트일` string, n int",
    )


def test_last_by(orders):
    kept = ts.dedupe(orders, ["거래ID"], "last_by:업데이트일", "n")
    assert sorted(r[2] for r in rows(kept)) == [2, 4, 5]


def test_first_and_last(orders):
    assert sorted(r[2] for r in rows(ts.dedupe(orders, "거래id", "first", "n"))) == [1, 3, 5]
    assert sorted(r[2] for r in rows(ts.dedupe(orders, "거래id", "last", "n"))) == [2, 4, 6]
    assert sorted(r[2] for r in rows(ts.dedupe(orders, "거래id", "any", "n"))) == [1, 3, 5]
    with pytest.raises(ValueError):
        ts.dedupe(orders, "거래id", "last")


def test_all_columns_and_report(spark, orders):
    doubled = orders.unionAll(orders)
    assert ts.dedupe(doubled).count() == 6
    assert rows(ts.dedupe_report(doubled).select("keys", "input_rows", "output_rows", "removed")) == [("ALL", 12, 6, 6)]
    assert rows(ts.dedupe_report(orders, "거래id", "last_by:업데이트일").select("sorted_by", "removed")) == [("업데이트일", 3)]


def test_hot_key_is_cut_down_before_the_shuffle(spark):
    hot = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    kept = ts.dedupe(hot, "k", "last", "id")
    plan = plan_of(kept)
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    result = dict(rows(kept))
    assert result[0] == 19998 and len(result) == kept.count() == hot.select("k").distinct().count()
