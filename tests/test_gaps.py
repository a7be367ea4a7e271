from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablesmith as ts
from tablesmith.functions.ordered import neighbours
from tablesmith.functions.quantiles import exact_quantiles, grouped_quantiles
from tablesmith.operators.impute import parse_impute_rules
from tablesmith.operators.outlier import parse_outlier_rules

from .conftest import plan_of, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group, many ties in the first order column, long gaps."""
    rng = random.Random(7)
    data = [
        (i, 0 if i % 2 else rng.randrange(20), rng.randrange(5), None if rng.random() < 0.6 else float(rng.randrange(100)))
        for i in range(2000)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "id long, g long, t long, v double").repartition(16)


def expected(df, groups, action):
    pdf = df.toPandas().sort_values([*groups, "t", "id"]).reset_index(drop=True)
    column = pdf.groupby(groups)["v"].transform(action) if groups else action(pdf["v"])
    return {k: (None if pd.isna(x) else round(x, 6)) for k, x in zip(pdf["id"], column)}


ACTIONS = {
    "ffill": lambda s: s.ffill(),
    "bfill": lambda s: s.bfill(),
    "interpolate": lambda s: s.interpolate(method="linear"),
}


@pytest.mark.parametrize("strategy", list(ACTIONS))
@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("limit", [None, 100])
def test_ordered_fills_match_pandas(spark, skewed, strategy, groups, limit, monkeypatch):
    if limit:
        monkeypatch.setattr(neighbours, "__defaults__", (*neighbours.__defaults__[:-1], limit))
    filled = ts.fill(skewed, strategy, "v", order_by=["t", "id"], partition_by=groups)
    found = {r["id"]: (None if r["v"] is None else round(r["v"], 6)) for r in filled.select("id", "v").collect()}
    assert found == expected(skewed, groups, ACTIONS[strategy])
    assert filled.columns == skewed.columns


def test_fixed_interpolation_and_mode(spark):
    gaps = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, 3.0), (5, None)], "i int, v double")
    assert [r[1] for r in rows(ts.fill(gaps, "interpolate", "v", order_by="i"), "i")] == [None, 1.0, 2.0, 3.0, 3.0]
    letters = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    assert sorted(r[0] for r in rows(ts.fill(letters, "mode", "s"))) == ["a", "a", "a", "b", "b"]


def test_order_is_required(spark, skewed):
    with pytest.raises(ValueError):
        ts.fill(skewed, "ffill", "v")


def test_chunked_window_never_collects_the_table_in_one_task(spark, skewed):
    plan = plan_of(ts.fill(skewed, "ffill", "v", order_by=["t", "id"]))
    assert "broadcast" in plan.lower()
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    # The only single-task window runs over one row per chunk.
    assert all("last_0" in line or "SinglePartition" in line for line in single) and len(single) <= 1


def test_simple_fills(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, None), (3, float("nan"), "y"), (4, 4.0, "x")], "i int, v double, s string")
    assert [r[1] for r in rows(ts.fill(df, "zero", "v"), "i")] == [2.0, 0.0, 0.0, 4.0]
    assert [r[2] for r in rows(ts.fill(df, "zero", "s"), "i")] == ["x", "0", "y", "x"]
    assert [r[1] for r in rows(ts.fill(df, "avg", "v"), "i")] == [2.0, 3.0, 3.0, 4.0]
    assert [r[1] for r in rows(ts.fill(df, "median", "v"), "i")] == [2.0, 3.0, 3.0, 4.0]
    assert rows(ts.fill(df, "mean", "s"), "i")[1][2] is None
    assert ts.fill(df, "drop", "v").count() == 2
    assert rows(ts.fill(df, "const", "s", "?"), "i")[1][2] == "?"
    assert rows(ts.fill(df, "something", "s", "!"), "i")[1][2] == "!"
    assert ts.fill(df, "something", "s") is df


def test_strategies_drop_first_and_keep_order(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, 2.0, None), (3.0, 4.0, None), (5.0, 9.0, 1.0)], "a double, b double, c double")
    out = ts.handle_missing_values(df, {"b": "drop", "a": "median", "c": "zero"})
    assert sorted(rows(out)) == [(3.0, 4.0), (4.0, 2.0), (5.0, 9.0)]
    assert parse_impute_rules("median:금액;zero:수량") == {"금액": "median", "수량": "zero"}


def test_impute_report(spark):
    df = spark.createDataFrame([(1, "1,0", None), (2, None, None), (3, "4", 7)], "i int, s string, n int")
    out, report = ts.impute(df, [
        {"col": "n", "method": "ffill"}, {"col": "s", "method": "median"}, {"col": "i", "method": "zero"},
        {"col": "x", "method": "zero"}, {"col": "n", "method": "interpolate"},
    ], order_by="i")
    assert rows(report, "rule") == [
        (1, "n", "ffill", 0, "ok"), (2, "s", "median", 1, "ok"), (3, "i", "zero", None, "noop"),
        (4, "x", "zero", None, "skip:not_found"), (5, "n", "interpolate", None, "skip:unknown_method"),
    ]
    assert out.where("i = 2").first()["s"] == "4.0"


def test_patterns_and_suggestions(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "b"), (3, 1.0, "c"), (4, 2.0, "d")], "i int, v double, s string")
    first = ts.missing_patterns(df).orderBy("column").collect()
    assert [(r["column"], r["missing"]) for r in first] == [("i", 0), ("s", 1), ("v", 2)]
    assert (first[0]["missing_cells"], first[0]["max_missing_in_row"], first[0]["avg_missing_in_row"], first[0]["columns_with_missing"]) == (3, 2, 0.75, 2)
    assert dict(rows(ts.suggest_strategies(df).select("column", "strategy"))) == {"v": "zero", "s": "mode"}


@pytest.mark.parametrize("buffer_rows", [10, 500, 1_000_000])
def test_exact_quantiles(spark, buffer_rows):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.lognormal(0, 4, 3000), "tied": rng.integers(0, 3, 3000).astype(float), "same": np.full(3000, 5.0),
        "signed": np.where(np.arange(3000) % 3 == 0, -0.5, rng.normal(0, 1e6, 3000)),
    }
    df = spark.createDataFrame(pd.DataFrame(values)).repartition(8)
    probabilities = [0.0, 0.25, 0.5, 0.731, 1.0]
    found = exact_quantiles(df, list(values), probabilities, buffer_rows)
    for name, v in values.items():
        assert np.allclose(found[name], np.quantile(v, probabilities), rtol=1e-12), name


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [None]}


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(np.arange(5000) % 3 == 0, "hot", rng.choice(list("abc"), 5000)), "v": rng.integers(0, 400, 5000) / 4})
    found = {r["g"]: r["quantiles"] for r in grouped_quantiles(spark.createDataFrame(pdf).repartition(9), ["g"], "v", [0.25, 0.5]).collect()}
    wanted = pdf.groupby("g")["v"].quantile([0.25, 0.5]).unstack()
    assert {g: list(q) for g, q in found.items()} == {g: list(wanted.loc[g]) for g in wanted.index}


def test_iqr_golden(spark):
    df = spark.createDataFrame([(1234.0,), (1234.0,), (12000.0,), (-3500.0,), (None,)], "`금액` double")
    out, report = ts.outlier(df, parse_outlier_rules("iqr_clip:금액@k=1.5"))
    assert sorted((r[0] for r in rows(out)), key=lambda x: (x is None, x)) == [-3500.0, 1234.0, 1234.0, 9738.0, None]
    row = report.first()
    assert (row["q1"], row["q3"], row["hi"], row["changed"], row["status"]) == (50.5, 3925.5, 9738.0, 1, "ok")


def test_outlier_actions_and_rules(spark):
    df = spark.createDataFrame([(i, 1000 if i == 0 else i % 5) for i in range(50)], "i int, v int")
    info = {"v": {"method": "iqr"}}
    assert ts.handle_outliers(df, info, "remove").count() == 49
    assert ts.handle_outliers(df, info, "mark").where("v__outlier").count() == 1
    clipped = ts.handle_outliers(df, info)
    assert dict(clipped.dtypes)["v"] == "double" and clipped.agg(F.max("v")).first()[0] < 10
    assert ts.handle_outliers(df, {}) is df
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert rows(ts.zscore_clip(same, "v")) == [(5.0,), (5.0,)]
    twice, report = ts.outlier(df, [{"col": "v", "method": "iqr"}, {"col": "v", "method": "z", "threshold": 1}])
    pdf = pd.Series([1000.0 if i == 0 else float(i % 5) for i in range(50)])
    q1, q3 = pdf.quantile(0.25), pdf.quantile(0.75)
    once = pdf.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).round()
    assert math.isclose(report.where("rule = 2").first()["mean"], once.mean())
    assert parse_outlier_rules("iqr_clip:금액@multiplier=1.5;zscore_clip:수량@z=3;broken") == [
        {"method": "iqr_clip", "col": "금액", "multiplier": 1.5}, {"method": "zscore_clip", "col": "수량", "z": 3.0}]


@pytest.mark.parametrize("buffer_rows,n", [(100, 4000), (100_000, 200_001)])
def test_quantiles_between_heavy_values_end(spark, buffer_rows, n):
    """Half zeros and half ones, few heavy values, and ranks on the border of two ties."""
    table = spark.range(n).selectExpr("cast(id % 2 as double) as half", "cast(id % 5 as double) as five", "if(id < 3, double(id), 7.0D) as rare")
    probabilities = [0.0, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0]
    found = exact_quantiles(table, ["half", "five", "rare"], probabilities, buffer_rows)
    columns = {"half": [i % 2 for i in range(n)], "five": [i % 5 for i in range(n)], "rare": [i if i < 3 else 7 for i in range(n)]}
    for name, values in columns.items():
        assert found[name] == pytest.approx(list(np.quantile(np.array(values, float), probabilities)))
