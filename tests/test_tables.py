from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

import tablesmith as ts
from tablesmith.functions import keywords
from tablesmith.functions.names import name_similarity, suggest_mapping
from tablesmith.operators.profile import column_diagnostics
from tablesmith.operators.validate import load_spec

from .conftest import plan_of, rows


def test_similarity_values():
    assert name_similarity("amount", "amount") == 1.0
    assert round(name_similarity("c_name", "s_name"), 4) == round(0.7 * 10 / 12, 4)
    assert name_similarity("", "") == 1.0
    assert suggest_mapping(["amount"], ["amounts", "amount_"], 0.5) == {"amount": "amounts"}
    # One target may serve two references.
    assert suggest_mapping(["price a", "price b"], ["price"], 0.4) == {"price a": "price", "price b": "price"}


def test_alignment(spark):
    a = spark.createDataFrame([("x", 1, 2.0)], "Name string, Qty int, Price double")
    b = spark.createDataFrame([("y", 5, "n")], "NAME string, qty long, note string")
    exact = ts.align_schemas([a, b], "exact")
    assert [f.columns for f in exact] == [["Name", "Qty"], ["Name", "Qty"]] and rows(exact[1]) == [("y", 5)]
    assert [f.columns for f in ts.align_schemas([a, b], "exact", case_sensitive=True)] == [[], []]
    manual = ts.align_schemas([a, b], "manual", {"Name": "NAME", "Price": "absent"})[1]
    assert rows(manual) == [("y", None, None)]
    assert ts.align_schemas([a, b], "other") == [a, b] and ts.align_schemas([a], "auto") == [a] and ts.align_schemas([a, b], "manual") == [a, b]
    merged = ts.merge_aligned(ts.align_schemas([a, b], "manual", {"Name": "NAME", "Qty": "qty"}))
    assert sorted(rows(merged)) == [("x", 1, 2.0), ("y", 5, None)] and dict(merged.dtypes)["Qty"] == "bigint"
    text = ts.merge_aligned([a.select("Qty"), b.select(F.col("note").alias("Qty"))])
    assert sorted(rows(text)) == [("1",), ("n",)]
    assert ts.merge_aligned([a]).columns == a.columns


def test_compatibility(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1,), (2,)], "z int")
    found = ts.schema_compatibility([a, b]).orderBy("table").collect()
    assert [(r["rows"], r["columns"], r["compatibility_score"]) for r in found] == [(1, 2, 0.0), (2, 1, 0.0)]
    assert "no common column" in found[0]["recommendations"]


def test_profile(spark, mixed):
    found = {r["column"]: r for r in ts.profile(mixed).collect()}
    assert (found["거래ID"]["n_rows"], found["거래ID"]["nunique"], found["메모"]["nulls"]) == (4, 3, 4)
    assert found["금액"]["type_candidates"][0]["type"] == "currency" and found["금액"]["type_candidates"][0]["confidence"] == 0.75
    assert found["업데이트일"]["type_candidates"][0] == ("datetime", 1.0)
    assert found["도시"]["type_candidates"][0]["type"] == "string"
    assert found["활성"]["type_candidates"][0] == ("boolean", 1.0)
    assert found["거래ID"]["sample_values"] == ["A001", "A001", "A002", "A003"]
    numbers = spark.createDataFrame([("1,000",), ("2",), ("3",), (None,)], "s string")
    stats = ts.profile(numbers).first()["stats"]
    assert (stats["count"], stats["min"], stats["p50"], stats["max"]) == (3, 2.0, 3.0, 1000.0)
    assert all(c["type"] != "string" for c in ts.profile(mixed, compat=True).where("column = '도시'").first()["type_candidates"])
    sampled = ts.profile(spark.range(5000).toDF("n"), sample_rows=500).first()
    assert sampled["n_rows"] == 5000 and 300 < sampled["nonnull"] < 700
    assert column_diagnostics(mixed)["date_candidates"] == ["주문일", "업데이트일"]


def test_validation(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "010-123-4567"), ("b", -5.0, None), (None, None, "x")], "`거래id` string, v double, phone string")
    spec = {"checks": [
        {"unique": ["거래ID", "absent"]}, {"required": ["v"]}, {"regex": {"column": "phone", "pattern": r"01[016]-\d{3,4}"}},
        {"range": {"column": "v", "min": 0, "max": 10}}, {"range": {"column": "absent", "min": 0}},
    ]}
    report = [(r["check"], r["col"], r["ok"], r["missing"], r["fails"], r["error"]) for r in ts.validate(df, spec).collect()]
    assert report == [
        ("unique", "거래ID", True, None, None, None), ("unique", "absent", False, None, None, None), ("required", "v", False, 1, None, None),
        ("regex", "phone", False, None, 2, None), ("range", "v", False, None, 1, None), ("range", "absent", False, None, None, "col_not_found"),
    ]
    assert rows(ts.summarize(ts.validate(df, spec))) == [(6, 1, False, 1 / 6)]
    two_nulls = spark.createDataFrame([(None,), (None,), ("a",)], "x string")
    assert ts.validate(two_nulls, {"checks": [{"unique": ["x"]}]}).first()["ok"] is False
    assert rows(ts.gate(df, {"checks": []})) == [(0, 0, True, 0.0, False)]
    written = []
    assert ts.gated_write(df, spec, written.append, 0.1) and len(written) == 1
    assert not ts.gated_write(df, spec, written.append, 1.0, blocked=written.append) and len(written) == 2
    path = tmp_path / "spec.yaml"
    path.write_text('checks:\n  - unique: ["거래ID"]\n  - range: {column: v, min: 0}\n', encoding="utf-8")
    assert ts.validate(df, load_spec(str(path))).count() == 2


def test_checks_are_listed_as_specified(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "x string, y int")
    spec = {"checks": [
        {"range": {"column": "y", "max": 0}}, {"unique": ["x", "nope"]}, {"required": "y"}, {"unique": "y"},
        {"regex": {"column": "gone", "pattern": "."}}, {"required": ["x"], "unique": ["x"]},
    ]}
    assert [(r["check"], r["col"], r["ok"]) for r in ts.validate(df, spec).collect()] == [
        ("range", "y", False), ("unique", "x", False), ("unique", "nope", False), ("required", "y", False), ("unique", "y", True),
        ("regex", "gone", False), ("unique", "x", False), ("required", "x", True),
    ]


def test_profile_of_long_texts_and_many_numbers(spark, monkeypatch):
    """Long values shuffle as digests with what was found in them; quartiles of many numbers are dealt by range."""
    long = ["9" * 80, "2024-01-01 " + "x" * 80, "2024-01-01 " + "x" * 79 + "y", "z" * 4000]
    data = [(i, long[i % 4] if i % 5 else None, float(i % 97) if i % 4 else None, f"{i % 50},000") for i in range(400)]
    df = spark.createDataFrame(data, "id int, l string, x double, m string").repartition(6)
    first = [tuple(r) for r in ts.profile(df).select("column", "n_rows", "nonnull", "nulls", "nunique", "type_candidates", "stats").collect()]
    assert [r[:5] for r in first] == [("id", 400, 400, 0, 400), ("l", 400, 320, 80, 4), ("x", 400, 300, 100, 97), ("m", 400, 400, 0, 50)]
    assert ("datetime", 0.4) in map(tuple, first[1][5])
    plain = {r["column"]: tuple(r)[1:] for r in ts.profile_numeric(df, ["id", "x", "m"]).collect()}
    monkeypatch.setattr("tablesmith.operators.profile.VALUES_IN_ONE_BUFFER", 10)
    dealt = [tuple(r) for r in ts.profile(df).select("column", "stats").collect()]
    for (name, *_, stats), (_, again) in zip(first, dealt):
        if name != "l":
            assert tuple(stats) == pytest.approx(plain[name]) and tuple(again) == pytest.approx(plain[name])


@pytest.mark.parametrize("threshold", [0.2, 0.5, 2 / 3, 1.0])
def test_names_are_matched_as_over_all_pairs(spark, threshold):
    """Every name has one word in common, many names two; repeated, missing and wordless names."""
    draw = random.Random(3)
    vocabulary = ["Corp", "der", "서울", *(f"w{i}" for i in range(25))]
    sides = [[" ".join(["ACME", *draw.choices(vocabulary, k=draw.randrange(5))]) + draw.choice(["", ".", "!"]) for _ in range(150)] + [None, "", "--", "acme"] for _ in range(2)]
    left, right = (spark.createDataFrame([(x,) for x in side], f"`n {i}` string") for i, side in enumerate(sides))
    found = ts.match_names(left, "n 0", right, "n 1", threshold)
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    words = lambda x: set(re.findall(r"\w+", x.lower()))
    expected = set()
    for a in set(filter(None, sides[0])):
        for b in set(filter(None, sides[1])):
            if words(a) and words(b) and len(words(a) & words(b)) / len(words(a) | words(b)) >= threshold:
                expected.add((a, b))
    result = found.collect()
    assert {(r["left_name"], r["right_name"]) for r in result} == expected and len(result) == len(expected)


def test_merged_profiles(spark, tmp_path):
    """Sketches of many small files: exact counts, distinct counts within 5 %, quartiles within 2 % of the ranks."""
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.col("id") * F.col("id") % 9973).alias("v"), F.concat(F.lit("k" * 100), F.col("id") % 7000).alias("t"),
        F.lit(None).cast("string").alias("none"), (F.col("id") % 20).alias("file"),
    )
    for part in (df.where("file < 7"), df.where("file >= 7")):
        ts.profile_sketches(part, ["file"]).write.mode("append").parquet(str(tmp_path / "sketches"))
    assert spark.read.parquet(str(tmp_path / "sketches")).count() == 60
    found = {r["column"]: r for r in ts.stored_profiles(spark, str(tmp_path / "sketches")).collect()}
    exact = {r["column"]: r for r in ts.profile(df.drop("file")).collect()}
    for name, row in found.items():
        assert [row[c] for c in ("n_rows", "nonnull", "nulls")] == [exact[name][c] for c in ("n_rows", "nonnull", "nulls")]
        assert abs(row["nunique"] - exact[name]["nunique"]) <= 0.05 * exact[name]["nunique"]
    values = sorted(r["v"] for r in df.where("v is not null").collect())
    assert (found["v"]["min"], found["v"]["max"], found["v"]["numbers"]) == (values[0], values[-1], len(values))
    assert found["v"]["mean"] == pytest.approx(sum(values) / len(values))
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        at = found["v"][name]
        assert sum(v < at for v in values) - 0.02 * len(values) <= p * len(values) <= sum(v <= at for v in values) + 0.02 * len(values)
    assert found["none"]["p50"] is None and found["t"]["numbers"] == 0
    one = {r["column"]: r["n_rows"] for r in ts.merge_profiles(ts.profile_sketches(df, ["file"]), ["file"]).where("file = 3").collect()}
    assert one == {"v": n // 20, "t": n // 20, "none": n // 20}


@pytest.mark.parametrize("sent", [100_000, 0])
def test_rows_that_break_rules(spark, monkeypatch, sent):
    """A third of all rows has one value; missing values repeat too; long texts differ in their last letter only."""
    monkeypatch.setattr("tablesmith.operators.validate.ROWS_SENT", sent)
    long = "x" * 500
    data = [(i, "hot" if i % 3 == 0 else f"v{i}", None if i in (4, 5) else float(i), long + ("a" if i < 2 else str(i))) for i in range(60)]
    data.append((59, None, float("nan"), None))
    df = spark.createDataFrame(data, "id int, `v.x` string, y double, l string").repartition(5)
    spec = {"checks": [{"unique": ["id", "V X"]}, {"range": {"column": "y", "max": 50}}, {"unique": ["y", "l", "gone"]}, {"required": ["v.x"]}]}
    marked = ts.validate_rows(df, spec)
    assert marked.columns == [*df.columns, "violations"] and marked.count() == 61
    assert "Window" not in plan_of(marked)
    found = {(r["id"], r["v.x"]): r["violations"] for r in marked.collect()}
    for i, v, y, _ in data:
        missing = y is None or y != y
        expected = ["unique:id"] * (i == 59) + ["unique:V X"] * (v == "hot") + ["range:y"] * (not missing and y > 50) + ["unique:y"] * missing
        expected += ["unique:l"] * (i < 2) + ["unique:gone"] + ["required:v.x"] * (v is None)
        assert found[i, v] == expected
    report = {(r["check"], r["col"]): r["ok"] for r in ts.validate(df, spec).collect()}
    broken = {tuple(x.split(":")) for r in found.values() for x in r}
    assert {k for k, ok in report.items() if not ok} == broken
    assert ts.validate_rows(df.limit(0), spec).count() == 0
    assert ts.validate_rows(df, {}).select("violations").distinct().collect()[0][0] == []


REQUESTS = [
    ("monthly sales by category in bar chart", ["월", "카테고리"], ["금액:sum"], "bar", []),
    ("서울과 부산 지역의 매출을 보여줘", ["도시"], ["금액:sum"], None, ["서울", "부산"]),
    ("월별 수량을 라인 차트로", ["월"], ["수량:sum"], "line", []),
    ("nothing here", [], [], None, []),
    (None, [], [], None, []),
]


def test_keywords(spark, tmp_path):
    df = spark.createDataFrame([(r[0],) for r in REQUESTS], "request string")
    tagged = ts.tag_keywords(df, "request").collect()
    assert [(r["request"], r["rows"], r["values"], r["chart"], r["filter_도시"]) for r in tagged] == REQUESTS
    kept = ts.tag_keywords(df, "request", columns=["월", "금액"]).first()
    assert (kept["rows"], kept["values"]) == (["월"], ["금액:sum"])
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"rows": {"x": ["nothing"]}}), encoding="utf-8")
    own = ts.tag_keywords(df, "request", ts.load_keyword_map(str(path))).collect()
    assert [r["rows"] for r in own] == [[], [], [], ["x"], []]


@pytest.mark.parametrize("sent", [0, 1 << 25])
def test_many_keywords_from_a_table(spark, monkeypatch, sent):
    """Equal to a search for each of 10 000 keywords; the plan does not grow with their number."""
    monkeypatch.setattr(keywords, "SENT_BYTES", sent)
    draw = random.Random(3)
    letters = "abcde월도시😀 "
    words = [("".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 5, 8]))), f"L{i % 700}") for i in range(10_000)]
    words += [("ABC", "upper"), ("", "any"), (None, "none"), ("zzz", None), ("absent word", "absent")]
    texts = ["", None, "  ", "ABCDE", "월", "도시", "a😀b", "ab\ncd", "ab\ncd"]
    texts += ["".join(draw.choice(letters + "XYZqrs") for _ in range(draw.choice([4, 30, 400]))) for _ in range(60)] + ["b" * 300_000 + "월도시"]
    df = spark.createDataFrame([(i % 5, t, 1) for i, t in enumerate(texts)], "id int, text string, row int")  # equal ids, a clashing name
    table = spark.createDataFrame(words, "keyword string, label string")
    tagged = ts.tag_by_table(df, "text", table)
    plan = plan_of(tagged)
    expected = [(i % 5, t, sorted({la for w, la in words if w is not None and la and w.lower() in (t or "").strip(" ").lower()})) for i, t in enumerate(texts)]
    found = [(r["id"], r["text"], r["tags"]) for r in tagged.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr) and tagged.columns == ["id", "text", "row", "tags"]
    assert len(plan) < len(plan_of(ts.tag_by_table(df, "text", table.limit(10)))) + 500
    assert [r["tags"] for r in ts.tag_by_table(df, "text", table.limit(0)).collect()] == [[]] * len(texts)
    assert ts.tag_by_table(df.limit(0), "text", table).count() == 0


def test_keyword_table_agrees_with_the_map(spark):
    keyword_map = {"rows": {str(i): [c] for i, c in enumerate("가나다abc")}}
    df = spark.createDataFrame([("가 A",), ("xyz",), ("bc다",), (None,)], "text string")
    table = spark.createDataFrame([(k, w) for k, ws in keyword_map["rows"].items() for w in ws], "label string, keyword string")
    by_map = [sorted(r["rows"]) for r in ts.tag_keywords(df, "text", keyword_map).collect()]
    assert sorted(by_map) == sorted(r["tags"] for r in ts.tag_by_table(df, "text", table).collect())


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "y", 4)], "m string, c string, v int")


def test_grid(small):
    grid = ts.pivot_long(small, ts.PivotSpec(rows=["m", "c"], values=[("v", "sum")]))
    assert {(r[0], r[1]): r[2] for r in rows(grid)} == {("a", "x"): 1, ("a", "y"): 2, ("b", "x"): 3, ("b", "y"): 0, (None, "x"): 0, (None, "y"): 4}
    assert ts.pivot_long(small, ts.PivotSpec(rows=["m", "c"], values=["v"], grid=False)).count() == 4
    with pytest.raises(ValueError, match="no value"):
        ts.pivot_long(small, ts.PivotSpec(rows=["m"], values=[("absent", "sum")]))
    assert "CartesianProduct" not in grid._jdf.queryExecution().executedPlan().toString()


def test_wide(small):
    wide = ts.pivot_wide(small, ts.PivotSpec(rows=["c"], columns=["m"], values=["v:sum"]))
    assert sorted(wide.columns) == ["c", "v_a", "v_b", "v_nan"]
    assert sorted(rows(wide.select("c", "v_a", "v_b", "v_nan"))) == [("x", 1, 3, 0), ("y", 2, 0, 4)]
    both = ts.pivot_wide(small, ts.PivotSpec(columns=["m", "c"], values={"v": "sum"}))
    assert both.count() == 1 and both.first()["v_b_x"] == 3 and both.first()["v_b_y"] == 0
    assert ts.pivot_wide(small, ts.PivotSpec(values=["v:count"])).columns == ["v"]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 3, 1])] + [("b", 9, None)], "k string, i int, v double")
    def one(func):
        return {r[0]: r[1] for r in rows(ts.pivot_long(df, ts.PivotSpec(rows=["k"], values=[("v", func)], order_by="i")))}
    assert one("sum") == {"a": 10.0, "b": 0.0} and one("count") == {"a": 4, "b": 0} and one("nunique") == {"a": 3, "b": 0}
    assert one("first") == {"a": 5.0, "b": 0.0} and one("last") == {"a": 1.0, "b": 0.0} and one("median") == {"a": 2.0, "b": 0.0}
    assert round(one("std")["a"], 4) == 1.9149 and round(one("var")["a"], 4) == 3.6667 and one("mean")["a"] == 2.5
    with pytest.raises(ValueError):
        one("guess")


def test_months_and_time_series(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "A", 10), ("2024/02/10", "A", 20), ("2025.01.01", "A", 5), ("2024-02-01", "B", 7), ("bad", "B", 1)],
        "`주문일` string, `카테고리` string, `금액` int",
    )
    assert sorted({r[0] for r in rows(ts.month_bucket(df).select("월"))}, key=str) == ["2024-01", "2024-02", "2025-01", None]
    assert ts.month_bucket(df, compat=True).where("`월` = 'NaT'").count() == 1
    table = ts.pivot_long(df.where("`금액` > 1"), ts.PivotSpec(rows=["월", "카테고리"], values=[("금액", "sum")]))
    done = ts.add_running_total(ts.add_mom(table, ["금액"], "월", "카테고리"), ["금액"], "월", "카테고리")
    a = [r[2:] for r in rows(done.where("`카테고리` = 'A'"), "월")]
    assert a == [(10, 0.0, 10), (20, 1.0, 30), (5, -0.75, 35)]
    b = [r[2:] for r in rows(done.where("`카테고리` = 'B'"), "월")]
    assert b == [(0, 0.0, 0), (7, 0.0, 7), (0, -1.0, 7)]
    yearly = ts.add_running_total(table, ["금액"], "월", "카테고리", reset="year")
    assert [r["금액_YTD"] for r in yearly.where("`카테고리` = 'A'").orderBy("월").collect()] == [10, 30, 5]
    summary = ts.period_summary(df, "2024-01-01", "2024-02-10").first()
    assert (summary["amount_total"], summary["quantity_total"], summary["rows"], summary["period"]) == (37.0, 0.0, 3, "2024-01-01~2024-02-10")
    totals = ts.pivot_subtotals(ts.month_bucket(df), "월", "카테고리", ["금액"])
    assert {(r[0], r[2]): r[3] for r in rows(totals) if r[0] == "category"} == {("category", "A"): 35, ("category", "B"): 8}
    assert ts.group_sum(df.withColumn("k", F.when(F.col("카테고리") == "A", "A")), ["k"], ["금액"]).collect() == [("A", 35)]


def test_kpis(spark, mixed):
    k = ts.kpi_metrics(mixed).first()
    assert (k["rows"], k["missing_rate"], k["dup_rate"], k["numeric_col_rate"], k["date_parse_rate_guess"]) == (4, 0.1429, 0.0, 0.0, 0.2857)
    stages = {r["stage"]: r for r in ts.kpi_before_after(mixed).collect()}
    assert stages["after"]["numeric_col_rate"] == 0.2857 and stages["after"]["clean_seconds"] > 0
    doubled = mixed.unionAll(mixed)
    assert rows(ts.diff_metrics(doubled, mixed)) == [("before", 8, 4), ("after", 4, 0)]
    assert dict(rows(ts.report_kpi(mixed, 1.23456)))["clean_seconds"] == 1.235


def test_distinct_rows_of_long_texts(spark):
    """Long texts that differ in their last character are two; equal ones, missing and empty ones are told apart as rows are."""
    long = "x" * 100_000
    df = spark.createDataFrame([(1, long), (1, long), (1, long + "a"), (1, None), (1, None), (1, ""), (2, long)], "id int, text string")
    assert ts.kpi_metrics(df).first()["dup_rate"] == round(2 / 7, 4)


def test_profile_counts_floats_and_approximates(spark):
    df = spark.createDataFrame([(0.0, "x"), (-0.0, "x"), (1e-12, None), (2e-12, "y"), (float("nan"), "y"), (None, "z"), (1e7, "z")], "v double, s string")
    found = {r["column"]: r for r in ts.profile(df).collect()}
    assert (found["v"]["nonnull"], found["v"]["nulls"], found["v"]["nunique"]) == (5, 2, 4)
    exact = {r["column"]: r["nunique"] for r in ts.profile_columns(df).collect()}
    assert exact == {"v": 4, "s": 3} and found["s"]["nunique"] == 3
    assert found["v"]["type_candidates"][0]["type"] == "currency"
    rough = {r["column"]: r for r in ts.profile(df, approx_distinct=True).collect()}
    assert rough["s"]["nunique"] == 3 and rough["v"]["type_candidates"] == found["v"]["type_candidates"]
    assert ts.profile(df.limit(0)).count() == 2


def test_grid_of_many_levels(spark):
    table = spark.range(300_000).selectExpr("id as user", "concat('t', id % 6) as kind", "1 as n")
    grid = ts.pivot_long(table, ts.PivotSpec(rows=["user", "kind"], values=[("n", "sum")]))
    assert grid.count() == 1_800_000 and grid.agg({"n": "sum"}).first()[0] == 300_000
    assert "BroadcastNestedLoop" not in plan_of(grid)


def test_report_finds_the_month_among_the_keys(spark):
    data = [("2024-01-05", "a", 1.0), ("2024-02-05", "a", 3.0), ("2024-01-05", "b", 5.0), ("2024-02-05", "b", 9.0)]
    table = spark.createDataFrame(data, "`주문일` string, cat string, v double")
    reports = [ts.pivot_report(table, ts.PivotSpec(rows=keys, values=[("v", "sum")])) for keys in (["월", "cat"], ["cat", "월"])]
    first, second = (rows(r.select(*sorted(r.columns)), "cat", "월") for r in reports)
    assert first == second
    with pytest.raises(ValueError, match="month"):
        ts.pivot_report(table, ts.PivotSpec(rows=["cat", "주문일"], values=[("v", "sum")]))
