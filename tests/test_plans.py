from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import Row, functions as F, types as T

import tablesmith as ts
from tablesmith.plans.preprocess import preprocess_file, preview
from tablesmith.plans.recipe import cleaning_recipe, imputation_recipe, outlier_recipe, step_parts
from tablesmith.plans.report import preprocess_summary
from tablesmith.sources import csv
from tablesmith.sources.csv import charset_of, output_path, read_null_tokens, stored_lines
from tablesmith.sources.synthetic import messy_transactions, sales
from tablesmith.streaming import drops, ledger as ledgers

from .conftest import plan_of, rows

# Own rows: every currency, flag and date style once, two orders in two states, gaps in three columns.
TRANSACTIONS = '''거래ID,주문일,업데이트일,금액,도시,활성,메모
T10,2023/11/05,2023-11-06,"₩ 2,468",인천,Y,"첫 주문, 예약"
T20,2023.11.06,2023-11-07,"KRW 15,000",대전,예,
T20,2023-11-06,2023-11-09,"15,000원",대전,TRUE,바뀜
T30,11/08/2023,2023-11-08,"-4,750",광주,아니오,환불
T40,,2023-11-10,"2,000.25",제주,false,
T50,2023-11-11,2023-11-12,"640",울산,N,"두 줄
메모"
'''


@pytest.fixture()
def transactions(tmp_path):
    path = tmp_path / "transactions.csv"
    path.write_text(TRANSACTIONS, encoding="utf-8")
    return str(path)


CELLS = ["a", "", "NA", "plain text", '5" pipe', 'say "hi"', "two\nlines", "x\r\ny", '"', '",', ',"', "\n\n", 'q"\n"q', "a,b", "예", '""', "long " * 30 + "\n" + "cell " * 30, " padded "]


def _csv_text(draw, n, ending):
    def cell(x):
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r') and x != '5" pipe' or draw.random() < 0.2 else x

    rows = [["k", "one", "two\nheads"]] + [[str(i), draw.choice(CELLS), draw.choice(CELLS)] for i in range(n)]
    return ending.join(",".join(map(cell, r)) for r in rows) + draw.choice(["", ending])


@pytest.mark.parametrize(("block", "ending", "encoding"), [(128, "\n", "utf-8"), (300, "\r\n", "utf-8-sig"), (1 << 20, "\n", "utf-8"), (100, "\n", "cp949")])
def test_quoted_breaks_are_read_by_many_tasks(spark, tmp_path, block, ending, encoding):
    """Equal to the reader that takes a file in one task, also where a quoted cell goes over several blocks."""
    draw = random.Random(block)
    for name, n in (("a.csv", 200), ("b.csv", 1), ("c.csv", 0), ("d.csv", 40)):
        (tmp_path / name).write_bytes(_csv_text(draw, n, ending).encode(encoding))
    reader = spark.read.option("header", True).option("escape", '"').option("nullValue", "").option("multiLine", True)
    whole = reader.option("encoding", charset_of(spark, encoding)).csv(str(tmp_path))
    # That reader takes the first line break it sees for the file's, and leaves the other half of a longer one in the last cell.
    last = F.regexp_replace(whole.columns[-1], "\r$", "")
    whole = read_null_tokens(whole.withColumn(whole.columns[-1], F.when(last != "", last)))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        lines = stored_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > (20 if block < 1000 else 3)
        found = ts.read_csv_table(spark, str(tmp_path), typed=False, source_file="file")
        assert found.columns == [*whole.columns, "file"]
        counts = {r["file"].rsplit("/", 1)[1]: r["count"] for r in found.groupBy("file").count().collect()}
        assert counts == {"a.csv": 200, "b.csv": 1, "d.csv": 40}
        assert sorted(map(repr, found.drop("file").collect())) == sorted(map(repr, whole.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_recipe_from_yaml(spark, transactions, tmp_path):
    target = str(tmp_path / "weekly")
    recipe_file = tmp_path / "recipe.yaml"
    recipe_file.write_text(f'''
name: newest orders
steps:
- {{action: clean, params: {{normalize: {{currency_split: true, date_fmt: "YYYY-MM-DD", trim: true}}, type_infer: true}}}}
- {{action: dedupe, params: {{keep: "last_by:업데이트일", keys: [거래id]}}}}
source: {{path: "{transactions}"}}
target: {{path: "{target}"}}
''', encoding="utf-8")
    ts.run_recipe(spark, ts.Recipe.from_yaml(str(recipe_file)))
    stored = ts.read_csv_table(spark, target)
    found = rows(stored.select("거래id", "금액", "활성", "업데이트일"), "거래id")
    assert [r[:3] for r in found] == [("T10", 2468.0, True), ("T20", 15000.0, True), ("T30", -4750.0, False), ("T40", 2000.25, False), ("T50", 640.0, False)]
    assert found[1][3] == "2023-11-09 00:00:00"


def test_step_builders(spark):
    assert step_parts({"type": "dedupe", "keys": ["k"], "operation": "dedupe"}) == ("dedupe", {"keys": ["k"]})
    step = {"type": "outlier", "operation": "x", "method": "iqr", "action": "clip", "columns": ["v"]}
    assert step_parts(step) == ("outlier", {"method": "iqr", "action": "clip", "columns": ["v"]})
    with pytest.raises(ValueError):
        ts.run_steps(spark.range(1), [{"action": "fly"}])
    with pytest.raises(ValueError):
        step_parts({"params": {}})
    df = spark.createDataFrame([("k", "1", 1.0), ("k", "2", 2.0), ("j", "3", 900.0)] + [("x%d" % i, "4", None if i == 0 else float(i)) for i in range(9)], "k string, n string, v double")
    out = ts.run_recipe(spark, cleaning_recipe("c", dedupe_keys=["k"], keep="first", order_by=["n"]), df)
    assert out.count() == 11
    filled = ts.run_recipe(spark, imputation_recipe("i", {"v": "zero"}), df)
    assert filled.where("v is null").count() == 0
    assert ts.run_recipe(spark, outlier_recipe("o", ["v"], "iqr", "remove"), df).count() == 11


def test_preprocess_file_and_gate(spark, transactions, tmp_path):
    target = str(tmp_path / "out.parquet")
    spec = {"checks": [{"required": ["금액"]}]}
    out = preprocess_file(spark, transactions, target, spec=spec, impute="zero:금액", outliers="iqr_clip:금액@k=1.5", keys=["거래id"], keep="last_by:업데이트일")
    assert spark.read.parquet(target).count() == 5 and preview(out, 2).count() == 2
    blocked = str(tmp_path / "blocked.parquet")
    preprocess_file(spark, transactions, blocked, spec={"checks": [{"required": ["absent"]}]})
    assert not (tmp_path / "blocked.parquet").exists()
    # The currency column is empty in three of five rows, so imputation drops it.
    assert rows(preprocess_summary(out, out))[0][1:] == (5, 7)


def test_reading(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿이름,n,x,b,when\r\n\"a, \"\"b\"\"\",1,1.5,TRUE,2024-01-01\r\nNA,2,,FALSE,null\r\n".encode("utf-8"))
    df = ts.read_csv_table(spark, str(path))
    assert df.dtypes == [("이름", "string"), ("n", "bigint"), ("x", "double"), ("b", "boolean"), ("when", "string")]
    assert rows(df, "n") == [('a, "b"', 1, 1.5, True, "2024-01-01"), (None, 2, None, False, None)]
    assert dict(ts.read_csv_table(spark, str(path), typed=False).dtypes)["n"] == "string"


def test_encodings(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-8"), ("b.csv", "utf-8-sig"), ("c.csv", "cp949")):
        (tmp_path / name).write_bytes(TRANSACTIONS.replace("₩", "원").encode(encoding))
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in ts.detect_encodings(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": "utf-8", "b.csv": "utf-8-sig", "c.csv": "cp949"}
    tables = [ts.read_csv_table(spark, str(tmp_path / n), e) for n, e in found.items()]
    tables += [ts.read_csv_table(spark, str(tmp_path / n)) for n in found]
    assert len({tuple(rows(t, "거래ID", "업데이트일")) for t in tables}) == 1 and tables[0].columns[0] == "거래ID"
    assert ts.read_csv_table(spark, str(tmp_path)).groupBy("거래ID", "업데이트일", "도시").count().filter("count = 3").count() == 6
    assert "두 줄\n메모" in [r["메모"] for r in tables[0].collect()]
    with pytest.raises(ValueError, match="quotes"):
        ts.read_csv_table(spark, str(tmp_path / "a.csv"), multiline=False)


KOREAN = "번호,도시,메모\n" + "".join(f"{i},{c},{m}\n" for i, (c, m) in enumerate([("서울", "첫 주문"), ("부산", "재고 없음"), ("뷁", "펲시 똠방각하"), ("Seoul", "plain")]))
WESTERN = "id,city,note\n" + "".join(f"{i},{c},{m}\n" for i, (c, m) in enumerate([("Köln", "große Stücke"), ("Orléans", "déjà vu, naïveté".replace(",", "")), ("Málaga", "año ¿qué?"), ("Bath", "20 £")]))


@pytest.mark.parametrize(("text", "encoding", "found"), [
    (KOREAN, "utf-8", "utf-8"), (KOREAN, "utf-8-sig", "utf-8-sig"), (KOREAN, "cp949", "cp949"), (KOREAN, "utf-16", "utf-16"),
    (KOREAN, "utf-16-le", "utf-16-le"), (KOREAN, "utf-16-be", "utf-16-be"),
    (WESTERN, "utf-8", "utf-8"), (WESTERN, "latin-1", "latin-1"), (WESTERN, "utf-16-le", "utf-16-le"), (WESTERN, "utf-16-be", "utf-16-be"),
    ("a,b\n1,plain\n", "ascii", "utf-8"), ("a,b\n1,Ärger\n", "latin-1", "latin-1"), ("a,b\n1,예\n", "cp949", "cp949"),
    (WESTERN.replace("\n", "\r\n"), "utf-16-be", "utf-16-be"), (WESTERN.replace("\n", "\r\n"), "utf-16-le", "utf-16-le"),
])
def test_statistical_encodings(spark, tmp_path, text, encoding, found):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode(encoding))
    [row] = ts.detect_encodings(spark, str(path)).collect()
    assert row["encoding"] == found and 0.7 <= row["score"] <= 1
    table = ts.read_csv_table(spark, str(tmp_path), typed=False)
    assert [",".join(r) for r in [table.columns, *table.collect()]] == text.splitlines()


def test_damaged_file_keeps_its_encoding(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes((KOREAN * 5).encode() + b"9,\xeb\xb6,cut\n")
    [row] = ts.detect_encodings(spark, str(tmp_path)).collect()
    assert row["encoding"] == "utf-8" and 0.9 < row["score"] < 1


def test_writing(spark, tmp_path, mixed):
    assert output_path("/x/a.csv") == "/x/a_clean.csv" and output_path("/x/a.dat", "_v") == "/x/a_v.dat.csv"
    ts.write_table(mixed, str(tmp_path / "m"))
    assert rows(ts.read_csv_table(spark, str(tmp_path / "m"), typed=False), "업데이트일") == rows(mixed, "업데이트일")


def test_folder_run(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("k,amount\n1,₩ 10\n2,₩ 20\n", encoding="utf-8")
    (source / "b.csv").write_text("k,amount\n3,₩ 30\n", encoding="utf-8")
    (source / "c.csv").write_text("other\nx\n", encoding="utf-8")
    report = ts.run_folder(spark, str(source), str(tmp_path / "out"))
    assert sorted((r["source_file"].rsplit("/", 1)[1], r["rows"]) for r in report.collect()) == [("a.csv", 2), ("b.csv", 1), ("c.csv", 1)]
    assert report.select("group").distinct().count() == 2 and {r["status"] for r in report.collect()} == {"ok"}
    (source / "d.csv").write_text("k,k_2,amount\n1,2,3\n", encoding="utf-8")
    broken = ts.run_folder(spark, str(source), str(tmp_path / "again"), keys=["amount"], order_by=["k"])
    states = {r["source_file"].rsplit("/", 1)[1]: (r["rows"], r["status"].split(":")[0]) for r in broken.collect()}
    assert states["a.csv"] == (2, "ok") and states["d.csv"] == (1, "ok") and states["c.csv"][0] == 0 and states["c.csv"][1] != "ok"
    (tmp_path / "none").mkdir()
    assert ts.run_folder(spark, str(tmp_path / "none"), str(tmp_path / "out2")).count() == 0


def test_one_bad_file_of_a_folder(spark, tmp_path):
    """Four results and five status rows, all files with one header; short rows are filled up as before."""
    source = tmp_path / "in"
    source.mkdir()
    for i in range(5):
        more = ",surplus" if i == 3 else ""
        (source / f"f{i}.csv").write_text(f"k,amount,note\n{i},₩ 1{i},a\n9{i},₩ 2{i}{',b' + more if i < 4 else ''}\n", encoding="utf-8")
    report = {r["source_file"].rsplit("/", 1)[1]: r for r in ts.run_folder(spark, str(source), str(tmp_path / "out")).collect()}
    assert {n: (r["rows"], r["status"]) for n, r in report.items()} == {
        **{f"f{i}.csv": (2, "ok") for i in (0, 1, 2, 4)}, "f3.csv": (0, "ragged: 1 rows have more cells than the header")}
    out = spark.read.parquet(str(tmp_path / "out" / "group=0"))
    assert out.count() == 8 and sorted(r["amount"] for r in out.collect()) == [10.0, 11.0, 12.0, 14.0, 20.0, 21.0, 22.0, 24.0]


def test_report_and_log(spark, tmp_path):
    tables = ts.build_report(sales(spark, 2000))
    written = ts.write_report(tables, str(tmp_path / "report"))
    assert set(written) == {"kpi", "sample", "profile", "pivot"}
    assert spark.read.parquet(written["sample"]).count() == 50
    assert spark.read.parquet(written["pivot"]).count() == 7 * 4
    ts.log_run(spark, str(tmp_path / "log"), "clean", {"rows": 3})
    ts.log_run(spark, str(tmp_path / "log"), "dedupe", {"rows": 2})
    log = spark.read.json(str(tmp_path / "log"))
    assert sorted((r["kind"], json.loads(r["payload"])["rows"]) for r in log.collect()) == [("clean", 3), ("dedupe", 2)]


def test_generator_is_stable(spark):
    a, b = messy_transactions(spark, 1000), messy_transactions(spark, 1000).repartition(3)
    assert sorted(rows(a)) == sorted(rows(b))
    assert 880 <= a.select("거래ID").distinct().count() < 1000


# Streams -----------------------------------------------------------------------------------------------------

SCHEMA = "id long, day string, kind string, amount string"


def test_byte_patterns_count_the_same_in_shortened_lines(spark):
    draw = random.Random(4)
    pieces = ["a", "é", "ß", "\xb0\xa1", "\x81A", "\xc3\xa9", "\0", "plain words, ", '"', "\xff", "Zz", "\xe0\x80\x80"]
    texts = spark.createDataFrame([("".join(draw.choices(pieces, k=draw.randrange(30))),) for _ in range(400)], "t string")
    patterns = (csv._HIGH, csv._UTF8, csv._CP949_USUAL, csv._LATIN_LETTER, csv._LATIN_PAIR, f"(?:{csv._CP949_USUAL})|{csv._CP949_OTHER}")
    short = csv.short_ascii(F.col("t"))
    counts = texts.select(F.char_length(short).alias("n"), F.char_length("t").alias("m"), *[
        (csv._removed(F.col("t"), p) == csv._removed(short, p)).alias(f"same{i}") for i, p in enumerate(patterns)
    ]).collect()
    assert all(r[2:] == (True,) * len(patterns) for r in counts) and sum(r["n"] for r in counts) < 0.7 * sum(r["m"] for r in counts)


def _drop(folder, name, lines):
    (folder / name).write_text("id,day,kind,amount\n" + "\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture()
def dropped(tmp_path):
    folder = tmp_path / "drops"
    folder.mkdir()
    _drop(folder, "one.csv", ['1,2024-01-01,a,"₩ 1,000"', '2,2024/01/02,b,"₩ 2,000"'])
    _drop(folder, "two.csv", ['1,2024-02-01,a,"₩ 5,000"', '3,2024.02.02,b,'])
    return folder


def test_reports_per_drop_and_restart(spark, dropped, tmp_path):
    static = spark.read.schema(SCHEMA).option("header", True).csv(str(dropped))
    plan = ts.infer_clean(static)
    assert [c.kind for c in plan.columns] == ["keep", "date", "text", "currency"]
    target, state = str(tmp_path / "reports"), str(tmp_path / "state")
    spec = ts.PivotSpec(rows=["월", "kind"], values=[("amount", "sum")], date_col="day")

    def run():
        stream = drops.read_drops(spark, str(dropped), SCHEMA, files_per_batch=1)
        drops.report_drops(stream, target, state, spec, plan).awaitTermination()

    run()
    def report(name):
        [folder] = (tmp_path / "reports").glob(f"{name}-*")
        return spark.read.parquet(f"{folder}/pivot")

    assert sorted(rows(report("one.csv"))) == [("2024-01", "a", 1000.0), ("2024-01", "b", 2000.0)]
    _drop(dropped, "three.csv", ['9,2024-03-01,a,"₩ 9"'])
    run()
    assert rows(report("three.csv")) == [("2024-03", "a", 9.0)]


def test_a_large_drop_is_aggregated_in_parts(spark, tmp_path, monkeypatch):
    (tmp_path / "drops").mkdir()
    _drop(tmp_path / "drops", "big.csv", [f"{i},2024-01-{i % 28 + 1:02d},k{i % 3},{1000 - i}" for i in range(200)])
    _drop(tmp_path / "drops", "small.csv", ["7,2024-02-01,a,5"])
    read, build = [], drops.build_report

    def watched(df, *args, **kwargs):
        read.append(len(df.inputFiles()))
        return build(df, *args, **kwargs)

    monkeypatch.setattr(drops, "ROWS_PER_FILE", 20)
    monkeypatch.setattr(drops, "build_report", watched)
    stream = drops.read_drops(spark, str(tmp_path / "drops"), "id int, day string, kind string, amount double")
    spec = ts.PivotSpec(rows=["월", "kind"], values=[("amount", "sum")], date_col="day")
    drops.report_drops(stream, str(tmp_path / "reports"), str(tmp_path / "state"), spec).awaitTermination()
    assert min(read) >= 10
    [folder] = (tmp_path / "reports").glob("big.csv-*")
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/sample").collect()) == list(range(50))
    profile = {r["column"]: r for r in spark.read.parquet(f"{folder}/profile").collect()}
    assert set(profile) == {"id", "day", "kind", "amount"} and profile["id"]["n_rows"] == 200 and profile["id"]["sample_values"] == [str(i) for i in range(5)]
    assert sorted(rows(spark.read.parquet(f"{folder}/pivot"))) == [("2024-01", f"k{k}", float(sum(1000 - i for i in range(200) if i % 3 == k))) for k in range(3)]


class _Handle:
    """State and timers of one key in memory, and how many calls they got."""

    def __init__(self):
        self.calls, self.timers, self.value = 0, [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_key_costs_few_state_calls_and_ends_at_its_own_time():
    processor, handle = drops._Newest(T.StructType.fromDDL("user_id long, event_id long, ts timestamp"), "ts", "event_id", "ts", 10_000), _Handle()
    processor.init(handle)
    row = lambda event, second: Row(user_id=1, event_id=event, ts=datetime(2024, 1, 1, 0, 0, second))
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    clock = lambda at: type("Clock", (), {"getCurrentWatermarkInMs": lambda self: start + at})()
    found = [[r["event_id"] for r in processor.handleInputRows((1,), iter(batch), clock(0))] for batch in (
        [row(5, 1), row(4, 3), row(3, 3), row(9, 2)], [row(8, 2)], [row(2, 8), row(1, 5)], [row(7, 8)])]
    assert found == [[3], [], [2], []] and handle.timers == [start + 13_000]
    assert handle.calls == 3 + 1 + 2 + 1
    list(processor.handleExpiredTimer((1,), clock(13_500), None))
    assert handle.timers == [start + 13_000, start + 18_000] and handle.value is not None
    list(processor.handleExpiredTimer((1,), clock(18_500), None))
    assert len(handle.timers) == 2 and handle.value is None
    assert [r["event_id"] for r in processor.handleInputRows((1,), iter([row(6, 20)]), clock(18_500))] == [6]


def test_changed_files_replace_their_results(spark, dropped, tmp_path, monkeypatch):
    target, ledger, read_files = str(tmp_path / "results"), str(tmp_path / "ledger"), []

    def read(paths):
        read_files.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return ts.read_csv_table(spark, paths, typed=False, source_file="source_file")

    def work(table):
        return table.groupBy("source_file", "kind").agg(F.count(F.lit(1)).alias("n"))

    def run():
        return ledgers.refresh_changed(spark, str(dropped), target, ledger, read, work)

    def results():
        found = ledgers.current_results(spark, target, ledger).collect()
        return sorted((r["source_file"].rsplit("/", 1)[1], r["kind"], r["n"]) for r in found)

    old = [("one.csv", "a", 1), ("one.csv", "b", 1), ("two.csv", "a", 1), ("two.csv", "b", 1)]
    assert run() == 2 and results() == old and run() == 0
    # The run ends after the results and before the ledger: nothing of it is seen, and it is done again.
    _drop(dropped, "two.csv", ["1,2024-02-01,c,1", "2,2024-02-01,c,2"])
    (dropped / "sub").mkdir()
    _drop(dropped / "sub", "three.csv", ["1,2024-02-01,d,1"])
    with monkeypatch.context() as patch:
        patch.setattr(ledgers, "_enter", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    assert results() == old
    _drop(dropped, "two.csv", ["1,2024-02-01,e,1"])
    assert run() == 2 and run() == 0
    assert results() == [("one.csv", "a", 1), ("one.csv", "b", 1), ("three.csv", "d", 1), ("two.csv", "e", 1)]
    # A file without rows has no results left; one that is gone keeps them.
    _drop(dropped, "one.csv", [])
    (dropped / "two.csv").unlink()
    assert run() == 1 and results() == [("three.csv", "d", 1), ("two.csv", "e", 1)]
    assert read_files == [["one.csv", "two.csv"], ["three.csv", "two.csv"], ["three.csv", "two.csv"], ["one.csv"]]


def test_ledger_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert ledgers.refresh_changed(spark, str(tmp_path / "none"), str(tmp_path / "t"), str(tmp_path / "l"), None, None) == 0


def test_gate_sends_bad_batches_to_quarantine(spark, dropped, tmp_path):
    stream = drops.read_drops(spark, str(dropped), SCHEMA, files_per_batch=1)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    drops.gated_stream(stream, {"checks": [{"required": ["amount"]}]}, good, bad, str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(good).count() == 2 and spark.read.parquet(bad).count() == 2


def test_stream_results_equal_batch(spark, tmp_path):
    events = spark.range(300).select(
        F.col("id"), (F.col("id") % 7).alias("k"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7919 % 86400 * 5).alias("ts"), (F.col("id") * 1.5).alias("v")
    )
    folder = str(tmp_path / "events")
    events.repartition(4).write.parquet(folder)

    def drain(build, mode, name):
        stream = build(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder))
        query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    last = drain(lambda s: drops.dedupe_stream_last_by(s, ["k"], "ts", "id"), "complete", "last_rows")
    assert sorted(rows(last.select("k", "id"))) == sorted(rows(ts.dedupe(events, "k", "last_by:ts", "id").select("k", "id")))
    daily = drain(lambda s: drops.pivot_stream(s, "ts", "k", [("v", "sum")], "30 days"), "complete", "daily")
    batch = events.groupBy(F.date_trunc("day", "ts").alias("period"), "k").agg(F.sum("v").alias("v"))
    assert sorted(rows(daily)) == sorted(rows(batch))
    monthly = drain(lambda s: drops.pivot_stream(s, "ts", "k", [("v", "count")], "30 days", window=None), "complete", "monthly")
    assert monthly.agg(F.sum("v")).first()[0] == 300
    first = drain(lambda s: drops.dedupe_stream_first(s.unionAll(s), ["id"], "ts", "30 days"), "append", "first_rows")
    assert first.count() == 300


# Driver contract -----------------------------------------------------------------------------------------------

def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for name in ("orders", "events"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    for name in ("level1_clean", "impute_interpolate_global", "pivot_long_null_level"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.count() == len(con.execute(entry.oracle_sql()[name]).fetchall())


def test_types_and_cleaning_from_one_pass(spark, transactions):
    text = ts.read_csv_table(spark, transactions, typed=False).withColumn("n", F.lit("7")).withColumn("t", F.lit("TRUE"))
    once = ts.level1_clean(text, untyped=True)
    twice = ts.level1_clean(ts.infer_types(text))
    assert once.schema.simpleString() == twice.schema.simpleString() and dict(once.dtypes)["n"] == "bigint"
    assert rows(once, "업데이트일", "주문일") == rows(twice, "업데이트일", "주문일")


def test_stream_forgets_each_key_at_its_own_time(spark, tmp_path):
    """A key ends after its quiet days, not with the others; the stream is stopped and started again in between."""
    schema = "k string, id long, by long, at timestamp, x timestamp_ntz, v double"

    def batch(number, *rows):
        data = [(k, i, by, datetime(2024, 1, day), datetime(2024, 1, day), None) for k, i, by, day in rows]
        spark.createDataFrame(data, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        newest = drops.dedupe_stream_last_by_ttl(stream, ["k"], "by", "id", "at", "1 day", timedelta(days=5))
        write = lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out{number}/batch={n}"))
        newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["k"], r["id"], r["by"], r["at"].day, r["x"].day) for r in spark.read.schema(schema).parquet(str(tmp_path / f"out{number}")).collect())

    assert batch(0, ("a", 1, 50, 1), ("a", 2, 50, 1), ("a", 3, 7, 1), ("b", 4, 50, 1)) == [("a", 1, 50, 1, 1), ("b", 4, 50, 1, 1)]
    assert batch(1, ("b", 6, 40, 5), ("c", 7, None, 5)) == [("c", 7, None, 5, 5)]
    assert batch(2, ("c", 8, 1, 8), ("d", 9, 1, 9)) == [("c", 8, 1, 8, 8), ("d", 9, 1, 9, 9)]
    # The watermark is day 8: a has been quiet for seven days, b only for three. A row of day 2 is late.
    assert batch(3, ("a", 10, 3, 9), ("b", 11, 45, 9), ("late", 12, 1, 2)) == [("a", 10, 3, 9, 9)]


def test_deal_only_tables_of_few_parts(spark):
    df = spark.range(1000).coalesce(1)
    assert ts.deal(df, 6).rdd.getNumPartitions() == 6 and ts.deal(df, 6).count() == 1000
    wide = spark.range(0, 1000, 1, 8)
    assert "Exchange" in plan_of(ts.deal(df, 6)) and "Exchange" not in plan_of(ts.deal(wide, 6))
