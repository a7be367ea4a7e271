"""Pivot, time-series, KPI, pipeline and streaming queries."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

import tablesmith as ts
from pyspark.sql import DataFrame, functions as F
from tablesmith.session import checkpoint_dir
from tablesmith.streaming import drops, ledger as ledgers

from .tables import GAPPY_EVENTS_SQL, MESSY_ORDERS_CLEAN_SQL, MONTHLY_SQL, gappy_events, messy_orders, monthly_orders, table


def filter_in(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return ts.filter_in(orders, {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "absent": [1]})


def month_bucket(spark, sf):
    return ts.month_bucket(monthly_orders(spark, sf), "order_date", name="month").select("o_orderkey", "month")


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 2) for c in columns})


def pivot_long(spark, sf):
    spec = ts.PivotSpec(rows=["월", "priority", "status"], values=[("price", "sum")])
    return _round(ts.pivot_long(monthly_orders(spark, sf), spec), "price")


def pivot_long_null_level(spark, sf):
    spec = ts.PivotSpec(rows=["user_id", "event_type"], values={"value": "sum", "event_id": "count"})
    return _round(ts.pivot_long(gappy_events(spark, sf), spec), "value")


def pivot_wide(spark, sf):
    spec = ts.PivotSpec(rows=["priority"], columns=["status"], values=["price:sum", "o_orderkey:count"], filters={"status": ["F", "O", "P"]})
    wide = ts.pivot_wide(monthly_orders(spark, sf), spec)
    return _round(wide, *[c for c in wide.columns if c.startswith("price_")])


def pivot_aggs(spark, sf):
    base = monthly_orders(spark, sf)
    copies = base.select("priority", *[F.col("price").alias(f) for f in ("sum", "mean", "count", "min", "max", "median", "std", "var")],
                         F.col("o_orderkey").alias("nunique"), F.col("price").alias("first"), F.col("price").alias("last"), "o_orderkey")
    values = [(c, c) for c in copies.columns if c not in ("priority", "o_orderkey")]
    found = ts.pivot_long(copies, ts.PivotSpec(rows=["priority"], values=values, order_by="o_orderkey"))
    return _round(found, "sum", "mean", "min", "max", "median", "std", "first", "last").withColumn("var", F.round("var", -2))


def group_sum(spark, sf):
    return _round(ts.group_sum(gappy_events(spark, sf), ["event_type", "user_id"], ["value"]), "value")


def _monthly(spark, sf):
    spec = ts.PivotSpec(rows=["월", "priority"], values=[("price", "sum")], grid=True)
    return ts.pivot_long(monthly_orders(spark, sf), spec)


def mom(spark, sf):
    return ts.add_mom(_monthly(spark, sf), ["price"], "월", "priority").select("월", "priority", F.round("price_MoM", 4).alias("price_MoM"))


def running_total(spark, sf):
    return ts.add_running_total(_monthly(spark, sf), ["price"], "월", "priority").select("월", "priority", F.round("price_YTD", 2).alias("price_YTD"))


def ytd(spark, sf):
    return ts.add_running_total(_monthly(spark, sf), ["price"], "월", "priority", reset="year").select("월", "priority", F.round("price_YTD", 2).alias("price_YTD"))


def pivot_report(spark, sf):
    report = ts.pivot_report(monthly_orders(spark, sf), ts.PivotSpec(rows=["월", "status"], values=[("price", "sum")]))
    return _round(report, "price", "price_YTD").withColumn("price_MoM", F.round("price_MoM", 4))


def pivot_report_category_first(spark, sf):
    """The same report with the category as the first row key."""
    report = ts.pivot_report(monthly_orders(spark, sf), ts.PivotSpec(rows=["status", "월"], values=[("price", "sum")]))
    return _round(report, "price", "price_YTD").withColumn("price_MoM", F.round("price_MoM", 4))


def pivot_subtotals(spark, sf):
    dated = ts.month_bucket(monthly_orders(spark, sf), "order_date")
    return ts.pivot_subtotals(dated, "월", "priority", ["price"])


def period_summary(spark, sf):
    found = ts.period_summary(table(spark, sf, "orders"), "1995-01-01", "1996-06-30", "o_totalprice", "o_custkey", "o_orderdate")
    return _round(found, "amount_total", "quantity_total")


def kpi_metrics(spark, sf):
    return ts.kpi_metrics(gappy_events(spark, sf).select("user_id", "event_type", "value"))


def kpi_before_after(spark, sf):
    return ts.kpi_before_after(messy_orders(spark, sf)).drop("clean_seconds")


def diff_metrics(spark, sf):
    before = gappy_events(spark, sf).select("user_id", "event_type", "sparse")
    return ts.diff_metrics(before, ts.dedupe(before))


def report_kpi(spark, sf):
    return ts.report_kpi(gappy_events(spark, sf).select("user_id", "event_type", "value"))


def preprocess(spark, sf):
    """Messy orders cleaned, one order per customer kept, gaps filled, outliers clipped."""
    orders = messy_orders(spark, sf).withColumn("Amount", F.when(F.col(" Order ID ") % 11 != 0, F.col("Amount")))
    found = ts.preprocess(
        orders, keys=["Cust-Key"], keep="last_by:order_date", order_by="order_id",
        impute="median:amount", outliers="iqr_clip:amount@multiplier=0.5",
    )
    return found.withColumn("amount", F.round("amount", 3))


def recipe_weekly(spark, sf):
    recipe = ts.Recipe.from_dict({"name": "weekly", "steps": [
        {"action": "clean", "params": {"type_infer": True, "normalize": {"trim": True, "currency_split": True, "date_fmt": "YYYY-MM-DD"}}},
        {"type": "dedupe", "keys": ["cust_key"], "keep": "last_by:order_date", "order_by": ["order_id"]},
    ]})
    return ts.run_recipe(spark, recipe, messy_orders(spark, sf))


def report_tables(spark, sf):
    """The pivot of the report tables over cleaned orders."""
    cleaned = ts.level1_clean(messy_orders(spark, sf))
    tables = ts.build_report(cleaned, ts.PivotSpec(rows=["월", "priority"], values=[("amount", "sum")], date_col="order_date"), parts=["kpi", "pivot"])
    return tables["pivot"]


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(stream, spark, mode, name):
    """Run a stream over everything that is there and return the table of the last emitted state."""
    target = _folder(spark, name)

    def keep(batch, _batch_id):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", _folder(spark, "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def stream_clean(spark, sf):
    flag = F.expr("case event_id % 6 when 0 then '예' when 1 then 'Y' when 2 then 'true' when 3 then '아니오' when 4 then 'N' else 'False' end")
    amount = F.concat(F.lit("₩ "), F.format_number("value", 2))
    plan = ts.infer_clean(table(spark, sf, "events").select("event_id", flag.alias("Flag"), amount.alias("Amount")))
    stream = _events_stream(spark, sf).select("event_id", flag.alias("Flag"), amount.alias("Amount"))
    return _drain(drops.clean_stream(stream, plan), spark, "append", "stream-clean")


def stream_dedupe_last_by(spark, sf):
    stream = _events_stream(spark, sf).select("event_id", "user_id", "event_type", "value", "ts")
    return _drain(drops.dedupe_stream_last_by(stream, ["user_id"], "ts", "event_id").drop("ts"), spark, "complete", "stream-dedupe")


def stream_dedupe_ttl(spark, sf):
    """Events arrive in four parts by time, and the stream starts again for each; keys are forgotten after two quiet days.
    The last change of a key is its answer."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    folder, changes, state = _folder(spark, "quarters"), _folder(spark, "changes"), _folder(spark, "state")
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    ends = [span["low"] + (span["high"] - span["low"]) * k / 4 for k in (1, 2, 3)]
    quarter = sum(((F.col("ts") >= end).cast("int") for end in ends), F.lit(0))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    for i in range(4):
        events.where(quarter == i).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        newest = drops.dedupe_stream_last_by_ttl(stream, ["user_id"], "ts", "event_id", "ts", "1 day", timedelta(days=2))
        newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return ts.dedupe(spark.read.schema(events.schema).parquet(changes), "user_id", "last_by:ts", "event_id").drop("ts", "batch")


def stream_dedupe_first(spark, sf):
    """Every event arrives twice."""
    stream = _events_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = stream.unionByName(_events_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts")))
    return _drain(drops.dedupe_stream_first(stream, ["event_id"], "ts", "1 day").select("event_id"), spark, "append", "stream-first")


def stream_pivot(spark, sf):
    stream = _events_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    daily = drops.pivot_stream(stream, "ts", "event_type", [("value", "sum"), ("event_id", "count")], "36500 days")
    found = _drain(daily, spark, "complete", "stream-pivot")
    return _round(found.withColumn("period", F.date_format("period", "yyyy-MM-dd")), "value")


def stream_pivot_monthly(spark, sf):
    """Events in two batches, cut by time; the state of the first one goes on in the second."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = events.agg(F.expr("timestamp_seconds(avg(unix_timestamp(ts)))").alias("m")).first()["m"]
    folder = _folder(spark, "halves")
    for half in (events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle)):
        half.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    monthly = drops.pivot_stream(stream, "ts", "event_type", [("value", "sum"), ("event_id", "count")], "31 days", window=None)
    found = _drain(monthly, spark, "complete", "stream-monthly")
    return _round(found.withColumn("period", F.date_format("period", "yyyy-MM")), "value")


def profile_merged(spark, sf):
    """Events with gaps dropped as CSV folders one after the other; their stored sketches make one profile. Only what
    merges exactly is shown."""
    folder, sketches, state = _folder(spark, "drops"), _folder(spark, "sketches"), _folder(spark, "state")
    events = gappy_events(spark, sf).select("event_id", "event_type", "value")
    for i in range(3):
        ts.write_table(events.where(F.col("event_id") % 3 == i), f"{folder}/part={i}")
        stream = drops.read_drops(spark, f"{folder}/*", "event_id string, event_type string, value string")
        drops.profile_drops(stream, sketches, state).awaitTermination()
    found = ts.stored_profiles(spark, sketches).where("column <> 'part'")
    return found.select("column", "n_rows", "nonnull", "nulls", "numbers", F.round("mean", 4).alias("mean"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


def refresh_changed(spark, sf):
    """Events dropped as CSV folders in three rounds, each working on the files it finds new; the counts of all kinds."""
    folder, target, ledger = _folder(spark, "drops"), _folder(spark, "results"), _folder(spark, "ledger")
    events = table(spark, sf, "events").select("event_id", "event_type")
    for i in range(3):
        ts.write_table(events.where(F.col("event_id") % 3 == i), f"{folder}/part={i}")
        ledgers.refresh_changed(
            spark, folder, target, ledger, lambda files: ts.read_csv_table(spark, files, source_file="source_file"),
            lambda rows: rows.groupBy("source_file", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")),
        )
    results = ledgers.current_results(spark, target, ledger)
    return results.groupBy(F.regexp_extract("source_file", "part=([0-9])", 1).cast("int").alias("part"), "event_type").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def detect_encodings(spark, sf):
    """Documents of two languages written in four encodings: what is found of each folder, and the rows that are read from it."""
    documents = table(spark, sf, "documents").where("lang in ('fr', 'es')").select("doc_id", "text")
    parts = []
    for written, charset in (("utf-8", "UTF-8"), ("latin-1", "ISO-8859-1"), ("utf-16-le", "UTF-16LE"), ("utf-16-be", "UTF-16BE")):
        folder = _folder(spark, "texts")
        documents.write.option("header", True).option("escape", '"').option("encoding", charset).csv(folder)
        stored = ts.read_csv_table(spark, folder, source_file="path").join(ts.detect_encodings(spark, folder), "path")
        parts.append(stored.groupBy(F.lit(written).alias("written"), "encoding").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")))
    return reduce(DataFrame.unionByName, parts)


def stream_gate(spark, sf):
    """Two batches: the gate lets the complete one pass and puts the one with gaps aside."""
    accepted, quarantine, folder = _folder(spark, "accepted"), _folder(spark, "quarantine"), _folder(spark, "batches")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    gappy = events.where("event_id % 2 = 1").withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    for part in (events.where("event_id % 2 = 0"), gappy):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    spec = {"checks": [{"required": ["event_id", "event_type"]}, {"range": {"column": "event_id", "min": 0}}]}
    drops.gated_stream(stream, spec, accepted, quarantine, _folder(spark, "state")).awaitTermination()
    columns = ["event_id", "event_type", "value"]
    passed = spark.read.schema(events.schema).parquet(accepted).select(*columns, F.lit(True).alias("accepted"))
    return passed.unionByName(spark.read.schema(events.schema).parquet(quarantine).select(*columns, F.lit(False).alias("accepted")))


def report_drops(spark, sf):
    """Orders dropped as two CSV files in two folders; the pivots of both reports."""
    folder, target = _folder(spark, "drops"), _folder(spark, "reports")
    orders = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", "o_totalprice")
    for i, test in enumerate(("o_totalprice < 100000", "o_totalprice >= 100000")):
        ts.write_table(orders.where(test).coalesce(1), f"{folder}/part={i}")
    stream = drops.read_drops(spark, f"{folder}/*", "day string, o_orderpriority string, o_totalprice double", files_per_batch=1)
    spec = ts.PivotSpec(rows=["월", "o_orderpriority"], values=[("o_totalprice", "sum")], date_col="day")
    drops.report_drops(stream, target, _folder(spark, "state"), spec).awaitTermination()
    return _round(spark.read.parquet(f"{target}/*/pivot"), "o_totalprice")


M = f"({MONTHLY_SQL}) m"
G = f"({GAPPY_EVENTS_SQL}) g"
_GRID = f"""a as (select "월", priority, sum(price) as price from {M} group by all),
    grid as (select * from (select distinct "월" from a) cross join (select distinct priority from a)),
    p as (select "월", priority, coalesce(price, 0) as price from grid left join a using ("월", priority))"""

QUERIES = {
    "refresh_changed": (refresh_changed, "select (event_id % 3)::integer as part, event_type, count(*) as n, sum(event_id)::bigint as ids from events group by all"),
    "detect_encodings": (detect_encodings, """
        select w as written, w as encoding, count(*) as n, sum(doc_id)::bigint as ids
        from documents, (select unnest(['utf-8', 'latin-1', 'utf-16-le', 'utf-16-be']) as w) where lang in ('fr', 'es') group by all"""),
    "filter_in": (filter_in, "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders where o_orderstatus in ('F', 'P') and o_orderpriority in ('1-URGENT', '2-HIGH')"),
    "month_bucket": (month_bucket, "select o_orderkey, strftime(o_orderdate, '%Y-%m') as \"month\" from orders"),
    "pivot_long": (pivot_long, f"""
        with a as (select "월", priority, status, sum(price) as price from {M} group by all),
        grid as (select * from (select distinct "월" from a) cross join (select distinct priority from a) cross join (select distinct status from a))
        select "월", priority, status, round(coalesce(price, 0), 2) as price from grid left join a using ("월", priority, status)"""),
    "pivot_long_null_level": (pivot_long_null_level, f"""
        with a as (select user_id, event_type, coalesce(sum("value"), 0) as v, count(event_id) as c from {G} group by all),
        grid as (select * from (select distinct user_id from a) cross join (select distinct event_type from a))
        select grid.user_id, grid.event_type, round(coalesce(v, 0), 2) as "value", coalesce(c, 0) as event_id
        from grid left join a on grid.user_id = a.user_id and grid.event_type is not distinct from a.event_type"""),
    "pivot_wide": (pivot_wide, f"""
        select priority, {", ".join(f"round(coalesce(sum(price) filter (where status = '{s}'), 0), 2) as price_{s}, count(o_orderkey) filter (where status = '{s}') as o_orderkey_{s}" for s in "FOP")}
        from {M} group by priority"""),
    "pivot_aggs": (pivot_aggs, f"""
        select priority, round(sum(price), 2) as "sum", round(avg(price), 2) as mean, count(price) as "count", round(min(price), 2) as "min", round(max(price), 2) as "max",
               round(median(price), 2) as median, round(stddev_samp(price), 2) as std, round(var_samp(price), -2) as "var", count(distinct o_orderkey) as nunique,
               round(arg_min(price, o_orderkey), 2) as "first", round(arg_max(price, o_orderkey), 2) as "last" from {M} group by priority"""),
    "group_sum": (group_sum, f'select event_type, user_id, round(sum("value"), 2) as "value" from {G} where event_type is not null and user_id is not null group by all'),
    "mom": (mom, f"""with {_GRID}, l as (select *, lag(price) over (partition by priority order by "월") as before from p)
        select "월", priority, round(coalesce((price - before) / nullif(before, 0), 0), 4) as "price_MoM" from l"""),
    "running_total": (running_total, f"""with {_GRID} select "월", priority, round(sum(price) over (partition by priority order by "월"), 2) as "price_YTD" from p"""),
    "ytd": (ytd, f"""with {_GRID} select "월", priority, round(sum(price) over (partition by priority, left("월", 4) order by "월"), 2) as "price_YTD" from p"""),
    "pivot_report": (pivot_report, f"""
        with a as (select "월", status, sum(price) as price from {M} group by all),
        grid as (select * from (select distinct "월" from a) cross join (select distinct status from a)),
        p as (select "월", status, coalesce(price, 0) as price from grid left join a using ("월", status)),
        l as (select *, lag(price) over w as before, sum(price) over w as total from p window w as (partition by status order by "월"))
        select "월", status, round(price, 2) as price, round(coalesce((price - before) / nullif(before, 0), 0), 4) as "price_MoM", round(total, 2) as "price_YTD" from l"""),
    "pivot_report_category_first": (pivot_report_category_first, f"""
        with a as (select "월", status, sum(price) as price from {M} group by all),
        grid as (select * from (select distinct "월" from a) cross join (select distinct status from a)),
        p as (select "월", status, coalesce(price, 0) as price from grid left join a using ("월", status)),
        l as (select *, lag(price) over w as before, sum(price) over w as total from p window w as (partition by status order by "월"))
        select "월", status, round(price, 2) as price, round(coalesce((price - before) / nullif(before, 0), 0), 4) as "price_MoM", round(total, 2) as "price_YTD" from l"""),
    "pivot_subtotals": (pivot_subtotals, f"""
        select 'month' as "level", "월", null::varchar as priority, round(sum(price), 2) as price from {M} group by "월"
        union all select 'category', null, priority, round(sum(price), 2) from {M} group by priority"""),
    "period_summary": (period_summary, """
        select round(coalesce(sum(o_totalprice), 0), 2) as amount_total, round(coalesce(sum(o_custkey), 0)::double, 2) as quantity_total, count(*) as "rows", '1995-01-01~1996-06-30' as period
        from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1996-06-30'"""),
    "kpi_metrics": (kpi_metrics, f"""
        with s as (select count(*) as n, 3 * count(*) - count(user_id) - count(event_type) - count("value") as missing from {G}),
        d as (select count(*) as k from (select distinct user_id, event_type, "value" from {G}))
        select n as "rows", round(missing::double / (3 * n), 4) as missing_rate, round((n - k)::double / n, 4) as dup_rate,
               round(2 / 3.0::double, 4) as numeric_col_rate, 0.0::double as date_parse_rate_guess from s, d"""),
    "kpi_before_after": (kpi_before_after, f"""
        with c as (select count(*) as n, count(*) filter (where amount__currency is null) as gaps from ({MESSY_ORDERS_CLEAN_SQL}))
        select 'before' as stage, n as "rows", round(1 / 7.0::double, 4) as missing_rate, 0.0::double as dup_rate, round(2 / 7.0::double, 4) as numeric_col_rate, round(1 / 5.0::double, 4) as date_parse_rate_guess from c
        union all select 'after', n, round(gaps::double / (7 * n), 4), 0.0, round(4 / 7.0::double, 4), round(1 / 3.0::double, 4) from c"""),
    "diff_metrics": (diff_metrics, f"""
        with b as (select user_id, event_type, sparse from {G}), a as (select distinct * from b)
        select 'before' as stage, (select 3 * count(*) - count(user_id) - count(event_type) - count(sparse) from b) as nulls, (select count(*) from b) - (select count(*) from a) as duplicates
        union all select 'after', (select 3 * count(*) - count(user_id) - count(event_type) - count(sparse) from a), 0"""),
    "report_kpi": (report_kpi, f"""
        with s as (select count(*) as n, 3 * count(*) - count(user_id) - count(event_type) - count("value") as missing from {G}),
        d as (select count(*) as k from (select distinct user_id, event_type, "value" from {G}))
        select 'rows' as metric, n::double as "value" from s union all select 'columns', 3.0 union all select 'missing_rate', round(missing::double / (3 * n), 4) from s
        union all select 'dup_rate', round((n - k)::double / n, 4) from s, d"""),
    "preprocess": (preprocess, f"""
        with c as (select order_id, cust_key, order_date, case when order_id % 11 <> 0 then amount end as amount, priority, active,
                          case when order_id % 11 <> 0 then amount__currency end as amount__currency from ({MESSY_ORDERS_CLEAN_SQL})),
        d as (select * from c qualify row_number() over (partition by cust_key order by order_date desc, order_id) = 1),
        i as (select * replace (coalesce(amount, (select median(amount) from d)) as amount) from d),
        q as (select quantile_cont(amount, 0.25) as q1, quantile_cont(amount, 0.75) as q3 from i)
        select i.* replace (round(greatest(q1 - 0.5 * (q3 - q1), least(q3 + 0.5 * (q3 - q1), amount)), 3) as amount) from i, q"""),
    "recipe_weekly": (recipe_weekly, f"select * from ({MESSY_ORDERS_CLEAN_SQL}) qualify row_number() over (partition by cust_key order by order_date desc, order_id) = 1"),
    "report_tables": (report_tables, f"""
        with a as (select left(order_date, 7) as "월", priority, sum(amount) as amount from ({MESSY_ORDERS_CLEAN_SQL}) group by all),
        grid as (select * from (select distinct "월" from a) cross join (select distinct priority from a))
        select "월", priority, coalesce(amount, 0) as amount from grid left join a using ("월", priority)"""),
    "stream_clean": (stream_clean, "select event_id, event_id % 6 in (0, 1, 2) as flag, round(\"value\", 2) as amount, 'KRW' as amount__currency from events"),
    "stream_dedupe_last_by": (stream_dedupe_last_by, 'select user_id, event_id, event_type, "value" from events qualify row_number() over (partition by user_id order by ts desc, event_id) = 1'),
    "stream_dedupe_ttl": (stream_dedupe_ttl, 'select user_id, event_id, event_type, "value" from events qualify row_number() over (partition by user_id order by ts desc, event_id) = 1'),
    "stream_dedupe_first": (stream_dedupe_first, "select distinct event_id from events"),
    "stream_pivot": (stream_pivot, "select strftime(ts, '%Y-%m-%d') as period, event_type, round(sum(\"value\"), 2) as \"value\", count(event_id) as event_id from events group by all"),
    "stream_pivot_monthly": (stream_pivot_monthly, "select strftime(ts, '%Y-%m') as period, event_type, round(sum(\"value\"), 2) as \"value\", count(event_id) as event_id from events group by all"),
    "profile_merged": (profile_merged, " union all ".join(
        f"""select '{c}' as "column", count(*) as n_rows, count({c}) as nonnull, count(*) - count({c}) as nulls, count({n}) as numbers,
            round(avg({n}), 4) as mean, round(min({n}), 4)::double as min, round(max({n}), 4)::double as max from ({GAPPY_EVENTS_SQL}) g"""
        for c, n in (("event_id", "event_id"), ("event_type", "null::double"), ('value', '"value"')))),
    "stream_gate": (stream_gate, 'select event_id, case when event_id % 2 = 0 or event_id % 7 <> 0 then event_type end as event_type, "value", event_id % 2 = 0 as accepted from events'),
    "report_drops": (report_drops, """
        with o as (select o_totalprice >= 100000 as high, strftime(o_orderdate, '%Y-%m') as "월", o_orderpriority, o_totalprice from orders),
        a as (select high, "월", o_orderpriority, sum(o_totalprice) as price from o group by all),
        grid as (select * from (select distinct high, "월" from a) join (select distinct high, o_orderpriority from a) using (high))
        select "월", o_orderpriority, round(coalesce(price, 0), 2) as o_totalprice from grid left join a using (high, "월", o_orderpriority)"""),
}
