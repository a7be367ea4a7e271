"""Naming, reading, cleaning and dedupe queries."""

from __future__ import annotations

import tablesmith as ts
from pyspark.sql import functions as F
from tablesmith.functions.text import currency_code

from .tables import GAPPY_EVENTS_SQL, MESSY_ORDERS_CLEAN_SQL, amount_text, date_text, dealt, gappy_events, messy_orders, table


def snake_columns(spark, sf):
    named = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Order ID "), F.col("o_custkey").alias("Cust--Key"),
        F.col("o_totalprice").alias("Total Price ($)"), F.col("o_orderstatus").alias("주문 상태"),
    )
    return ts.snake_columns(named)


def read_null_tokens(spark, sf):
    token = F.expr("""case l_orderkey % 7 when 0 then 'NA' when 1 then 'null' when 2 then '' when 3 then 'NaN'
                      when 4 then 'n/a' when 5 then 'None' else l_returnflag end""")
    return ts.read_null_tokens(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", token.alias("token")))


def infer_types(spark, sf):
    texts = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_key"),
        F.col("l_linenumber").cast("string").alias("line_number"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("FALSE").alias("returned"),
        F.col("l_linestatus").alias("status"),
    )
    return ts.infer_types(texts)


def clean_trim(spark, sf):
    padded = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    return ts.level1_clean(padded, protect=["text"])


def clean_bool(spark, sf):
    flag = F.expr("""case event_id % 6 when 0 then '예' when 1 then 'Y' when 2 then 'true'
                     when 3 then '아니오' when 4 then 'N' else 'False' end""")
    return ts.level1_clean(table(spark, sf, "events").select("event_id", flag.alias("flag")))


def clean_currency(spark, sf):
    dirty = amount_text(spark, sf)
    compat = dirty.withColumn("compat_currency", currency_code(F.col("amount"), "compat"))
    return ts.level1_clean(compat, protect=["compat_currency"])


def clean_number(spark, sf):
    dirty = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("price")
    )
    return ts.level1_clean(dirty)


def clean_date(spark, sf):
    layouts = ["yyyy-MM-dd", "yyyy/M/d", "yyyy.MM.dd", "yyyyMMdd", "MM/dd/yyyy", "MMMM d, yyyy", "d MMM yyyy",
               "yyyy-MM-dd HH:mm:ss", "yyyy년 M월 dd일"]
    return ts.level1_clean(dealt(spark, sf, "orders").select("o_orderkey", date_text(layouts).alias("order_date")))


def clean_decisions(spark, sf):
    plan = ts.infer_clean(messy_orders(spark, sf))
    rows = [
        (r["column"], r["kind"], *(round(r[f"{k}_ratio"], 4) for k in ("bool", "marked", "amount", "number", "date")))
        for r in plan.ratios()
    ]
    schema = "column string, kind string, bool_ratio double, marked_ratio double, amount_ratio double, number_ratio double, date_ratio double"
    return spark.createDataFrame(rows, schema)


def drop_empty(spark, sf):
    events = gappy_events(spark, sf)
    blank = F.col("event_id") % 10 == 0
    return ts.drop_empty(events.select(
        *[F.when(~blank, F.col(c)).alias(c) for c in ("event_id", "user_id", "value")],
        F.lit(None).cast("string").alias("memo"),
    ))


def level1_clean(spark, sf):
    return ts.level1_clean(messy_orders(spark, sf))


def dedupe_all(spark, sf):
    return ts.dedupe(table(spark, sf, "documents").select("lang", "source"))


def dedupe_first(spark, sf):
    return ts.dedupe(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "first", "o_orderkey")


def dedupe_last(spark, sf):
    return ts.dedupe(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "last", "o_orderkey")


def dedupe_last_by(spark, sf):
    events = gappy_events(spark, sf).select("user_id", "event_id", "event_type", "value", "ts")
    return ts.dedupe(events, "user_id", "last_by:ts", "event_id").drop("ts")


def dedupe_report(spark, sf):
    return ts.dedupe_report(gappy_events(spark, sf), ["user_id", "event_type"], "last_by:ts")


SPACE = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

QUERIES = {
    "snake_columns": (snake_columns, 'select o_orderkey as order_id, o_custkey as cust_key, o_totalprice as total_price, o_orderstatus as "주문_상태" from orders'),
    "read_null_tokens": (read_null_tokens, "select l_orderkey, l_linenumber, case when l_orderkey % 7 = 6 then l_returnflag end as token from lineitem"),
    "infer_types": (infer_types, "select l_orderkey as order_key, cast(l_linenumber as bigint) as line_number, l_extendedprice as price, l_returnflag = 'R' as returned, l_linestatus as status from lineitem"),
    "clean_trim": (clean_trim, f"select doc_id, trim(regexp_replace('  ' || \"text\" || ' ', '{SPACE}', ' ', 'g')) as \"text\" from documents"),
    "clean_bool": (clean_bool, "select event_id, event_id % 6 in (0, 1, 2) as flag from events"),
    "clean_currency": (clean_currency, """
        select o_orderkey, cast(floor(o_totalprice) as double) as amount,
               case o_orderkey % 6 when 3 then 'USD' when 4 then 'EUR' when 5 then null else 'KRW' end as amount__currency,
               case when o_orderkey % 6 < 5 then 'KRW' end as compat_currency
        from orders"""),
    "clean_number": (clean_number, "select l_orderkey, l_linenumber, round(l_extendedprice, 2) as price from lineitem"),
    "clean_date": (clean_date, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as order_date from orders"),
    "clean_decisions": (clean_decisions, """
        with s as (select count(*) as n, count(*) filter (where o_orderkey % 6 >= 0) as b,
                          count(*) filter (where o_orderkey % 4 <> 3) as m, count(*) filter (where o_orderkey % 4 = 3) as p,
                          count(*) filter (where o_orderkey % 5 = 3) as contiguous, count(*) filter (where o_orderkey % 5 > 0) as not_iso,
                          count(*) filter (where o_orderkey % 5 in (1, 3, 4)) as digits_only,
                          count(*) filter (where o_orderkey % 5 = 2) as dotted
                   from orders)
        select 'order_date' as "column", 'date' as kind, 0.0::double as bool_ratio, 0.0::double as marked_ratio,
               round((digits_only)::double / n, 4) as amount_ratio, round(contiguous::double / n, 4) as number_ratio, 1.0::double as date_ratio from s
        union all select 'amount', 'currency', 0.0, round(m::double / n, 4), 1.0, round(p::double / n, 4), 0.0 from s
        union all select 'priority', 'text', 0.0, 0.0,
               (select round(count(*) filter (where regexp_matches(regexp_replace(o_orderpriority, '[^0-9.\\-]+', '', 'g'), '^-?[0-9]+\\.?[0-9]*$'))::double / count(*), 4) from orders), 0.0, 0.0 from s
        union all select 'active', 'bool', round(b::double / n, 4), 0.0, 0.0, 0.0, 0.0 from s
        union all select 'memo', 'text', 0.0, 0.0, 0.0, 0.0, 0.0 from s"""),
    "drop_empty": (drop_empty, f"select event_id, user_id, \"value\" from ({GAPPY_EVENTS_SQL}) where event_id % 10 <> 0"),
    "level1_clean": (level1_clean, MESSY_ORDERS_CLEAN_SQL),
    "dedupe_all": (dedupe_all, "select distinct lang, source from documents"),
    "dedupe_first": (dedupe_first, "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1"),
    "dedupe_last": (dedupe_last, "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1"),
    "dedupe_last_by": (dedupe_last_by, f"select user_id, event_id, event_type, \"value\" from ({GAPPY_EVENTS_SQL}) qualify row_number() over (partition by user_id order by ts desc, event_id) = 1"),
    "dedupe_report": (dedupe_report, f"""
        with g as (select count(*) as n from ({GAPPY_EVENTS_SQL}) group by user_id, event_type)
        select 'user_id, event_type' as keys, 'last_by:ts' as keep, 'ts' as sorted_by, sum(n)::bigint as input_rows,
               count(*) as output_rows, (sum(n) - count(*))::bigint as removed from g"""),
}
