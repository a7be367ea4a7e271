"""Dirty inputs derived from the clean tables, each with the SQL that derives the same rows."""

from __future__ import annotations

import tablesmith as ts
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly expressions, in as many parts as there are cores."""
    return ts.deal(table(spark, sf_dir, name), spark.sparkContext.defaultParallelism)


def whole_price_text() -> str:
    """Spark SQL text of the whole price with a thousands comma."""
    n = "cast(floor(o_totalprice) as bigint)"
    return f"concat(cast({n} div 1000 as string), ',', lpad(cast({n} % 1000 as string), 3, '0'))"


def amount_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a money text in six styles."""
    nn = whole_price_text()
    return dealt(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(f"""case o_orderkey % 6 when 0 then concat('₩ ', {nn}) when 1 then concat('KRW ', {nn})
                   when 2 then concat({nn}, '원') when 3 then concat('$', {nn}) when 4 then concat({nn}, ' EUR')
                   else {nn} end""").alias("amount"),
    )


def date_text(layouts: list[str]) -> "F.Column":
    chosen = F.date_format(F.col("o_orderdate").cast("timestamp"), layouts[-1])
    for i, layout in enumerate(layouts[:-1]):
        chosen = F.when(
            F.col("o_orderkey") % len(layouts) == i, F.date_format(F.col("o_orderdate").cast("timestamp"), layout)
        ).otherwise(chosen)
    return chosen


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a messy export: odd headers, blanks, mixed dates, money styles, yes/no words, an empty column."""
    nn = whole_price_text()
    return dealt(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" Order ID "),
        F.col("o_custkey").alias("Cust-Key"),
        date_text(["yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "MM/dd/yyyy"]).alias("Order Date"),
        F.expr(f"""case o_orderkey % 4 when 0 then concat('₩ ', {nn}) when 1 then concat('KRW ', {nn})
                   when 2 then concat({nn}, '원') else {nn} end""").alias("Amount"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("　 ")).alias("Priority"),
        F.expr("""case o_orderkey % 6 when 0 then '예' when 1 then 'Y' when 2 then 'true'
                  when 3 then '아니오' when 4 then 'N' else 'False' end""").alias("Active?"),
        F.lit(None).cast("string").alias("Memo"),
    )


MESSY_ORDERS_CLEAN_SQL = """
select o_orderkey as order_id, o_custkey as cust_key, strftime(o_orderdate, '%Y-%m-%d') as order_date,
       cast(floor(o_totalprice) as double) as amount, o_orderpriority as priority,
       o_orderkey % 6 in (0, 1, 2) as active,
       case when o_orderkey % 4 in (0, 1, 2) then 'KRW' end as amount__currency
from orders
"""


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps: a seventh of the values, a ninth of the types, most of a third column."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "user_id",
        F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 10 >= 6, F.col("value")).alias("sparse"),
    )


GAPPY_EVENTS_SQL = """
select event_id, ts, user_id, case when event_id % 9 <> 0 then event_type end as event_type,
       case when event_id % 7 <> 0 then "value" end as "value",
       case when event_id % 10 >= 6 then "value" end as sparse
from events
"""


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        "o_orderkey",
    )


MONTHLY_SQL = """
select strftime(o_orderdate, '%Y-%m') as "월", o_orderpriority as priority, o_orderstatus as status,
       o_totalprice as price, o_orderkey from orders
"""
