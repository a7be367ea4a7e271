"""Missing-value and outlier queries."""

from __future__ import annotations

import tablesmith as ts
from pyspark.sql import functions as F

from .tables import GAPPY_EVENTS_SQL, gappy_events, table


def _events(spark, sf, *columns):
    return gappy_events(spark, sf).select(*columns)


def impute_zero(spark, sf):
    return ts.fill(_events(spark, sf, "event_id", "value"), "zero", "value")


def impute_mean(spark, sf):
    filled = ts.fill(_events(spark, sf, "event_id", "value"), "mean", "value")
    return filled.withColumn("value", F.round("value", 4))


def impute_median(spark, sf):
    filled = ts.fill(_events(spark, sf, "event_id", "value"), "median", "value")
    return filled.withColumn("value", F.round("value", 4))


def impute_mode(spark, sf):
    return ts.fill(_events(spark, sf, "event_id", "event_type"), "mode", "event_type")


def impute_const(spark, sf):
    return ts.fill(_events(spark, sf, "event_id", "event_type"), "const", "event_type", "unknown")


def impute_drop(spark, sf):
    return ts.fill(_events(spark, sf, "event_id", "value"), "drop", "value")


def impute_ffill(spark, sf):
    events = _events(spark, sf, "event_id", "ts", "user_id", "value", "event_type")
    filled = ts.fill(events, "ffill", ["value", "event_type"], order_by=["ts", "event_id"], partition_by="user_id")
    return filled.drop("ts")


def impute_ffill_global(spark, sf):
    events = _events(spark, sf, "event_id", "ts", "value")
    return ts.fill(events, "forward_fill", "value", order_by=["ts", "event_id"]).drop("ts")


def impute_bfill(spark, sf):
    events = _events(spark, sf, "event_id", "ts", "value")
    return ts.fill(events, "bfill", "value", order_by=["ts", "event_id"]).drop("ts")


def impute_interpolate(spark, sf):
    events = _events(spark, sf, "event_id", "ts", "user_id", "value")
    filled = ts.fill(events, "interpolate", "value", order_by=["ts", "event_id"], partition_by="user_id")
    return filled.select("event_id", "user_id", F.round("value", 4).alias("value"))


def impute_interpolate_global(spark, sf):
    events = _events(spark, sf, "event_id", "ts", "value")
    filled = ts.fill(events, "interpolate", "value", order_by=["ts", "event_id"])
    return filled.select("event_id", F.round("value", 4).alias("value"))


def impute_drop_cols(spark, sf):
    return ts.handle_missing_values(_events(spark, sf, "event_id", "event_type", "value", "sparse"), {})


def impute_strategies(spark, sf):
    events = _events(spark, sf, "event_id", "event_type", "value", "sparse")
    filled = ts.handle_missing_values(events, {"value": "median", "event_type": "mode", "absent": "zero"})
    return filled.withColumn("value", F.round("value", 4))


def impute_report(spark, sf):
    events = _events(spark, sf, "event_id", "event_type", "value", "sparse")
    rules = [
        {"col": "value", "method": "median"},
        {"col": "event_type", "method": "most_frequent"},
        {"col": "sparse", "method": "guess"},
        {"col": "event_id", "method": "zero"},
        {"col": "absent", "method": "zero"},
    ]
    return ts.impute(events, rules)[1]


def missing_patterns(spark, sf):
    found = ts.missing_patterns(_events(spark, sf, "event_id", "event_type", "value", "sparse"))
    return found.select(
        "column", "missing", F.round("missing_ratio", 4).alias("missing_ratio"), "total_rows",
        F.col("columns_with_missing").cast("long").alias("columns_with_missing"), F.col("missing_cells").cast("long").alias("missing_cells"),
        F.col("max_missing_in_row").cast("long").alias("max_missing_in_row"),
        F.round("avg_missing_in_row", 4).alias("avg_missing_in_row"),
    )


def suggest_impute(spark, sf):
    return ts.suggest_strategies(_events(spark, sf, "event_id", "event_type", "value", "sparse"))


def outlier_iqr(spark, sf):
    clipped = ts.iqr_clip(table(spark, sf, "events").select("event_id", "value"), "value")
    return clipped.withColumn("value", F.round("value", 4))


def outlier_iqr_integer(spark, sf):
    return ts.iqr_clip(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")


def outlier_iqr_tied(spark, sf):
    """A 0/1 column: its quartiles lie on the border of two values that hold half of the rows each."""
    tied = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 2).cast("double").alias("odd"))
    return ts.iqr_clip(tied, "odd", -0.25)


def outlier_zscore(spark, sf):
    clipped = ts.zscore_clip(table(spark, sf, "events").select("event_id", "value"), "value")
    return clipped.withColumn("value", F.round("value", 4))


def outlier_report(spark, sf):
    rules = ts.operators.outlier.parse_outlier_rules("iqr_clip:value@k=1.5;zscore_clip:user_id@z=1;iqr:absent;best:value")
    report = ts.outlier(table(spark, sf, "events").select("event_id", "user_id", "value"), rules)[1]
    return report.select(
        F.col("rule").cast("long").alias("rule"), "col", "method", "changed",
        *[F.round(c, 4).alias(c) for c in ("q1", "q3", "mean", "std", "lo", "hi", "parameter")], "status",
    )


def outlier_detect(spark, sf):
    report = ts.detect_outliers(table(spark, sf, "documents"), ["n_chars"], "zscore", z=2)
    return report.select("col", "method", "changed", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def outlier_remove(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return ts.handle_outliers(events, {"value": {"method": "iqr"}}, "remove")


def outlier_mark(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return ts.handle_outliers(events, {"value": {"method": "zscore"}}, "mark")


G = f"({GAPPY_EVENTS_SQL}) g"
_IQR = """with q as (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {t}),
          b as (select q1, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)"""
_Z = """with m as (select avg({c}) as mu, stddev_pop({c}) as sd from {t}), b as (select mu, sd, mu - {z} * sd as lo, mu + {z} * sd as hi from m)"""

_INTERPOLATE = """
    with r as (select *, row_number() over ({p} order by ts, event_id) as pos from {g}),
    a as (select *, case when "value" is not null then pos end as vp from r),
    n as (select event_id, user_id, "value", pos,
                 last_value("value" ignore nulls) over w1 as pv, last_value(vp ignore nulls) over w1 as pp,
                 first_value("value" ignore nulls) over w2 as nv, first_value(vp ignore nulls) over w2 as np
          from a window w1 as ({p} order by pos rows between unbounded preceding and current row),
                        w2 as ({p} order by pos rows between current row and unbounded following))
    select event_id{k}, round(coalesce("value", case when nv is null then pv else pv + (nv - pv) * ((pos - pp)::double / (np - pp)) end), 4) as "value" from n"""

QUERIES = {
    "impute_zero": (impute_zero, f'select event_id, coalesce("value", 0) as "value" from {G}'),
    "impute_mean": (impute_mean, f'select event_id, round(coalesce("value", (select avg("value") from {G})), 4) as "value" from {G}'),
    "impute_median": (impute_median, f'select event_id, round(coalesce("value", (select median("value") from {G})), 4) as "value" from {G}'),
    "impute_mode": (impute_mode, f"select event_id, coalesce(event_type, (select event_type from {G} where event_type is not null group by event_type order by count(*) desc, event_type limit 1)) as event_type from {G}"),
    "impute_const": (impute_const, f"select event_id, coalesce(event_type, 'unknown') as event_type from {G}"),
    "impute_drop": (impute_drop, f'select event_id, "value" from {G} where "value" is not null'),
    "impute_ffill": (impute_ffill, f"""
        select event_id, user_id, last_value("value" ignore nulls) over w as "value", last_value(event_type ignore nulls) over w as event_type
        from {G} window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)"""),
    "impute_ffill_global": (impute_ffill_global, f"""
        select event_id, last_value("value" ignore nulls) over (order by ts, event_id rows between unbounded preceding and current row) as "value" from {G}"""),
    "impute_bfill": (impute_bfill, f"""
        select event_id, first_value("value" ignore nulls) over (order by ts, event_id rows between current row and unbounded following) as "value" from {G}"""),
    "impute_interpolate": (impute_interpolate, _INTERPOLATE.format(p="partition by user_id", g=G, k=", user_id")),
    "impute_interpolate_global": (impute_interpolate_global, _INTERPOLATE.format(p="", g=G, k="")),
    "impute_drop_cols": (impute_drop_cols, f'select event_id, event_type, "value" from {G}'),
    "impute_strategies": (impute_strategies, f"""
        select event_id, coalesce(event_type, (select event_type from {G} where event_type is not null group by event_type order by count(*) desc, event_type limit 1)) as event_type,
               round(coalesce("value", (select median("value") from {G})), 4) as "value" from {G}"""),
    "impute_report": (impute_report, f"""
        select 1::integer as rule, 'value' as col, 'median' as "method", count(*) filter (where "value" is null) as filled, 'ok' as status from {G}
        union all select 2, 'event_type', 'most_frequent', count(*) filter (where event_type is null), 'ok' from {G}
        union all select 3, 'sparse', 'guess', null, 'skip:unknown_method'
        union all select 4, 'event_id', 'zero', null, 'noop'
        union all select 5, 'absent', 'zero', null, 'skip:not_found'"""),
    "missing_patterns": (missing_patterns, f"""
        with s as (select count(*) as n, count(event_id) as a, count(event_type) as b, count("value") as c, count(sparse) as d,
                          max((event_type is null)::int + ("value" is null)::int + (sparse is null)::int) as worst from {G}),
        l as (select unnest([('event_id', n - a), ('event_type', n - b), ('value', n - c), ('sparse', n - d)]) as e, n, worst, 4 * n - a - b - c - d as cells from s)
        select e[1] as "column", e[2] as missing, round(e[2]::double / n, 4) as missing_ratio, n as total_rows, 3::bigint as columns_with_missing,
               cells::bigint as missing_cells, worst::bigint as max_missing_in_row, round(cells::double / n, 4) as avg_missing_in_row from l"""),
    "suggest_impute": (suggest_impute, f"""
        select 'event_type' as "column", count(*) filter (where event_type is null) as missing, 'mode' as strategy from {G}
        union all select 'value', count(*) filter (where "value" is null), 'median' from {G}
        union all select 'sparse', count(*) filter (where sparse is null), 'zero' from {G}"""),
    "outlier_iqr": (outlier_iqr, _IQR.format(c='"value"', t="events") + ' select event_id, round(greatest(lo, least(hi, "value")), 4) as "value" from events, b'),
    "outlier_iqr_tied": (outlier_iqr_tied, """
        with q as (select quantile_cont((l_orderkey % 2)::double, 0.25) as q1, quantile_cont((l_orderkey % 2)::double, 0.75) as q3 from lineitem),
        b as (select q1 + 0.25 * (q3 - q1) as lo, q3 - 0.25 * (q3 - q1) as hi from q)
        select l_orderkey, l_linenumber, greatest(lo, least(hi, (l_orderkey % 2)::double)) as odd from lineitem, b"""),
    "outlier_iqr_integer": (outlier_iqr_integer, _IQR.format(c="n_chars", t="documents") + " select doc_id, round_even(greatest(lo, least(hi, n_chars::double)), 0)::double as n_chars from documents, b"),
    "outlier_zscore": (outlier_zscore, _Z.format(c='"value"', t="events", z=3) + ' select event_id, round(greatest(lo, least(hi, "value")), 4) as "value" from events, b'),
    "outlier_report": (outlier_report, _IQR.format(c='"value"', t="events") + """,
        m as (select avg(user_id) as mu, stddev_pop(user_id) as sd from events), z as (select mu, sd, mu - sd as lo, mu + sd as hi from m)
        select 1::bigint as rule, 'value' as col, 'iqr_clip' as "method", count(*) filter (where "value" < lo or "value" > hi) as changed,
               round(any_value(q1), 4) as q1, round(any_value(q3), 4) as q3, null::double as mean, null::double as std,
               round(any_value(lo), 4) as lo, round(any_value(hi), 4) as hi, 1.5::double as parameter, 'ok' as status from events, b
        union all select 2, 'user_id', 'zscore_clip', count(*) filter (where user_id <> round_even(greatest(lo, least(hi, user_id::double)), 0)::double), null, null,
               round(any_value(mu), 4), round(any_value(sd), 4), round(any_value(lo), 4), round(any_value(hi), 4), 1.0, 'ok' from events, z
        union all select 3, 'absent', 'iqr', null, null, null, null, null, null, null, null, 'skip:not_found'
        union all select 4, 'value', 'best', null, null, null, null, null, null, null, null, 'skip:unknown_method'"""),
    "outlier_detect": (outlier_detect, _Z.format(c="n_chars", t="documents", z=2) + """
        select 'n_chars' as col, 'zscore_clip' as "method", count(*) filter (where n_chars <> round_even(greatest(lo, least(hi, n_chars::double)), 0)::double) as changed,
               round(any_value(lo), 4) as lo, round(any_value(hi), 4) as hi from documents, b"""),
    "outlier_remove": (outlier_remove, _IQR.format(c='"value"', t="events") + ' select event_id, "value" from events, b where "value" between lo and hi'),
    "outlier_mark": (outlier_mark, _Z.format(c='"value"', t="events", z=3) + ' select event_id, "value", "value" < lo or "value" > hi as value__outlier from events, b'),
}
