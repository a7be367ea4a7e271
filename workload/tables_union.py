"""Schema alignment, union, profile, validation and keyword queries."""

from __future__ import annotations

import uuid

import tablesmith as ts
from pyspark.sql import functions as F
from tablesmith.session import checkpoint_dir

from .tables import GAPPY_EVENTS_SQL, dealt, gappy_events, messy_orders, table


def _parties(spark, sf):
    customer = table(spark, sf, "customer").select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return customer, table(spark, sf, "supplier").select("s_name", "s_nationkey", "s_acctbal", "s_suppkey")


def _accounts(spark, sf):
    customer, supplier = _parties(spark, sf)
    return (
        customer.toDF("account name", "nation key", "account balance", "market segment"),
        supplier.toDF("accounts name", "nation keys", "account balances", "supply id"),
    )


def align_exact(spark, sf):
    customer, supplier = _parties(spark, sf)
    first = customer.toDF("Name", "NationKey", "AcctBal", "Segment")
    return ts.align_schemas([first, supplier.toDF("name", "NATIONKEY", "acctbal", "suppkey")], "exact")[1]


def align_fuzzy(spark, sf):
    return ts.align_schemas(list(_accounts(spark, sf)), "fuzzy")[1]


def align_auto(spark, sf):
    return ts.align_schemas(list(_parties(spark, sf)), "auto")[1]


def align_manual(spark, sf):
    mapping = {"c_name": "s_name", "c_acctbal": "s_acctbal", "c_nationkey": "absent"}
    return ts.align_schemas(list(_parties(spark, sf)), "manual", mapping)[1]


def merge_union(spark, sf):
    return ts.merge_aligned(ts.align_schemas(list(_accounts(spark, sf)), "auto"))


def schema_compat(spark, sf):
    customer, supplier = _parties(spark, sf)
    found = ts.schema_compatibility([customer.toDF("name", "nation", "balance", "segment"), supplier.toDF("name", "nation", "balance", "key")])
    return found.select("table", "rows", "columns", "common_columns", "unique_columns", "compatibility_score", "recommendations")


def profile_columns(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return ts.profile_columns(orders).unionByName(
        ts.profile_columns(gappy_events(spark, sf).select("event_type", "value"))
    )


def profile_types(spark, sf):
    typed = ts.profile_types(messy_orders(spark, sf))
    best = F.col("type_candidates")[0]
    return typed.select(
        "column", *[F.round(f"{k}_ratio", 4).alias(f"{k}_ratio") for k in ("datetime", "boolean", "currency", "numeric")],
        best["type"].alias("best_type"), F.round(best["confidence"], 4).alias("best_confidence"),
    )


def profile_numeric(spark, sf):
    found = ts.profile_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.select("column", "count", *[F.round(c, 2).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def profile_full(spark, sf):
    found = ts.profile(table(spark, sf, "orders"))
    return found.select(
        "column", "n_rows", "nonnull", "nulls", "nunique", F.size("sample_values").cast("long").alias("samples"),
        F.col("type_candidates")[0]["type"].alias("best_type"), F.col("stats.count").alias("numbers"),
        F.round("stats.mean", 2).alias("mean"), F.round("stats.p50", 2).alias("p50"),
    )


def match_names(spark, sf):
    """Customers and suppliers of one number; the word that all customers share is in every name."""
    return ts.match_names(table(spark, sf, "customer"), "c_name", table(spark, sf, "supplier"), "s_name", 0.3).withColumn("score", F.round("score", 4))


def match_part_names(spark, sf):
    """Parts against parts of one brand, by the words of their names."""
    part = table(spark, sf, "part")
    return ts.match_names(part, "p_name", part.where("p_brand = 'Brand#11'"), "p_name", 0.5).withColumn("score", F.round("score", 4))


def validate_unique(spark, sf):
    spec = {"checks": [{"unique": ["o_orderkey", "o_custkey", "absent"]}]}
    return ts.validate(table(spark, sf, "orders"), spec).select("check", "col", "ok")


def validate_required(spark, sf):
    spec = {"checks": [{"required": ["event_id", "value", "absent"]}]}
    return ts.validate(gappy_events(spark, sf), spec).select("check", "col", "ok", "missing")


def validate_regex(spark, sf):
    spec = {"checks": [
        {"regex": {"column": "p_brand", "pattern": r"Brand#[1-4]"}},
        {"regex": {"column": "p_name", "pattern": r"^[a-z]+"}},
        {"regex": {"column": "phone", "pattern": r"^01[016789]-\d{3,4}-\d{4}$"}},
    ]}
    return ts.validate(table(spark, sf, "part"), spec).select("check", "col", "ok", "fails", "error")


def validate_range(spark, sf):
    spec = {"checks": [
        {"range": {"column": "l_discount", "min": 0, "max": 0.05}},
        {"range": {"column": "l_quantity", "min": 1}},
        {"range": {"column": "l_returnflag", "max": 5}},
    ]}
    return ts.validate(table(spark, sf, "lineitem"), spec).select("check", "col", "ok", "fails", "min", "max")


EVENT_SPEC = {"checks": [
    {"unique": ["event_id"]},
    {"required": ["event_id", "event_type"]},
    {"regex": {"column": "event_type", "pattern": "[a-z]+"}},
    {"range": {"column": "value", "min": 0, "max": 1000000}},
]}


def validate_report(spark, sf):
    return ts.validate(gappy_events(spark, sf), EVENT_SPEC)


ROW_SPEC = {"checks": [
    {"unique": ["event_id", "event_type"]}, {"required": ["event_type", "value"]}, {"regex": {"column": "event_type", "pattern": "[a-m]"}},
    {"range": {"column": "value", "min": 10, "max": 80}}, {"unique": ["value"]}, {"required": ["absent"]},
]}


def validate_rows(spark, sf):
    """Every event with the rules it breaks; one type is on a large part of the rows."""
    marked = ts.validate_rows(gappy_events(spark, sf), ROW_SPEC)
    return marked.select("event_id", F.array_join("violations", ",").alias("violations"))


def validate_gate(spark, sf):
    found = ts.gate(gappy_events(spark, sf), EVENT_SPEC, 0.5)
    return found.select("checks", "passed", "ok", F.round("pass_ratio", 4).alias("pass_ratio"), "allowed")


KEYWORDS = {
    "rows": {"time": ["month", "year", "day"], "place": ["city", "country", "world"]},
    "values": {"money": {"keywords": ["price", "cost", "money"], "agg": "sum"}},
    "chart": {"bar": ["column", "bar"], "line": ["line"]},
    "filters": {"lang": {"en": ["the "], "de": [" und ", " der "]}},
}


def _tagged(spark, sf, name, keys):
    tagged = ts.tag_keywords(dealt(spark, sf, name), "text", KEYWORDS)
    return tagged.select(
        *keys, F.array_join("rows", ",").alias("row_tags"), F.array_join("values", ",").alias("value_tags"), "chart",
        F.array_join("filter_lang", ",").alias("lang_tags"),
    )


def tag_keywords(spark, sf):
    return _tagged(spark, sf, "documents", ["doc_id"])


def tag_conversations(spark, sf):
    return _tagged(spark, sf, "conversations", ["conv_id", "turn"])


def tag_restricted(spark, sf):
    """Only labels that name one of the table's columns."""
    tagged = ts.tag_keywords(table(spark, sf, "documents"), "text", KEYWORDS, columns=["TIME", "money", "text"])
    return tagged.select("doc_id", F.array_join("rows", ",").alias("row_tags"), F.array_join("values", ",").alias("value_tags"))


def tag_by_table(spark, sf):
    """Documents with the benchmark items that share a longer word with them: some hundred keywords and more."""
    words = F.explode(F.split("text", "[ .,?!\n]+"))
    keywords = table(spark, sf, "benchmark").select("item_id", words.alias("word")).where("length(word) >= 7")
    tagged = ts.tag_by_table(table(spark, sf, "documents"), "text", keywords, label="item_id", keyword="word")
    return tagged.select("doc_id", F.array_join("tags", ",").alias("items"))


def csv_round_trip(spark, sf):
    """Orders written as CSV and read back: encoding, cell texts and types come from the files alone."""
    folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    noted = orders.withColumn("note", F.expr("case o_orderkey % 3 when 0 then concat('line one\\nline \"two\", ', o_orderpriority) when 1 then '예' end"))
    ts.write_table(noted, folder)
    return ts.read_csv_table(spark, folder)


def _tag_sql(name, keys):
    def hit(words):
        return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"
    def tags(labelled):
        return "concat_ws(',', " + ", ".join(f"case when {hit(w)} then '{label}' end" for label, w in labelled.items()) + ")"
    values = {f"{k}:{v['agg']}": v["keywords"] for k, v in KEYWORDS["values"].items()}
    chart = "case " + " ".join(f"when {hit(w)} then '{k}'" for k, w in KEYWORDS["chart"].items()) + " end"
    return (f"select {keys}, {tags(KEYWORDS['rows'])} as row_tags, {tags(values)} as value_tags, {chart} as chart, "
            f"{tags(KEYWORDS['filters']['lang'])} as lang_tags from (select *, lower(trim(\"text\")) as t from {name})")


G = f"({GAPPY_EVENTS_SQL}) g"


def _profile_sql(column, name, source):
    return f"select '{name}' as \"column\", count(*) as n_rows, count({column}) as nonnull, count(*) - count({column}) as nulls, count(distinct {column}) as nunique from {source}"


def _match_sql(left, a, right, b, threshold):
    def words(name, source):
        return f"select distinct {name} as name, list_distinct(regexp_extract_all(lower({name}), '\\w+')) as w from {source}"
    return f"""
        select left_name, right_name, round(score, 4) as score from (
          select x.name as left_name, y.name as right_name, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) as score
          from ({words(a, left)}) x, ({words(b, right)}) y) where score >= {threshold}"""


def _numeric_sql(c):
    return (f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std, round(min({c}), 2) as min, "
            f"round(quantile_cont({c}, 0.25), 2) as p25, round(quantile_cont({c}, 0.5), 2) as p50, round(quantile_cont({c}, 0.75), 2) as p75, round(max({c}), 2) as max from lineitem")


QUERIES = {
    "align_exact": (align_exact, 'select s_name as "Name", s_nationkey as "NationKey", s_acctbal as "AcctBal" from supplier'),
    "align_fuzzy": (align_fuzzy, 'select s_name as "account name", s_nationkey as "nation key", s_acctbal as "account balance", null::varchar as "market segment" from supplier'),
    # c_name and s_name score 0.58, below the threshold, so that column stays empty.
    "align_auto": (align_auto, "select null::varchar as c_name, s_nationkey as c_nationkey, s_acctbal as c_acctbal, null::varchar as c_mktsegment from supplier"),
    "align_manual": (align_manual, "select s_name as c_name, null::integer as c_nationkey, s_acctbal as c_acctbal, null::varchar as c_mktsegment from supplier"),
    "merge_union": (merge_union, """
        select c_name as "account name", c_nationkey as "nation key", c_acctbal as "account balance", c_mktsegment as "market segment" from customer
        union all select s_name, s_nationkey, s_acctbal, null from supplier"""),
    "schema_compat": (schema_compat, """
        select t."table"::integer as "table", t.n as "rows", 4::integer as "columns", 'name, nation, balance' as common_columns, 'segment, key' as unique_columns,
               0.6::double as compatibility_score, '3 common columns can be merged' as recommendations
        from (select 0 as "table", count(*) as n from customer union all select 1, count(*) from supplier) t"""),
    "profile_columns": (profile_columns, " union all ".join(
        [_profile_sql(c, c, "orders") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]
        + [_profile_sql("event_type", "event_type", G), _profile_sql('"value"', "value", G)])),
    "profile_types": (profile_types, """
        with s as (select count(*)::double as n, count(*) filter (where o_orderkey <= 1) as two_keys, count(*) filter (where o_custkey in (0, 1)) as two_customers,
                          count(*) filter (where o_orderkey % 5 = 3) as contiguous, count(*) filter (where o_orderkey % 4 = 3) as plain,
                          count(*) filter (where o_orderkey % 5 <> 3) as hinted from orders)
        select ' Order ID ' as "column", 0.0::double as datetime_ratio, round(two_keys / n, 4) as boolean_ratio, 1.0::double as currency_ratio, 1.0::double as numeric_ratio,
               'currency' as best_type, 1.0::double as best_confidence from s
        union all select 'Cust-Key', 0.0, round(two_customers / n, 4), 1.0, 1.0, 'currency', 1.0 from s
        union all select 'Order Date', round(hinted / n, 4), 0.0, round(contiguous / n, 4), round(contiguous / n, 4), 'datetime', round(hinted / n, 4) from s
        union all select 'Amount', 0.0, 0.0, 1.0, round(plain / n, 4), 'currency', 1.0 from s
        union all select 'Priority', 0.0, 0.0, 0.0, 0.0, 'string', 1.0 from s
        union all select 'Active?', 0.0, 1.0, 0.0, 0.0, 'boolean', 1.0 from s
        union all select 'Memo', 0.0, 0.0, 0.0, 0.0, 'string', 1.0 from s"""),
    "profile_numeric": (profile_numeric, " union all ".join(_numeric_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount"))),
    "profile_full": (profile_full, " union all ".join(
        [f"select '{c}' as \"column\", count(*) as n_rows, count({c}) as nonnull, 0::bigint as nulls, count(distinct {c}) as nunique, 5::bigint as samples, "
         f"'currency' as best_type, count({c}) as numbers, round(avg({c}), 2) as mean, round(median({c}), 2)::double as p50 from orders"
         for c in ("o_orderkey", "o_custkey", "o_totalprice")]
        + [f"select '{c}', count(*), count({c}), 0, count(distinct {c}), 5, '{kind}', null, null, null from orders"
           for c, kind in (("o_orderstatus", "string"), ("o_orderpriority", "string"), ("o_orderdate", "datetime"))])),
    "match_names": (match_names, _match_sql("customer", "c_name", "supplier", "s_name", 0.3)),
    "match_part_names": (match_part_names, _match_sql("part", "p_name", "part where p_brand = 'Brand#11'", "p_name", 0.5)),
    "validate_unique": (validate_unique, """
        select 'unique' as "check", 'o_orderkey' as col, count(*) = count(distinct o_orderkey) as ok from orders
        union all select 'unique', 'o_custkey', count(*) = count(distinct o_custkey) from orders
        union all select 'unique', 'absent', false"""),
    "validate_required": (validate_required, f"""
        select 'required' as "check", 'event_id' as col, true as ok, 0::bigint as missing
        union all select 'required', 'value', count(*) = count("value"), count(*) - count("value") from {G}
        union all select 'required', 'absent', false, null"""),
    "validate_regex": (validate_regex, """
        select 'regex' as "check", 'p_brand' as col, count(*) filter (where not regexp_matches(p_brand, '^Brand#[1-4]')) = 0 as ok,
               count(*) filter (where not regexp_matches(p_brand, '^Brand#[1-4]')) as fails, null::varchar as error from part
        union all select 'regex', 'p_name', count(*) filter (where not regexp_matches(p_name, '^[a-z]+')) = 0, count(*) filter (where not regexp_matches(p_name, '^[a-z]+')), null from part
        union all select 'regex', 'phone', false, null, 'col_not_found'"""),
    "validate_range": (validate_range, """
        select 'range' as "check", 'l_discount' as col, count(*) filter (where l_discount > 0.05 or l_discount < 0) = 0 as ok,
               count(*) filter (where l_discount > 0.05 or l_discount < 0) as fails, 0.0::double as min, 0.05::double as max from lineitem
        union all select 'range', 'l_quantity', count(*) filter (where l_quantity < 1) = 0, count(*) filter (where l_quantity < 1), 1.0, null from lineitem
        union all select 'range', 'l_returnflag', true, 0, null, 5.0"""),
    "validate_report": (validate_report, f"""
        select 'unique' as "check", 'event_id' as col, count(*) = count(distinct event_id) as ok, null::bigint as missing, null::bigint as fails, null::double as min, null::double as max, null::varchar as error from {G}
        union all select 'required', 'event_id', count(*) = count(event_id), count(*) - count(event_id), null, null, null, null from {G}
        union all select 'required', 'event_type', count(*) = count(event_type), count(*) - count(event_type), null, null, null, null from {G}
        union all select 'regex', 'event_type', count(*) filter (where not regexp_matches(coalesce(event_type, ''), '^[a-z]+')) = 0, null, count(*) filter (where not regexp_matches(coalesce(event_type, ''), '^[a-z]+')), null, null, null from {G}
        union all select 'range', 'value', count(*) filter (where "value" < 0 or "value" > 1000000) = 0, null, count(*) filter (where "value" < 0 or "value" > 1000000), 0.0, 1000000.0, null from {G}"""),
    "validate_rows": (validate_rows, f"""
        with v as (select "value", count(*) as n from {G} group by 1), t as (select event_type, count(*) as n from {G} group by 1),
             k as (select event_id, count(*) as n from {G} group by 1)
        select g.event_id, concat_ws(',', case when k.n > 1 then 'unique:event_id' end, case when t.n > 1 then 'unique:event_type' end,
               case when g.event_type is null then 'required:event_type' end, case when g."value" is null then 'required:value' end,
               case when not regexp_matches(coalesce(g.event_type, ''), '^[a-m]') then 'regex:event_type' end,
               case when g."value" < 10 or g."value" > 80 then 'range:value' end, case when v.n > 1 then 'unique:value' end, 'required:absent') as violations
        from {G} join v on g."value" is not distinct from v."value" join t on g.event_type is not distinct from t.event_type join k on g.event_id = k.event_id"""),
    "validate_gate": (validate_gate, f"""
        with c as (select unnest([count(*) = count(distinct event_id), count(*) = count(event_id), count(*) = count(event_type),
                                  count(*) filter (where not regexp_matches(coalesce(event_type, ''), '^[a-z]+')) = 0,
                                  count(*) filter (where "value" < 0 or "value" > 1000000) = 0]) as ok from {G})
        select count(*) as checks, count(*) filter (where ok) as passed, bool_and(ok) as ok, round((count(*) filter (where ok))::double / count(*), 4) as pass_ratio,
               (count(*) filter (where ok))::double / count(*) >= 0.5 as allowed from c"""),
    "tag_by_table": (tag_by_table, """
        with k as (select distinct item_id::varchar as item, lower(w) as w from (select item_id, unnest(regexp_split_to_array("text", '[ .,?!\n]+')) as w from benchmark) where length(w) >= 7),
             t as (select doc_id, lower(trim(coalesce("text", ''))) as t from documents),
             h as (select doc_id, string_agg(distinct item, ',' order by item) as items from t join k on contains(t, w) group by 1)
        select doc_id, coalesce(items, '') as items from t left join h using (doc_id)"""),
    "tag_keywords": (tag_keywords, _tag_sql("documents", "doc_id")),
    "tag_restricted": (tag_restricted, f'select doc_id, case when contains(row_tags, \'time\') then \'time\' else \'\' end as row_tags, value_tags from ({_tag_sql("documents", "doc_id")})'),
    "csv_round_trip": (csv_round_trip, """
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority,
               case o_orderkey % 3 when 0 then 'line one' || chr(10) || 'line "two", ' || o_orderpriority when 1 then '예' end as note from orders"""),
    "tag_conversations": (tag_conversations, _tag_sql("conversations", "conv_id, turn")),
}
