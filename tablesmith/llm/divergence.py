"""How far the sources of a language differ in their use of terms, and by which terms.

Tasks lower and split texts with Arrow's compute functions, number the terms by dictionary encoding and count them by
hash grouping; equal (lang, source, term) are one row of partial counts, and rows travel as compressed columns, one
shard of the terms at a time. Shards are merged and keep the terms that enough documents of a language have. With the
totals of all groups beside it, each shard then adds up its terms' share of every divergence, in whole numbers.

Null text, lang and source are empty texts. Rows that repeat count again, an empty table has no groups, further columns
are ignored. Terms are runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import pack_columns, pick, small_batches, stored, table, text_slices, unpack_columns

#: Documents of a language that must have a term, added to every count, unit of a probability, terms listed for a group.
LEAST_DOCUMENTS, SMOOTHING, UNIT, LISTED = 30, 5, 1_000_000_000, 50
#: Bytes of text that are split at a time, and rows of partial counts that a task gathers.
SLICE, GATHERED = 1 << 22, 500_000

_NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_KEYS = ["lang", "source", "term"]
_COUNTS = "shard int, counts binary"
_KEPT = "shard int, lang string, source string, term string, n long"
_SHARES = "lang string, source string, part string, item string, value long"


def _encoded(column: pa.ChunkedArray) -> pa.DictionaryArray:
    return column.combine_chunks().dictionary_encode() if isinstance(column, pa.ChunkedArray) else column.dictionary_encode()


def term_counts(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents: occurrences, and documents that have the term."""
    # Put together anew: ascii_lower mistakes the places of texts whose buffer begins with other rows.
    text = pa.concat_arrays([pc.fill_null(part.column("text").cast(pa.large_string()), ""), pa.array([], pa.large_string())])
    text = pc.ascii_lower(text)
    lists = pc.split_pattern_regex(text, _NO_TERM)
    terms = lists.flatten().dictionary_encode()
    group = pa.table({"lang": pc.fill_null(part.column("lang"), ""), "source": pc.fill_null(part.column("source"), "")})
    lang, source = group["lang"], group["source"]
    size = max(1, len(terms.dictionary))
    place = pc.add(pc.multiply(pc.list_parent_indices(lists).cast(pa.int64()), size), terms.indices.cast(pa.int64()))
    per_doc = pa.table({"place": place}).group_by("place", use_threads=False).aggregate([([], "count_all")])
    doc, term = np.divmod(per_doc["place"].to_numpy(), size)
    names = pa.table({"lang": lang.take(pa.array(doc)), "source": source.take(pa.array(doc)), "term": terms.dictionary.cast(pa.string()).take(pa.array(term)), "n": per_doc["count_all"]})
    names = names.filter(pc.not_equal(names["term"], ""))
    counted = names.group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    return counted.rename_columns({"n_sum": "n", "n_count": "docs"})


def merged(tables: list[pa.Table]) -> pa.Table:
    """Partial counts as one table, equal keys added up."""
    whole = pa.concat_tables(tables)
    return whole.group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns({"n_sum": "n", "docs_sum": "docs"})


def _shard_of(terms: pa.ChunkedArray, shards: int) -> np.ndarray:
    """By the term alone: all that is counted for it meets in one shard."""
    codes = _encoded(terms)
    of_term = np.array([xxhash.xxh32_intdigest(t) % shards for t in codes.dictionary.to_pylist()], np.int32)
    return of_term[codes.indices.to_numpy()] if len(of_term) else np.empty(0, np.int32)


def _sharded(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.Table] = []

        def out(counts: pa.Table) -> Iterator[pa.RecordBatch]:
            shard = _shard_of(counts["term"], shards)
            order = np.argsort(shard, kind="stable")
            counts, shard = counts.take(pa.array(order)), shard[order]
            ends = np.flatnonzero(np.r_[shard[1:] != shard[:-1], True]) + 1 if len(shard) else []
            begin = 0
            for end in ends:
                yield pa.record_batch([pa.array([shard[begin]], pa.int32()), pa.array([pack_columns(counts.slice(begin, end - begin))], pa.binary())], ["shard", "counts"])
                begin = int(end)

        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                gathered.append(term_counts(part))
                if sum(map(len, gathered)) > GATHERED:
                    gathered[:] = [merged(gathered)]
                    if len(gathered[0]) > GATHERED:
                        yield from out(gathered.pop())
        if gathered:
            yield from out(merged(gathered))

    return run


def _keeping(least_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for shard, counts in zip(batch.column("shard").to_pylist(), batch.column("counts").to_pylist()):
                tables = shards.setdefault(shard, [])
                tables.append(unpack_columns(counts))
                if len(tables) > 1 and sum(map(len, tables)) > 2 * len(tables[0]) + GATHERED // 10:
                    shards[shard] = [merged(tables)]
        for shard, tables in shards.items():
            counts = merged(tables)
            in_lang = counts.group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum")])
            kept = in_lang.filter(pc.greater_equal(in_lang["docs_sum"], least_documents)).select(["lang", "term"])
            rows = counts.join(kept, ["lang", "term"], join_type="inner", use_threads=False).select([*_KEYS, "n"])
            for piece in rows.combine_chunks().to_batches(100_000):
                yield pa.record_batch([pa.array(np.full(len(piece), shard, np.int32)), *piece.columns], ["shard", *_KEYS, "n"])

    return run


def kept_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, shards: int = 64) -> DataFrame:
    """(shard, lang, source, term, n) of the terms that ``least_documents`` documents of the language have."""
    counts = pick(docs, "text", "lang", "source").mapInArrow(_sharded(shards), _COUNTS)
    # The shuffle deals whole shards; a shard is merged as it comes, so a task holds its distinct rows only.
    return stored(counts.repartition("shard").mapInArrow(_keeping(least_documents), _KEPT), "term-counts")


def probabilities(counts: np.ndarray, total: np.ndarray, terms: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)) in 64 bits: long division by thousands."""
    below = total + SMOOTHING * terms
    digits, rest = np.divmod(counts + SMOOTHING, below)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, below)
        digits = digits * 1000 + step
    return digits + 1


def _shares(listed: int):
    """One shard of a language: its share of the divergence of each two sources, and each source's foremost terms."""

    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, terms_kept = groups["lang"][0].as_py(), groups["terms"][0].as_py()
        sources = groups["source"].to_pylist()
        totals = groups["total"].to_numpy().astype(np.int64)
        codes = _encoded(counts["term"])
        matrix = np.zeros((len(sources), len(codes.dictionary)), np.int64)
        if counts.num_rows:
            row = {s: i for i, s in enumerate(sources)}
            matrix[[row[s] for s in counts["source"].to_pylist()], codes.indices.to_numpy()] = counts["n"].to_numpy()
        below = totals[:, None]
        p = probabilities(matrix, below, terms_kept) if matrix.shape[1] else matrix
        out = {k: [] for k in ("source", "part", "item", "value")}

        def add(source: str, part: str, items: list[str], values: list[int]) -> None:
            out["source"] += [source] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += items
            out["value"] += values

        for i, source in enumerate(sources):
            apart = np.abs(p - p[i]).sum(axis=1).tolist()
            add(source, "pair", sources[:i] + sources[i + 1 :], apart[:i] + apart[i + 1 :])
        if matrix.shape[1]:
            q = probabilities(matrix.sum(axis=0), totals.sum(), terms_kept)
            for i, source in enumerate(sources):
                more = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
                found = pa.table({"item": codes.dictionary.take(pa.array(more)), "value": p[i][more] - q[more]})
                found = found.sort_by([("value", "descending"), ("item", "ascending")]).slice(0, listed)
                add(source, "term", found["item"].to_pylist(), found["value"].to_pylist())
        n = len(out["item"])
        return pa.table([pa.array([lang] * n, pa.string()), pa.array(out["source"], pa.string()), pa.array(out["part"], pa.string()), pa.array(out["item"], pa.string()), pa.array(out["value"], pa.int64())], ["lang", "source", "part", "item", "value"])

    return run


def divergences(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, listed: int = LISTED, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source).

    Part ``pair``: each other source of the language and the sum of differences in all terms' probabilities, largest
    first. Part ``term``: the ``listed`` terms that the source uses most beyond the language as a whole.

    ``shards`` cut the terms; by default there are twice as many as shuffle partitions. One shard of a language is held
    as a matrix of sources by terms, and the result itself has a row for every two sources.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = kept_counts(docs, least_documents, shards)
    every = pick(docs, "lang", "source").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = groups.join(terms, "lang", "left").select("lang", "source", "total", F.coalesce("terms", F.lit(0)).alias("terms"))
    everywhere = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    shares = kept.groupBy("lang", "shard").cogroup(everywhere.groupBy("lang", "shard")).applyInArrow(_shares(listed), _SHARES)
    # The part keeps a source and a term of one name apart; shares of a pair add up, a term has one.
    summed = shares.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= listed)).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


_SQL = """
with docs as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce("source", '') as source,
  regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
words as (select doc, lang, source, unnest(terms) as term from docs),
kept as (select lang, term from words group by 1, 2 having count(distinct doc) >= 30),
counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by 1, 2, 3),
sizes as (select lang, count(*) as v from kept group by 1),
groups as (
  select g.lang, g.source, coalesce(v, 0) as v, coalesce(total, 0) as total from (select distinct lang, source from docs) g
  left join sizes using (lang) left join (select lang, source, sum(n) as total from counts group by 1, 2) using (lang, source)),
probs as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v) as p
  from groups g join kept k using (lang) left join counts using (lang, source, term)),
whole as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)::hugeint) // (any_value(total) + 5 * any_value(v)) as q
  from counts join sizes using (lang) join (select lang, sum(n) as total from counts group by 1) using (lang) group by 1, 2),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join (
    select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as value
    from probs x join probs y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3) s
  on s.lang = a.lang and s.source = a.source and s.other = b.source),
result as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, p - q from probs join whole using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value,
       cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank
from result qualify part = 'pair' or rank <= 50
"""

QUERIES = {"op11_divergence": (op11_divergence, _SQL)}
