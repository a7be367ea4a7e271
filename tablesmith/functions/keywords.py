"""Tag texts with the pivot rows, values, chart and filters their keywords name."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .lexicon import KEYWORD_MAP
from .names import col

KEYWORD_MAP_VARIABLE = "TABLESMITH_KEYWORD_MAP"
#: Characters of the pieces by which a text finds its keywords; shorter keywords are found by themselves.
GRAM = 6
#: A keyword table of at most so many bytes is sent to every task.
SENT_BYTES = 32 << 20


def load_keyword_map(path: str | None = None) -> dict[str, Any]:
    """Keyword map from a JSON file (argument, then environment variable), else the built-in one.

    A file that is named but missing is an error, not a reason to tag with other words than asked for.
    """
    path = path or os.getenv(KEYWORD_MAP_VARIABLE)
    if not path:
        return KEYWORD_MAP
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


def _mentions(text: Column, keywords: Sequence[str]) -> Column:
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | F.contains(text, F.lit(keyword.lower()))
    return hit


def _tags(text: Column, labelled: Mapping[str, Sequence[str]]) -> Column:
    if not labelled:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(_mentions(text, kws), F.lit(label)) for label, kws in labelled.items()]))


def tag_keywords(
    df: DataFrame,
    text: str,
    keyword_map: Mapping[str, Any] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``rows``, ``values`` (label:aggregate), ``chart`` (first hit) and one ``filter_<column>`` array.

    Keywords are case-insensitive substrings of the whole text. ``columns`` keeps only row and value
    labels that name one of them, ignoring case.
    """
    keyword_map = keyword_map or load_keyword_map()
    # Lowered once in a projection of its own, then searched for every keyword.
    df = df.withColumn("__lowered", F.lower(F.trim(F.coalesce(col(text), F.lit("")))))
    lowered = F.col("__lowered")
    allowed = None if columns is None else {c.lower() for c in columns}

    def usable(label: str) -> bool:
        return allowed is None or label.lower() in allowed

    rows = {label: kws for label, kws in keyword_map.get("rows", {}).items() if usable(label)}
    values = {
        f"{label}:{entry.get('agg', 'sum')}": entry.get("keywords", [])
        for label, entry in keyword_map.get("values", {}).items()
        if usable(label)
    }
    chart = F.lit(None).cast("string")
    for kind, kws in reversed(list(keyword_map.get("chart", {}).items())):
        chart = F.when(_mentions(lowered, kws), F.lit(kind)).otherwise(chart)
    added = {"rows": _tags(lowered, rows), "values": _tags(lowered, values), "chart": chart}
    for name, levels in keyword_map.get("filters", {}).items():
        added[f"filter_{name}"] = _tags(lowered, levels)
    return df.withColumns(added).drop("__lowered")


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    """The distinct pieces of a text of the given lengths; the empty text is the one piece of length 0."""
    cut = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths if n]
    return F.array_distinct(F.concat(*cut, *([F.array(F.lit(""))] if 0 in lengths else [])))


def keyword_index(words: DataFrame) -> DataFrame:
    """(word, gram): the distinct words, and of each the one of its pieces that fewest words share."""
    own = F.when(F.char_length("word") >= GRAM, _grams(F.col("word"), [GRAM])).otherwise(F.array("word"))
    pieces = words.select("word").distinct().select("word", F.explode(own).alias("gram"))
    shared = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return pieces.join(shared, "gram").groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def tag_by_table(
    df: DataFrame, text: str, keywords: DataFrame, into: str = "tags", label: str = "label", keyword: str = "keyword"
) -> DataFrame:
    """Add ``into``: the sorted labels whose keywords the text contains, as :func:`tag_keywords` finds them.

    For keyword tables of any size: a plan of fixed size takes the place of one search for each keyword. Every keyword
    is looked up by one piece of ``GRAM`` characters, and only texts that hold this piece are searched for it. Texts
    are compared in lower case and without blanks at their ends; a missing text is an empty one; an empty keyword is in
    every text. The table is stored once with row numbers, so rows may be equal and need no key. A keyword table of at most ``SENT_BYTES`` goes to
    every task; with a larger one the pieces are shuffled without their texts. Rows without a label or keyword tag nothing.
    """
    words = materialize(keywords.select(col(label).cast("string").alias("label"), F.lower(col(keyword)).alias("word")).dropna().distinct(), "labels")
    index = materialize(keyword_index(words), "keywords")
    size = F.sum(F.octet_length("word") + F.octet_length("gram") + 64)
    found = index.agg(size.alias("size"), F.array_sort(F.collect_set(F.char_length("gram"))).alias("lengths")).first()
    if not found["lengths"]:
        return df.withColumn(into, F.array().cast("array<string>"))
    row, lowered = _unused(df, "row"), _unused(df, "lowered")
    stored = materialize(df.withColumn(row, F.monotonically_increasing_id()), "texts")
    texts = stored.select(F.col(row).alias("row"), F.lower(F.trim(F.coalesce(col(text), F.lit("")))).alias(lowered))
    holds = F.contains(F.col(lowered), F.col("word"))
    cut = F.explode(_grams(F.col(lowered), found["lengths"])).alias("gram")
    if found["size"] <= SENT_BYTES:
        hits = texts.select("row", lowered, cut).join(F.broadcast(index), "gram").where(holds)
    else:
        candidates = texts.select("row", cut).join(index, "gram").select("row", "word")
        hits = candidates.join(texts, "row").where(holds)
    tags = hits.select("row", "word").join(words, "word").groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("tags")).select(F.col("row").alias(row), F.col("tags").alias(lowered))
    return stored.join(tags, row, "left").select(
        *[col(c) for c in df.columns if c != into], F.coalesce(lowered, F.array().cast("array<string>")).alias(into)
    )


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name
