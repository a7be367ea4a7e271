"""Corpus preparation in five stages, each over what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.llm import decontamination, ngram_join, packing, quality_rules, secrets
from tablesmith.llm.common import plain, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality rules' label model takes for good; rejected ones go."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 keep one row, that of the smallest doc_id.

    Rows are told apart by their place: of repeated rows one stays, rows without a doc_id yield to rows with one.
    """
    numbered = _numbered(docs, "near-duplicates")
    groups = ngram_join.similar_groups(_texts(numbered), k=5, num=80, den=100).selectExpr("doc_id as place", "component_id")
    named = groups.join(numbered.selectExpr("place", "row.doc_id as doc_id"), "place")
    keeper = named.groupBy("component_id").agg(F.expr("min(struct(doc_id is null as unnamed, doc_id, place)).place as place"))
    return _without(numbered, groups.join(keeper, "place", "left_anti"), "copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers, names or units. Each row is judged by itself."""
    numbered = _numbered(docs, "decontamination")
    found = decontamination.contaminated(_texts(numbered), table(spark, sf_dir, "benchmark"))
    return _without(numbered, found.selectExpr("doc_id as place").distinct(), "contaminated")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind; the documents stay."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents that are left into sequences of 1024."""
    return packing.pack(docs, packing.default_vocabulary())


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    """(place, row): all rows, stored with a number of their own, whatever their columns hold or are called."""
    row = F.struct(*[F.col(plain(n)) for n in docs.columns]).alias("row")
    return stored(docs.select(F.monotonically_increasing_id().alias("place"), row), label + "-rows")


def _texts(numbered: DataFrame) -> DataFrame:
    """The texts under their rows' numbers, as the operators read them."""
    return numbered.selectExpr("place as doc_id", "row.text as text")


def _without(numbered: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """The rows but for those dropped. Their numbers are stored first, so their true size decides how to join."""
    gone = stored(dropped.select("place"), label)
    return numbered.join(gone, "place", "left_anti").select("row.*")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", without_secrets),
    ("packing", pack),
]

#: Estimation, tokenisation and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
