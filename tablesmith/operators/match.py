"""Names of two tables that share most of their words, found through their rarest words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import col
from ..session import materialize

#: Words with this share of all word occurrences are common. So there are at most 1 / COMMON of them.
COMMON = 1e-4


def match_names(left: DataFrame, left_column: str, right: DataFrame, right_column: str, threshold: float = 0.5) -> DataFrame:
    """(left_name, right_name, score): all pairs of different names whose word Jaccard reaches ``threshold`` (above 0).

    Words are ``\\\\w+`` of the lowered name, each once; names without words and missing names match nothing. Every name
    sorts its words, common ones last, in one order for both tables. Names that reach the threshold then share one of
    their first few words, so these words are joined and only such pairs are compared. A word that many names have is
    last and rarely joined; the list of common words that is sent to every task has a size bound by its definition.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    sides = []
    for side, (df, column) in enumerate(((left, left_column), (right, right_column))):
        names = df.select(col(column).cast("string").alias("name")).where("name is not null").distinct()
        sides.append(names.select(F.lit(side).alias("side"), "name", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(name), '(?U)\\w+', 0)"))).alias("word")))
    words = materialize(sides[0].unionByName(sides[1]), "words")
    total = words.count()
    common = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2.0, total * COMMON))
    ranked = words.join(F.broadcast(common), "word", "left")
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
    named = ranked.groupBy("side", "name").agg(listed.alias("w")).select("side", "name", F.transform("w", lambda x: x["word"]).alias("words"))
    size = F.size("words")
    # With fewer words in common than this many from the start leave over, the threshold is out of reach.
    first = F.slice("words", 1, (size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)) + 1).cast("int"))
    keyed = materialize(named.select("side", "name", "words", F.explode(first).alias("word")), "first-words")
    a = keyed.where("side = 0").select("word", F.col("name").alias("left_name"), F.col("words").alias("a"))
    b = keyed.where("side = 1").select("word", F.col("name").alias("right_name"), F.col("words").alias("b"))
    score = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    pairs = a.join(b, "word").withColumn("score", score).where(F.col("score") >= threshold)
    return pairs.select("left_name", "right_name", "score").distinct()
