"""Quality rules that vote, and a label model that weighs them; DataFrame expressions only.

Each rule says good, bad or nothing about a document. Nobody knows how far to trust a rule, so expectation-maximisation
estimates, from the votes of all documents, how often each rule says what about good and about bad documents. A
document is kept when the posterior probability of being good, given all its votes, reaches ``keep_at``.

The estimation sees the vote patterns and their counts only, at most 3 ** rules rows whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pick, plain, stored, table

SYMBOLS = "#*$%&|<>"
#: Frequent short words of the languages that the corpus is expected in (fixed values).
STOP_WORDS = "the of and to in that is was for it with as be on at by this are or de la le et les des en un une que el los y se por con der die und das den ist von zu mit ein eine auf"

#: (name, says good, says bad): conditions over the columns of :func:`features`; neither means no vote.
RULES = [
    ("length", "n_words >= 30", "n_words < 10"),
    ("symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    ("plain lines", "n_symbol_lines <= 0.1 * n_lines and n_lines > 0", "n_symbol_lines > 0.4 * n_lines"),
    ("repeated lines", "n_dup_lines = 0 and n_lines > 1", "n_dup_lines > 0.4 * n_lines"),
    ("repeated words", "n_repeat_words <= 0.1 * n_words", "n_repeat_words > 0.4 * n_words"),
    ("word length", "word_chars between 3.8 * n_words and 7 * n_words", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    ("capitals", "n_capitals <= 0.1 * word_chars", "n_capitals > 0.3 * word_chars"),
    ("different words", "n_distinct > 0.4 * n_words", "n_distinct < 0.25 * n_words and n_words >= 30"),
    ("stop words", "n_stop_words >= 3", "n_stop_words = 0 and n_words >= 30"),
    ("sentence ends", "n_ended_lines >= 0.6 * n_lines and n_lines > 0", "n_ended_lines < 0.2 * n_lines"),
]

_WINDOW = 5
_BLANKS = "' \\t\\n\\u000B\\u000C\\r'"


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with counts over each whole text; a null text has none of anything.

    Adds n_words, word_chars, n_symbols, n_lines, n_symbol_lines, n_dup_lines, n_repeat_words, n_capitals, n_distinct, n_stop_words and
    n_ended_lines; the text must be in column ``text``, and no other column may have one of these names or be called
    words, lines, windows or kinds (the operators below only pass what they need).
    """
    names = docs.columns
    w = ", ".join(f"words[i + {j}]" for j in range(_WINDOW))
    # The repeated windows of a text: sorted by hash, equal ones are neighbours; the words they cover are counted by
    # the gaps between their places.
    covered = f"""
        transform(array(array_sort(transform(windows, (h, i) -> struct(h as h, i as i)))), s ->
        transform(array(array_sort(filter(transform(s, (x, k) -> if(x.h = get(s, k - 1).h or x.h = get(s, k + 1).h, x.i, null)), i -> i is not null))), p ->
        aggregate(transform(p, (x, k) -> least({_WINDOW}, coalesce(get(p, k + 1) - x, {_WINDOW}))), 0, (a, x) -> a + x))[0])[0]"""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS.split())
    split = docs.withColumn("text", F.coalesce("text", F.lit(""))).select(
        *[F.col(f"`{n}`") for n in names],
        F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')").alias("words"),
        F.expr(f"filter(split(text, '\\n'), l -> translate(l, {_BLANKS}, '') <> '')").alias("lines"),
    )
    hashed = split.withColumn("windows", F.expr(f"if(size(words) < {_WINDOW}, array(), transform(sequence(0, size(words) - {_WINDOW}), i -> xxhash64({w})))")).withColumn("kinds", F.expr("array_distinct(words)"))
    counts = {
        "n_words": "size(words)",
        "word_chars": f"length(translate(text, {_BLANKS}, ''))",
        "n_symbols": f"length(text) - length(translate(text, '{SYMBOLS}', ''))",
        "n_lines": "size(lines)",
        "n_symbol_lines": f"size(filter(lines, l -> length(l) - length(translate(l, '{SYMBOLS}', '')) > 1))",
        "n_dup_lines": "size(lines) - size(array_distinct(lines))",
        "n_repeat_words": f"case when size(array_distinct(windows)) = size(windows) then 0 else {covered} end",
        "n_capitals": "length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
        "n_distinct": "size(kinds)",
        "n_stop_words": f"size(array_intersect(kinds, array({stop})))",
        "n_ended_lines": "size(filter(lines, l -> right(rtrim(l), 1) in ('.', '!', '?', ':', ';', '\"')))",
    }
    return hashed.select(*[F.col(f"`{n}`") for n in names], *[F.expr(e).cast("long").alias(n) for n, e in counts.items()])


def base_failed() -> Column:
    """The hard rule before all votes: too few words, or too many in repeated windows."""
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def votes() -> Column:
    """The votes of all rules: for rule ``i`` the number 3 i + 2 (good), 3 i + 1 (no vote) or 3 i (bad)."""
    return F.expr("array(" + ", ".join(f"case when {bad} then {3 * i} when {good} then {3 * i + 2} else {3 * i + 1} end" for i, (_, good, bad) in enumerate(RULES)) + ")")


@dataclass
class LabelModel:
    """Share of good documents, and how often each rule that votes says what over bad and over good documents.

    That a rule does not vote says nothing: it counts 1 under both.
    """

    good: float
    over_bad: list[float]
    over_good: list[float]

    def posterior(self) -> Column:
        """Probability of a good document from its column ``votes``.

        The odds go in as one array, so that the plans of all rounds share their generated code.
        """
        odds = F.array(*[F.lit(math.log(g / b)) for b, g in zip(self.over_bad, self.over_good)], F.lit(math.log(self.good / (1 - self.good))))
        total = F.aggregate("votes", odds[len(self.over_bad)], lambda a, v: a + odds[v])
        return 1 / (1 + F.exp(-total))


def fit(counted: DataFrame, rounds: int = 50, tolerance: float = 1e-6) -> LabelModel:
    """Estimate the model from the patterns ``votes`` and their counts ``n``. A round is one small aggregation.

    The start is the share of good votes among a pattern's votes. An empty table gives rules that say nothing.
    """
    model = LabelModel(0.5, [1.0] * (3 * len(RULES)), [1.0] * (3 * len(RULES)))
    posterior = F.expr("0.5D + 0.5D * aggregate(votes, 0, (a, v) -> a + v % 3 - 1) / greatest(1, aggregate(votes, 0, (a, v) -> a + abs(v % 3 - 1)))")
    for _ in range(rounds):
        weighed = counted.select("n", (F.col("n") * posterior).alias("g"), F.explode("votes").alias("vote"))
        cast = {r["vote"]: (r["n"] - r["g"], r["g"]) for r in weighed.groupBy("vote").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()}
        if not cast:
            return model
        seen = lambda v, c: cast.get(v, (0.0, 0.0))[c]
        bad, good = (sum(seen(v, c) for v in range(3)) for c in (0, 1))
        over_bad, over_good = (
            [1.0 if v % 3 == 1 else (seen(v, c) + 1) / (seen(v - v % 3, c) + seen(v - v % 3 + 2, c) + 2) for v in range(3 * len(RULES))] for c in (0, 1)
        )
        change = max(abs(x - y) for x, y in zip(model.over_bad + model.over_good, over_bad + over_good))
        model = LabelModel((good + 1) / (good + bad + 2), over_bad, over_good)
        posterior = model.posterior()
        if change < tolerance:
            break
    return model


def counted_votes(voted: DataFrame) -> DataFrame:
    """The patterns of ``votes`` and how many documents have each, stored: at most 3 ** rules rows."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    return stored(patterns, "votes").coalesce(1).sortWithinPartitions("votes")


def judged(measured: DataFrame, model: LabelModel, keep_at: float = 0.5) -> DataFrame:
    """``measured`` with ``posterior``, ``base_failed`` and ``kept``."""
    names = [f"`{n}`" for n in measured.columns]
    scored = measured.select(*names, votes().alias("votes"), base_failed().alias("base_failed")).withColumn("posterior", model.posterior())
    return scored.select(*names, "posterior", "base_failed", F.expr(f"not base_failed and posterior >= {keep_at}").alias("kept"))


def quality_rules(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """(doc_id, counts, posterior, base_failed, kept) for every row of ``docs``.

    Null and empty texts have no words and fail. Repeated rows vote as often as they occur. Further columns are
    ignored; an empty table gives an empty result.
    """
    measured = stored(features(pick(docs, "doc_id", "text")).drop("text"), "rule-counts")
    return judged(measured, fit(counted_votes(measured.select(votes().alias("votes")))), keep_at)


def kept_documents(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever these are called.

    Null and empty texts go; repeated rows are kept or go together; an empty table stays empty.
    """
    names = [F.col(plain(n)) for n in docs.columns]
    inner = docs.select(F.struct(*names).alias("row"), F.col("text"))
    # Rows are stored with their votes, as counting is dearer than reading a row again.
    voted = stored(features(inner).select("row", votes().alias("votes"), base_failed().alias("base_failed")), "voted")
    model = fit(counted_votes(voted))
    return voted.withColumn("posterior", model.posterior()).filter(~F.col("base_failed") & (F.col("posterior") >= keep_at)).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES = {"op1_quality_rules": (op1_quality_rules, None)}
