"""Column names: normal form, lookup by normal form and similarity of two names.

Everything here works on schema metadata, never on rows.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

_NOT_WORD = re.compile(r"\W+")
_UNDERSCORES = re.compile(r"__+")


def snake(name: str) -> str:
    """Lower-case name whose punctuation and blanks are single underscores; Hangul is kept."""
    joined = _UNDERSCORES.sub("_", _NOT_WORD.sub("_", name.strip()))
    return joined.strip("_").lower()


def unique_names(names: Iterable[str]) -> list[str]:
    """Add ``_2``, ``_3`` … to repeated names so that every column stays addressable."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, suffix = name, 2
        while candidate in taken:
            candidate = f"{name}_{suffix}"
            suffix += 1
        taken.add(candidate)
        result.append(candidate)
    return result


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its normal form; a metadata-only projection."""
    return df.toDF(*unique_names(snake(c) for c in df.columns))


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    positions = {}
    for position, name in enumerate(df.columns):
        positions.setdefault(name, position)
    by_position = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_position.select(*[F.col(f"c{i}").alias(name) for name, i in positions.items()])


def col(name: str) -> Column:
    """Column reference that is safe for dots and blanks in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(columns: Iterable[str], wanted: str | Iterable[str], mode: str = "strict") -> list[str]:
    """Map the names a user typed to real columns.

    ``strict`` compares normal forms and raises ``KeyError`` for a name it cannot find; ``ignore``
    leaves such names out; ``contains`` falls back to the first column of which one name holds the other.
    """
    columns = list(columns)
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    exact = set(columns)
    by_normal_form: dict[str, str] = {}
    for column in columns:
        by_normal_form[snake(column)] = column
    found, missing = [], []
    for name in wanted:
        match = name if name in exact else by_normal_form.get(snake(name))
        if match is None and mode == "contains":
            low = name.lower()
            match = next((c for c in columns if low in c.lower() or c.lower() in low), None)
        if match is not None:
            found.append(match)
        else:
            missing.append(name)
    if missing and mode == "strict":
        raise KeyError(f"columns not found: {missing}; available: {columns}")
    return found


def resolve_one(columns: Iterable[str], wanted: str) -> str | None:
    found = resolve(columns, wanted, mode="ignore")
    return found[0] if found else None


def name_similarity(left: str, right: str) -> float:
    """0.7 × sequence ratio + 0.3 × Jaccard of word tokens; the ratio alone when a side has no token."""
    left, right = left.lower(), right.lower()
    ratio = difflib.SequenceMatcher(None, left, right).ratio()
    words_left, words_right = set(re.findall(r"\w+", left)), set(re.findall(r"\w+", right))
    if not (words_left and words_right):
        return ratio
    shared = len(words_left & words_right) / len(words_left | words_right)
    return 0.7 * ratio + 0.3 * shared


def suggest_mapping(reference: Iterable[str], target: Iterable[str], threshold: float = 0.6) -> dict[str, str]:
    """Best target per reference name at or above ``threshold``; the first of equals wins."""
    target = list(target)
    mapping = {}
    for name in reference:
        scored = [(name_similarity(name, t), t) for t in target]
        score, choice = max(scored, key=lambda pair: pair[0], default=(0.0, None))
        if choice is not None and score >= threshold and score > 0:
            mapping[name] = choice
    return mapping
