from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "ve", "zu") for b in ("bar", "den", "fol", "gim", "hus", "lek", "mon", "pra", "sil", "tor")]


def prose(seed: int, n: int) -> str:
    """Invented sentences of ``n`` words with some stop words."""
    draw = random.Random(seed)
    out, line = [], []
    for i in range(n):
        line.append(draw.choice(["the", "of", "and", "to"]) if draw.random() < 0.3 else draw.choice(WORDS) + draw.choice(WORDS))
        if len(line) == 12 or i == n - 1:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join(out)


ODD_TEXTS = [None, "", " \n\t", "one", "a b", "x" * 50_000, "ß é   \U0001f600 word\x00word", "\n\n\n", "same words here\nsame words here"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, tiny and very long texts, repeated rows, null ids, and columns whose names clash."""
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, prose(1, 30_000), prose(2, 60), prose(2, 60)])]
    rows += [rows[-1], rows[-1], (None, prose(3, 40)), (None, None)]
    return frame(spark, rows)


def frame(spark, rows):
    full = [(i, t, "en", "src", None if t is None else len(t), 1, "x", 2.0, "k", 5, True) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, node long, words string, score double, `key` string, `start` int, kept boolean")
