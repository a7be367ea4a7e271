"""Licence scan: a trained paragraph classifier, a calibrated unknown class and templates that confirm.

A multinomial logistic regression over hashed word 1- to 3-grams tells licence families from each other and from
unknown paragraphs. It is trained on variations of public notices and, as unknown, on ordinary sentences and a bounded
sample of the corpus' own paragraphs. A temperature fitted on held-out variations calibrates its probabilities. What
it predicts counts only if a notice of that family shares enough word 3-grams with the paragraph.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pick, small_batches, table, text_slices
from .licence_texts import NOTICES, ORDINARY
from .wordhash import WordHasher, mix

FAMILIES = ["unknown", *NOTICES]
BUCKETS = 1 << 16
#: Paragraphs of the corpus in the training set, as examples of unknown ones.
SAMPLED_PARAGRAPHS = 2000
_WORD = re.compile(r"[a-z0-9]+")


def _features(hasher: WordHasher, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of all lines, line after line, and the range of each line."""
    words, bounds = hasher.words(lines)
    n = len(words)
    grams = np.full((n, 3), -1, np.int64)
    grams[:, 0] = (mix(words + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    line = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for size, salt in ((2, 2), (3, 3)):
        if n >= size:
            rolled = words[: n - size + 1].copy()
            for j in range(1, size):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : n - size + 1 + j]
            whole = line[: n - size + 1] == line[size - 1 :]
            grams[: n - size + 1, size - 1] = np.where(whole, (mix(rolled + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64), -1)
    flat = grams.ravel()
    kept = flat >= 0
    return flat[kept], np.r_[0, np.cumsum(kept)][bounds * 3]


def _bare(lines: pa.Array) -> pa.Array:
    """Lines with everything but letters and digits made blank, so that punctuation does not matter."""
    return pc.replace_substring_regex(lines, r"[^\pL\pN]+", " ")


@dataclass
class LicenceModel:
    weights: np.ndarray  # bucket x family
    bias: np.ndarray
    temperature: float

    def scores(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, a row for each line. A line that can't beat "unknown" gets no more than that.

        The sum of each gram's best gain over "unknown" bounds every family's gain; only lines where the bound is
        positive are scored in full.
        """
        counts = np.diff(bounds)
        root = np.sqrt(np.maximum(counts, 1))
        gain = (self.weights[:, 1:] - self.weights[:, :1]).max(axis=1)
        sums = np.r_[0.0, np.cumsum(gain[grams])]
        hopeful = np.flatnonzero((sums[bounds[1:]] - sums[bounds[:-1]]) / root + (self.bias[1:] - self.bias[0]).max() > 0)
        out = np.zeros((len(counts), len(FAMILIES)))
        out[:, 0] = 1
        for i in hopeful.tolist():
            logits = (self.weights[grams[bounds[i] : bounds[i + 1]]].sum(axis=0) / root[i] + self.bias) / self.temperature
            e = np.exp(logits - logits.max())
            out[i] = e / e.sum()
        return out


def _variations(text: str, draw: random.Random, number: int) -> list[str]:
    """The text, and copies of it with a word left out, doubled or cut off, or with words before it."""
    out, words = [text], text.split()
    for _ in range(number - 1):
        w = list(words)
        change = draw.randrange(4)
        at = draw.randrange(len(w))
        if change == 0 and len(w) > 4:
            del w[at]
        elif change == 1:
            w.insert(at, w[at])
        elif change == 2 and len(w) > 8:
            w = w[: len(w) - draw.randrange(1, len(w) // 3)]
        else:
            w = ["Copyright", "(c)", str(draw.randrange(1990, 2030)), *w] if draw.random() < 0.5 else ["*", *w]
        out.append(" ".join(w))
    return out


def train(unknown: list[str], seed: int = 7, epochs: int = 12) -> LicenceModel:
    """Fit the classifier; ``unknown`` are paragraphs of the corpus."""
    draw = random.Random(seed)
    examples = [(v, FAMILIES.index(f)) for f, notices in NOTICES.items() for t in notices for v in _variations(t, draw, 30)]
    examples += [(v, 0) for t in ORDINARY for v in _variations(t, draw, 10)] + [(t, 0) for t in unknown if not confirmed_family(t)]
    draw.shuffle(examples)
    hasher = WordHasher()
    grams, bounds = _features(hasher, _bare(pa.array([t for t, _ in examples], pa.string())))
    y = np.array([f for _, f in examples])
    x = [grams[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    weights, bias = np.zeros((BUCKETS, len(FAMILIES))), np.zeros(len(FAMILIES))
    bias[0] = 1.0
    squares = np.full((BUCKETS, 1), 1e-2)
    held = np.arange(len(y)) % 5 == 0
    for _ in range(epochs):
        for i in np.flatnonzero(~held):
            if not len(x[i]):
                continue
            root = np.sqrt(len(x[i]))
            logits = weights[x[i]].sum(axis=0) / root + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            squares[x[i], 0] += (p @ p) / len(x[i])
            weights[x[i]] -= 0.3 * p / root / np.sqrt(squares[x[i]])
            bias -= 0.01 * p
    model = LicenceModel(weights.astype(np.float32), bias, 1.0)
    best = (np.inf, 1.0)
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        loss = 0.0
        for i in np.flatnonzero(held):
            logits = (weights[x[i]].sum(axis=0) / np.sqrt(max(1, len(x[i]))) + bias) / temperature
            loss -= logits[y[i]] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        best = min(best, (loss, temperature))
    model.temperature = best[1]
    return model


def _trigrams(text: str) -> set[tuple]:
    words = _WORD.findall(text.lower())
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


_TEMPLATES = {f: [_trigrams(t) for t in notices] for f, notices in NOTICES.items()}


def confirmed_by(family: str, text: str, share: float = 0.6) -> bool:
    """Whether a notice of the family and the text have most word 3-grams of the shorter one in common."""
    own = _trigrams(text)
    return any(t and own and len(own & t) >= share * min(len(own), len(t)) for t in _TEMPLATES[family])


def confirmed_family(text: str) -> str | None:
    return next((f for f in _TEMPLATES if confirmed_by(f, text)), None)


_SPAN = pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])


def _classify(model, templates, at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").fill_null("")
                split = pc.split_pattern(texts, "\n")
                lines, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
                scores = model.value.scores(*_features(hasher, _bare(lines)))
                found: dict[int, list] = {}
                for i in np.flatnonzero(scores[:, 0] < 1 - at_least).tolist():
                    family = FAMILIES[int(scores[i].argmax())]
                    if family != "unknown" and scores[i].max() >= at_least and templates(family, lines[i].as_py()):
                        doc = int(np.searchsorted(ends, i, side="right"))
                        found.setdefault(doc, []).append((i, family, float(scores[i].max())))
                out = []
                for doc in range(len(texts)):
                    first, spans, starts = (int(ends[doc - 1]) if doc else 0), [], None
                    for i, family, p in found.get(doc, ()):
                        if starts is None:
                            starts = np.r_[0, np.cumsum([len(x.as_py()) + 1 for x in lines[first : int(ends[doc])]])]
                        start = int(starts[i - first])
                        end = int(starts[i - first + 1]) - 1
                        if spans and spans[-1]["family"] == family and spans[-1]["end"] + 1 == start:
                            spans[-1] |= {"end": end, "probability": max(p, spans[-1]["probability"])}
                        else:
                            spans.append({"family": family, "start": start, "end": end, "probability": p})
                    out.append(spans)
                yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.list_(_SPAN))], ["doc_id", "licences"])

    return run


def sampled_paragraphs(docs: DataFrame, number: int = SAMPLED_PARAGRAPHS) -> list[str]:
    """The ``number`` different paragraphs of the corpus with the smallest hashes, cut at 400 characters; all if there are fewer.

    Lines are counted first, so that only hashes below a border are sorted: what reaches the driver does not grow with
    the number of tasks.
    """
    lines_in_all = docs.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 1
    border = -(2**63) + min(2**64 - 1, 8 * number * 2**64 // lines_in_all)
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''").select(F.xxhash64("line").alias("h"), F.substring("line", 1, 400).alias("line"))
    return [r["line"] for r in lines.filter(F.col("h") <= border).distinct().orderBy("h", "line").limit(number).collect()]


def scan_licences(docs: DataFrame, at_least: float = 0.5, sampled: int = SAMPLED_PARAGRAPHS) -> DataFrame:
    """(doc_id, licences) for every row: family, place in code points and probability of each licence paragraph.

    A paragraph is a line; neighbouring lines of one family are one finding. Null and empty texts have none; repeated
    rows give repeated results; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, "doc_id", "text")
    model = spark.sparkContext.broadcast(train(sampled_paragraphs(docs, sampled)))  # BUCKETS x families numbers
    return docs.mapInArrow(_classify(model, confirmed_by, at_least), "doc_id long, licences array<struct<family string, start long, end long, probability double>>")


def op7_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id",
        "cast(size(licences) as long) as n_licences",
        "array_join(array_sort(array_distinct(transform(licences, s -> s.family))), ',') as families",
        "array_join(transform(licences, s -> concat(s.family, ':', s.start, ':', s.end)), ',') as spans",
    )


QUERIES = {"op7_licence_scans": (op7_licence_scans, None)}
