"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's label depends on features of the line and of its neighbours, and on the label
before it. Forward-backward gives each line's marginal probability of being good; their mean, weighted by the lengths
of the lines, is the quality of the document. Training takes the label of a document for all its lines, from a bounded
sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pick, small_batches, table, text_slices, texts

#: Documents of each label in the training sample, and the lines of a chain there (longer texts are several chains).
SAMPLED_DOCUMENTS = 2000
CHAIN_LINES = 48

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_DROP_SYMBOLS = str.maketrans("", "", _SYMBOLS)
_OWN = 14
#: Own features that also count for the neighbours, by number.
_SHARED = (2, 3, 6, 7, 8, 10)
WIDTH = _OWN + 2 * len(_SHARED) + 2


def line_features(lines: list[str]) -> np.ndarray:
    """A row for each line: length, words, symbols, letters, capitals, digits, repetition, its end, copies above it;
    then the shared ones of the line before and behind it, and whether these exist."""
    own = np.zeros((len(lines), _OWN))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = _WORD.findall(line)
        n, chars = len(words), len(line)
        if not n:
            own[i, 0] = 1.0
            own[i, 13] = 1.0
            continue
        letters = sum(map(len, re.findall(r"[^\W\d_]+", line)))
        mean = sum(map(len, words)) / n
        different = len(set(words)) / n
        expected = 1.0 if n < 20 else (20 / n) ** 0.15  # words recur in long good lines too
        again = sum(a == b for a, b in zip(words, words[1:])) / n
        own[i] = (
            1.0,
            math.log1p(n) / 5,
            min(2.0, (chars - len(line.translate(_DROP_SYMBOLS))) / n * 2),
            min(1.0, 2 * max(0.0, 0.8 - letters / chars)),
            sum(map(str.isupper, line)) / chars,
            sum(map(str.isdigit, line)) / chars,
            min(2.0, 3 * max(0.0, expected - different)),
            min(1.0, 4 * again),
            line in seen,
            line.rstrip()[-1:] in ".!?:;\"",
            min(1.0, 2 * line.count("!") / n + 2 * line.count("?") / n),
            min(2.0, abs(mean - 5.2) / 3),
            n < 4,
            0.0,
        )
        seen.add(line)
    out = np.zeros((len(lines), WIDTH))
    out[:, :_OWN] = own
    k = len(_SHARED)
    out[1:, _OWN : _OWN + k] = own[:-1, _SHARED]
    out[:-1, _OWN + k : _OWN + 2 * k] = own[1:, _SHARED]
    out[0, -2] = out[-1, -1] = 1.0
    return out


@dataclass
class LineModel:
    """Score of "good" over "bad" by feature, and of each pair of neighbouring labels (bad, good)."""

    weights: np.ndarray
    transitions: np.ndarray


def _chain(emissions: np.ndarray, mask: np.ndarray, transitions: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For padded chains (chain x line) of log odds: marginals of good; sums of pairs of labels, chains by ``scale``."""
    chains, length = emissions.shape
    forward = np.zeros((length, chains, 2))
    backward = np.zeros((length, chains, 2))
    local = np.stack([np.zeros_like(emissions), emissions], axis=2).transpose(1, 0, 2)
    on = mask.T[:, :, None]
    forward[0] = local[0]
    for t in range(1, length):
        step = np.logaddexp(forward[t - 1][:, 0, None] + transitions[0], forward[t - 1][:, 1, None] + transitions[1]) + local[t]
        forward[t] = np.where(on[t], step, forward[t - 1])
    for t in range(length - 2, -1, -1):
        ahead = local[t + 1] + backward[t + 1]
        step = np.logaddexp(transitions[:, 0] + ahead[:, 0, None], transitions[:, 1] + ahead[:, 1, None])
        backward[t] = np.where(on[t + 1], step, backward[t + 1])
    total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - total).T * mask
    pairs = np.zeros((2, 2))
    for t in range(1, length):
        joint = forward[t - 1][:, :, None] + transitions + (local[t] + backward[t])[:, None, :] - total[:, None, None]
        pairs += (np.exp(joint) * (on[t] * scale[:, None])[:, :, None]).sum(axis=0)
    return good, pairs


def train(documents: list[tuple[np.ndarray, int]], rounds: int = 150, penalty: float = 1e-3) -> LineModel:
    """Maximum likelihood with Adam. ``documents``: features of the lines, and the label that all of them take.

    Both labels weigh the same in sum. Without documents every line is even.
    """
    model = LineModel(np.zeros(WIDTH), np.zeros((2, 2)))
    chains = [(x[i : i + CHAIN_LINES], y) for x, y in documents for i in range(0, len(x), CHAIN_LINES)]
    if not chains:
        return model
    length = max(len(x) for x, _ in chains)
    features = np.zeros((len(chains), length, WIDTH), np.float32)
    mask = np.zeros((len(chains), length), bool)
    labels = np.array([y for _, y in chains])
    for i, (x, _) in enumerate(chains):
        features[i, : len(x)] = x
        mask[i, : len(x)] = True
    lines = mask.sum(axis=1)
    # A chain weighs by the inverse of its line count and of its label's share, so that no long text rules.
    share = np.array([max(1, (labels == y).sum()) for y in (0, 1)])
    scale = 1.0 / (2 * share[labels] * lines)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, rounds + 1):
        transitions = theta[WIDTH:].reshape(2, 2)
        emissions = features @ theta[:WIDTH].astype(np.float32)
        good, pairs = _chain(emissions.astype(float), mask, transitions, scale)
        wanted = np.where(mask, labels[:, None], 0)
        gradient = np.zeros(WIDTH + 4)
        gradient[:WIDTH] = ((wanted - good) * scale[:, None]).ravel() @ features.reshape(-1, WIDTH)
        for y in (0, 1):
            gradient[WIDTH + 3 * y] += ((lines - 1) * scale)[labels == y].sum()
        gradient[WIDTH:] -= pairs.ravel()
        gradient -= penalty * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return LineModel(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def marginals(model: LineModel, features: np.ndarray) -> list[float]:
    """Probability of good for each line of one text, by forward-backward on log odds."""
    emissions = (features @ model.weights).tolist()
    (bb, bg), (gb, gg) = model.transitions.tolist()
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead = [0.0] * len(emissions)  # log odds of good from the lines behind
    for t in range(len(emissions) - 2, -1, -1):
        e = emissions[t + 1] + ahead[t + 1]
        ahead[t] = add(gb, gg + e) - add(bb, bg + e)
    out, odds = [], 0.0
    for t, e in enumerate(emissions):
        odds = (add(bg, gg + odds) - add(bb, gb + odds) if t else 0.0) + e
        x = odds + ahead[t]
        out.append(1 / (1 + math.exp(-x)) if x > -700 else 0.0)
    return out


def document_quality(model: LineModel, text: str) -> float:
    """Mean of the marginals, weighted by line lengths. A text without words is one empty line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")] or [""]
    p = marginals(model, line_features(lines))
    size = [len(x) + 1 for x in lines]
    return min(1.0, max(0.0, sum(a * b for a, b in zip(p, size)) / sum(size)))


def held_out() -> F.Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _label_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            rows = [line_features([x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] or [""]).astype("<f4").tobytes() for t in texts(part, "text")]
            yield pa.record_batch([part.column("quality"), pa.array(rows, pa.binary())], ["quality", "lines"])


def fit(docs: DataFrame, labels: DataFrame, sampled: int = SAMPLED_DOCUMENTS) -> LineModel:
    """Train on at most ``sampled`` documents of each label, those with the smallest hashes, held-out rows never."""
    small_batches(docs.sparkSession)
    usable = pick(labels, "doc_id", "quality").filter(~held_out() & F.col("quality").isin(0, 1)).withColumn("h", F.xxhash64("doc_id")).dropDuplicates(["doc_id"])
    chosen = [usable.filter(F.col("quality") == y).orderBy("h", "doc_id").limit(sampled) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).select("doc_id", "quality")
    rows = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_label_features, "quality int, lines binary").collect()  # bounded by the sample
    found = sorted((r["quality"], bytes(r["lines"])) for r in rows)
    return train([(np.frombuffer(lines, "<f4").reshape(-1, WIDTH).astype(float), y) for y, lines in found])


def score_documents(docs: DataFrame, model: LineModel) -> DataFrame:
    """(doc_id, score) for every row; a null text is empty; further columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array([document_quality(model, t) for t in texts(part, "text")], pa.float64())], ["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": (op8_quality_classifier, None)}
