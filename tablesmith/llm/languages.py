"""Languages of the spans of a text: word scores narrowed by script, joined by a Viterbi path that pays for switching.

A word's score in a language is the log-likelihood of its character 1- to 4-grams (hashed, its edges marked). The script
of a word, by ranges of code points, says which languages come into question: those that the training texts write in it.
The best path through the words' languages, where each change costs a penalty, gives the spans. A document's language
is the one with most letters.

Words are runs of letters. A null text or one without letters is ``und`` with score 0, as is every text when there is
nothing to learn from. Rows that repeat are judged each for itself; further columns are ignored. The path runs over
whole texts, in blocks of words whose transfer matrices join them, so a long text takes no longer than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import pick, small_batches, table, text_slices, texts
from .line_crf import held_out

#: Documents of each language in the training sample; slots of the hashed n-grams; longest n-gram.
SAMPLED_DOCUMENTS, SLOTS, LONGEST = 2000, 1 << 16, 4
#: Log-likelihood that a change of language costs, and a word in a script that the language does not use.
SWITCH, FOREIGN = 6.0, 12.0
#: A language uses a script that has this share of its training letters.
SCRIPT_SHARE = 0.01
_SMOOTHING = 0.1
_BLOCK = 128

#: First code points of the letters of a script, and the code point behind them.
SCRIPTS = [
    ("Latin", 0x41, 0x250), ("Greek", 0x370, 0x400), ("Cyrillic", 0x400, 0x530), ("Armenian", 0x531, 0x590), ("Hebrew", 0x590, 0x600),
    ("Arabic", 0x600, 0x700), ("Devanagari", 0x900, 0x980), ("Bengali", 0x980, 0xA00), ("Tamil", 0xB80, 0xC00), ("Telugu", 0xC00, 0xC80),
    ("Thai", 0xE00, 0xE80), ("Georgian", 0x10A0, 0x1100), ("Hangul", 0x1100, 0x1200), ("Ethiopic", 0x1200, 0x1380), ("Latin", 0x1E00, 0x1F00),
    ("Greek", 0x1F00, 0x2000), ("Kana", 0x3040, 0x3100), ("Han", 0x3400, 0xA000), ("Hangul", 0xAC00, 0xD7B0), ("Arabic", 0xFB50, 0xFE00),
    ("Han", 0x20000, 0x32400),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_LAST = 0x32400


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, its lower case where that is one character, its script's number."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(_LAST):
        if chr(code).isalpha():
            letter[code] = True
            low = chr(code).lower()
            lower[code] = ord(low) if len(low) == 1 else code
    script = np.zeros(0x110000, np.uint8)
    for name, start, stop in SCRIPTS:
        script[start:stop] = SCRIPT_NAMES.index(name)
    return letter, lower, script


class Reader:
    """Words of texts as arrays. The tables of code points are built once a task."""

    def __init__(self) -> None:
        self.letter, self.lower, self.script = _tables()

    def words(self, column: list[str]) -> "Words":
        return Words(column, self)


class Words:
    """The words of some texts: text of each, place in it in code points, and the distinct words among them."""

    def __init__(self, column: list[str], reader: Reader) -> None:
        sizes = np.array([len(t) for t in column], np.int64)
        begins = np.cumsum(sizes) - sizes
        code = np.frombuffer("".join(column).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = reader.letter[code]
        edge = np.zeros(len(code) + 1, bool)
        edge[begins] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(begins, starts, "right") - 1
        self.start, self.letters = starts - begins[self.doc] if len(starts) else starts, stops - starts
        low = reader.lower[code].astype(np.uint64)
        sums = np.zeros(len(code) + 1, np.uint64)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(code) - 1), _BASE, np.uint64)])[: len(code)]
        np.cumsum(_mixed(low) * powers, out=sums[1:])
        # Equal words: the polynomials of two words are equal when each is shifted by the other's place.
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(max(0, len(code) - 1), _INVERSE, np.uint64)])[: len(code)]
        key = (sums[stops] - sums[starts]) * inverse[starts] if len(starts) else np.empty(0, np.uint64)
        _, at, self.kind = np.unique(key, return_index=True, return_counts=False, return_inverse=True)
        self.distinct = len(at)
        self.scripts = reader.script[code[starts[at]]] if len(at) else np.empty(0, np.uint8)
        # The distinct words one after the other, each between two marks (zeros).
        length = self.letters[at] + 2
        offset = np.cumsum(length) - length
        self.marked = np.zeros(int(length.sum()), np.uint64)
        word = np.repeat(np.arange(len(at)), length)
        place = np.arange(len(self.marked)) - offset[word]
        body = (place > 0) & (place < length[word] - 1)
        self.marked[body] = low[(starts[at][word] + place - 1)[body]]
        self.word, self.place, self.length = word, place, length

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, distinct word, slot) of all n-grams; a single mark is none."""
        for n in range(1, LONGEST + 1):
            count = len(self.marked) - n + 1
            if count <= 0:
                continue
            at = np.flatnonzero(self.place[:count] + n <= self.length[self.word[:count]])
            if n == 1:
                at = at[self.marked[at] > 0]
            rolled = np.full(len(at), n, np.uint64)
            for j in range(n):
                rolled = rolled * np.uint64(_BASE) + self.marked[at + j]
            yield n, self.word[at], (_mixed(rolled) >> np.uint64(64 - 16)).astype(np.int64)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class LanguageModel:
    """Names of the languages, log-likelihood per n-gram slot and language, and whether a language uses a script."""

    names: list[str]
    weights: np.ndarray  # (slots of all lengths) x languages
    uses: np.ndarray  # scripts x languages


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): n-grams of the training texts by length and slot; letters by script behind these."""
    reader, counts = Reader(), {}
    for batch in batches:
        for part in text_slices(batch, "text"):
            column = list(texts(part, "text"))
            words = reader.words(column)
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])[words.doc] if len(words.doc) else np.empty(0, bool)
                times = np.bincount(words.kind[mine], minlength=words.distinct)
                own = counts.setdefault(lang, np.zeros(LONGEST * SLOTS + len(SCRIPT_NAMES), np.int64))
                for n, word, slot in words.grams():
                    own[(n - 1) * SLOTS : n * SLOTS] += np.bincount(slot, times[word], SLOTS).astype(np.int64)
                letters = np.bincount(words.scripts[words.kind[mine]], words.letters[mine], len(SCRIPT_NAMES)) if mine.any() else 0
                own[LONGEST * SLOTS :] += np.asarray(letters).astype(np.int64)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "slot", "n"])


def fit(docs: DataFrame, sampled: int = SAMPLED_DOCUMENTS) -> LanguageModel:
    """Learn from at most ``sampled`` documents of each language, those with the smallest hashes, held-out rows never.

    The driver gets one number for each slot and language, however long the sampled texts are.
    """
    small_batches(docs.sparkSession)
    usable = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Ranked by id alone, so the texts themselves are not sorted; rows that repeat an id come along.
    chosen = usable.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sampled).select("doc_id", "lang").distinct()
    sample = usable.join(chosen, usable["doc_id"].eqNullSafe(chosen["doc_id"]) & (usable["lang"] == chosen["lang"]), "left_semi").select("text", "lang")
    rows = sample.mapInArrow(_training_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((LONGEST * SLOTS + len(SCRIPT_NAMES), len(names)))
    if names:
        number = {x: i for i, x in enumerate(names)}
        counts[rows["slot"].to_numpy(), [number[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    letters = counts[LONGEST * SLOTS :]
    uses = (letters > 0) & (letters >= SCRIPT_SHARE * letters.sum(axis=0))
    per_length = counts[: LONGEST * SLOTS].reshape(LONGEST, SLOTS, len(names))
    known = per_length.any(axis=2, keepdims=True)  # slots that no language has tell none apart
    share = (per_length + _SMOOTHING) / (per_length.sum(axis=1, keepdims=True) + _SMOOTHING * np.maximum(known.sum(axis=1, keepdims=True), 1))
    weights = np.where(known, np.log(share) / LONGEST, 0.0)
    return LanguageModel(names, weights.reshape(LONGEST * SLOTS, len(names)).astype(np.float32), uses)


def word_scores(model: LanguageModel, words: Words) -> np.ndarray:
    """Distinct word x language: log-likelihood against the best language; those that do not write its script fall behind."""
    scores = np.zeros((words.distinct, len(model.names)))
    for n, word, slot in words.grams():
        gathered = model.weights[(n - 1) * SLOTS + slot]
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
        if len(begin):
            scores[word[begin]] += np.add.reduceat(gathered, begin, axis=0)
    candidate = model.uses[words.scripts]
    scores[~candidate.any(axis=1)] = 0.0  # no language in question, so none is preferred
    candidate |= ~candidate.any(axis=1, keepdims=True)
    best = np.where(candidate, scores, -np.inf).max(axis=1, keepdims=True) if len(scores) else 0.0
    return np.where(candidate, scores - best, np.minimum(scores - best, 0.0) - FOREIGN)


def viterbi(emission: np.ndarray, fresh: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. A change costs ``switch``, but nothing at a ``fresh`` word (the first of a text).

    Words are cut into blocks that run side by side: first each block's matrix of best scores from every language
    before it to every language at its end, then the blocks one after the other, then the paths within them.
    """
    n, k = emission.shape
    if not n:
        return np.empty(0, np.int64)
    blocks = -(-n // _BLOCK)
    e = np.zeros((blocks * _BLOCK, k))
    e[:n] = emission
    cost = np.full(blocks * _BLOCK, switch)
    cost[:n][fresh] = 0.0
    e, cost = e.reshape(blocks, _BLOCK, k), cost.reshape(blocks, _BLOCK)
    through = np.full((blocks, k, k), -np.inf)  # block, language before, language now
    through[:, np.arange(k), np.arange(k)] = 0.0
    for t in range(_BLOCK):
        changed = through.max(axis=2, keepdims=True) - cost[:, t, None, None]
        through = np.maximum(through, changed) + e[:, t, None, :]
    before = np.zeros((blocks + 1, k))
    for b in range(blocks):
        ahead = (before[b][:, None] + through[b]).max(axis=0)
        before[b + 1] = ahead - ahead.max()
    now, stay = before[:-1].copy(), np.empty((_BLOCK, blocks, k), bool)
    source = np.empty((_BLOCK, blocks), np.int64)
    for t in range(_BLOCK):
        source[t] = now.argmax(axis=1)
        changed = now.max(axis=1, keepdims=True) - cost[:, t, None]
        stay[t] = now >= changed
        now = np.maximum(now, changed) + e[:, t]
    ends = np.empty(blocks, np.int64)
    ends[-1] = before[-1].argmax()
    for b in range(blocks - 1, 0, -1):
        ends[b - 1] = (before[b] + through[b][:, ends[b]]).argmax()
    path, at, every = np.empty((_BLOCK, blocks), np.int64), ends, np.arange(blocks)
    for t in range(_BLOCK - 1, -1, -1):
        path[t] = at
        at = np.where(stay[t][every, at], at, source[t])
    return path.T.ravel()[:n]


def _labelled(model: LanguageModel, column: list[str], reader: Reader, switch: float) -> tuple[Words, np.ndarray, np.ndarray]:
    words = reader.words(column)
    emission = word_scores(model, words)[words.kind]
    fresh = np.r_[True, words.doc[1:] != words.doc[:-1]] if len(words.doc) else np.empty(0, bool)
    return words, emission, viterbi(emission, fresh, switch)


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language with most letters; its share of them, times its
    probability against the other languages where the whole text has to be in one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, k = Reader(), max(1, len(model.names))
        for batch in batches:
            for part in text_slices(batch, "text"):
                column = list(texts(part, "text"))
                langs, scores = ["und"] * len(column), np.zeros(len(column))
                if model.names:
                    words, emission, path = _labelled(model, column, reader, switch)
                    letters = np.bincount(words.doc * k + path, words.letters, len(column) * k).reshape(-1, k)
                    whole = np.stack([np.bincount(words.doc, emission[:, j], len(column)) for j in range(k)], axis=1)
                    likely = np.exp(whole - whole.max(axis=1, keepdims=True))
                    best, every = letters.argmax(axis=1), np.arange(len(column))
                    scores = letters[every, best] / np.maximum(letters.sum(axis=1), 1) * (likely / likely.sum(axis=1, keepdims=True))[every, best]
                    langs = [model.names[b] if some else "und" for b, some in zip(best.tolist(), letters.any(axis=1).tolist())]
                yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """(doc_id, start, end, lang): runs of words of one language, in code points, end exclusive. None without letters."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, _, path = _labelled(model, list(texts(part, "text")), reader, switch)
                if not len(path):
                    continue
                begin = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (words.doc[1:] != words.doc[:-1])])
                last = np.r_[begin[1:], len(path)] - 1
                yield pa.record_batch([
                    part.column("doc_id").take(pa.array(words.doc[begin])), pa.array(words.start[begin]),
                    pa.array(words.start[last] + words.letters[last]), pa.array([model.names[i] for i in path[begin].tolist()], pa.string()),
                ], ["doc_id", "start", "end", "lang"])

    if not model.names:
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, end long, lang string")
    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, lang string")


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op13_languages": (op13_languages, None)}
