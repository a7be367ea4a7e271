"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders, so a question asked again with other values has the
same template. Template windows of documents and benchmark items are joined by hash. Along each alignment of a
document with an item the slots must then be consistent: one value of the item always stands for one value of the
document; values that became one count once. Chance hits of templates fail that; re-parameterised questions pass.
Where a value has more or fewer words than the one it stands for, the alignment goes on at a neighbouring shift. Beside them
all windows are joined by their lowered words and values as they stand, so a verbatim copy counts whatever it is made of.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bitmap import SLOTS, as_flags, bitmap_of
from .common import pick, small_batches, stored, table, text_slices, texts
from .wordhash import mix

#: Words read as numbers and as units behind a number (fixed values).
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split())
UNITS = frozenset("% ° $ € £ mm cm m km inch inches in ft foot feet yard yards yd mile miles mi mg g kg gram grams kilogram kilograms ton tons lb lbs oz ounce ounces pound pounds ml cl l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph cent cents dollar dollars euro euros degree degrees percent meter meters metre metres centimeter centimeters kilometer kilometers square cubic".split())

WINDOW = 8
#: An item is found where so many of its tokens (or all, if it has fewer) are covered by one alignment.
COVERED = 13
#: Sets the hashes of windows as they stand apart from those of templates; their rows have a negative size.
EXACT = 1 << 32
#: Window starts that a task reads in all ways at once.
BLOCK = 16384
#: Tokens after which windows that begin like no window of an item are left; spares work only.
PREFIX = 3
#: Tokens by which the changed values of an alignment may move what follows, either way.
SPREAD = 2 * WINDOW

_NUMBER = re.compile(r"[-+]?[$€£]?(\d+(?:[.,:/]\d+)*)(.*)")
_SLOT = {"number": 1, "name": 2, "unit": 3}
_PLAIN, _CAPITAL, _NUM, _UNIT, _NUM_UNIT, _NOTHING = range(6)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


_SLOT_CODES = {kind: xxhash.xxh64_intdigest(f"<{kind}>".encode()) for kind in _SLOT}


def classify(raw: str) -> tuple[int, int, str, bool, str]:
    """(class, code of the lowered word, value, ends a sentence, unit) of a string without blanks."""
    if raw.isalpha() or raw[:-1].isalpha() and raw[-1] in ".,;:!?":  # most words; what follows gives the same
        lowered = (raw if raw[-1].isalpha() else raw[:-1]).lower()
        kind = _NUM if lowered in NUMBER_WORDS else _CAPITAL if raw[0].isupper() else _PLAIN
        return kind, _code(lowered), lowered, raw[-1] in ".!?:", ""
    ends = raw.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")
    core = raw.strip("\"'()[]{}<>«»“”‘’.,;:!?…*_`~#&|/\\-–—=")
    if not core:
        return _NOTHING, 0, "", ends, ""
    lowered = core.lower()
    found = _NUMBER.fullmatch(core)
    if found:
        unit = found[2].lower()
        if not unit or unit in UNITS:
            return (_NUM_UNIT if unit else _NUM), _code(found[1]), found[1], ends, unit
    if lowered in NUMBER_WORDS:
        return _NUM, _code(lowered), lowered, ends, ""
    return (_CAPITAL if core[0].isupper() else _PLAIN), _code(lowered), lowered, ends, ""


class Templates(dict):
    """Splits texts into classified words; remembers how words are read, each under a number."""

    def __init__(self, remembered: int = 300_000) -> None:
        self.remembered = remembered
        self.read: list[tuple] = []
        self.codes, self.kinds, self.ends, self.units = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, bool)

    def __missing__(self, raw: str) -> int:
        number = self[raw] = len(self.read)
        self.read.append(classify(raw))
        return number

    def steps(self, texts: list[str]) -> Steps:
        """A word's class depends on itself and, for units, on the word before it, so it is the same in every text."""
        if len(self.read) > self.remembered:
            self.clear()
            self.read.clear()
        known, numbers, upto, ends = len(self.read), [], [], []
        for text in texts:
            for line in text.split("\n"):
                numbers += [self[w] for w in line.split()]
                upto.append(len(numbers))
            ends.append(len(numbers))
        new = self.read[known:]
        if new:
            columns = [x[0] for x in new], [x[1] for x in new], [x[3] for x in new], [x[0] == _PLAIN and x[2] in UNITS for x in new]
            self.kinds, self.codes, self.ends, self.units = (np.concatenate([old[:known], np.array(c, old.dtype)]) for old, c in zip((self.kinds, self.codes, self.ends, self.units), columns))
        word, line = np.array(numbers, np.int64), np.searchsorted(np.array(upto), np.arange(len(numbers)), "right")
        breaks = np.cumsum(self.ends[word])
        kept = np.flatnonzero(self.kinds[word] != _NOTHING)
        double = self.kinds[word[kept]] == _NUM_UNIT
        kept = np.repeat(kept, 1 + double)  # a number with its unit is two tokens
        second = np.zeros(len(kept), bool)
        second[1:] = kept[1:] == kept[:-1]
        word, line = word[kept], line[kept]
        codes, kinds, last = self.codes[word], self.kinds[word], np.ones(len(kept), bool)
        before = breaks[kept] - self.ends[word]
        last[:-1] = (before[1:] > before[:-1]) | (line[1:] != line[:-1])
        kinds[kinds == _NUM_UNIT] = _NUM
        kinds[second] = _UNIT
        for at in np.flatnonzero(second).tolist():
            codes[at] = _code(self.read[word[at]][4])
        unit = np.zeros(len(kept), bool)
        unit[1:] = self.units[word[1:]] & (kinds[:-1] == _NUM) & (line[1:] == line[:-1])
        kinds[unit] = _UNIT
        return Steps(codes, kinds, last, np.searchsorted(kept, ends), lambda at: self.read[word[at]][4 if second[at] else 2])


class Steps:
    """The ways through texts, one behind the other, in template tokens.

    A number is one token and so is a run of numbers; a capitalised word is a plain word, or with the capitalised words
    behind it in its sentence one name. An item is read in one way, a document in all.
    """

    def __init__(self, codes: np.ndarray, kinds: np.ndarray, last: np.ndarray, ends: np.ndarray, word: Callable[[int], str]) -> None:
        self.exact, self.kinds, self.last, self.word = codes, kinds, last, word
        #: The text of each token, and where the texts begin and end.
        self.text, self.starts, self.ends = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.r_[0, ends[:-1]], ends
        self.bound = ends[self.text]
        self.capital = kinds == _CAPITAL
        self.slot = (kinds == _NUM) | (kinds == _UNIT)
        self.codes = self.exact.copy()
        self.codes[kinds == _NUM], self.codes[kinds == _UNIT] = _SLOT_CODES["number"], _SLOT_CODES["unit"]
        n = len(kinds)
        joined = np.zeros(n, bool)
        joined[:-1] = (kinds[:-1] == kinds[1:]) & ~last[:-1] & (self.capital | (kinds == _NUM))[:-1]
        ends = np.flatnonzero(~joined) + 1
        self.run_end = ends[np.searchsorted(ends, np.arange(n), "right")] if n else np.zeros(0, np.int64)
        self.next = np.where(kinds == _NUM, self.run_end, np.arange(1, n + 1))

    def names(self) -> np.ndarray:
        """The one reading of an item: capitalised words are names inside a sentence, and at its start if they are elsewhere."""
        words = [(self.word(at), at == 0 or self.last[at - 1]) if capital else (None, True) for at, capital in enumerate(self.capital.tolist())]
        inside = {value for value, first in words if not first}
        return np.array([value in inside for value, _ in words], bool)

    def path(self, names: np.ndarray) -> list[tuple[int, int, str | None]]:
        """(start, end, kind of slot) of the tokens in the reading of an item."""
        out, at = [], 0
        while at < len(self.codes):
            end = int(self.run_end[at] if names[at] else self.next[at])
            out.append((at, end, "name" if names[at] else self.kind(at)))
            at = end
        return out

    def kind(self, at: int) -> str | None:
        return {_NUM: "number", _UNIT: "unit"}.get(self.kinds[at])

    def value(self, start: int, end: int) -> str:
        return " ".join(map(self.word, range(start, end)))

    def readings(self, sizes: list[int], begun: np.ndarray, prefix: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, starts, readings, hashes) of the template windows from every place in every reading.

        Bit ``j`` of a reading says that token ``j`` is a name. Windows with more slots than words are left out,
        and after ``prefix`` tokens those that begin as no window of an item does (``begun``).
        """
        n, most = len(self.codes), max(sizes, default=0)
        for block in range(0, n, BLOCK):
            start = np.arange(block, min(n, block + BLOCK))
            at, hashes = start, np.zeros(len(start), np.uint64)
            reading, slots = np.zeros(len(start), np.int32), np.zeros(len(start), np.int8)
            for j in range(most):
                named = np.flatnonzero(self.capital[at] & (2 * slots < most))
                rolled = hashes * _ROLL
                hashes = np.concatenate([rolled + self.codes[at], rolled[named] + np.uint64(_SLOT_CODES["name"])])
                slots = np.concatenate([slots + self.slot[at], slots[named] + np.int8(1)])
                reading = np.concatenate([reading, reading[named] | np.int32(1 << j)])
                start = np.concatenate([start, start[named]])
                at = np.concatenate([self.next[at], self.run_end[at[named]]])
                if j + 1 in sizes:  # tokens end with their line, so windows end with their text
                    yield j + 1, start, reading, mix(hashes + np.uint64(j + 1)).view(np.int64)
                live = (at < self.bound[start]) & (2 * slots <= most)
                if j + 1 == prefix:
                    live &= begun[mix(hashes).view(np.int64) & (SLOTS - 1)]
                live = np.flatnonzero(live)
                start, at, hashes, reading, slots = start[live], at[live], hashes[live], reading[live], slots[live]

    def window(self, start: int, reading: int, size: int) -> tuple[int, list[str]]:
        """End of a window, and its slots."""
        slots, at = [], start
        for j in range(size):
            named = reading >> j & 1
            end = int(self.run_end[at] if named else self.next[at])
            kind = "name" if named else self.kind(at)
            if kind:
                slots.append(f"{j} {kind} {self.value(at, end)}")
            at = end
        return at, slots


def window_hashes(codes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``size`` tokens."""
    count = max(0, len(codes) - size + 1)
    rolled = np.zeros(count, np.uint64)
    for j in range(size):
        rolled = rolled * _ROLL + codes[j : j + count]
    return mix(rolled + np.uint64(size + salt)).view(np.int64)


def _item_windows(window: int, least: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch, "text")):
                steps = templates.steps([text])
                count = len(steps.exact)
                if count < least:
                    continue
                names = steps.names()
                path = steps.path(names)
                size = min(window, len(path))
                codes = np.array([_SLOT_CODES[kind] if kind else steps.exact[at] for at, _, kind in path], np.uint64)
                begins = window_hashes(codes, prefix, -prefix).tolist()
                for place, key in enumerate(window_hashes(codes, size).tolist()):
                    part = path[place : place + size]
                    filled = [f"{at - part[0][0]} {kind} {steps.value(at, end)}" for at, end, kind in part if kind]
                    if 2 * len(filled) <= size and 2 * (size - len(filled)) >= min(window, count):
                        rows.append((key, begins[place], size, item, part[0][0], part[-1][1], count, filled))
                size = min(window, count)
                kinds = ["name" if name else steps.kind(at) for at, name in enumerate(names.tolist())]
                for place, key in enumerate(window_hashes(steps.exact, size, EXACT).tolist()):
                    filled = [f"{j} {kinds[place + j]} {steps.word(place + j)}" for j in range(size) if kinds[place + j]]
                    rows.append((key, None, -size, item, place, place + size, count, filled))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "begins", "size", "item_id", "item_at", "item_end", "item_tokens", "item_slots"])

    return run


def _document_windows(sizes: list[int], packed: bytes, begun: bytes, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, flags, begins = Templates(), as_flags(packed), as_flags(begun)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows, docs = [], part.column("doc_id").to_pylist()
                steps = templates.steps(list(texts(part, "text")))
                for size, starts, readings, keys in steps.readings([n for n in sizes if n > 0], begins, prefix):
                    for k in np.flatnonzero(flags[keys & (SLOTS - 1)]).tolist():
                        at, text = int(starts[k]), steps.text[starts[k]]
                        end, filled = steps.window(at, int(readings[k]), size)
                        rows.append((int(keys[k]), size, docs[text], at - int(steps.starts[text]), end - int(steps.starts[text]), filled))
                for size in [-n for n in sizes if n < 0]:
                    keys = window_hashes(steps.exact, size, EXACT)
                    for at in np.flatnonzero(flags[keys & (SLOTS - 1)] & (np.arange(len(keys)) + size <= steps.bound[: len(keys)])).tolist():
                        text = steps.text[at]
                        at_text = at - int(steps.starts[text])
                        rows.append((int(keys[at]), -size, docs[text], at_text, at_text + size, []))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "size", "doc_id", "doc_at", "doc_end", "doc_slots"])

    return run


class Alignment:
    """Windows of an item that lie in one order in a document, with one value there for each value of the item."""

    def __init__(self) -> None:
        self.hits: list[tuple[int, int, int, list]] = []
        self.to: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.places: dict[int, list[int]] = {}

    def add(self, hit: tuple[int, int, int, list]) -> bool:
        """Whether ``hit`` fits; if so it is part of the alignment."""
        shift, at, _, slots = hit
        to, back = {}, {}
        for _, item, doc in slots:
            if self.to.get(item, doc) != doc or to.setdefault(item, doc) != doc or self.back.get(doc, item) != item or back.setdefault(doc, item) != item:
                return False
        for other, places in self.places.items():  # at most 2 * SPREAD + 1 shifts
            low, high = (at, at + shift - other) if other < shift else (at + shift - other, at)
            k = bisect_right(places, low)
            if k < len(places) and places[k] < high:
                return False
        self.to |= to
        self.back |= back
        insort(self.places.setdefault(shift, []), at)
        self.hits.append(hit)
        return True

    def result(self) -> tuple[int, int]:
        """(covered tokens, values that changed)"""
        reach = covered = 0
        for _, at, end, _ in sorted(self.hits, key=lambda h: h[1:3]):
            covered += max(0, end - max(reach, at))
            reach = max(reach, end)
        changed = {place for _, _, _, slots in self.hits for place, item, doc in slots if item != doc}
        return covered, max(len(changed), len(self.places) - 1)


def best_alignment(hits: list[tuple[int, int, int, list]], tokens: int, need: int) -> tuple[int, int] | None:
    """(covered tokens, changed values) of the best alignment of ``hits`` (shift, start, end, slots), if one covers enough.

    Windows of one shift in which a value of the item has two values contradict each other and are all left out. Of
    values of the item that became one, the one in most windows stays. Windows of neighbouring shifts are added where
    they agree with the rest, so values may be longer or shorter than those of the item.
    """
    runs: dict[int, list] = {}
    for hit in hits:
        runs.setdefault(hit[0], []).append(hit)
    for shift, run in list(runs.items()):
        values = {(item, doc) for *_, slots in run for _, item, doc in slots}
        if len(values) > len({item for item, _ in values}):
            del runs[shift]
            continue
        often = Counter(pair for *_, slots in run for pair in {(item, doc) for _, item, doc in slots})
        run.sort(key=lambda h: (-min((often[item, doc] for _, item, doc in h[3]), default=len(run)), h[1], h[2]))
    best = None
    for seed in sorted(runs, key=lambda s: (-len(runs[s]), s)):
        near = sorted((s for s in range(seed - SPREAD, seed + SPREAD + 1) if s in runs), key=lambda s: (s != seed, -len(runs[s]), abs(s - seed), s))
        if sum(end - at for s in near for at, end in {h[1:3] for h in runs[s]}) < need:
            continue
        alignment = Alignment()
        for shift in near:
            for hit in runs[shift]:
                alignment.add(hit)
            if shift == seed and alignment.result()[0] >= tokens:
                break
        covered, changed = alignment.result()
        if covered >= need and (best is None or (covered, -changed) > (best[0], -best[1])):
            best = covered, changed
        if best == (tokens, 0):
            break
    return best


def _align(covered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                doc, item, tokens, hits = (c[row].as_py() for c in batch.columns)
                found = best_alignment([(h["shift"], h["item_at"], h["item_end"], [(x["place"], x["item"], x["doc"]) for x in h["slots"] or []]) for h in hits], tokens, min(covered, tokens))
                if found:
                    rows.append((doc, item, "reparameterised" if found[1] else "exact", found[0], tokens, found[1]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "kind", "covered_tokens", "item_tokens", "n_changed"])

    return run


#: Tokens in the intervals ``at``, which are sorted by their beginning.
_UNION = "aggregate(at, struct(0 as upto, 0 as n), (a, x) -> struct(greatest(a.upto, x.item_end) as upto, a.n + greatest(0, x.item_end - greatest(a.upto, x.item_at)) as n), a -> a.n)"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: int = COVERED, least: int = 5) -> DataFrame:
    """(doc_id, item_id, kind, covered_tokens, item_tokens, n_changed) for every document that holds a benchmark item.

    ``kind`` is "exact", or "reparameterised" where slots have other values (``n_changed`` of them). Items of fewer than
    ``least`` tokens can't be told from chance and are not searched; items shorter than a window are one window. A
    window that is mostly slots is evidence only with its own values. Null texts are empty; rows that share a doc_id count as one document;
    an empty table on either side gives an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    prefix = PREFIX if least >= 2 * PREFIX - 1 else 1  # no window is shorter
    items = stored(pick(benchmark, "item_id", "text").mapInArrow(_item_windows(window, least, prefix), "key long, begins long, size int, item_id long, item_at int, item_end int, item_tokens int, item_slots array<string>"), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` of either kind
    places = pick(docs, "doc_id", "text").mapInArrow(_document_windows(sizes, bitmap_of(items, "key"), bitmap_of(items.filter("size > 0"), "begins"), prefix), "key long, size int, doc_id long, doc_at int, doc_end int, doc_slots array<string>")
    hits = places.join(items.drop("begins"), ["key", "size"]).withColumn("shift", F.expr("doc_at - item_at"))
    pairs = F.expr("transform(item_slots, (s, i) -> struct(item_at + int(split(s, ' ', 2)[0]) as place, split(s, ' ', 2)[1] as item, if(size < 0, split(s, ' ', 2)[1], split(doc_slots[i], ' ', 2)[1]) as doc))")
    hit = F.struct("shift", "item_at", "item_end", pairs.alias("slots"))
    both = hits.groupBy("doc_id", "item_id").agg(F.max("item_tokens").alias("item_tokens"), F.array_sort(F.collect_set(F.struct("item_at", "item_end"))).alias("at"), F.collect_set(hit).alias("hits"))
    both = both.filter(F.expr(_UNION) >= F.least(F.lit(covered), "item_tokens"))  # no alignment covers more than all windows together
    return both.select("doc_id", "item_id", "item_tokens", "hits").mapInArrow(_align(covered), "doc_id long, item_id long, kind string, covered_tokens int, item_tokens int, n_changed int")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": (op3_decontamination, None)}
