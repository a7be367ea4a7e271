"""Phrases of two to five words that occur together more often than their parts would by chance, per language.

Candidates come from mergeable Misra-Gries summaries. Tasks count the hashes of their n-grams, exactly, and cut them
into parts by the hash; the summary of a part merges what all tasks counted for it. A part whose counts sum to ``mass``
keeps more than ``mass / threshold`` counters, so its error stays below ``threshold`` and every n-gram that occurs
``threshold`` times survives. First the words go through this, then the pairs of surviving words, then the longer
n-grams made of surviving pairs. A last pass counts the survivors themselves, by their texts, and Spark joins each phrase
with the counts of its parts. (A task tells n-grams apart by 64 bits, Spark by their texts.) Between the passes travel Bloom filters of survivors, which spare work and decide nothing.

Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words, A-Z lowered. Null texts
are empty, a null lang is ``und``, rows that repeat count again, an empty table gives no phrase. A text is read whole,
in one piece of numpy arrays of some 60 times its bytes; all else in a task has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import pack_columns, pick, small_batches, stored, table, text_slices, unpack_columns, with_size_bound
from .wordhash import mix

#: Words of a phrase at most, occurrences and phrases per language that are reported.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Distinct n-grams that a task gathers before it hands its counts on.
GATHERED = 1 << 21
#: Parts of the hash range at least, and counters of one part's summary that are aimed at.
PARTS, COUNTERS = 256, 250_000

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Summaries keep this many bits of a hash: two n-grams that share them only raise each other's count.
_KEPT_BITS = 48
_COUNTS = "part int, mass long, grams binary"
#: Bits of a Bloom filter for each key, looked at for one key, and (as a power of two) at most.
_BITS_A_KEY, _LOOKS, _MOST_BITS = 32, 4, 29
#: Languages whose word counts are sent to every task; more are joined through a shuffle.
_FEW_LANGS = 10_000


class Words:
    """The words of some texts: hashes, and where they are."""

    def __init__(self, column: pa.Array, langs: np.ndarray, reader: "Reader") -> None:
        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        size = int(offsets[-1] - offsets[0])
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if size else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = reader.kinds[self.data]
        inside = kind == 0
        edges = np.zeros(size + 1, bool)  # where a text begins or ends, no word goes on
        edges[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edges[1:-1]
        last[:-1] &= ~inside[1:] | edges[1:-1]
        self.starts, self.stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        # Pieces end at a breaking character and where a text ends.
        breaks = np.cumsum((kind == 2) | edges[:-1])
        self.piece = breaks[self.starts]
        self.lang = langs[np.searchsorted(offsets, self.starts, "right") - 1]
        self.hashes = reader.hashes(self.data, self.starts, self.stops) if len(self.starts) else np.empty(0, np.uint64)

    def grams(self, length: int, usable: np.ndarray, linked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams of ``length`` words within a piece, made of ``usable`` words; and their hashes.

        ``linked`` says which words make a usable pair with the next one. A hash covers the words, their number and
        their language.
        """
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        whole = self.piece[:n] == self.piece[length - 1 :]
        for j in range(length):
            whole &= usable[j : j + n]
            if linked is not None and j:
                whole &= linked[j - 1 : j - 1 + n]
        at = np.flatnonzero(whole)
        rolled = self.lang[at] + np.uint64(length)
        for j in range(length):
            rolled = rolled * np.uint64(_BASE) + self.hashes[at + j]
        return at, mix(rolled)

    def text(self, at: int, length: int) -> str:
        raw = self.data
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.starts[at : at + length].tolist(), self.stops[at : at + length].tolist())).lower().decode("utf-8", "replace")


class Reader:
    """Tables that all texts share: kinds of bytes (0 in words, 1 between words, 2 between pieces), powers of the base."""

    def __init__(self) -> None:
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[list(b" \t")] = 1
        self.kinds[list(b".,;:!?\n\x0b\x0c\r")] = 2
        self.values = mix(np.arange(1, 257, dtype=np.uint64))
        self.values[65:91] = self.values[97:123]
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.langs: dict[str, np.uint64] = {}

    def hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Polynomials of the words' bytes, read off one running sum and shifted back to the word's start."""
        if len(self.powers) < len(data):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _BASE, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _INVERSE, np.uint64)])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[stops] - sums[starts]) * self.inverses[starts] + (stops - starts).astype(np.uint64))

    def lang(self, name: str) -> np.uint64:
        if name not in self.langs:
            value = np.uint64(len(name))
            with np.errstate(over="ignore"):
                for byte in name.encode("utf-8", "replace"):
                    value = value * np.uint64(_BASE) + self.values[byte]
                self.langs[name] = mix(np.array([value]))[0]
        return self.langs[name]

    def words(self, part: pa.RecordBatch) -> tuple[Words, list[str]]:
        names = ["und" if x is None else x for x in part.column("lang").to_pylist()]
        return Words(part.column("text"), np.array([self.lang(x) for x in names], np.uint64), self), names


def merged(hashes: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes as one, ascending, with the sums of their counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes as steps and the counts, byte planes compressed: some 4 bytes an n-gram."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    planes = np.concatenate([steps.astype("<u8"), counts.astype("<u8")]).view(np.uint8).reshape(-1, 8).T
    return len(hashes).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[8:], max_output_size=16 * n + 1), np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(values[:n], dtype=np.uint64), values[n:].astype(np.int64)


class Summary:
    """Misra-Gries counters. At most ``capacity`` of them stay; ``error`` is what any count may lack.

    Taking d from more than ``capacity`` counters uses up more than d * capacity of the mass, so ``error`` never
    exceeds mass / capacity, in whatever order counts arrive and summaries are merged.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.counts = merged([self.hashes, hashes], [self.counts, counts])
        if len(self.counts) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.error += cut
            more = self.counts > cut
            self.hashes, self.counts = self.hashes[more], self.counts[more] - cut

    def possible(self, threshold: int) -> np.ndarray:
        """The hashes that may have ``threshold`` occurrences: all that have, among them."""
        return self.hashes[self.counts + self.error >= threshold]


class Filter:
    """A Bloom filter of hashes: knows every key that was put in, and few others. At most 64 MiB, whatever it holds."""

    def __init__(self, size: int, packed: bytes) -> None:
        self.size, self.packed = size, packed
        self.flags = None

    @staticmethod
    def of(grams: DataFrame) -> "Filter":
        """Of a column ``gram``. Spark builds the bits; the driver gets them in pieces of 4 KiB."""
        size = 15
        wanted = grams.count() * _BITS_A_KEY
        while size < _MOST_BITS and 1 << size < wanted:
            size += 1
        mask, high = (1 << size) - 1, _KEPT_BITS - size
        slots = [F.expr(f"((gram & {mask}) + {j} * ((gram >> {high}) & {mask})) & {mask}") for j in range(_LOOKS)]
        # The functions count from 1: the bits 32768 i .. 32768 i + 32767 are piece i + 1.
        bits = grams.select(F.explode(F.array(*slots)).alias("slot")).selectExpr("bitmap_bucket_number(slot + 1) as piece", "bitmap_bit_position(slot + 1) as bit")
        pieces = bits.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
        packed = bytearray((1 << size) // 8)
        for piece, bits in pieces:
            packed[(piece - 1) * 4096 : piece * 4096] = bits
        return Filter(size, bytes(packed))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For each 64-bit hash whether its kept bits may be a key."""
        if self.flags is None:
            self.flags = np.frombuffer(self.packed, np.uint8)
        gram = hashes >> np.uint64(64 - _KEPT_BITS)
        mask = np.uint64((1 << self.size) - 1)
        first, step = gram & mask, (gram >> np.uint64(_KEPT_BITS - self.size)) & mask
        found = np.ones(len(hashes), bool)
        for j in range(_LOOKS):
            slot = (first + np.uint64(j) * step) & mask
            found &= (self.flags[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def _usable(words: Words, filters: Sequence[Filter]) -> tuple[np.ndarray, np.ndarray | None]:
    """Which words, and which pairs by their first word, pass the filters that there are already."""
    usable, linked = np.ones(len(words.hashes), bool), None
    if filters:
        at, hashes = words.grams(1, usable)
        usable[at] = filters[0].has(hashes)
    if len(filters) > 1:
        at, hashes = words.grams(2, usable)
        linked = np.zeros(len(words.hashes), bool)
        linked[at[filters[1].has(hashes)]] = True
    return usable, linked


def _gathered(lengths: Sequence[int], parts: int, filters: Sequence[Filter] = ()):
    """Task: (part, mass, n-grams with counts) of its texts; n-grams with parts that no filter knows can't be frequent."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, n = merged(hashes, counts)
            hashes.clear(), counts.clear()
            ends = np.flatnonzero(np.r_[h[1:] >> shift != h[:-1] >> shift, True]) + 1
            begin, rows = 0, []
            for end in ends.tolist():
                rows.append((int(h[begin] >> shift), int(n[begin:end].sum()), pack(h[begin:end] >> np.uint64(64 - _KEPT_BITS), n[begin:end])))
                begin = end
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["part", "mass", "grams"])

        for batch in batches:
            for part in text_slices(batch, "text"):
                words, _ = reader.words(part)
                usable, linked = _usable(words, filters)
                h, n = np.unique(np.concatenate([words.grams(k, usable, linked)[1] for k in lengths]), return_counts=True)
                hashes.append(h)
                counts.append(n)
                if sum(map(len, hashes)) > GATHERED:
                    if sum(map(len, hashes)) > 2 * GATHERED or len(hashes) > 64:
                        h, n = merged(hashes, counts)
                        hashes[:], counts[:] = [h], [n]
                    if len(hashes[0]) > GATHERED:
                        yield from out()
        if sum(map(len, hashes)):
            yield from out()

    return run


def _merged_parts(threshold: int):
    """Task: the possibly frequent n-grams of its parts, which come one after the other, packed."""

    def possible(packed: list[bytes], mass: int) -> pa.RecordBatch:
        summary = Summary(mass // threshold + 1)
        for grams in packed:
            summary.add(*unpack(grams))
        return pa.record_batch([pa.array(summary.possible(threshold).astype(np.int64))], ["gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packed, mass = None, [], 0
        for batch in batches:
            for part, more, grams in zip(*(batch.column(c).to_pylist() for c in ("part", "mass", "grams"))):
                if part != now and packed:
                    yield possible(packed, mass)
                    packed, mass = [], 0
                now, mass = part, mass + more
                packed.append(grams)
        if packed:
            yield possible(packed, mass)

    return run


def survivors(docs: DataFrame, lengths: Sequence[int], threshold: int, filters: Sequence[Filter], label: str) -> DataFrame:
    """(gram): hashes of all n-grams of these lengths that may occur ``threshold`` times in one language; few others."""
    gathered = docs.mapInArrow(_gathered(lengths, _parts(docs, lengths, threshold), filters), _COUNTS)
    dealt = gathered.repartition("part").sortWithinPartitions("part")
    return stored(dealt.mapInArrow(_merged_parts(threshold), "gram long"), label)


def _parts(docs: DataFrame, lengths: Sequence[int], threshold: int) -> int:
    """A power of two: so many parts that a summary has some COUNTERS counters; a word takes four bytes at least, mostly."""
    words = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = PARTS
    while parts < 1 << 20 and words / 4 * len(lengths) / threshold / parts > COUNTERS:
        parts *= 2
    return parts


def _exact(filters: Sequence[Filter], longest: int):
    """Task: survivors in its texts with their counts, as tables (lang, phrase, length, n) by part of the hash range; all
    words of a language are its phrase of length 0."""
    shift = np.uint64(64 - (PARTS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        counts: dict[int, int] = {}
        phrases: dict[int, tuple[str, str, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            hashes = np.fromiter(counts, np.uint64, len(counts))
            order = np.argsort(hashes)
            langs, texts, lengths = zip(*(phrases[h] for h in hashes[order].tolist()))
            rows = pa.table({"lang": langs, "phrase": texts, "length": pa.array(lengths, pa.int32()), "n": np.fromiter(counts.values(), np.int64, len(counts))[order]})
            part = (hashes[order] >> shift).astype(np.int32)
            begin = 0
            for end in (np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1).tolist():
                yield pa.record_batch([part[begin : begin + 1], pa.array([pack_columns(rows.slice(begin, end - begin))], pa.binary())], ["part", "rows"])
                begin = end
            counts.clear(), phrases.clear()

        def add(hashes: np.ndarray, first: np.ndarray, total: np.ndarray, named) -> None:
            for h, i, n in zip(hashes.tolist(), first.tolist(), total.tolist()):
                if h in counts:
                    counts[h] += n
                else:
                    counts[h], phrases[h] = n, named(i)

        for batch in batches:
            for part in text_slices(batch, "text"):
                words, names = reader.words(part)
                if not len(words.hashes):
                    continue
                by_hash = {int(reader.lang(x)): x for x in names}
                add(*np.unique(words.lang, return_index=True, return_counts=True), lambda i: (by_hash[int(words.lang[i])], "", 0))
                usable, linked = _usable(words, filters)
                for length in range(1, longest + 1):
                    at, hashes = words.grams(length, usable, linked)
                    if length > 2:
                        known = filters[2].has(hashes)
                        at, hashes = at[known], hashes[known]
                    hashes, first, total = np.unique(hashes, return_index=True, return_counts=True)
                    add(hashes, at[first], total, lambda i: (by_hash[int(words.lang[i])], words.text(i, length), length))
                if len(counts) > GATHERED // 8:
                    yield from out()
        if counts:
            yield from out()

    return run


def _summed(threshold: int):
    """Task: the counts of its parts, which come one after the other, added up; only those that reach ``threshold``."""

    def whole(tables: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(tables).group_by(["lang", "phrase", "length"], use_threads=False).aggregate([("n", "sum")])
        return rows.rename_columns({"n_sum": "n"})

    def frequent(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = whole(tables)
        rows = rows.filter(pc.or_(pc.greater_equal(rows["n"], threshold), pc.equal(rows["length"], 0)))
        yield from rows.rename_columns({"n": "f"}).select(["lang", "phrase", "length", "f"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, []
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist()):
                if part != now and tables:
                    yield from frequent(tables)
                    tables = []
                now = part
                tables.append(unpack_columns(packed))
                if len(tables) > 64:
                    tables = [whole(tables)]
        if tables:
            yield from frequent(tables)

    return run


def frequent_phrases(docs: DataFrame, threshold: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of up to ``longest`` words with ``threshold`` occurrences, counted exactly;
    and (lang, n), all word occurrences of each language."""
    small_batches(docs.sparkSession)
    docs = pick(docs, "lang", "text")
    filters: list[Filter] = []
    for lengths, label in (([1], "words"), ([2], "pairs"), (range(3, longest + 1), "grams")):
        filters.append(Filter.of(survivors(docs, lengths, threshold, filters, f"frequent-{label}")))
    dealt = docs.mapInArrow(_exact(filters, longest), "part int, rows binary").repartition("part").sortWithinPartitions("part")
    total = stored(dealt.mapInArrow(_summed(threshold), "lang string, phrase string, length int, f long"), "phrase-counts")
    return total.filter("length > 0"), total.filter("length = 0").select("lang", F.col("f").alias("n"))


#: floor(1000 * a * n / (l * r)); the products pass 64 bits.
_SCORE = "(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"


def collocations(docs: DataFrame, threshold: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, score is floor(1000 * a * n / (l * r)).
    A phrase within a longer one that occurs as often is left out.
    """
    frequent, sizes = frequent_phrases(docs, threshold, longest)
    phrases = frequent.filter("length > 1").select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a"))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    # Occurrences only fall as a phrase grows, so a longer one that occurs as often has one word more at some step.
    inner = phrases.filter(F.size("words") > 2).select(
        F.col("lang").alias("i_lang"), F.explode(F.array(part(1, F.size("words") - 1), part(2, F.size("words") - 1))).alias("i_phrase"), F.col("a").alias("i_a")
    ).groupBy("i_lang", "i_phrase").agg(F.max("i_a").alias("i_a"))
    outside = phrases.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")) & (F.col("i_a") >= F.col("a")), "left_anti")
    cuts = outside.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words")).alias("right"))
    left = frequent.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = frequent.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("right"), F.col("f").alias("r"))
    parts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (cuts["left"] == left["left"])).drop("l_lang", left["left"], cuts["left"])
    parts = parts.join(right, (F.col("lang") == F.col("r_lang")) & (parts["right"] == right["right"])).select("lang", "phrase", "a", "k", "l", "r")
    if with_size_bound(sizes, _FEW_LANGS):  # one language may have most phrases, so better no shuffle by it
        sizes = F.broadcast(sizes)
    sized = parts.join(sizes.withColumnRenamed("lang", "n_lang"), F.col("lang") == F.col("n_lang")).drop("n_lang")
    weakest = sized.withColumn("score", F.expr(_SCORE)).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, doc, generate_subscripts(piece, 1) as no, unnest(piece) as piece from (
    select lang, row_number() over () as doc, string_split_regex(
      translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as piece
    from documents)),
lists as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
sizes as (select lang, cast(sum(len(w)) as bigint) as n from lists group by 1 having sum(len(w)) > 0),
grams as (
  select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from lists, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k),
counted as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as f from grams group by 1, 2, 3 having count(*) >= 100),
phrases as (select lang, phrase, string_split(phrase, ' ') as w, k, f as a from counted where k > 1),
inner_ as (
  select lang, phrase, max(a) as a from (
    select lang, array_to_string(w[1:k - 1], ' ') as phrase, a from phrases where k > 2
    union all select lang, array_to_string(w[2:k], ' '), a from phrases where k > 2) group by 1, 2),
outside as (select p.* from phrases p left join inner_ i on p.lang = i.lang and p.phrase = i.phrase where i.a is null or i.a < p.a),
cuts as (select lang, phrase, w, k as size, a, unnest(range(1, k)) as k from outside),
scored as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, s.n,
         (cast(1000 as hugeint) * c.a * s.n) // (cast(l.f as hugeint) * r.f) as score
  from cuts c join counted l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ')
  join counted r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:c.size], ' ') join sizes s on s.lang = c.lang),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase,
       cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, cast(score as bigint) as score
from weakest qualify rank <= 2000
"""

QUERIES = {"op12_phrases": (op12_phrases, _SQL)}
