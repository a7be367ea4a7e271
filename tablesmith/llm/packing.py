"""Sum-of-squares online packing of tokenised documents into sequences of a fixed window.

Each task packs the documents of its own partition as they come, so nothing is shuffled and a lost task repeats
itself exactly. Whole windows of a long document are sequences of their own; the rest of a document is one piece.
``levels[h]`` counts the open sequences that hold ``h`` tokens; a piece of size ``s`` goes to the level ``h`` (0: a new
sequence) for which the sum of squares of these counts afterwards is smallest. When a partition ends, or when its open
sequences take more memory than a task may hold, they are merged by cutting pieces; the last one, not full, stays open
for what follows. So one sequence of a partition at most is not full, and no stream of documents fills the memory.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import pick, small_batches, table, texts

#: Word pattern of the byte-level vocabularies (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SEQUENCES = 1 << 36  # of one task
#: Bytes of open pieces that a task holds before it merges them, and what a piece takes beside its ids.
OPEN_BYTES, _PIECE = 64 << 20, 256


def byte_level_encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Encoder of a byte-level BPE vocabulary file (JSON), with the ids that its own library gives.

    Ids of such a vocabulary rise in the order of the merges, so they are the ranks that the faster encoder wants.
    Special tokens inside a text are taken as special, as that library does.
    """
    import tiktoken

    described = json.loads(vocabulary)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in described.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in described["model"]["vocab"].items() if word not in special}
    encoding = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    if not special:
        return lambda text: np.array(encoding.encode_ordinary(text), np.uint32)
    return lambda text: np.array(
        encoding.encode(text, allowed_special="all") if any(s in text for s in special) else encoding.encode_ordinary(text), np.uint32
    )


class Packer:
    """Packs pieces (doc, start, ids, tokens of the document) online; :meth:`add` and :meth:`finish` give full sequences.

    Open pieces that take more than ``open_bytes`` are merged early, which leaves one open sequence.
    """

    def __init__(self, window: int, open_bytes: int = OPEN_BYTES) -> None:
        self.window, self.open_bytes, self.held = window, open_bytes, 0
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def _level_for(self, size: int) -> int:
        """Level with the smallest sum of squares after placement; of equal ones the fullest."""
        n, top = self.levels, self.window - size
        change = 2 - 2 * n[: top + 1] + 2 * n[size : size + top + 1]
        change[0] = 2 * n[size] + 1  # a new sequence leaves no level
        change[top] -= 1  # a full sequence enters none
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list]:
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield [(doc, start, ids[start : start + self.window], total)]
        size = total - whole
        if not size:
            return
        level = self._level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        self.held += 4 * size + _PIECE
        pieces.append((doc, whole, ids[whole:].copy(), total))
        if level + size == self.window:
            self.held -= sum(4 * len(p[2]) + _PIECE for p in pieces)
            yield pieces
        else:
            self.open[level + size].append(pieces)
            self.levels[level + size] += 1
            if self.held > self.open_bytes:
                yield from self._early()

    def _early(self) -> Iterator[list]:
        merged = self.finish()
        rest = next(merged)
        for pieces in merged:
            yield rest
            rest = pieces
        fill = sum(len(p[2]) for p in rest)
        if fill == self.window:
            yield rest
            rest, fill = [], 0
        self.levels[:] = 0
        self.open = [[] for _ in range(self.window)]
        self.held = sum(4 * len(p[2]) + _PIECE for p in rest)
        if rest:
            # Copies, as a cut piece would keep the whole one in memory.
            self.open[fill].append([(doc, start, ids.copy(), total) for doc, start, ids, total in rest])
            self.levels[fill] = 1

    def finish(self) -> Iterator[list]:
        """Merge the open sequences, fullest first; pieces are cut where a sequence ends."""
        current, fill = [], 0
        for pieces in (p for level in reversed(self.open) for p in level):
            for doc, start, ids, total in pieces:
                while fill + len(ids) >= self.window:
                    cut = self.window - fill
                    current.append((doc, start, ids[:cut], total))
                    yield current
                    current, fill, start, ids = [], 0, start + cut, ids[cut:]
                if len(ids):
                    current.append((doc, start, ids, total))
                    fill += len(ids)
        if current:
            yield current


def _run(vocabulary, window: int, end_id: int, keep_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = byte_level_encoder(vocabulary.value), Packer(window)
        sequence = TaskContext.get().partitionId() * _SEQUENCES
        rows: list[tuple] = []

        def place(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, *([ids.tolist()] if keep_ids else [])))
                offset += len(ids)
            sequence += 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:7]]
            if keep_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
            rows.clear()
            return pa.record_batch(columns, names + ["ids"] * keep_ids)

        for part in batches:
            for doc, text in zip(part.column("doc_id").to_pylist(), texts(part, "text")):
                for pieces in packer.add(doc, np.append(encode(text), np.uint32(end_id))):
                    place(pieces)
                if len(rows) >= 4000:
                    yield batch()
        for pieces in packer.finish():
            place(pieces)
            if len(rows) >= 4000:
                yield batch()
        if rows:
            yield batch()

    return run


def pack(docs: DataFrame, vocabulary_path: str, window: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    Every id of every document, with ``end_id`` behind it, is in exactly one piece; a null or empty text is the end id
    alone. ``offset`` is the place in the sequence, without gaps. Repeated rows are packed as often as they occur;
    further columns are ignored; an empty table has no pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # as large as the vocabulary
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return pick(docs, "doc_id", "text").mapInArrow(_run(vocabulary, window, end_id, keep_ids), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op9_packing": (op9_packing, None)}
