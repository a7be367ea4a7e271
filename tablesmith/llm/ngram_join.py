"""Exact n-gram Jaccard self-join: documents that link, and the groups that their links form.

Method: set-relation skipping.

* **Index lists by position.** A document's shingle hashes, sorted, are cut at equal steps of the hash range into
  ``m`` parts, ``m`` larger than the number of shingles in which two linking sets of that size class can differ. So
  linking sets agree in a whole part at the same position, and (size class, position, part) are the keys of the
  index. A passage that thousands of otherwise different documents share fills no part by itself, so it makes no
  list long; a plain word or shingle index would compare all of them.
* **Block skipping.** Members of the lists live in blocks of bounded size. A list is kept as one header for each of
  its blocks, with the smallest and largest set size there; two blocks meet only if as many
  lists hold both as two linking sets need, and their sizes allow a link. What meets is shipped once, however many
  lists name it. Sets with lists in common gather in the same block, so most blocks meet only themselves.
* **Answers from answers.** Inside a pair of blocks one set's overlaps with all others are counted through an
  inverted index. The overlaps of a similar set follow from them by adding the lists of the shingles it has more
  and subtracting those it has less (:func:`links_within`).

Sets that are equal are one node from the start, and of the links inside a pair of blocks only a spanning forest
leaves the task, so groups of copies of any size produce rows in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bitmap import SLOTS, as_flags, bitmap_of
from .common import pick, small_batches, stored, table, text_slices
from .components import components
from .wordhash import WordHasher, mix

#: Shingles that one block of the index holds; the memory of a task follows from it.
BLOCK_SHINGLES = 1_500_000
#: What a set counts at least, so that a block has a bounded number of sets too.
SET_SHINGLES = 150
#: Nodes a task remembers, so that it sends the parts of equal sets only once.
REMEMBERED_NODES = 200_000
#: Bits of a part's hash in an index key. Parts that share them by chance only make a list longer; links are exact.
PART_BITS = 47


def size_classes(num: int, den: int, largest: int = 1 << 31) -> np.ndarray:
    """Lower bounds of classes of set sizes, such that linking sets are in one class or in neighbouring ones."""
    bounds = [1, 2]
    while bounds[-1] < largest:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * den // num + 1))
    return np.array(bounds, np.int64)


def difference_bound(bounds: np.ndarray, c: int, num: int, den: int) -> int:
    """Most shingles in which a set of class ``c`` and a linking set at least as large can differ."""
    small = int(bounds[c + 1]) - 1
    return (small + small * den // num) * (den - num) // (den + num)


def parts_of_class(bounds: np.ndarray, c: int, num: int, den: int) -> tuple[int, int]:
    """Into how many parts sets that meet in class ``c`` are cut, and how many keys linking ones have in common.

    Of ``parts`` at least ``parts - differ`` are equal in both. A quarter more than the bare need is taken, so that
    linking sets agree in many parts, and few other sets agree in as many. Half of the equal parts may be empty ones,
    which are not in the index (see :func:`part_keys`).
    """
    differ = difference_bound(bounds, c, num, den)
    equal = 4 + -(-differ // 4)
    return differ + equal, -(-equal // 2)


def part_bits(bounds: np.ndarray) -> int:
    """Bits of a part's hash in a posting: what the size class and the mark leave of 64, ``PART_BITS`` at most."""
    return min(PART_BITS, 63 - len(bounds).bit_length())


def part_postings(shingles: np.ndarray, bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of a set, each in one number: the size class in which sets meet, bits of the part's hash, and last a 1
    where the set has the upper of the two size classes that meet. In a shuffle all but the hash bits of one set's keys look alike."""
    own = int(np.searchsorted(bounds, len(shingles), side="right")) - 1
    bits = np.uint64(part_bits(bounds))
    postings = []
    for upper, c in ((0, own), (1, own - 1)):
        if c < 0:
            continue
        parts, need = parts_of_class(bounds, c, num, den)
        position = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, position[1:] != position[:-1]])
        content = np.add.reduceat(mix(shingles), starts)
        position = position[starts]
        # Two sets of which one has few empty parts agree in ``need`` others. A set with more of them has its empty
        # parts in the index too: with another such set it agrees in all equal parts, empty or not.
        if parts - len(starts) > parts - difference_bound(bounds, c, num, den) - need:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), position)
            position, content = np.r_[position, empty], np.r_[content, np.zeros(len(empty), np.uint64)]
        hashes = mix(content + mix(position + np.uint64(c << 40))) >> (np.uint64(64) - bits)
        postings.append((np.uint64(c) << (bits + np.uint64(1))) | (hashes << np.uint64(1)) | np.uint64(upper))
    return np.concatenate(postings).view(np.int64)


def part_keys(shingles: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and a tag for each: twice the keys that linking sets have in common in this class, plus 1
    where the set has the upper of the two size classes that meet."""
    postings = part_postings(shingles, bounds, num, den)
    return postings >> 1, (2 * needs(postings, bounds, num, den) + (postings & 1)).astype(np.int32)


def needs(postings: np.ndarray, bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many keys linking sets have in common in the size classes of postings."""
    classes, at = np.unique(postings.view(np.uint64) >> np.uint64(part_bits(bounds) + 1), return_inverse=True)
    return np.array([parts_of_class(bounds, int(c), num, den)[1] for c in classes], np.int64)[at]


def node_of(shingles: np.ndarray) -> int:
    """Identity of a set."""
    return int(mix(np.add.reduce(mix(shingles), keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def _sets_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = hasher.shingles(part.column("text"), k)
                yield pa.record_batch([
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                ], ["doc_id", "n_shingles", "node"])

    return run


def _postings(k: int, num: int, den: int):
    bounds = size_classes(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = []
                for shingles in hasher.shingles(part.column("text"), k):
                    if not len(shingles) or (node := node_of(shingles)) in seen:
                        continue
                    if len(seen) >= REMEMBERED_NODES:
                        seen.clear()
                    seen.add(node)
                    postings = part_postings(shingles, bounds, num, den)
                    out.append((postings, np.full(len(postings), node)))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["posting", "node"])

    return run


def _shared(num: int, den: int):
    """Of postings sorted by (posting, node), those in lists of two nodes or more, one of the lower class."""
    bounds = size_classes(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, (None, None, False, False)  # a lone row; its list's key, last node, lower class?, sent?
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
                held = None
            posting, node = (batch.column(c).to_numpy() for c in ("posting", "node"))
            key = posting >> 1
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            if state[3] and key[0] == state[0] and node[0] == state[1]:
                new[0] = False
            rows = np.flatnonzero(new)
            if not len(rows):
                continue
            k = key[rows]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            counts = np.diff(np.r_[starts, len(k)])
            lower = posting[rows][starts] % 2 == 0
            sent = counts >= 2
            if state[3] and k[0] == state[0]:
                lower[0], sent[0] = state[2], True
            keep = np.repeat(sent & lower, counts)
            if not sent[-1]:
                held = batch.slice(int(rows[-1]), 1)
            state = (k[-1], node[rows[-1]], bool(lower[-1]), bool(sent[-1]))
            if keep.any():
                kept = rows[keep]
                yield pa.record_batch([pa.array(key[kept]), pa.array(needs(posting[kept], bounds, num, den)), pa.array(node[kept])], ["key", "need", "node"])

    return run


def links_within(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, by rising size, the later sets that link with it; with sides, only those of the other side.

    ``sets`` are sorted distinct hashes, ordered by size. The overlaps of a pivot are counted through the inverted
    lists. Those of the next set come from the pivot's, as long as the two differ in fewer shingles than the set has.
    """
    sizes = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.r_[0, np.cumsum(sizes)]
    lists = np.repeat(np.arange(len(sets)), sizes)[np.argsort(tokens, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(tokens))]

    def counted(ids: np.ndarray) -> np.ndarray:
        lengths = first[ids + 1] - first[ids]
        at = np.repeat(first[ids] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        return np.bincount(lists[at], minlength=len(sets))

    mark = np.zeros(len(first), bool)
    pivot, known = None, None
    for i in range(len(sets)):
        own = tokens[bounds[i] : bounds[i + 1]]
        if pivot is not None and sizes[i] + sizes[pivot] - 2 * known[i] < sizes[i]:
            base = tokens[bounds[pivot] : bounds[pivot + 1]]
            mark[base] = True
            more = own[~mark[own]]
            mark[base] = False
            mark[own] = True
            less = base[~mark[base]]
            mark[own] = False
            overlap = known + counted(more) - counted(less)
        else:
            overlap = counted(own)
            pivot, known = i, overlap
        end = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))  # larger sets can't link
        later = overlap[i + 1 : end]
        link = den * later >= num * (sizes[i] + sizes[i + 1 : end] - later)
        if side is not None:
            link &= side[i + 1 : end] != side[i]
        yield i, np.flatnonzero(link) + i + 1


def _forest(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    nodes, sets = nodes[order], [sets[i] for i in order]
    root = np.arange(len(sets))
    for i, linked in links_within(sets, None if side is None else side[order], num, den):
        if len(linked):
            roots = np.unique(np.r_[root[i], root[linked]])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return [(int(nodes[r]), int(nodes[i])) for i, r in enumerate(root) if r != i]


def _link_pairs(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list) -> list[tuple[int, int]]:
            rows = list({r[1]: r for r in rows}.values())
            if len(rows) < 2:
                return []
            side = np.array([r[2] for r in rows])
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            return _forest(np.array([r[1] for r in rows]), sets, side if side.any() else None, num, den)

        current, rows = None, []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.select(["pair", "node", "side", "shingles"]).columns)):
                if row[0] != current:
                    found += solve(rows)
                    current, rows = row[0], []
                rows.append(row)
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        if found := solve(rows):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _shingle_bytes(k: int, packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, flags, seen = WordHasher(), as_flags(packed), set()
        for batch in batches:
            for part in text_slices(batch, "text"):
                nodes, kept = [], []
                for shingles in hasher.shingles(part.column("text"), k):
                    if not len(shingles):
                        continue
                    node = node_of(shingles)
                    if flags[node & (SLOTS - 1)] and node not in seen:
                        if len(seen) >= REMEMBERED_NODES:
                            seen.clear()
                        seen.add(node)
                        nodes.append(node)
                        kept.append(shingles.tobytes())
                if nodes:
                    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(kept, pa.binary())], ["node", "shingles"])

    return run


def similar_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``n_shingles`` counts distinct ``k``-word shingles of the lowered text (a shorter text is one shingle; a null or
    blank text has none and links with nothing). Documents link when ``den * intersection >= num * union``;
    ``component_id`` is the smallest doc_id that links reach. Repeated rows stay repeated and share a group, also
    under one doc_id. Further columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, "doc_id", "text")
    base = stored(docs.mapInArrow(_sets_of(k), "doc_id long, n_shingles long, node long"), "sets")

    postings = docs.mapInArrow(_postings(k, num, den), "posting long, node long")
    dealt = postings.repartition(F.expr("shiftright(posting, 1)")).sortWithinPartitions("posting", "node")
    lists = stored(dealt.mapInArrow(_shared(num, den), "key long, need long, node long"), "lists")

    # A set that shares fewer keys than linking needs, whoever with, links with nothing.
    near = lists.groupBy("node", "need").agg(F.min("key").alias("home"), F.count("*").alias("keys")).filter("keys >= need")
    listed = stored(lists.join(near.select("node", "need", "home"), ["node", "need"]), "listed")
    smallest = listed.groupBy("key").agg(F.min("home").alias("moved"))
    moved = listed.join(smallest, "key").groupBy("node").agg(F.min("moved").alias("home"))
    sizes = base.groupBy("node").agg(F.first("n_shingles").alias("n"))
    home = stored(moved.join(sizes, "node"), "homes")
    crowd = home.groupBy("home").agg(F.expr(f"cast(ceil(sum(greatest(n, {SET_SHINGLES})) / {BLOCK_SHINGLES}) as long)").alias("salts"))
    blocks = stored(home.join(crowd, "home").selectExpr("node", "n", "xxhash64(home, pmod(xxhash64(node), salts)) as block"), "blocks")

    headers = listed.join(blocks, "node").groupBy("key", "need", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("members"))
    left, right = headers.alias("l"), headers.alias("r")
    common = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.block") <= F.col("r.block"))).filter(
        f"(l.block < r.block or l.members > 1) and {den}L * l.high >= {num}L * r.low and {den}L * r.high >= {num}L * l.low"
    )
    meet = common.groupBy(F.col("l.block").alias("a"), F.col("r.block").alias("b"), F.col("l.need").alias("need")).agg(F.count("*").alias("keys")).filter("keys >= need").select("a", "b").distinct()
    meet = meet.selectExpr("xxhash64(a, b) as pair", "explode(if(a = b, array(named_struct('block', a, 'side', 0)), array(named_struct('block', a, 'side', 0), named_struct('block', b, 'side', 1)))) as x").selectExpr("pair", "x.block", "x.side")

    sets = docs.mapInArrow(_shingle_bytes(k, bitmap_of(blocks, "node")), "node long, shingles binary")
    members = meet.join(blocks.select("node", "block"), "block").select("pair", "side", "node")
    shipped = members.join(sets, "node").repartition("pair").sortWithinPartitions("pair", "side")
    links = stored(shipped.mapInArrow(_link_pairs(num, den), "a long, b long"), "links")

    return _numbered(base, None if links.isEmpty() else components(links))


def _numbered(base: DataFrame, roots: DataFrame | None) -> DataFrame:
    smallest = base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    if roots is not None:
        joined = smallest.join(roots, "node", "left").selectExpr("node", "coalesce(root, node) as root", "least")
        groups = joined.groupBy("root").agg(F.min("least").alias("least"))
        smallest = joined.select("node", "root").join(groups, "root").select("node", "least")
    found = base.join(smallest, "node", "left")
    return found.selectExpr("doc_id", "n_shingles", "coalesce(least, doc_id) as component_id")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
    from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
    select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
    join sizes m on m.doc_id = a.doc_id join sizes n on n.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, m.n, n.n having 100 * count(*) >= 85 * (m.n + n.n - count(*))),
reach as (select doc_id as x, doc_id as y from documents union select reach.x, links.y from reach join links on links.x = reach.y)
select d.doc_id, coalesce(s.n, 0) as n_shingles, (select min(y) from reach where reach.x = d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id
"""

QUERIES = {"op10_ngram_jaccard": (op10_ngram_jaccard, _SQL)}
