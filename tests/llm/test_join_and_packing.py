from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tablesmith.llm.ngram_join import links_within, part_bits, part_keys, part_postings, parts_of_class, similar_groups, size_classes
from tablesmith.llm.packing import Packer, byte_level_encoder, default_vocabulary, pack

from .conftest import frame, prose


def brute_groups(rows, k, num, den):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for blank in "\t\n\x0b\x0c\r":
            low = low.replace(blank, " ")
        w = [x for x in low.split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(text, seed, edits):
    draw, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"edit{draw.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_groups_equal_brute_force(spark, k, num, den):
    passage = prose(99, 60)
    rows = [(i, prose(i, 20 + 11 * i)) for i in range(40)]
    rows += [(100 + i, edited(prose(30, 350), i, i % 9)) for i in range(60)]  # a family around the threshold
    rows += [(200 + i, edited(prose(5, 75), i, i % 3)) for i in range(20)]
    rows += [(300 + i, prose(500 + i, 90) + "\n" + passage) for i in range(40)]  # strangers with a common passage
    rows += [(400 + i, "a b c") for i in range(5)] + [(500 + i, "A  b\tC") for i in range(3)] + [(600, None), (601, " "), (602, "one"), (603, "ONE")]
    rows.append(rows[-1])
    got = sorted((tuple(r) for r in similar_groups(frame(spark, rows), k, num, den).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_groups(rows, k, num, den)


def test_groups_of_odd_texts(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in similar_groups(odd).collect()), key=str)
    assert got == brute_groups(rows, 5, 80, 100)
    assert similar_groups(odd.limit(0)).count() == 0


def test_linking_sets_share_keys():
    draw = np.random.default_rng(3)
    bounds = size_classes(85, 100)
    for n in (1, 3, 7, 12, 40, 173, 900, 6000):
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(20):
            keep = a[draw.random(len(a)) > 0.06]
            b = np.unique(np.r_[keep, draw.integers(0, 1 << 63, max(0, int(0.05 * n)), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
                (x, tags), (y, _) = (part_keys(s, bounds, 85, 100) for s in (a, b))
                common = [int(tags[np.flatnonzero(x == key)[0]]) // 2 for key in np.intersect1d(x, y)]
                assert any(common.count(need) >= need for need in common)


def test_postings_are_small_and_hold_their_class():
    draw = np.random.default_rng(5)
    for num, den in ((80, 100), (85, 100), (99, 100)):
        bounds = size_classes(num, den)
        for n in (1, 4, 300, 5000):
            shingles = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            postings = part_postings(shingles, bounds, num, den)
            own = int(np.searchsorted(bounds, len(shingles), side="right")) - 1
            classes = postings.view(np.uint64) >> np.uint64(part_bits(bounds) + 1)
            assert {(int(c), int(p & 1)) for c, p in zip(classes, postings)} == {(own - u, u) for u in (0, 1) if own >= u}
            _, tags = part_keys(shingles, bounds, num, den)
            assert {int(t) // 2 for t in tags} == {parts_of_class(bounds, own - u, num, den)[1] for u in (0, 1) if own >= u}
    # One set's postings differ in six bytes, where whole hashes differ in eight.
    postings = part_postings(np.unique(draw.integers(0, 1 << 63, 300, dtype=np.uint64)), size_classes(80, 100), 80, 100)
    assert len(np.unique(postings >> 48)) == 2


def test_derived_overlaps_are_exact():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = sorted((np.unique(np.r_[base[draw.random(200) > 0.07], draw.integers(0, 1 << 60, draw.integers(0, 25), dtype=np.uint64)]) for _ in range(80)), key=len)
    got = {(i, int(j)) for i, linked in links_within(sets, None, 80, 100) for j in linked}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    assert got == want and want


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    special = frame(spark, [(900, "a<|endoftext|>b  c\n\n d's 12 é"), (901, None)])
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(special)
    rows = [r.asDict() for r in pack(docs, default_vocabulary(), keep_ids=True).collect()]
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    for doc, ids in want.items():
        pieces = sorted((p for p in rows if p["doc_id"] == doc), key=lambda p: p["start"])
        assert [x for p in pieces for x in p["ids"]] == ids
        at = 0
        for p in pieces:
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] == len(p["ids"])
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            at += p["length"]
    sequences = {}
    for p in rows:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(docs.limit(0), default_vocabulary()).count() == 0


def test_sum_of_squares_rule():
    draw, packer, full = random.Random(4), Packer(32), []
    for doc in range(400):
        size = draw.randrange(1, 32)
        levels = packer.levels.copy()

        def after(level):
            new = levels.copy()
            if level:
                new[level] -= 1
            if level + size < 32:
                new[level + size] += 1
            return int((new**2).sum())

        options = [h for h in range(32 - size + 1) if h == 0 or levels[h]]
        full += list(packer.add(doc, np.zeros(size, np.uint32)))
        assert int((packer.levels**2).sum()) == min(map(after, options))
    assert all(sum(len(p[2]) for p in s) == 32 for s in full)
    rest = [sum(len(p[2]) for p in s) for s in packer.finish()]
    assert all(x == 32 for x in rest[:-1])


@pytest.mark.parametrize("size, open_bytes", [(600, 100_000), (1, 5_000), (1023, 100_000), (512, 3_000), (700, 1)])
def test_open_sequences_are_bounded(size, open_bytes):
    packer, full, most = Packer(1024, open_bytes), [], 0
    for doc in range(3_000):
        full += list(packer.add(doc, np.arange(size, dtype=np.uint32)))
        held = sum(4 * len(p[2]) + 256 for level in packer.open for pieces in level for p in pieces)
        assert held == packer.held and [len(level) for level in packer.open] == packer.levels[:-1].tolist()
        most = max(most, held)
    # One document may pass the bound, and the last sequence stays open.
    assert most <= open_bytes + (4 * 1024 + 256 * -(-1024 // size)) * 2
    rest = list(packer.finish())
    assert all(sum(len(p[2]) for p in s) == 1024 for s in full + rest[:-1])
    at = dict.fromkeys(range(3_000), 0)
    for doc, start, ids, total in sorted((p for s in full + rest for p in s), key=lambda p: p[:2]):
        assert start == at[doc] and ids.tolist() == list(range(start, start + len(ids))) and total == size
        at[doc] += len(ids)
    assert set(at.values()) == {size}


def test_encoder_knows_special_tokens():
    with open(default_vocabulary(), encoding="utf-8") as file:
        encode = byte_level_encoder(file.read())
    assert 50256 in encode("x<|endoftext|>").tolist()
