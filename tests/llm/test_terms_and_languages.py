"""Divergences, phrases and languages against plain Python versions of what they promise."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablesmith.llm import divergence, languages, phrases
from tools.check_oracle import canonical

from .conftest import prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOW = ["the of and", "The OF and\tto", "of. and, the of and", "  ", "", None, "ÄÖ of\x0band", "the of and the of and the of and", "x" * 70_000]


def documents(spark, seed=0, n=120):
    """Texts of few words, three sources of which one holds most rows, two languages and null, columns that clash."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text = draw.choice(LOW) if draw.random() < 0.5 else " ".join(draw.choice(["the", "of", "And", "to.", "go,", "é"]) for _ in range(draw.randrange(40)))
        rows.append((i if i % 7 else None, text, draw.choice(["en", "en", "en", "fr", None]), draw.choice(["a", "a", "a", "b", "ß", None]), 1, 2, "t", 3))
    rows += rows[:5]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, shard int, term string, a int").repartition(3), rows


# divergence


def plain_divergences(rows, least, listed):
    docs = [((r[2] or ""), (r[3] or ""), [t for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(UPPER))]) for r in rows]
    having, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        having[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in counts:
        kept = [t for t, n in having[lang].items() if n >= least]
        p = {}
        for key in [k for k in counts if k[0] == lang]:
            total = sum(counts[key][t] for t in kept)
            p[key[1]] = {t: 1 + 10**9 * (counts[key][t] + 5) // (total + 5 * len(kept)) for t in kept}
        whole = Counter({t: sum(counts[k][t] for k in counts if k[0] == lang) for t in kept})
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(kept)) for t in kept}
        pairs = [(other, sum(abs(p[source][t] - p[other][t]) for t in kept)) for other in p if other != source]
        terms = [(t, p[source][t] - q[t]) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, listed)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "listed", "shards"), [(1, 3, 5), (9, 50, 64), (10_000, 50, 3)])
def test_divergences(spark, least, listed, shards):
    docs, rows = documents(spark, least)
    found = divergence.divergences(docs, least, listed, shards)
    assert sorted(map(tuple, found.collect())) == plain_divergences(rows, least, listed)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergences_of_odd_tables(spark, odd):
    assert divergence.divergences(odd.limit(0)).collect() == []
    assert divergence.divergences(odd).collect() == []  # one source, and no term in 30 documents
    rows = [(None, t, "en", "src") for t in [r["text"] for r in odd.select("text").collect()]]
    assert sorted(map(tuple, divergence.divergences(odd, 1).collect())) == plain_divergences(rows, 1, 50)


def test_partial_counts_of_a_task_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 3)
    docs, rows = documents(spark, 3)
    run = divergence._sharded(4)
    batches = list(run(iter(docs.select("text", "lang", "source").toArrow().to_batches(10))))
    assert len(batches) > 8
    merged = divergence.merged([divergence.unpack_columns(c) for b in batches for c in b.column("counts").to_pylist()])
    expected = Counter()
    for r in rows:
        expected.update(((r[2] or ""), (r[3] or ""), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(UPPER)))
    assert {(x["lang"], x["source"], x["term"]): x["n"] for x in merged.to_pylist()} == expected


def test_slices_of_a_batch_are_counted_alike(spark):
    docs, _ = documents(spark, 8)
    (batch,) = docs.coalesce(1).select("text", "lang", "source").toArrow().combine_chunks().to_batches()
    whole = divergence.term_counts(batch).to_pylist()
    pieces = divergence.merged([divergence.term_counts(batch.slice(i, 9)) for i in range(0, len(batch), 9)]).to_pylist()
    assert sorted(map(str, whole)) == sorted(map(str, pieces))


@given(st.integers(0, 10**13), st.integers(0, 10**13), st.integers(1, 10**9))
def test_probabilities_are_exact(count, more, terms):
    total = count + more
    found = divergence.probabilities(np.array([count]), np.array([total]), terms)
    assert found[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)


# phrases


def plain_counts(rows, longest=5):
    counts, sizes = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, " ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return counts, sizes


def plain_collocations(rows, least, top):
    counts, sizes = plain_counts(rows)
    frequent = {k: n for k, n in counts.items() if n >= least}
    out = defaultdict(list)
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        if len(words) < 2 or any(g == lang and len(q.split(" ")) > len(words) and f" {phrase} " in f" {q} " and n >= a for (g, q), n in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = frequent[lang, " ".join(words[:k])], frequent[lang, " ".join(words[k:])]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((phrase, a, left, right, sizes[lang], score))
    result = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        result += [(lang, rank, *x) for rank, x in enumerate(found[:top], 1)]
    return sorted(result)


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 7), (30, 2000), (10_000, 5)])
def test_collocations(spark, least, top):
    docs, rows = documents(spark, least, 200)
    found = phrases.collocations(docs, least, top)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, least, top)
    assert dict(found.dtypes)["rank"] == dict(found.dtypes)["score"] == "bigint"


def test_phrases_of_odd_tables(spark, odd):
    assert phrases.collocations(odd.limit(0)).collect() == []
    rows = [(None, r["text"], r["lang"]) for r in odd.select("text", "lang").collect()]
    assert sorted(map(tuple, phrases.collocations(odd, 3).collect())) == plain_collocations(rows, 3, 2000)


def test_scores_pass_64_bits(spark):
    rows = [(a, n, l, r) for a, n, l, r in [(10**11, 10**13, 10**11, 10**12), (7 * 10**12 + 1, 10**13, 9 * 10**12, 9 * 10**12 + 7), (100, 10**13, 100, 100)]]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr("a", "n", "l", "r", f"{phrases._SCORE} as score").collect()
    assert [x["score"] for x in found] == [1000 * a * n // (l * r) for a, n, l, r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=80), min_size=1, max_size=8), st.integers(2, 12), st.randoms())
def test_summaries_keep_all_that_is_frequent(tasks, threshold, draw):
    mass = sum(map(len, tasks))
    parts = [np.unique(np.array(t, np.uint64) << np.uint64(40), return_counts=True) for t in tasks]
    draw.shuffle(parts)
    summary = phrases.Summary(mass // threshold + 1)
    for hashes, counts in parts:
        summary.add(*phrases.unpack(phrases.pack(hashes, counts)))
        assert len(summary.counts) <= summary.capacity
    assert summary.error < threshold
    exact = Counter(x for t in tasks for x in t)
    assert {x << 40 for x, n in exact.items() if n >= threshold} <= set(summary.possible(threshold).tolist())


@pytest.mark.parametrize("bits", [15, 29])
def test_filters_know_their_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(phrases, "_MOST_BITS", bits)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    built = phrases.Filter.of(spark.createDataFrame([(int(k),) for k in keys], "gram long"))
    assert built.has(keys << np.uint64(16)).all()
    others = np.random.default_rng(2).integers(0, 1 << 62, 100_000).astype(np.uint64) << np.uint64(2)
    assert built.has(others).mean() < (0.1 if bits == 15 else 0.002)
    assert not phrases.Filter.of(spark.createDataFrame([], "gram long")).has(others).any()


def test_gathered_counts_are_exact(spark, monkeypatch):
    """However often a task hands its counts on, they add up; n-grams never cross pieces, texts or languages."""
    docs, rows = documents(spark, 4, 60)
    batches = docs.select("text", "lang").toArrow().to_batches(7)
    whole = list(phrases._gathered([1, 2, 3], 256)(iter(batches)))
    monkeypatch.setattr(phrases, "GATHERED", 2)
    pieces = list(phrases._gathered([1, 2, 3], 256)(iter(batches)))
    assert len(pieces) > len(whole) == 1

    def total(found):
        sums = Counter()
        for b in found:
            for grams in b.column("grams").to_pylist():
                for h, n in zip(*(x.tolist() for x in phrases.unpack(grams))):
                    sums[h] += n
        return sums

    counts, _ = plain_counts(rows, 3)
    assert sorted(total(whole).values()) == sorted(counts.values())
    assert total(whole) == total(pieces)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_phrases"])
def test_registered_queries_equal_their_sql(spark, name):
    query, sql = {**divergence.QUERIES, **phrases.QUERIES}[name]
    found = query(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert found.columns == columns
    assert canonical([tuple(r) for r in found.collect()], columns) == canonical(cursor.fetchall(), columns)


# languages


def plain_viterbi(emission, fresh, switch):
    best, back = None, []
    for e, new in zip(emission, fresh):
        if best is None:
            best, step = list(e), list(range(len(e)))
        else:
            cost = 0 if new else switch
            top = max(range(len(e)), key=lambda j: best[j])
            step = [j if best[j] >= best[top] - cost else top for j in range(len(e))]
            best = [max(best[j], best[top] - cost) + e[j] for j in range(len(e))]
        back.append(step)
    at = max(range(len(best)), key=lambda j: best[j])
    path = []
    for step in reversed(back):
        path.append(at)
        at = step[at]
    return path[::-1]


@pytest.mark.parametrize("n", [1, 5, languages._BLOCK, 3 * languages._BLOCK + 7])
def test_viterbi_in_blocks(n):
    draw = np.random.default_rng(n)
    emission = -draw.random((n, 4)) * 5
    fresh = draw.random(n) < 0.05
    fresh[0] = True
    assert languages.viterbi(emission, fresh, 6.0).tolist() == plain_viterbi(emission.tolist(), fresh.tolist(), 6.0)
    assert languages.viterbi(np.empty((0, 3)), np.empty(0, bool)).tolist() == []


SYLLABLES = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["sch", "eit", "ung", "der"], "gr": ["αλ", "φα", "βη", "τα"]}


def invented(lang, seed, n):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, invented(lang, i, 30), lang) for i in range(120) for lang in [list(SYLLABLES)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return rows, docs, languages.fit(docs)


def test_held_out_rows_are_never_learned(spark, learned):
    rows, docs, model = learned
    assert model.names == ["aa", "bb", "gr"]
    held = {r["doc_id"] for r in docs.filter(languages.held_out()).collect()}
    assert held
    other = spark.createDataFrame([(i, "zzz qqq", "zz") if i in held else (i, t, g) for i, t, g in rows], "doc_id long, text string, lang string")
    again = languages.fit(other)
    assert again.names == model.names and np.array_equal(again.weights, model.weights)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.identify(docs, model).collect()}
    assert all(found[i][0] == g and found[i][1] > 0.9 for i, _, g in rows)


def test_spans_of_mixed_texts(spark, learned):
    model = learned[2]
    a, b, g = invented("aa", 1000, 25), invented("bb", 1000, 25), invented("gr", 1000, 5)
    text = f"  {a}, {b}! 12 {g}"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "12 ... —"), (4, "\U0001f600 " + a)], "doc_id long, text string")
    spans = [(r["doc_id"], r["lang"], text[r["start"] : r["end"]]) for r in languages.language_spans(docs, model).filter("doc_id = 1").orderBy("start").collect()]
    assert spans == [(1, "aa", a), (1, "bb", b), (1, "gr", g)]
    assert {r["doc_id"] for r in languages.language_spans(docs, model).collect()} == {1, 4}
    # Greek letters leave one candidate, however unlike the training words they are.
    assert languages.identify(spark.createDataFrame([(1, "ωωω")], "doc_id long, text string"), model).first()["lang_pred"] == "gr"


def test_languages_of_odd_tables(spark, odd, learned):
    model = learned[2]
    found = languages.identify(odd, model)
    texts = odd.select("text").collect()
    assert found.count() == len(texts)
    with_letters = sum(any(c.isalpha() for c in r["text"] or "") for r in texts)
    assert found.filter("lang_pred <> 'und'").count() == with_letters
    assert found.filter("score < 0 or score > 1 or score is null or (lang_pred = 'und' and score <> 0)").count() == 0
    nothing = languages.fit(odd.limit(0))
    assert nothing.names == []
    assert {(r["lang_pred"], r["score"]) for r in languages.identify(odd, nothing).collect()} == {("und", 0.0)}
    assert languages.language_spans(odd, nothing).collect() == []
    assert languages.identify(odd.limit(0), model).collect() == []
    assert languages.fit(odd).names == ["en"]


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    found = languages.op13_languages(spark, sf)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    both = found.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in both) >= 0.97 * len(both) > 0


def test_long_texts_are_read_whole(spark, learned):
    text = invented("aa", 5, 30_000) + " " + invented("bb", 5, 60_000)
    docs = spark.createDataFrame([(1, text), (2, prose(1, 10))], "doc_id long, text string")
    row = languages.identify(docs, learned[2]).filter("doc_id = 1").first()
    assert row["lang_pred"] == "bb"
    spans = languages.language_spans(docs, learned[2]).filter("doc_id = 1").orderBy("start").collect()
    assert [r["lang"] for r in spans] == ["aa", "bb"] and spans[-1]["end"] == len(text)
