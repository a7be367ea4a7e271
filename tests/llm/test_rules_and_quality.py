from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablesmith.llm import quality_rules as q
from tablesmith.llm.line_crf import LineModel, WIDTH, _chain, document_quality, fit, held_out, line_features, marginals, score_documents, train

from .conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, odd):
    draw = random.Random(1)
    small = [(1000 + i, " ".join(draw.choice("ab") for _ in range(draw.randrange(40)))) for i in range(60)]
    docs = odd.unionByName(frame(spark, [*small, (2000, "a%|b <c>\x0bd\x0ce\rf\tg")]))
    got = q.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = sorted((str((r["doc_id"], *(c := counts(r["text"])), c[0] < 10 or 100 * c[4] > 20 * c[0])) for r in docs.collect()))
    assert sorted(str(tuple(r)) for r in got) == want
    assert q.quality_rules(odd.limit(0)).count() == 0


def test_label_model_equals_plain_em(spark):
    draw = random.Random(2)
    rules = len(q.RULES)
    rows = []
    for _ in range(800):
        good = draw.random() < 0.7
        rows.append([draw.choices([0, 1, 2], [0.1, 0.3, 0.6] if good else [0.5, 0.3, 0.2])[0] for _ in range(rules)])
    patterns = Counter(tuple(3 * i + v for i, v in enumerate(r)) for r in rows)
    model = q.fit(spark.createDataFrame([(list(p), float(n)) for p, n in patterns.items()], "votes array<int>, n double").coalesce(1), rounds=8, tolerance=0)

    def share(p):
        said = [v % 3 - 1 for v in p]
        return 0.5 + 0.5 * sum(said) / max(1, sum(map(abs, said)))

    post = {p: share(p) for p in patterns}
    for _ in range(8):
        total = [sum(n * (post[p] if c else 1 - post[p]) for p, n in patterns.items()) for c in (0, 1)]
        says = [[[1.0] * 3 for _ in range(rules)] for _ in (0, 1)]
        for c in (0, 1):
            for i in range(rules):
                seen = [sum(n * (post[p] if c else 1 - post[p]) for p, n in patterns.items() if p[i] % 3 == v) for v in range(3)]
                says[c][i] = [(seen[0] + 1) / (seen[0] + seen[2] + 2), 1.0, (seen[2] + 1) / (seen[0] + seen[2] + 2)]
        good = (total[1] + 1) / (sum(total) + 2)
        post = {p: 1 / (1 + math.exp(-math.log(good / (1 - good)) - sum(math.log(says[1][i][v % 3] / says[0][i][v % 3]) for i, v in enumerate(p)))) for p in patterns}
    assert model.good == pytest.approx(good) and model.over_good == pytest.approx([x for r in says[1] for x in r])


def test_junk_goes_and_prose_stays(spark):
    good = [(i, prose(i, 60 + i)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "%%%" for w in prose(i, 80).split())) for i in range(8)] + [(200 + i, f"word{i} " * 90) for i in range(8)]
    docs = frame(spark, good + junk)
    kept = q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in good}
    assert {r["doc_id"] for r in q.quality_rules(docs).filter("kept").collect()} == {i for i, _ in good}


def test_rules_run_without_python(spark):
    docs = frame(spark, [(1, prose(1, 50))]).select("doc_id", "text")
    plan = q.features(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chain_equals_enumeration():
    draw = np.random.default_rng(1)
    emissions, transitions = draw.normal(size=5), draw.normal(size=(2, 2))
    paths = [[(b >> t) & 1 for t in range(5)] for b in range(32)]
    weight = [math.exp(sum(emissions[t] * p[t] for t in range(5)) + sum(transitions[p[t - 1], p[t]] for t in range(1, 5))) for p in paths]
    want = [sum(w for p, w in zip(paths, weight) if p[t]) / sum(weight) for t in range(5)]
    padded = np.zeros((2, 7))
    padded[0, :5] = emissions
    mask = np.zeros((2, 7), bool)
    mask[0, :5] = mask[1, :1] = True
    good, pairs = _chain(padded, mask, transitions, np.array([1.0, 0.0]))
    assert good[0, :5] == pytest.approx(want)
    both = sum(w * sum(p[t - 1] and p[t] for t in range(1, 5)) for p, w in zip(paths, weight)) / sum(weight)
    assert pairs[1, 1] == pytest.approx(both)
    features = np.zeros((5, WIDTH))
    features[:, 0] = emissions
    model = LineModel(np.eye(WIDTH)[0], transitions)
    assert marginals(model, features) == pytest.approx(want)


def test_classifier_on_held_out_rows(spark, odd):
    docs = frame(spark, [(i, prose(i, 100)) for i in range(150)] + [(500 + i, "\n".join(["buy now!!! $$$ now now now"] * 12) + "\n" + prose(i, 12)) for i in range(60)])
    labels = docs.selectExpr("doc_id", "cast(doc_id < 500 as int) as quality", "0 as toxic", "'x' as text")
    model = fit(docs, labels)
    scored = score_documents(docs, model).withColumn("held_out", held_out()).collect()
    assert any(r["held_out"] for r in scored)
    assert all((r["score"] >= 0.5) == (r["doc_id"] < 500) for r in scored if r["held_out"])
    again = [tuple(r) for r in score_documents(odd, model).collect()]
    assert len(again) == odd.count() and all(0 <= s <= 1 for _, s in again)
    assert document_quality(train([]), "") == 0.5
    assert line_features([""]).shape == (1, WIDTH)
    even = fit(docs, labels.limit(0))
    assert {r["score"] for r in score_documents(docs, even).collect()} == {0.5}
