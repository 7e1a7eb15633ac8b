"""Segments against all segments, the fit on planted words, and odd rows."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def plain(scores):
    """Maximal segments by their definition: best of the whole, then of what is left of it and right of it."""
    if not len(scores):
        return []
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = round(float(sum(scores[a:b])), 6)
            if s > 0 and (best is None or s > best[2] or s == best[2] and b - a < best[1] - best[0]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return plain(scores[:a]) + [best] + [(x + b, y + b, z) for x, y, z in plain(scores[b:])]


def test_segments_by_definition():
    rnd = random.Random(9)
    for _ in range(400):
        scores = np.array([rnd.choice([-3.1, -1.03, -0.107, 0.517, 1.301, 2.719]) + rnd.random() / 1000 for _ in range(rnd.randint(0, 14))])
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
        want = plain(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)


def test_the_search_takes_linear_time():
    def seconds(n):
        began = time.perf_counter()
        assert len(toxicity.segments(np.tile([1.0, -2.0], n))) == n
        return time.perf_counter() - began

    seconds(20_000)
    assert min(seconds(320_000) for _ in range(3)) < 4 * min(seconds(160_000) for _ in range(3))
    falling = np.ravel([[3.0 - i / 40_000, -1.0] for i in range(100_000)])
    assert toxicity.segments(falling) and seconds(200_000) < 10


def test_scores_by_definition():
    rnd = random.Random(4)
    model = toxicity.Model({"=bad": 2.5, "^wor": 1.5, "$ile": 3.0}, rate=0.9, place=-1.2, logistic=(-3.0, 0.6, 0.4))
    of = {"bad": 2.5, "Bad!": 2.5, "worst": 1.5, "vile": 3.0, "ile": -0.1, "wor": -0.1, "fine": -0.1, "12": -0.1}
    for _ in range(300):
        words = [rnd.choice(list(of)) for _ in range(rnd.randint(0, 14))]
        seen, scores = {}, []
        for w in words:
            seen[w] = seen.get(w, 0) + 1
            scores.append(of[w] / seen[w] if of[w] > 0 else of[w])
        evidence = [0.9 * s - (-1.2 + math.log(max(1, len(words)))) for *_, s in plain(np.array(scores))]
        evidence = [e for e in evidence if e > 0]
        want = 1 / (1 + math.exp(3 - 0.6 * max(evidence, default=0) - 0.4 * math.log1p(sum(evidence))))
        assert abs(model.score(model.passages(" ".join(words))) - want) < 1e-4


def test_a_long_toxic_text(spark):
    model = toxicity.Model({"=bad": 3.0}, place=-15.0, logistic=(-3.0, 1.0, 0.0))
    docs = spark.createDataFrame([(1, "bad x y z " * 50_000), (2, "x y z " * 50_000)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()} == {1: 1, 2: 0}


def corpus(n, seed):
    rnd, bad = random.Random(seed), ["vilest", "vilely", "vileish", "scoundrel", "wretch"]
    rows = []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rnd.choice(["", "o", "ing"]) for _ in range(rnd.randint(5, 120))]
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(bad).capitalize() + rnd.choice(["", ",", "."]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "0.5 as score", "1 as toxic", "'x' as id")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (3, None), (77_777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    truth = {i: t for i, _, t in rows}
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held]
    assert 100 < len(held) < 260 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    hit = next(r for r in out if truth[r.doc_id] and r.predicted)
    words = rows[hit.doc_id][1].split()
    assert any(w.lower().startswith(("vile", "scoun", "wretch")) for p in hit.passages for w in words[p["start"] : p["end"]])


def test_odd_rows_and_missing_classes(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    for marked in (labels, labels.limit(0)):
        model = toxicity.train(docs, marked)
        assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0] * 4
    assert toxicity.score(docs.limit(0), toxicity.Model({})).count() == 0
