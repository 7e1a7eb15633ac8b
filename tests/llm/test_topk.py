"""Search against all inner products, sorted."""

import math
import random

from pyspark.sql import functions as F

from tidemark.llm import topk


def plain(rows, k):
    vectors = {}
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in usable:
        if i % 50 == 0:
            vectors[i] = min(vectors.get(i, v), v)
    out = []
    for q, v in vectors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_against_all_products(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([0.0, 0.0, 0.5, -0.25, 1.0, 0.003]) for _ in range(6)]) for i in range(301)]
    rows += [(350, None), (400, [1.0, None]), (450, [float("nan")]), (500, [float("inf")]), (None, [1.0]), (550, []), (600, [1.0, 1.0]), (100, rows[100][1]), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as score", "1 as id")
    vectors = docs.withColumn("vector", topk.quantized(F.col("embedding")))
    want = plain(rows, 5)
    get = lambda: sorted(tuple(r) for r in topk.search(vectors, F.col("vec_id") % 50 == 0).collect())
    assert get() == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 17)
    assert get() == want
    assert topk.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = vectors.where("vec_id in (0, 1, 2)")
    assert [tuple(r)[:3] for r in topk.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(q, n, i) for q, n, i, _ in plain(rows[:3], 5)]
