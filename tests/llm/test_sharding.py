"""Balance, gapless slots, and groups, hot ones too."""

import zlib

import numpy as np

from tidemark.llm import sharding


def check(rows, out, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    return [sum(r.size for r in out if r.shard == s) for s in range(shards)]


def test_sizes_are_near_equal_and_equal_texts_stay_together(spark):
    rows = [(i, f"text {i} " + "é " * (i % 37)) for i in range(3000)] + [(9000 + i, "a small group") for i in range(5)]
    rows += [(5, None), (5, None), (None, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as shard", "'a' as item", "1 as rank")
    out = sharding.shard(docs, 8).collect()
    sizes = check(rows, out, 8)
    assert max(sizes) <= 1.02 * min(sizes)
    assert len({r.shard for r in out if r.doc_id and r.doc_id >= 9000}) == 1


def test_a_group_of_a_third_is_split(spark):
    rows = [(i, "the same text for all of these") for i in range(1000)] + [(1000 + i, f"other {i} of much the same size") for i in range(2000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    sizes = check(rows, out, 16)
    assert max(sizes) <= 1.05 * min(sizes)


def test_empty_table_and_one_giant(spark):
    docs = spark.createDataFrame([(1, "x" * 100_000), (2, "y"), (3, "z")], "doc_id long, text string")
    assert sharding.shard(docs.limit(0)).count() == 0
    out = {r.doc_id: r.shard for r in sharding.shard(docs, 4).collect()}
    assert out[2] != out[1] != out[3]


def test_placement_takes_the_highest_dot_product():
    weights = np.array([[5, 1, 1], [1, 5, 1], [1, 1, 5], [2, 2, 2], [1, 0, 0]], float)
    share, residual, want = weights / weights.sum(axis=0), np.full((3, 3), 1 / 3), {}
    for i in sorted(range(5), key=lambda i: -share[i].max()):
        want[i] = max(range(3), key=lambda s: (sum(residual[s] * share[i]), -s))
        residual[want[i]] -= share[i]
    assert sharding.place(weights, 3).tolist() == [want[i] for i in range(5)]
