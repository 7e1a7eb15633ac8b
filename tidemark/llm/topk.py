"""Exact top-k search by term-at-a-time accumulation.

A stated set of queries is scored against all candidates, block by block. A block of candidates is held as postings: for
each term (dimension) the candidates with a value there, and the values. For each query one dense array has a score for
every candidate of the block; each term of the query, taken as a sparse row, scatters its weight times the posting's
values into that array. A partition of the array then picks the block's k best, which merge into the task's k best, and
these merge once more over all tasks. Nothing is pruned: every candidate gets its exact score.

Queries go out in passes of about QUERY_BLOCK rows, so that what a task holds is bounded; candidates never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, ship

#: Queries of one pass, candidates of one block.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 4096


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null if the vector, or one of its components, is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


def postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term -> candidates with a value other than 0, and these values. Vectors may differ in length."""
    rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    terms = np.concatenate([np.arange(len(v)) for v in vectors]) if vectors else np.array([], int)
    values = np.concatenate(vectors) if vectors else np.array([], np.int64)
    keep = values != 0
    rows, terms, values = rows[keep], terms[keep], values[keep]
    order = np.argsort(terms, kind="stable")
    ends = np.flatnonzero(np.diff(terms[order])) + 1
    return {int(terms[p[0]]): (rows[p], values[p]) for p in np.split(order, ends) if len(p)}


def accumulate(query: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Inner products of one query with a block of size candidates, a term at a time."""
    scores = np.zeros(size, np.int64)
    for term in np.flatnonzero(query):
        if (found := lists.get(int(term))) is not None:
            rows, values = found
            if len(rows) == size:
                scores += query[term] * values
            else:
                scores[rows] += query[term] * values
    return scores


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id, the highest first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _pass(candidates: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], k: int) -> DataFrame:
    ship(candidates.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.array([], np.int64), np.array([], np.int64))] * len(ids)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                column = part.column(1)
                offsets = column.offsets.to_numpy()
                flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
                lists = postings([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
                for n, (query, vector) in enumerate(zip(ids, vectors)):
                    scores, others = accumulate(vector, lists, len(own)), own != query
                    if not others.all():
                        new, scores = own[others], scores[others]
                    else:
                        new = own
                    new, scores = best(new, scores, k)
                    kept[n] = best(np.concatenate([kept[n][0], new]), np.concatenate([kept[n][1], scores]), k)
        if not kept:
            return
        size = [len(i) for i, _ in kept]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.concatenate([i for i, _ in kept])), pa.array(np.concatenate([s for _, s in kept]))], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest inner product for each query row.

    vectors holds integer arrays; queries says which of its rows are queries, and every row is a candidate but for rows
    with the query's own id. A null id or vector takes no part; a short vector counts as followed by zeros. Ties go to
    the smaller id; a query that occurs more than once is answered once, by the smallest of its vectors; with fewer
    than k candidates all are returned. No query or no candidate: no row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), queries.alias("asks")).where("id is not null and vector is not null")
    rows = materialize(rows, "vectors")  # read once a pass
    asking = materialize(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")), "asking")
    passes = max(1, -(-asking.count() // QUERY_BLOCK))
    parts = []
    for p in range(passes):
        block = asking.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).toArrow()  # about QUERY_BLOCK rows
        ids = block.column("id").to_numpy().astype(np.int64)
        queries_now = [np.array(v, np.int64) for v in block.column("vector").to_pylist()]
        part = _pass(rows.select("id", "vector"), ids, queries_now, k)
        parts.append(part if passes == 1 else materialize(part, "topk"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same for embeddings and queries divisible by 50, for DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
