"""Vector bin packing of documents into shards.

Bytes, tokens and rows are balanced jointly. Items are placed in falling order of size, each where the dot product of
its weights with the residual capacity of the shard is highest; weights are shares of the corpus, so that the three
dimensions count alike.

Equal texts are a group and stay together as long as the group is small. Groups are placed through a bounded number of
items: the hash of a text picks one of BUCKETS light items, and a group with over 1 / (shards * SPLIT) of the corpus in
any dimension is an item of its own, cut into parts of about that share by a hash of the document id. So the driver
places at most BUCKETS + 6 * shards * SPLIT items, however large the corpus; all per-document work is distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

BUCKETS, SPLIT = 16384, 64


def place(weights: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; weights has a row for each item and a column for each dimension.

    Ties go to the emptier, then to the smaller shard. The last dimension's counts, if all dimensions are filled up,
    still go where the least is overfull, since the residual capacity is then least negative.
    """
    total = weights.sum(axis=0)
    share = weights / np.where(total > 0, total, 1)
    residual = np.full((shards, weights.shape[1]), 1.0 / shards)
    found = np.zeros(len(weights), np.int64)
    for i in np.lexsort((np.arange(len(weights)), -share.max(axis=1))):
        found[i] = shard = int(np.argmax(residual @ share[i]))
        residual[shard] -= share[i]
    return found


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 1), tokens (words), text_crc32, text_group."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_group"),
    )


def shard(docs: DataFrame, shards: int = 16, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot (gapless from 0 in each shard).

    Null texts are empty ones, null ids and repeated rows get slots like any other; within an item slots go by id
    (nulls first), then by the text's checksum. An empty table gives an empty result. Other columns of docs are left out.
    """
    spark, weights = docs.sparkSession, ["size", "tokens", "n"]
    slim = materialize(measured(docs, id_col, text_col), "measured")
    sums = [F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("n")]
    total = slim.agg(*sums).first()
    groups = slim.groupBy("text_group").agg(*sums)
    part = F.greatest(*[F.col(w) * shards * SPLIT / max(1, total[w]) for w in weights])
    # At most 3 * shards * SPLIT groups can be above that share.
    heavy = groups.select("text_group", F.least(F.ceil(part), F.col("n")).cast("long").alias("parts"), part.alias("share")).where("share > 1").select("text_group", "parts")
    listed = sorted((r.text_group, r.parts) for r in heavy.collect())
    first, rows = buckets, []
    for group, parts in listed:
        rows.append((group, parts, first))
        first += parts
    heavy = spark.createDataFrame(rows, "text_group long, parts long, first long")
    light = F.pmod(F.col("text_group"), F.lit(buckets))
    own = F.col("first") + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts"))
    items = slim.join(F.broadcast(heavy), "text_group", "left").withColumn("item", F.coalesce(own, light))
    sizes = sorted(items.groupBy("item").agg(*sums).collect())  # at most `first` rows
    to = place(np.array([[r[w] for w in weights] for r in sizes], float).reshape(-1, 3), shards)
    start, placed = [0] * shards, []
    for r, s in zip(sizes, to.tolist()):
        placed.append((r.item, s, start[s]))
        start[s] += r.n
    placed = spark.createDataFrame(placed, "item long, shard int, start long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "text_crc32"))
    return items.withColumn("rank", rank).join(F.broadcast(placed), "item").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
