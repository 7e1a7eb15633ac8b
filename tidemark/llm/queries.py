"""The queries of this subpackage, their SQL where SQL can express them, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, imatch, line_dedup, packing, secrets, sharding, simhash, token_counts, topk, toxicity
from tidemark.llm._common import table
from tidemark.session import shared_dir


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Production parameters of line dedup.
LINES = {"ratio": 0.1, "min_pages": 5}


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.update(docs, f"{shared_dir(spark)}/tidemark-ledger-{uuid.uuid4().hex}")
    found = secrets.findings(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    counts = [secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    return topk.search(rows, F.col("vec_id") % 50 == 0, k=5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    windows = packing.cut_windows(docs, vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(windows)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), vocabulary())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), F.col("source"), **LINES)


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = imatch.neighbours(docs, imatch.lexicon(docs))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), imatch.fingerprint_of(F.col("hashes")).alias("fingerprint"),
        imatch.fingerprint_of(F.col("edited_hashes")).alias("edited_fingerprint"), imatch.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        imatch.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_exact_topk": op2_exact_topk,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_imatch": op9_imatch,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": topk.SQL,
    "op8_line_dedup": line_dedup.SQL.format(**LINES),
}
