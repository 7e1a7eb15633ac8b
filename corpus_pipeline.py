"""From raw documents to packed training windows: five stages, each an operator of tidemark.llm on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, packing, secrets, simhash, toxicity
from tidemark.llm._common import table
from tidemark.llm.queries import LINES, vocabulary
from tidemark.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, toxicity.train(docs, labels)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; the document stays, even if nothing of it is left."""
    kept = line_dedup.line_dedup(docs, F.col("source"), **LINES, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, a similarity of 0.8 or more.

    Copies are found by fingerprints and their Golay keys, and by minima of the shingles' hashes; whole sets are compared.
    """
    return simhash.without_copies(docs, least=0.8, shingle=5).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the document stays."""
    ledger = materialize(secrets.scan_unseen(docs), "ledger")
    return secrets.without_secrets(docs, ledger).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of at most 1024, each with its sequence and place there."""
    return packing.pack(packing.cut_windows(docs, vocabulary()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the tokenizer, the classifier or the keys; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
