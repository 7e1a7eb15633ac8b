"""Reading and checking event logs.

A store is a folder of JSON lines, one file a run, or a Parquet table of events. Payloads stay JSON text, so that what
was written can be given back byte by byte; replay parses the fields that it needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.faults import CorruptLog
from tidemark.functions.schema import EVENT, KINDS, RUN_KINDS

_LOOSE = T.StructType([T.StructField(f.name, T.StringType()) for f in EVENT.fields] + [T.StructField("_corrupt", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def open_store(spark: SparkSession, root: str, create: bool = True) -> str:
    """The path of a store; a missing folder is made, or an error without create."""
    if not _exists(spark, root):
        if not create:
            raise FileNotFoundError(f"no store at {root}")
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    return root


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw envelopes of JSON lines as text, with the line itself where it isn't an object; blank lines are left out.

    Values keep their JSON spelling, so that a check can tell 1 from "1" and from true.
    """
    text = spark.read.text(path).where(F.trim("value") != "")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl)?$", 1)
    line = F.col("value")
    fields = {f.name: F.try_variant_get(F.try_parse_json(line), f"$.{f.name}", "variant") for f in EVENT.fields}
    return text.select(name.alias("file_run"), line.alias("line"), *[v.alias(k) for k, v in fields.items()])


def malformed(raw: DataFrame) -> DataFrame:
    """file_run, line, problem: lines of read_lines() that aren't events. Booleans are neither integers nor numbers."""

    def kind(c: str):
        return F.schema_of_variant(F.col(c))

    number = ["BIGINT", "DOUBLE", "FLOAT"]
    decimal = lambda c: kind(c).startswith("DECIMAL")
    problem = F.when(F.try_parse_json("line").isNull() | ~F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), "not an object")
    for c in ("seq", "at", "kind", "run_id"):
        problem = problem.when(F.col(c).isNull(), f"{c} is missing")
    problem = problem.when(~F.coalesce(F.try_variant_get("kind", "$", "string"), F.lit("")).isin(*KINDS), "unknown kind")
    problem = problem.when(kind("seq") != "BIGINT", "seq is not an integer")
    problem = problem.when(F.try_variant_get("seq", "$", "bigint") < 0, "seq is below 0")
    problem = problem.when(~(kind("at").isin(*number) | decimal("at")), "at is not a number")
    problem = problem.when(F.col("attempt").isNotNull() & ~kind("attempt").isin("BIGINT", "VOID"), "attempt is not an integer")
    problem = problem.when(F.try_variant_get("attempt", "$", "bigint") < 1, "attempt is below 1")
    problem = problem.when(F.col("payload").isNotNull() & ~(kind("payload").startswith("OBJECT") | (kind("payload") == "VOID")), "payload is not an object")
    return raw.withColumn("problem", problem).where("problem is not null").select("file_run", "line", "problem")


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of a file or folder of JSON lines; with strict a malformed line is an error, without it is left out."""
    raw = read_lines(spark, path)
    if strict and (first := malformed(raw).select("file_run", "problem").first()):
        raise CorruptLog(f"{first.file_run}: {first.problem}")
    parsed = raw.where(F.try_variant_get("kind", "$", "string").isin(*KINDS))
    columns = []
    for f in EVENT.fields:
        value = F.col(f.name)
        columns.append((F.to_json(value) if f.name == "payload" else F.try_variant_get(value, "$", f.dataType.simpleString())).alias(f.name))
    return parsed.select(*columns, "file_run").where("seq is not null and at is not null and run_id is not null")


def read_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """One run's events in order."""
    return read_events(spark, f"{root.rstrip('/')}/{run_id}.jsonl").orderBy("seq")


def run_ids(events: DataFrame) -> DataFrame:
    """run_id, in lexicographic order."""
    return events.select("run_id").distinct().orderBy("run_id")


def run_ids_by_creation(events: DataFrame, position: str) -> DataFrame:
    """run_id, in the order of the first row of each by a column that says when it came in."""
    return events.groupBy("run_id").agg(F.min(position).alias("created")).orderBy("created", "run_id").select("run_id")


def has_run(events: DataFrame, run_id: str) -> bool:
    return bool(events.where(F.col("run_id") == run_id).limit(1).count())


def adopt(events: DataFrame, log: DataFrame) -> DataFrame:
    """events and the rows of log, none of whose runs may be there yet."""
    clash = log.select("run_id").distinct().join(events.select("run_id").distinct(), "run_id", "left_semi").first()
    if clash:
        raise CorruptLog(f"run {clash.run_id} is there already")
    return events.unionByName(log)


def ingest(rows: DataFrame, position: str) -> DataFrame:
    """run_id, seq, problem: rows of many interleaved runs whose seq isn't the next one of their run, in order of arrival."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(position)) - 1
    return rows.withColumn("expected", nth).where("seq <> expected").select("run_id", "seq", "expected")


def mixed_runs(events: DataFrame) -> DataFrame:
    """file_run, run_id: events of another run than their file's."""
    return events.where("file_run <> run_id").select("file_run", "run_id", "seq")


def parse_timestamp(column):
    """Epoch seconds of a compact (20260310T093000Z) or ISO (2026-03-10T09:30:00Z) UTC time."""
    compact = F.try_to_timestamp(column, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    iso = F.try_to_timestamp(column, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    found = F.coalesce(compact, iso)
    return F.when(column.isNull() | found.isNotNull(), F.unix_timestamp(found).cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a timestamp: "), column)))


def parse_assignment(text: str) -> tuple[str, object]:
    """key=value of a command line; the value is JSON if it parses as such, else text."""
    import json

    key, sign, value = text.partition("=")
    if not sign or not re.fullmatch(r"[A-Za-z_]\w*", key.strip()):
        raise ValueError(f"expected key=value, got {text!r}")
    try:
        return key.strip(), json.loads(value)
    except ValueError:
        return key.strip(), value


__all__ = [
    "CorruptLog", "RUN_KINDS", "adopt", "has_run", "ingest", "malformed", "mixed_runs", "open_store", "parse_assignment", "parse_timestamp",
    "read_events", "read_lines", "read_run", "run_ids", "run_ids_by_creation",
]
