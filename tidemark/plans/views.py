"""The driver's tables seen as a run log: events, runs, tasks; as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What each type of event stands for.
KIND_OF = {"signup": "task_scheduled", "view": "task_started", "purchase": "task_succeeded", "error": "task_failed", "click": "resource_blocked"}
STATE_OF = {"F": "succeeded", "O": "running", "P": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Epoch seconds of a timestamp column, to the microsecond."""
    return (F.unix_micros(F.col(column).cast("timestamp")).cast("double") / F.lit(1e6))


def _renamed(column: str, names: dict[str, str], other: str):
    found = F.lit(other)
    for k, v in names.items():
        found = F.when(F.col(column) == k, v).otherwise(found)
    return found


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENT rows with what replay reads of the payload as columns: elapsed, reason, result."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").cast("string").alias("run_id"), seq.cast("long").alias("seq"), epoch("ts").alias("at"), _renamed("event_type", KIND_OF, "unknown").alias("kind"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("task"), F.lit(None).cast("int").alias("attempt"), F.floor(F.col("value")).cast("double").alias("elapsed"),
        F.col("event_type").alias("reason"), F.col("props").alias("result"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUN_SNAPSHOT rows from orders; a run without line items isn't finished."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.count("*").alias("tasks"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    started, finished = epoch("o_orderdate"), epoch("last")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("workflow"), _renamed("o_orderstatus", STATE_OF, "pending").alias("state"), started.alias("started_at"),
        finished.alias("finished_at"), F.when(finished.isNotNull(), F.greatest(F.lit(0.0), finished - started)).alias("duration"), F.coalesce("tasks", F.lit(0)).alias("tasks"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TASK_SNAPSHOT rows from line items: one for each distinct (order, line)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    g = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("s"), F.max("l_returnflag").alias("flag"), F.sum(F.floor("l_quantity")).alias("quantity"))
    state = F.when(F.col("flag") == "A", "succeeded").when(F.col("flag") == "R", "failed").otherwise("skipped")
    return g.select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("task"), state.alias("state"), F.col("l_linenumber").cast("int").alias("attempts"),
        (F.col("l_linenumber") - 1).cast("int").alias("retries"), epoch("s").alias("started_at"), (epoch("s") + F.col("quantity") * 60).alias("finished_at"),
        (F.col("quantity") * 60).cast("double").alias("duration"), F.when(state == "skipped", F.col("l_linenumber") % 3).otherwise(0).cast("int").alias("resource_waits"),
        F.col("l_linenumber").cast("int").alias("pos"),
    )


def _case(column: str, names: dict[str, str], other: str) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in names.items())} ELSE '{other}' END"


EVENTS_SQL = f"""ev AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS at, {_case("event_type", KIND_OF, "unknown")} AS kind,
         'k' || (props::JSON ->> '$.k') AS task, CAST(floor(value) AS DOUBLE) AS elapsed, event_type AS reason, props AS result
  FROM events)"""
RUNS_SQL = f"""runs AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS workflow, {_case("o_orderstatus", STATE_OF, "pending")} AS state,
         CAST(epoch_us(o_orderdate) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS started_at, CAST(epoch_us(last) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS finished_at,
         CASE WHEN last IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), CAST(epoch_us(last) AS DOUBLE) / CAST(1000000 AS DOUBLE) - CAST(epoch_us(o_orderdate) AS DOUBLE) / CAST(1000000 AS DOUBLE)) END AS duration,
         coalesce(n, 0) AS tasks
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""
TASKS_SQL = """lines AS (
  SELECT l_orderkey, l_linenumber, min(l_shipdate) AS s, max(l_returnflag) AS flag, sum(CAST(floor(l_quantity) AS BIGINT)) AS quantity FROM lineitem GROUP BY ALL),
tasks AS (
  SELECT l_orderkey AS run_id, 't' || l_linenumber AS task, CASE flag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS state, l_linenumber AS attempts,
         l_linenumber - 1 AS retries, CAST(epoch_us(s) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS started_at, CAST(epoch_us(s) AS DOUBLE) / CAST(1000000 AS DOUBLE) + quantity * 60 AS finished_at,
         CAST(quantity * 60 AS DOUBLE) AS duration, CASE WHEN flag NOT IN ('A', 'R') THEN l_linenumber % 3 ELSE 0 END AS resource_waits, l_linenumber AS pos
  FROM lines)"""
