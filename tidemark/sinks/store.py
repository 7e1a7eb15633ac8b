"""Writing event logs and reports.

A store is a Parquet table of events, partitioned by a hash of the run (a folder a run would make a file a run). Appends
are idempotent by (run_id, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso
from tidemark.functions.schema import EVENT, TASK_STATES

BUCKETS = 64

#: Columns of the two CSV reports, in order.
RUN_COLUMNS = ["run_id", "workflow", "state", "started_at", "finished_at", "duration", "tasks", "succeeded", "failed", "skipped", "attempts"]
TASK_COLUMNS = ["run_id", "workflow", "task", "state", "attempts", "retries", "started_at", "finished_at", "duration", "timed_out", "detail"]


def _bucketed(events: DataFrame) -> DataFrame:
    return events.select(*EVENT.names).withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int"))


def append(events: DataFrame, path: str) -> None:
    """Add events to a store."""
    _bucketed(events).write.mode("append").partitionBy("bucket").parquet(path)


def flush(events: DataFrame, path: str) -> int:
    """Add those events whose (run_id, seq) the store lacks; how many there were. Only the events' buckets are read."""
    spark = events.sparkSession
    recover(spark, path)
    buckets = [r.bucket for r in _bucketed(events).select("bucket").distinct().collect()]  # BUCKETS at most
    try:
        known = spark.read.parquet(path).where(F.col("bucket").isin(*buckets) if buckets else F.lit(False)).select("run_id", "seq")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    new = events.dropDuplicates(["run_id", "seq"])
    new = (new if known is None else new.join(known, ["run_id", "seq"], "left_anti")).cache()
    n = new.count()
    if n:
        append(new, path)
    new.unpersist()
    return n


def load(spark: SparkSession, path: str) -> DataFrame:
    recover(spark, path)
    return spark.read.parquet(path).select(*EVENT.names)


def number(events: DataFrame, order: str, start: DataFrame | None = None) -> DataFrame:
    """events with seq: places from 0 in each run by an order, or on from the last place that start (run_id, seq) has."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(order)) - 1
    if start is None:
        return events.withColumn("seq", nth.cast("long"))
    last = start.groupBy("run_id").agg((F.max("seq") + 1).alias("_next"))
    return events.join(last, "run_id", "left").withColumn("seq", (nth + F.coalesce("_next", F.lit(0))).cast("long")).drop("_next")


def _file_system(spark: SparkSession, path: str):
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def recover(spark: SparkSession, path: str) -> None:
    """Undo or finish a rewrite that broke off: a bucket that was set aside comes back unless a new one is in its place."""
    fs, to_path = _file_system(spark, path)
    aside = to_path(f"{path}__aside")
    if not fs.exists(aside):
        return
    for f in fs.listStatus(aside):
        live = to_path(f"{path}/{f.getPath().getName()}")
        if not fs.exists(live):
            fs.rename(f.getPath(), live)
    fs.delete(aside, True)


def _rewrite(kept: DataFrame, touched: DataFrame, path: str) -> None:
    """Replace the folders of the touched buckets by what is kept of them; a bucket of which nothing is kept stays empty.

    What is kept is written first. Then each bucket is set aside and the new one takes its place, by renaming alone, so
    that whenever this breaks off, recover() finds either the old bucket or the new one, whole.
    """
    spark = kept.sparkSession
    buckets = [r.bucket for r in _bucketed(touched).select("bucket").distinct().collect()]  # BUCKETS at most
    held = _bucketed(kept).where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
    staged, aside = f"{path}__staged", f"{path}__aside"
    held.write.mode("overwrite").partitionBy("bucket").parquet(staged)
    fs, to_path = _file_system(spark, path)
    fs.mkdirs(to_path(aside))
    for b in buckets:
        if fs.exists(to_path(f"{path}/bucket={b}")):
            fs.rename(to_path(f"{path}/bucket={b}"), to_path(f"{aside}/bucket={b}"))
        if not fs.exists(to_path(f"{staged}/bucket={b}")):
            fs.mkdirs(to_path(f"{path}/bucket={b}"))
        else:
            fs.rename(to_path(f"{staged}/bucket={b}"), to_path(f"{path}/bucket={b}"))
    fs.delete(to_path(aside), True)
    fs.delete(to_path(staged), True)


def replace(events: DataFrame, path: str) -> None:
    """Put the runs of events in place of what the store has of them."""
    stored = load(events.sparkSession, path)
    others = stored.join(events.select("run_id").distinct(), "run_id", "left_anti")
    _rewrite(others.unionByName(events.select(*EVENT.names)), events, path)


def delete(spark: SparkSession, path: str, run_id: str) -> None:
    stored = load(spark, path)
    _rewrite(stored.where(F.col("run_id") != run_id), stored.where(F.col("run_id") == run_id), path)


# Lines and reports ---------------------------------------------------------------------------------------------------


def event_lines(events: DataFrame) -> DataFrame:
    """run_id, seq, line: JSON with sorted keys, absent fields left out."""
    payload = F.try_parse_json("payload") if dict(events.dtypes)["payload"] == "string" else F.col("payload")
    rows = events.withColumn("payload", F.when(~F.col("payload").isin("{}", "null"), payload))
    fields = F.struct("at", "attempt", "kind", "payload", "run_id", "seq", "task")
    return rows.select("run_id", "seq", F.to_json(fields).alias("line"))


def write_lines(events: DataFrame, path: str) -> None:
    """Events as JSON lines, each run's in order within its files."""
    event_lines(events).repartition("run_id").sortWithinPartitions("run_id", "seq").select("line").write.mode("overwrite").text(path)


def checksums(events: DataFrame) -> DataFrame:
    """run_id, checksum: 16 digits of the SHA-256 of the run's lines as a JSON list."""
    lines = event_lines(events)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), ",")
    return lines.groupBy("run_id").agg(F.left(F.sha2(F.concat(F.lit("["), whole, F.lit("]")), 256), F.lit(16)).alias("checksum"))


def _stamp(at: str):
    return F.coalesce(iso(F.col(at)), F.lit("")).alias(at)


def _seconds():
    return F.when(F.col("duration").isNull(), "").otherwise(F.format_string("%.6f", F.col("duration"))).alias("duration")


def runs_csv(runs: DataFrame) -> DataFrame:
    """The run report's rows; skipped counts what an upstream failure kept from running too."""
    return runs.withColumns({"started_at": _stamp("started_at"), "finished_at": _stamp("finished_at"), "duration": _seconds()}).select(*RUN_COLUMNS)


def tasks_csv(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """The task report's rows; detail is the error's message, else the reason for a skip."""
    detail = F.coalesce(F.get_json_object("error", "$.message"), "skip_reason", F.lit(""))
    rows = tasks.join(runs.select("run_id", "workflow"), "run_id").withColumn("detail", detail)
    rows = rows.withColumns({"started_at": _stamp("started_at"), "finished_at": _stamp("finished_at"), "duration": _seconds(), "timed_out": F.when(F.col("timed_out"), "yes").otherwise("no")})
    return rows.select(*TASK_COLUMNS, "pos")


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").csv(path, header=True)


def run_json(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id, json: a run and its tasks, keys sorted, nulls kept."""
    task = F.struct(*[F.col(c) for c in sorted(["attempts", "duration", "error", "finished_at", "resource_waits", "result", "retries", "skip_reason", "started_at", "state", "timed_out"])], F.col("task").alias("name"))
    own = tasks.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", task.alias("t")))), lambda x: x["t"]).alias("task_rows"))
    joined = runs.join(own, "run_id", "left")
    body = F.struct("duration", "event_count", "finished_at", "params", "run_id", "started_at", "state", F.col("task_rows").alias("tasks"), "workflow")
    return joined.select("run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def runs_summary(runs: DataFrame) -> DataFrame:
    """count, succeeded, failed: the header over a list of runs."""
    return runs.agg(F.count("*").alias("count"), F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.count_if(F.col("state") == "failed").alias("failed"))


def runs_document(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """part, run_id, line: one JSON document over all runs, a line for its header (part 0), each run (1) and its end (2).

    In the order of (part, run_id) the lines make the document; no task holds more of it than a line at a time. Runs
    with a null run_id come first; without runs the list in it is empty.
    """
    head = runs_summary(runs).select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("run_id"), F.to_json(F.struct("count", "failed", "succeeded")).alias("line"))
    head = head.withColumn("line", F.concat(F.regexp_replace("line", r"\}$", ""), F.lit(',"runs":[')))
    body = run_json(runs, tasks)
    least = body.agg(F.min_by("run_id", F.struct(F.col("run_id").isNotNull(), "run_id"))).first()[0]
    comma = F.when(F.col("run_id").eqNullSafe(F.lit(least)), "").otherwise(",")
    body = body.select(F.lit(1), "run_id", F.concat(comma, "json"))
    return head.union(body).union(head.select(F.lit(2), "run_id", F.lit("]}")))


def write_runs_document(runs: DataFrame, tasks: DataFrame, path: str) -> None:
    """runs_document() as text files whose names follow its order."""
    lines = runs_document(runs, tasks)
    lines.orderBy("part", F.col("run_id").asc_nulls_first()).select("line").write.mode("overwrite").text(path)


def render_table(columns: list[str], rows: list[list], align: list[str] | None = None) -> str:
    """A small result as text, columns as wide as their widest cell."""
    from tidemark.functions.scalars import pad

    cells = [[("-" if c is None else str(c)) for c in r] for r in rows]
    width = [max(len(r[i]) for r in [columns, *cells]) for i in range(len(columns))]
    align = align or ["left"] * len(columns)
    lines = [columns, ["-" * w for w in width], *cells]
    return "\n".join("  ".join(pad(c, w, a) for c, w, a in zip(r, width, align)).rstrip() for r in lines)


def render_pairs(pairs: list[tuple[str, object]]) -> str:
    width = max((len(k) for k, _ in pairs), default=0)
    return "\n".join(f"{k.ljust(width)}  {v}" for k, v in pairs)


def render_bars(pairs: list[tuple[str, float]], width: int = 30) -> str:
    """Labels with bars in proportion to the largest value."""
    from tidemark.functions.scalars import bar

    most, label = max([v for _, v in pairs], default=0) or 1, max([len(k) for k, _ in pairs], default=0)
    return "\n".join(f"{k.ljust(label)}  {bar(v / most, width)}  {v:g}" for k, v in pairs)


def summarise(run, tasks: list) -> str:
    """One run in words: its state, and a line for each task."""
    counts = {s: sum(t.state == s for t in tasks) for s in TASK_STATES}
    head = [("run", run.run_id), ("workflow", run.workflow), ("state", run.state), ("tasks", ", ".join(f"{n} {s}" for s, n in counts.items() if n) or "none")]
    rows = [[t.task, t.state, t.attempts, None if t.duration is None else f"{t.duration:.3f}s", t.skip_reason or ""] for t in sorted(tasks, key=lambda t: t.pos)]
    return render_pairs(head) + "\n\n" + render_table(["task", "state", "attempts", "duration", "detail"], rows)
