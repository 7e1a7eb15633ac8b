"""Timelines of runs: places of tasks on a bar, and the busiest moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bar's mark for each state; others get the last.
MARKS = {"succeeded": "=", "failed": "!", "retry_wait": "~", "running": "*", "skipped": ".", "upstream_failed": "x", "cancelled": "/"}
OTHER = "-"


def timeline(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """A row for each task: its times, and its run's origin and span.

    The origin is the run's start, else the first start of a task, else 0; the end likewise, else the origin.
    """
    ends = tasks.groupBy("run_id").agg(F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_finish"))
    origin = F.coalesce("r_started", "first_start", F.lit(0.0))
    spans = runs.select("run_id", F.col("started_at").alias("r_started"), F.col("finished_at").alias("r_finished")).join(ends, "run_id", "left")
    spans = spans.withColumn("origin", origin).select("run_id", "origin", F.greatest(F.lit(0.0), F.coalesce("r_finished", "last_finish", "origin") - F.col("origin")).alias("span"))
    return tasks.select("run_id", "task", "pos", "state", "attempts", "started_at", "finished_at").join(spans, "run_id")


def placed() -> Column:
    return F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()


def bars(rows: DataFrame, width: int = 48) -> DataFrame:
    """rows of timeline() with bar: width characters, a mark wherever the task ran, at least one."""
    if width < 1:
        return rows.withColumn("bar", F.lit(""))

    def column(at: str) -> Column:
        where = ((F.col(at) - F.col("origin")) / F.col("span") * (width - 1)).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(width - 1), where))

    mark = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("state")), F.lit(OTHER))
    first, last = column("started_at"), F.greatest(column("started_at"), column("finished_at"))
    drawn = F.rpad(F.concat(F.repeat(F.lit(" "), first), F.repeat(mark, last - first + 1)), width, " ")
    return rows.withColumn("bar", F.when(~placed(), F.lit(" " * width)).when(F.col("span") <= 0, F.rpad(mark, width, " ")).otherwise(drawn))


def busiest_moment(rows: DataFrame, samples: int = 64) -> DataFrame:
    """run_id, at, running: of evenly spread instants that with the most tasks running, the earliest of equals.

    The first and the last instant that a task covers follow by arithmetic; one more runs from the first on, one fewer
    after the last, and a run's changes, two an instant at most, are summed up in order.
    """
    n = max(1, samples)
    instant = lambda i: F.col("origin") + F.col("span") * i / max(1, n - 1)
    near = lambda at: (F.col(at) - F.col("origin")) / F.col("span") * (n - 1)
    inside = lambda i: F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("int")
    live = rows.where(placed() & (F.col("span") > 0)).withColumns({"low": inside(F.ceil(near("started_at"))), "high": inside(F.floor(near("finished_at")))})
    # What rounding puts one instant off is put right by the instants themselves.
    low = F.when((F.col("low") > 0) & (instant(F.col("low") - 1) >= F.col("started_at")), F.col("low") - 1).when(instant(F.col("low")) < F.col("started_at"), F.col("low") + 1).otherwise(F.col("low"))
    high = F.when((F.col("high") < n - 1) & (instant(F.col("high") + 1) <= F.col("finished_at")), F.col("high") + 1).when(instant(F.col("high")) > F.col("finished_at"), F.col("high") - 1).otherwise(F.col("high"))
    spans = live.select("run_id", low.alias("low"), high.alias("high")).where("low <= high")
    one = lambda i, n: F.struct(i.alias("i"), F.lit(n).alias("change"))
    changes = spans.select("run_id", F.inline(F.array(one(F.col("low"), 1), one(F.col("high") + 1, -1)))).groupBy("run_id", "i").agg(F.sum("change").alias("change"))
    counted = changes.select("run_id", "i", F.sum("change").over(Window.partitionBy("run_id").orderBy("i")).alias("running"))
    best = counted.groupBy("run_id").agg(F.max(F.struct("running", (-F.col("i")).alias("k"))).alias("b"))
    runs = rows.groupBy("run_id").agg(F.first("origin").alias("origin"), F.first("span").alias("span"), F.count_if(placed()).alias("placed"))
    joined = runs.join(best, "run_id", "left")
    i = F.coalesce(-F.col("b.k"), F.lit(0))
    flat = F.col("span") <= 0
    return joined.select("run_id", F.when(flat, F.col("origin")).otherwise(instant(i)).alias("at"), F.when(flat, F.col("placed")).otherwise(F.coalesce("b.running", F.lit(0))).cast("long").alias("running"))


def legend(rows: list) -> str:
    """What the marks of collected rows of timeline() mean."""
    used = sorted({r.state for r in rows if r.started_at is not None and r.finished_at is not None})
    return "  ".join(f"{MARKS.get(s, OTHER)} {s}" for s in used)


def ruler(origin: float, span: float) -> str:
    """The line above a drawn timeline: its ends and its length."""
    from tidemark.functions.scalars import format_duration, iso_text

    return f"{iso_text(origin)} .. {iso_text(origin + span)} ({format_duration(span)})"
