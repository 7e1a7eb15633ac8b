"""Replay: run and task snapshots from events, as one aggregation over each run.

Nearly all rules of a log are "the last one counts", "the first one counts" or a tally, so snapshots are a groupBy over
(run_id, task) with max_by and min_by on seq. Events are shuffled once, by run; partial aggregates travel, not events.
Checks return the offending rows; replay itself takes whatever it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.schema import KINDS, PAYLOAD, RUN_KINDS, TASK_STATE_OF, TASK_STATES, TERMINAL_KINDS, TERMINAL_STATES

STATE_KINDS = tuple(TASK_STATE_OF)


def _payload(events: DataFrame) -> DataFrame:
    """events with the payload's fields as columns; a table that has them as columns already is left alone."""
    if "payload" not in events.columns:
        for f in PAYLOAD.fields:
            if f.name not in events.columns:
                events = events.withColumn(f.name, F.lit(None).cast(f.dataType))
        return events
    return events.withColumn("p", F.from_json("payload", PAYLOAD)).select("*", "p.*").drop("p", "payload")


def _among(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _last(value: Column | str, when: Column) -> Column:
    return F.max_by(F.col(value) if isinstance(value, str) else value, F.when(when, F.col("seq")))


def _first(value: str, when: Column) -> Column:
    return F.min_by(F.col(value), F.when(when, F.col("seq")))


def duration(started: Column, finished: Column) -> Column:
    """Seconds between both, not below 0; null if either is null."""
    return F.when(started.isNotNull() & finished.isNotNull(), F.greatest(F.lit(0.0), finished - started))


def task_records(events: DataFrame) -> DataFrame:
    """What replay_tasks() makes of each task, without the order of tasks: one aggregation, which also runs on a stream."""
    rows = _payload(events).withColumn("declared", F.lit(None).cast("long"))
    failed_with = _among("task_failed") | (_among("task_retry_scheduled") & F.col("error").isNotNull() & ~F.col("error").isin("{}", "null"))
    state = F.create_map(*[F.lit(x) for kv in TASK_STATE_OF.items() for x in kv])
    # A declared task is a row of its own that only makes it known.
    names = rows.where(_among("run_started") & F.col("tasks").isNotNull()).select("run_id", "seq", F.posexplode("tasks").alias("declared", "task"))
    names = names.select("run_id", "task", F.col("declared").cast("long").alias("declared"), "seq")
    mentions = rows.where(~_among(*RUN_KINDS) & F.col("task").isNotNull())
    found = mentions.unionByName(names, allowMissingColumns=True)
    tasks = found.groupBy("run_id", "task").agg(
        _last("kind", _among(*STATE_KINDS)).alias("state_kind"),
        F.count_if(_among("task_started")).cast("int").alias("attempts"),
        F.count_if(_among("task_retry_scheduled")).cast("int").alias("retries"),
        _first("at", _among("task_started")).alias("started_at"),
        _last("at", _among(*TERMINAL_KINDS)).alias("finished_at"),
        _last("result", _among("task_succeeded")).alias("result"),
        _last("error", failed_with).alias("error"),
        F.coalesce(F.bool_or(_among("task_timed_out")), F.lit(False)).alias("timed_out"),
        _last("reason", _among("task_skipped", "task_upstream_failed", "task_cancelled")).alias("skip_reason"),
        F.count_if(_among("resource_blocked")).cast("int").alias("resource_waits"),
        F.coalesce(F.sum(F.when(_among("task_succeeded", "task_failed"), F.col("elapsed"))), F.lit(0.0)).alias("running_seconds"),
        F.min("declared").alias("declared"),
        F.min(F.when(F.col("kind").isNotNull(), F.col("seq"))).alias("mentioned"),
    )
    return tasks.select(
        "run_id", "task", F.coalesce(state[F.col("state_kind")], F.lit("pending")).alias("state"), "attempts", "retries", "started_at", "finished_at",
        duration(F.col("started_at"), F.col("finished_at")).alias("duration"), "result", F.when(~F.col("error").isin("{}", "null"), F.col("error")).alias("error"),
        "timed_out", "skip_reason", "resource_waits", "running_seconds", "declared", "mentioned",
    )


def replay_tasks(events: DataFrame) -> DataFrame:
    """A row for each task of each run: those that run_started declares and those that any task event names.

    pos orders a run's tasks: declared ones first, in order, then the others by first mention.
    """
    order = Window.partitionBy("run_id").orderBy(F.col("declared").asc_nulls_last(), F.col("mentioned"))
    return task_records(events).withColumn("pos", F.row_number().over(order) - 1).drop("declared", "mentioned")


def derived_state(states: Column | None = None) -> Column:
    """A run's state from its tasks' states, as an aggregate over rows with a column `state`."""
    state = states if states is not None else F.col("state")
    open_ = F.count_if(~state.isin(*TERMINAL_STATES))
    return (
        F.when(F.count(state) == 0, "succeeded")
        .when(open_ > 0, "running")
        .when(F.count_if(state.isin("failed", "upstream_failed")) > 0, "failed")
        .when(F.count_if(state == "cancelled") > 0, "cancelled")
        .otherwise("succeeded")
    )


def state_counts(tasks: DataFrame) -> DataFrame:
    """run_id and a count for each of the nine task states, zeros included."""
    return tasks.groupBy("run_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in TASK_STATES])


def replay_runs(events: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """A row for each run, with the number of its tasks, attempts, and tasks by outcome."""
    rows = _payload(events)
    run_last = _among(*RUN_KINDS)
    runs = rows.groupBy("run_id").agg(
        F.coalesce(_last("workflow", _among("run_started")), F.lit("")).alias("workflow"),
        F.coalesce(_last("params", _among("run_started")), F.lit("{}")).alias("params"),
        _last("at", _among("run_started")).alias("started_at"),
        _last("at", _among("run_finished", "run_cancelled")).alias("finished_at"),
        _last("kind", run_last).alias("last_kind"),
        _last("state", _among("run_finished")).alias("said"),
        F.count("*").alias("event_count"),
    )
    tasks = replay_tasks(events) if tasks is None else tasks
    sums = tasks.groupBy("run_id").agg(
        derived_state().alias("derived"), F.count("*").alias("tasks"), F.sum("attempts").alias("attempts"), F.sum("retries").alias("retries"),
        F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state").isin("skipped", "upstream_failed")).alias("skipped"),
    )
    joined = runs.join(sums, "run_id", "left")
    derived = F.coalesce("derived", F.lit("succeeded"))
    state = (
        F.when(F.col("last_kind") == "run_cancelled", "cancelled")
        .when(F.col("last_kind") == "run_finished", F.coalesce("said", derived))
        .when(F.col("last_kind") == "run_started", "running")
        .otherwise("pending")
    )
    # An unfinished run takes on what its tasks say if that is an end.
    adopted = F.when(state.isin("pending", "running") & F.col("derived").isin("succeeded", "failed", "cancelled"), F.col("derived")).otherwise(state)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "run_id", "workflow", "params", adopted.alias("state"), "started_at", "finished_at", duration(F.col("started_at"), F.col("finished_at")).alias("duration"), "event_count",
        *[number(c) for c in ("tasks", "attempts", "retries", "succeeded", "failed", "skipped")],
    )


def conditions(events: DataFrame) -> DataFrame:
    """run_id, seq, upstream, downstream, condition, result (null: it couldn't be evaluated)."""
    rows = _payload(events).where(_among("condition_evaluated"))
    return rows.select("run_id", "seq", "upstream", F.col("task").alias("downstream"), "condition", F.expr("try_cast(result as boolean)").alias("result"))


# Checks --------------------------------------------------------------------------------------------------------------


def _bad(rows: DataFrame, rule: str) -> DataFrame:
    return rows.select("run_id", "seq", F.lit(rule).alias("rule"))


def check_empty(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs (run_id) that have no event at all."""
    return _bad(runs.select("run_id", F.lit(None).cast("long").alias("seq")).distinct().join(events.select("run_id").distinct(), "run_id", "left_anti"), "empty")


def check_sequence(events: DataFrame) -> DataFrame:
    """Rows whose seq isn't their place in the run, from 0."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1
    return _bad(events.withColumn("nth", nth).where("seq <> nth"), "sequence")


def check_task_named(events: DataFrame) -> DataFrame:
    """Task events without a task."""
    return _bad(events.where(~_among(*RUN_KINDS) & F.col("task").isNull()), "task")


def check_attempts(events: DataFrame) -> DataFrame:
    """Starts whose attempt, if they give one, isn't the one after the last."""
    starts = events.where(_among("task_started"))
    nth = F.row_number().over(Window.partitionBy("run_id", "task").orderBy("seq"))
    return _bad(starts.withColumn("nth", nth).where((F.coalesce("attempt", F.lit(0)) != 0) & (F.col("attempt") != F.col("nth"))), "attempt")


def check_running(events: DataFrame) -> DataFrame:
    """Successes, failures and retries of a task that isn't running."""
    rows = events.where(_among(*STATE_KINDS) & F.col("task").isNotNull())
    before = F.lag("kind").over(Window.partitionBy("run_id", "task").orderBy("seq"))
    return _bad(rows.withColumn("before", before).where(_among("task_succeeded", "task_failed", "task_retry_scheduled") & ~F.col("before").eqNullSafe(F.lit("task_started"))), "running")


def check_kinds(events: DataFrame) -> DataFrame:
    """Rows of a kind that doesn't exist."""
    return _bad(events.where(~_among(*KINDS) | F.col("kind").isNull()), "kind")


def check_envelope(events: DataFrame) -> DataFrame:
    """Rows without a seq of 0 or more, a time, a run, or with an attempt below 1."""
    return _bad(events.where("seq is null or seq < 0 or at is null or isnan(at) or run_id is null or attempt < 1"), "envelope")


def check_log(events: DataFrame) -> DataFrame:
    """run_id, seq, rule: all violations."""
    checks = [check_envelope, check_kinds, check_sequence, check_task_named, check_attempts, check_running]
    found = checks[0](events)
    for c in checks[1:]:
        found = found.unionByName(c(events))
    return found


def check_moves(states: DataFrame, moves: dict[str, tuple[str, ...]], key: list[str], order: str) -> DataFrame:
    """Rows whose state may not follow the one before, by a table of legal moves; staying is legal."""
    before = F.lag("state").over(Window.partitionBy(*key).orderBy(order))
    legal = F.create_map(*[x for k, v in moves.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    rows = states.withColumn("before", before).where("before is not null and before <> state")
    return rows.where(~F.coalesce(F.array_contains(F.try_element_at(legal, F.col("before")), F.col("state")), F.lit(False)))
