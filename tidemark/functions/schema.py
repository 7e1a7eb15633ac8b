"""Schemas, kinds and states of run logs."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of events, states of tasks and runs, in their order of declaration.
RUN_KINDS = ("run_started", "run_finished", "run_cancelled")
TASK_KINDS = (
    "task_scheduled", "task_started", "task_succeeded", "task_failed", "task_retry_scheduled", "task_timed_out", "task_skipped",
    "task_upstream_failed", "task_cancelled", "condition_evaluated", "resource_acquired", "resource_released", "resource_blocked",
)
KINDS = RUN_KINDS + TASK_KINDS
TERMINAL_KINDS = ("task_succeeded", "task_failed", "task_skipped", "task_upstream_failed", "task_cancelled")
TASK_STATES = ("pending", "ready", "running", "retry_wait", "succeeded", "failed", "skipped", "upstream_failed", "cancelled")
TERMINAL_STATES = ("succeeded", "failed", "skipped", "upstream_failed", "cancelled")
RUN_STATES = ("pending", "running", "succeeded", "failed", "cancelled")

#: The state that an event of a kind puts its task or run in.
TASK_STATE_OF = {
    "task_scheduled": "ready", "task_started": "running", "task_succeeded": "succeeded", "task_failed": "failed",
    "task_retry_scheduled": "retry_wait", "task_skipped": "skipped", "task_upstream_failed": "upstream_failed", "task_cancelled": "cancelled",
}

#: Legal successors of a state; staying in a state is legal too.
TASK_MOVES = {
    "pending": ("ready", "skipped", "upstream_failed", "cancelled"),
    "ready": ("running", "skipped", "cancelled"),
    "running": ("succeeded", "failed", "retry_wait", "cancelled"),
    "retry_wait": ("ready", "cancelled"),
}
RUN_MOVES = {"pending": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled")}

EVENT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("at", T.DoubleType()),
    T.StructField("kind", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])

#: The payload's fields that replay reads; nested values stay JSON text.
PAYLOAD = T.StructType([
    T.StructField("workflow", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("tasks", T.ArrayType(T.StringType())),
    T.StructField("state", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed", T.DoubleType()),
    T.StructField("upstream", T.StringType()),
    T.StructField("condition", T.StringType()),
])
