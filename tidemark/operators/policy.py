"""Run-time rules as queries: trigger rules, edge conditions, retries, admission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.schema import TERMINAL_STATES

RULES = ("all_success", "all_done", "any_success", "any_failed", "all_failed", "none_failed", "always")
BACKOFFS = ("fixed", "linear", "exponential")


def rule_decision(rule: Column, states: Column) -> Column:
    """run, wait or skip, as an aggregate over the upstream states of a task; no upstream (no non-null state) means run."""
    n, good, bad = F.count(states), F.count_if(states == "succeeded"), F.count_if(states == "failed")
    left = F.count_if(~states.isin(*TERMINAL_STATES))
    unrun = F.count_if(states.isin("skipped", "upstream_failed", "cancelled")) > 0
    either = lambda run, skip, wait: F.when(run, "run").when(skip, "skip").otherwise("wait") if wait else F.when(skip, "skip").when(run, "run").otherwise("wait")
    return (
        F.when((n == 0) | (rule == "always"), "run")
        .when(rule == "all_done", F.when(left == 0, "run").otherwise("wait"))
        .when(rule == "all_success", either(good == n, (bad > 0) | unrun, False))
        .when(rule == "none_failed", either(left == 0, bad > 0, False))
        .when(rule == "any_success", either(good > 0, left == 0, True))
        .when(rule == "any_failed", either(bad > 0, left == 0, True))
        .when(rule == "all_failed", either(bad == n, (good > 0) | unrun, False))
        .otherwise(F.raise_error(F.lit("unknown trigger rule")))
    )


def effective_state(upstream: Column, has_condition: Column, holds: Column) -> Column:
    """What an edge passes on: a success whose condition is false counts as skipped, one whose condition failed (null) as upstream_failed."""
    judged = F.when(holds.isNull(), "upstream_failed").when(holds, "succeeded").otherwise("skipped")
    return F.when(has_condition & (upstream == "succeeded"), judged).otherwise(upstream)


def decide(edges: DataFrame, keys: list[str], rule: str = "rule", state: str = "effective", upstream: str = "upstream", pos: str = "pos") -> DataFrame:
    """keys, verdict, reason for each task from a row for each edge into it (upstream null: it has none).

    A task that can't run any more is upstream_failed if an edge passes on a failure, else skipped.
    """
    s = F.col(state)
    names = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(pos, upstream)))), lambda x: x[upstream]), ", ")
    grouped = edges.groupBy(*keys).agg(
        rule_decision(F.max(rule), s).alias("decision"), names(~s.isin(*TERMINAL_STATES)).alias("open"),
        names(s.isin("failed", "upstream_failed")).alias("blamed"), names(s != "succeeded").alias("unmet"), F.max(rule).alias("rule"), F.count(s).alias("n"),
    )
    verdict = F.when((F.col("decision") == "skip") & (F.col("blamed") != ""), "upstream_failed").otherwise(F.col("decision"))
    reason = (
        F.when(F.col("n") == 0, "no upstreams")
        .when(F.col("decision") == "run", F.col("rule"))
        .when(F.col("decision") == "wait", F.when(F.col("open") != "", F.concat(F.lit("waiting for "), "open")).otherwise("waiting"))
        .when(F.col("blamed") != "", F.concat(F.lit("upstream "), "blamed", F.lit(" did not succeed")))
        .otherwise(F.concat(F.lit("trigger rule "), "rule", F.lit(" not satisfied"), F.when(F.col("unmet") != "", F.concat(F.lit(" ("), "unmet", F.lit(")"))).otherwise("")))
    )
    return grouped.select(*keys, verdict.alias("verdict"), reason.alias("reason"))


# Retries -------------------------------------------------------------------------------------------------------------


def jitter_fraction(key: Column, attempt: Column) -> Column:
    """A number in [0, 1) that key and attempt fix."""
    digest = F.sha2(F.concat(key, F.lit("#"), attempt.cast("string")), 256)
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 1
    backoff: str = "exponential"
    delay: float = 1.0
    multiplier: float = 2.0
    max_delay: float | None = None
    jitter: float = 0.0
    retry_on: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.max_attempts < 1 or self.backoff not in BACKOFFS or self.delay < 0 or not 0 <= self.jitter <= 1:
            raise ValueError("not a retry policy")

    def delay_after(self, attempt: Column, key: Column) -> Column:
        """Seconds between an attempt and the next."""
        grown = {"fixed": F.lit(1.0), "linear": attempt.cast("double"), "exponential": F.pow(F.lit(float(self.multiplier)), attempt - 1)}[self.backoff]
        found = F.lit(float(self.delay)) * grown
        if self.max_delay is not None:
            found = F.least(found, F.lit(float(self.max_delay)))
        if self.jitter:
            found = found * (F.lit(1.0) - F.lit(float(self.jitter)) * jitter_fraction(key, attempt))
        return F.greatest(F.lit(0.0), found)

    def schedule(self, tasks: DataFrame, key: str, start: str) -> DataFrame:
        """key, attempt, at: when each attempt starts if all before it fail at once."""
        rows = tasks.select(key, start, F.explode(F.sequence(F.lit(1), F.lit(self.max_attempts))).alias("attempt"))
        waited = F.when(F.col("attempt") > 1, self.delay_after(F.col("attempt") - 1, F.col(key))).otherwise(0.0)
        order = Window.partitionBy(key, start).orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("wait", waited).select(key, "attempt", (F.col(start) + F.sum("wait").over(order)).alias("at"))

    def decision(self, attempt: Column, classes: Column, cancelled: Column) -> Column:
        """retry, cancelled, exhausted or not_listed; classes are the error's class and its bases (null: unknown)."""
        listed = F.lit(True) if not self.retry_on else F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, self.retry_on))), F.lit(True))
        return F.when(cancelled, "cancelled").when(attempt >= self.max_attempts, "exhausted").when(~listed, "not_listed").otherwise("retry")


# Admission -----------------------------------------------------------------------------------------------------------


def order_tasks(tasks: DataFrame) -> DataFrame:
    """By priority (the lower first), then declaration, then name."""
    return tasks.orderBy("priority", "pos", "task")


def admit(tasks: DataFrame, free: Column, in_flight: Column | int = 0, most: int | None = None, key: str = "run_id") -> DataFrame:
    """key, admitted (names), blocked (name and the pools that are short, or "parallelism"), free (what is left of each pool).

    tasks has a row for each eligible task: priority, pos, task, requests (map of pool to units). A task that doesn't fit
    is passed over for the next. free is each run's map of pool to units, as an expression over its rows.
    """
    fields = F.struct("priority", "pos", "task", F.map_entries("requests").alias("requests"))
    runs = tasks.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("queue"), F.first(free, ignorenulls=True).alias("pools"))
    start = F.struct(
        F.col("pools").alias("free"), F.array().cast("array<string>").alias("admitted"),
        F.array().cast("array<struct<task:string,short:array<string>>>").alias("blocked"), (F.lit(in_flight) if isinstance(in_flight, int) else in_flight).cast("int").alias("n"),
    )

    def step(acc: Column, t: Column) -> Column:
        lacking = F.transform(F.filter(t["requests"], lambda r: F.coalesce(F.try_element_at(acc["free"], r["key"]), F.lit(0)) < r["value"]), lambda r: r["key"])
        full = F.lit(False) if most is None else acc["n"] >= most
        short = F.when(full, F.array(F.lit("parallelism"))).otherwise(lacking)
        fits = F.size(short) == 0
        asked = F.map_from_entries(t["requests"])
        left = F.transform_values(acc["free"], lambda k, v: v - F.coalesce(F.try_element_at(asked, k), F.lit(0)))
        return F.struct(
            F.when(fits, left).otherwise(acc["free"]).alias("free"),
            F.when(fits, F.concat(acc["admitted"], F.array(t["task"]))).otherwise(acc["admitted"]).alias("admitted"),
            F.when(fits, acc["blocked"]).otherwise(F.concat(acc["blocked"], F.array(F.struct(t["task"].alias("task"), short.alias("short"))))).alias("blocked"),
            (acc["n"] + fits.cast("int")).alias("n"),
        )

    done = F.aggregate("queue", start, step)
    return runs.select(key, done.alias("d")).select(key, "d.admitted", "d.blocked", "d.free")


def run_outcome(state: Column, failure_policy: Column) -> Column:
    """A run's state under its failure policy: isolate turns a failure into a success."""
    return F.when((failure_policy == "isolate") & (state == "failed"), "succeeded").otherwise(state)


def cancellable(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("state").isin(*TERMINAL_STATES))
