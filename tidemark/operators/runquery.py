"""Queries over run snapshots and over events."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sort keys of a run query and the columns behind them.
SORT_KEYS = {"started": "started_at", "finished": "finished_at", "duration": "duration", "workflow": "workflow", "run_id": "run_id", "tasks": "tasks"}


def sort_runs(runs: DataFrame, key: str = "started", descending: bool = False) -> DataFrame:
    """Nulls last either way; ties by run_id, which follows the direction except among nulls."""
    if key not in SORT_KEYS:
        raise ValueError(f"cannot sort by {key!r}; keys are {', '.join(sorted(SORT_KEYS))}")
    column = F.col(SORT_KEYS[key])
    if not descending:
        return runs.orderBy(column.asc_nulls_last(), F.col("run_id").asc())
    present = F.when(column.isNotNull(), F.col("run_id"))
    return runs.orderBy(column.desc_nulls_last(), present.desc_nulls_last(), F.col("run_id").asc())


@dataclass(frozen=True)
class RunQuery:
    """Filter, sort and limit over runs. Filters on tasks are semi joins with task snapshots."""

    workflow: str | None = None
    states: tuple[str, ...] = ()
    failed_only: bool = False
    since: float | None = None
    until: float | None = None
    contains_task: str | None = None
    task_state: str | None = None
    min_duration: float | None = None
    sort: str = "started"
    descending: bool = False
    limit: int | None = None
    extra: tuple[Column, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.sort not in SORT_KEYS:
            raise ValueError(f"cannot sort by {self.sort!r}")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be 1 or more")
        if self.since is not None and self.until is not None and self.until < self.since:
            raise ValueError("until must not be before since")

    def for_workflow(self, name: str) -> RunQuery:
        return replace(self, workflow=name)

    def in_state(self, *states: str) -> RunQuery:
        return replace(self, states=states)

    def where(self, predicate: Column) -> RunQuery:
        """One more condition on the run's columns."""
        return replace(self, extra=(*self.extra, predicate))

    def filter(self, runs: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
        tests = []
        if self.workflow is not None:
            tests.append(F.col("workflow") == self.workflow)
        if self.states:
            tests.append(F.col("state").isin(*self.states))
        if self.failed_only:
            tests.append(F.col("state") == "failed")
        if self.since is not None:
            tests.append(F.col("started_at") >= self.since)
        if self.until is not None:
            tests.append(F.col("started_at") <= self.until)
        if self.min_duration is not None:
            tests.append(F.col("duration") >= self.min_duration)
        if tests:
            runs = runs.where(reduce(lambda a, b: a & b, tests))
        for column, value in (("task", self.contains_task), ("state", self.task_state)):
            if value is not None:
                if tasks is None:
                    raise ValueError("this query needs task snapshots")
                runs = runs.join(tasks.where(F.col(column) == value).select("run_id"), "run_id", "left_semi")
        for predicate in self.extra:
            runs = runs.where(predicate)
        return runs

    def apply(self, runs: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
        found = sort_runs(self.filter(runs, tasks), self.sort, self.descending)
        return found if self.limit is None else found.limit(self.limit)

    def describe(self) -> str:
        said = []
        if self.workflow is not None:
            said.append(f"workflow is {self.workflow}")
        if self.states:
            said.append(f"state in {', '.join(self.states)}")
        if self.failed_only:
            said.append("failed only")
        if self.contains_task is not None:
            said.append(f"has task {self.contains_task}")
        if self.task_state is not None:
            said.append(f"has a task in state {self.task_state}")
        if self.min_duration is not None:
            said.append(f"took {self.min_duration:g}s or more")
        text = "runs where " + " and ".join(said) if said else "all runs"
        text += f", by {self.sort}" + (" descending" if self.descending else "")
        return text + (f", first {self.limit}" if self.limit is not None else "")


def only_runs_of(events: DataFrame, workflow: str) -> DataFrame:
    """Events of the runs of a workflow: the filter on what replay makes, brought below the replay as a semi join."""
    wanted = events.where((F.col("kind") == "run_started") & (F.get_json_object("payload", "$.workflow") == workflow)).select("run_id")
    return events.join(wanted, "run_id", "left_semi")


# Events --------------------------------------------------------------------------------------------------------------


def of_kind(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds))


def for_task(events: DataFrame, task: str) -> DataFrame:
    return events.where(F.col("task") == task)


def since(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("seq") >= seq)


def matching(events: DataFrame, task: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Events of a task and of one of the kinds, where given."""
    if task is not None:
        events = for_task(events, task)
    return of_kind(events, *kinds) if kinds else events


def first_mentions(events: DataFrame) -> DataFrame:
    """run_id, task, pos: each run's tasks in order of their first event."""
    first = events.where("task is not null").groupBy("run_id", "task").agg(F.min("seq").alias("seq"))
    return first.select("run_id", "task", (F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1).alias("pos"))


def span(events: DataFrame) -> DataFrame:
    """run_id, first_at, last_at: times of the first and last event by place, not the least and greatest times."""
    return events.groupBy("run_id").agg(F.min_by("at", "seq").alias("first_at"), F.max_by("at", "seq").alias("last_at"))


def ends(events: DataFrame) -> DataFrame:
    """run_id and the first and last event's kind and place."""
    return events.groupBy("run_id").agg(
        F.min("seq").alias("first_seq"), F.min_by("kind", "seq").alias("first_kind"), F.max("seq").alias("last_seq"), F.max_by("kind", "seq").alias("last_kind")
    )


def merge_logs(*logs: DataFrame) -> DataFrame:
    """All events in one order: by time, then run, then place."""
    return reduce(DataFrame.unionByName, logs).orderBy("at", "run_id", "seq")


def kinds_in_order(events: DataFrame) -> DataFrame:
    return events.orderBy("run_id", "seq").select("kind")


# Specs and sequences -------------------------------------------------------------------------------------------------


def specs_matching(specs: DataFrame, tag: str | None = None, pool: str | None = None) -> DataFrame:
    """Task specs (tags array, resources map) with a tag and that use a pool, where given."""
    if tag is not None:
        specs = specs.where(F.array_contains("tags", tag))
    return specs if pool is None else specs.where(F.map_contains_key("resources", pool))


def stable_unique(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def index_map(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key and its position among the distinct keys, by first occurrence."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    # Positions of distinct names: a definition's few, not a corpus.
    return first.select(key, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first")) - 1).alias("position"))


def partition(rows: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that don't; a null result doesn't."""
    passed = F.coalesce(predicate, F.lit(False))
    return rows.where(passed), rows.where(~passed)
