"""Column forms against their Python forms, the document over all runs, and the critical path of several workflows."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import dsl, errors, faults
from tidemark.functions import expr, scalars
from tidemark.operators import graph, policy, replay, schedule
from tidemark.plans.stored import whole_log
from tidemark.sinks import store

SECONDS = [0.0, 1e-6, 0.00025, 0.001, 0.0015, 0.25, 0.999, 1.0, 1.5, 7.25, 59.5, 60.0, 61.5, 3600.0, 3661.0, 86400.0, 90061.0, 604800.0, 694861.0, 1209600.0, -5.0, -90.0, -0.25]


def test_duration_columns(spark):
    rows = spark.createDataFrame([(x,) for x in SECONDS] + [(None,)], "x double")
    for precision in (1, 2, 5):
        got = {r.x: r.t for r in rows.select("x", scalars.duration_text(F.col("x"), precision).alias("t")).collect()}
        assert got == {x: scalars.format_duration(x, precision) for x in SECONDS} | {None: None}
    got = {r.x: r.t for r in rows.select("x", scalars.duration_words(F.col("x")).alias("t")).collect()}
    assert got == {x: scalars.humanize_duration(x) for x in SECONDS} | {None: None}
    with pytest.raises(ValueError):
        scalars.duration_text(F.col("x"), 0)


@pytest.mark.parametrize("limit", [None, 3])
def test_occurrence_column(spark, limit):
    trigger = schedule.Interval(0.3, anchor=1.0, limit=limit)
    values = [0.0, 0.7, 1.0, 1.3, 1.45, 1.6, 1.9, 2.2]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", trigger.occurrence_at(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == {x: trigger.occurrence(x) for x in values}


def test_runs_document(spark, sf_dir, tmp_path):
    log = whole_log(spark, sf_dir)
    runs, tasks = replay.replay_runs(log), replay.replay_tasks(log)
    store.write_runs_document(runs, tasks, str(tmp_path / "runs"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "runs").glob("part-*")))
    found = json.loads(whole)
    assert [r["run_id"] for r in found["runs"]] == sorted(r.run_id for r in runs.select("run_id").collect())
    assert found["count"] == len(found["runs"]) and found["failed"] == sum(r["state"] == "failed" for r in found["runs"])
    assert sum(len(r["tasks"]) for r in found["runs"]) == tasks.count()


def test_runs_document_without_runs(spark, sf_dir):
    log = whole_log(spark, sf_dir).where("false")
    lines = store.runs_document(replay.replay_runs(log), replay.replay_tasks(log)).orderBy("part", "run_id").collect()
    assert json.loads("".join(r.line for r in lines)) == {"count": 0, "failed": 0, "succeeded": 0, "runs": []}


def test_critical_path_by_workflow(spark):
    """Two workflows with tasks of the same names; ties by the later name; what didn't run and cycles end the way."""
    rows = [("x", "w", "a", 1.0), ("x", "w", "b", 1.0), ("x", "w", "c", 5.0), ("y", "v", "a", 9.0), ("y", "v", "b", 2.0), ("y", "v", "c", None), ("z", "w", "a", None)]
    tasks = spark.createDataFrame([(r, w, t, 0.0, f) for r, w, t, f in rows], "run_id string, workflow string, task string, started_at double, finished_at double")
    edges = spark.createDataFrame([("w", "a", "c"), ("w", "b", "c"), ("v", "b", "a"), ("v", "b", "a"), ("v", "a", "b"), ("v", "c", "b")], "workflow string, up string, down string")
    found = {}
    for r in sorted(graph.critical_path(tasks, edges).collect()):
        found.setdefault(r.run_id, []).append(r.task)
    assert found["x"] == ["b", "c"] and found["y"][-2:] == ["b", "a"] and set(found) == {"x", "y"}


def test_result_accessors(spark):
    w = dsl.Workflow("w")
    fine = w.task("fine", lambda: {"n": 2})
    bad = w.task("bad", lambda: 1 / 0, retry=policy.Retry(max_attempts=2, delay=1.0))
    fine >> bad >> w.task("after")
    clock = iter(range(1000))
    run = dsl.Engine(spark, clock=lambda: float(next(clock)), sleep=lambda s: None).run(w)
    assert run.failed and not run.succeeded and len(run) == 3 and "bad" in run and [t.name for t in run] == ["fine", "bad", "after"]
    assert run.values() == {"fine": {"n": 2}} and run.value("fine") == {"n": 2} and run["fine"].ran and run["fine"].duration > 0
    assert run["bad"].attempts == 2 and run["bad"].error_message == "division by zero" and run.first_error()["type"] == "ZeroDivisionError"
    assert run["after"].skipped and run["after"].duration is None and run.total_attempts() == 3
    assert run.counts()["failed"] == 1 and sum(run.counts().values()) == 3 and [t.name for t in run.failures()] == ["bad"]
    assert run.as_dict()["tasks"][0]["value"] == {"n": 2} and run.describe().splitlines()[2].startswith("  bad: failed in ")
    with pytest.raises(faults.RunFailed) as e:
        run.raise_for_status()
    assert e.value.as_dict()["details"]["tasks"] == ["bad"] and errors.exit_code(e.value) == errors.RUN_FAILED
    with pytest.raises(faults.UnknownTask):
        run["none"]
    with pytest.raises(faults.RunFailed):
        run.value("bad")


def test_codes():
    """Codes differ from kind to kind; families are inherited; each raising site has its kind."""
    kinds = [k for k in vars(faults).values() if isinstance(k, type) and issubclass(k, faults.Fault)]
    assert len({k.code for k in kinds}) == len(kinds) and {k.family for k in kinds} == {"definition", "execution", "storage"}

    def code(fn, *args) -> str:
        with pytest.raises(faults.Fault) as e:
            fn(*args)
        return errors.classify(e.value)[0]

    schema = {"n": {"type": "integer", "required": True, "choices": [1, "2"]}}
    assert code(scalars.bind_params, schema, {}) == "missing_parameter" and code(scalars.bind_params, schema, {"n": "x"}) == "parameter_type"
    assert code(scalars.bind_params, schema, {"n": 3}) == "parameter_error" and scalars.bind_params(schema, {"n": "2"}) == {"n": 2}
    assert code(expr.parse, "1 +") == "expression_syntax" and code(schedule.Cron.parse, "99 * * * *") == "cron_syntax"
    assert code(expr.Compiler({}).compile, "nothing") == "unknown_variable" and code(expr.Compiler({}).compile, "nothing()") == "unknown_function"
    assert code(dsl.assert_valid, dsl.Workflow("w")) == "validation_failed" and code(graph.topological, ["a", "b"], {"a": ["b"], "b": ["a"]}) == "dependency_cycle"
    assert errors.classify(ValueError("x")) == ("configuration_error", "definition") and errors.exit_code(faults.UnknownRun("x")) == errors.STORAGE
