"""Logs: reading, checks, replay, sinks and streams on small runs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.schema import EVENT, RUN_MOVES
from tidemark.operators import metrics, replay, runquery
from tidemark.sinks import store
from tidemark.sources import event_log
from tidemark.streaming import replay as streaming

SMALL = [
    ("r1", 0, 100.0, "run_started", None, None, {"workflow": "nightly", "params": {"day": "x"}, "tasks": ["a", "b"]}),
    ("r1", 1, 100.0, "task_scheduled", "a", None, None),
    ("r1", 2, 100.0, "task_started", "a", 1, None),
    ("r1", 3, 102.0, "task_succeeded", "a", 1, {"result": {"rows": 5}, "elapsed": 2.0}),
    ("r1", 4, 102.0, "task_skipped", "b", None, {"reason": "condition false"}),
    ("r1", 5, 102.0, "run_finished", None, None, {"state": "succeeded"}),
]


def log(spark, rows):
    return spark.createDataFrame([(*r[:6], None if r[6] is None else json.dumps(r[6])) for r in rows], EVENT)


def run(*kinds, run_id="r9"):
    return [(run_id, n, 10.0 * n, k, None if k.startswith("run_") else "a", a, p) for n, (k, a, p) in enumerate(kinds)]


def test_small_run(spark):
    events = log(spark, SMALL)
    tasks = {r.task: r for r in replay.replay_tasks(events).collect()}
    assert [tasks[n].pos for n in "ab"] == [0, 1] and tasks["a"].attempts == 1 and tasks["a"].duration == 2.0 and json.loads(tasks["a"].result) == {"rows": 5}
    assert tasks["b"].state == "skipped" and tasks["b"].skip_reason == "condition false" and tasks["b"].duration is None
    r = replay.replay_runs(events).first()
    assert (r.workflow, r.state, r.duration, r.event_count, r.attempts, r.skipped) == ("nightly", "succeeded", 2.0, 6, 1, 1) and json.loads(r.params) == {"day": "x"}
    assert replay.check_log(events).count() == 0
    counts = replay.state_counts(replay.replay_tasks(events)).first()
    assert counts.skipped == 1 and counts.succeeded == 1 and counts.pending == 0


def test_retries_errors_and_conditions(spark):
    error = {"error": {"type": "E", "message": "first"}}
    rows = run(("run_started", None, {"workflow": "w", "tasks": ["a"]}), ("task_started", 1, None), ("task_retry_scheduled", 1, error), ("task_scheduled", None, None), ("task_started", 2, None),
               ("task_timed_out", 2, {"timeout": 1}), ("resource_blocked", None, {"pools": ["p"]}), ("condition_evaluated", None, {"upstream": "z", "condition": "x", "result": False}), ("task_failed", 2, {"elapsed": 1.5, "error": {}}))
    events = log(spark, rows)
    t = replay.replay_tasks(events).first()
    assert (t.attempts, t.retries, t.timed_out, t.resource_waits, t.state, t.running_seconds, t.error, t.started_at, t.finished_at) == (2, 1, True, 1, "failed", 1.5, None, 10.0, 80.0)
    assert replay.replay_runs(events).first().state == "failed"
    c = replay.conditions(events).first()
    assert (c.upstream, c.downstream, c.condition, c.result) == ("z", "a", "x", False)
    again = log(spark, rows[:4])
    assert json.loads(replay.replay_tasks(again).first().error)["message"] == "first"
    assert replay.replay_runs(log(spark, rows[:2])).first().state == "running"
    cancelled = rows[:2] + [("r9", 2, 50.0, "run_cancelled", None, None, {"reason": "stop"})]
    assert replay.replay_runs(log(spark, cancelled)).first().state == "cancelled"


@pytest.mark.parametrize(
    "rows, rule",
    [
        ([SMALL[0], SMALL[2]], "sequence"),
        (run(("run_started", None, {}), ("task_succeeded", 1, None)), "running"),
        (run(("run_started", None, {}), ("task_started", 3, None)), "attempt"),
        ([("r", 0, 1.0, "task_started", None, 1, None)], "task"),
        ([("r", 0, 1.0, "odd", "a", 1, None)], "kind"),
        ([("r", 0, 1.0, "task_scheduled", "a", 0, None)], "envelope"),
    ],
)
def test_checks(spark, rows, rule):
    assert rule in {r.rule for r in replay.check_log(log(spark, rows)).collect()}


def test_moves(spark):
    states = spark.createDataFrame([("r", 0, "pending"), ("r", 1, "running"), ("r", 2, "running"), ("r", 3, "failed"), ("r", 4, "running")], "run_id string, seq int, state string")
    assert [r.seq for r in replay.check_moves(states, RUN_MOVES, ["run_id"], "seq").collect()] == [4]


def test_lines(spark, tmp_path):
    path = str(tmp_path / "store")
    event_log.open_store(spark, path)
    with pytest.raises(FileNotFoundError):
        event_log.open_store(spark, str(tmp_path / "none"), create=False)
    lines = [json.dumps({k: v for k, v in zip(EVENT.names, r) if v is not None}, sort_keys=True) for r in SMALL]
    (tmp_path / "store" / "r1.jsonl").write_text("\n".join(lines) + "\n\n")
    events = event_log.read_events(spark, path)
    assert events.count() == 6 and [r.seq for r in event_log.read_run(spark, path, "r1").collect()] == list(range(6))
    assert event_log.has_run(events, "r1") and not event_log.has_run(events, "r2")
    assert [r.line for r in store.event_lines(events).orderBy("seq").collect()][1] == '{"at":100.0,"kind":"task_scheduled","run_id":"r1","seq":1,"task":"a"}'
    bad = ["[1]", "nonsense", '{"seq":1}', '{"seq":true,"at":1,"kind":"run_started","run_id":"x"}', '{"seq":1.5,"at":1,"kind":"run_started","run_id":"x"}', '{"seq":1,"at":"1","kind":"run_started","run_id":"x"}',
           '{"seq":1,"at":1,"kind":"no","run_id":"x"}', '{"seq":1,"at":1,"kind":"run_started","run_id":"x","attempt":true}', '{"seq":1,"at":1,"kind":"run_started","run_id":"x","payload":[]}']
    (tmp_path / "store" / "bad.jsonl").write_text("\n".join(bad) + "\n")
    assert event_log.malformed(event_log.read_lines(spark, path)).count() == len(bad)
    with pytest.raises(event_log.CorruptLog):
        event_log.read_events(spark, path)
    assert event_log.read_events(spark, path, strict=False).where("run_id = 'r1'").count() == 6
    with pytest.raises(event_log.CorruptLog):
        event_log.adopt(log(spark, SMALL), log(spark, SMALL))
    mixed = log(spark, SMALL).withColumn("file_run", F.lit("r2"))
    assert event_log.mixed_runs(mixed).count() == 6


def test_store(spark, tmp_path):
    path, events = str(tmp_path / "s"), log(spark, SMALL)
    other = events.withColumn("run_id", F.lit("r2"))
    assert store.flush(events, path) == 6 and store.flush(events.unionByName(other), path) == 6 and store.flush(other, path) == 0
    assert {(r.run_id, r.n) for r in store.load(spark, path).groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {("r1", 6), ("r2", 6)}
    store.replace(events.where("seq < 2"), path)
    assert {(r.run_id, r.n) for r in store.load(spark, path).groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {("r1", 2), ("r2", 6)}
    store.delete(spark, path, "r2")
    assert [r.run_id for r in event_log.run_ids(store.load(spark, path)).collect()] == ["r1"]
    more = store.number(events.where("seq < 2").drop("seq"), "at", start=store.load(spark, path))
    assert sorted(r.seq for r in more.collect()) == [2, 3]


def test_reports(spark):
    events = log(spark, SMALL)
    runs, tasks = replay.replay_runs(events), replay.replay_tasks(events)
    assert list(store.runs_csv(runs).first()) == ["r1", "nightly", "succeeded", "1970-01-01T00:01:40Z", "1970-01-01T00:01:42Z", "2.000000", 2, 1, 0, 1, 1]
    rows = [list(r)[:-1] for r in store.tasks_csv(tasks, runs).orderBy("pos").collect()]
    assert rows[1] == ["r1", "nightly", "b", "skipped", 0, 0, "", "1970-01-01T00:01:42Z", "", "no", "condition false"]
    body = json.loads(store.run_json(runs, tasks).first().json)
    assert [t["name"] for t in body["tasks"]] == ["a", "b"] and body["tasks"][0]["error"] is None and body["event_count"] == 6
    assert tuple(store.runs_summary(runs).first()) == (1, 1, 0)
    text = store.summarise(runs.first(), tasks.collect())
    assert "nightly" in text and "condition false" in text and "##" in store.render_bars([("a", 2.0), ("b", 1.0)])


def test_stream_equals_batch(spark, tmp_path):
    source, rows = tmp_path / "in", SMALL + [("r2", *r[1:]) for r in SMALL[:4]]
    source.mkdir()
    for n in range(0, len(rows), 3):
        text = "\n".join(json.dumps({k: v for k, v in zip(EVENT.names, (*r[:6], None if r[6] is None else json.dumps(r[6]))) if v is not None}) for r in rows[n : n + 3])
        (source / f"{n}.jsonl").write_text(text)
    stream = streaming.read_stream(spark, str(source), 1)
    q = streaming.task_snapshots(stream).writeStream.outputMode("complete").format("memory").queryName("snapshots").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = replay.task_records(log(spark, rows))
    assert sorted(map(str, spark.table("snapshots").collect())) == sorted(map(str, batch.collect()))
    seen = []
    q = streaming.flush_stream(stream, str(tmp_path / "s"), str(tmp_path / "c"), lambda b: seen.append(b.count()))
    q.awaitTermination()
    assert sum(seen) == len(rows) and store.load(spark, str(tmp_path / "s")).count() == len(rows)


def test_stream_order(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(json.dumps({"run_id": "r", "seq": s, "at": 1.0, "kind": "run_started"}) for s in (0, 1, 3)))
    q = streaming.sequence_violations(streaming.read_stream(spark, str(source))).writeStream.outputMode("append").format("memory").queryName("order").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("order").collect()] == [("r", 3, 2)]


def test_run_queries(spark):
    runs = spark.createDataFrame([("a", "w", "failed", 1.0, 5.0, 4.0, 2), ("b", "w", "succeeded", 2.0, None, None, 1), ("c", "v", "failed", None, None, None, 1), ("d", "w", "failed", 3.0, 7.0, 4.0, 2)],
                                 "run_id string, workflow string, state string, started_at double, finished_at double, duration double, tasks int")
    ids = lambda q: [r.run_id for r in q.apply(runs).collect()]
    q = runquery.RunQuery
    assert ids(q(sort="duration")) == ["a", "d", "b", "c"] and ids(q(sort="duration", descending=True)) == ["d", "a", "b", "c"]
    assert ids(q(since=2.0)) == ["b", "d"] and ids(q().in_state("failed").for_workflow("w")) == ["a", "d"] and ids(q(min_duration=4.0, limit=1)) == ["a"]
    for bad in ({"sort": "x"}, {"limit": 0}, {"since": 2.0, "until": 1.0}):
        with pytest.raises(ValueError):
            q(**bad)
    assert "workflow is w" in q(workflow="w", limit=3).describe()
    events = log(spark, SMALL).unionByName(log(spark, run(("run_started", None, {"workflow": "other"}))))
    assert [r.run_id for r in runquery.only_runs_of(events, "nightly").select("run_id").distinct().collect()] == ["r1"]
    first, rest = runquery.partition(runs, F.col("duration") > 1)
    assert first.count() == 2 and rest.count() == 2
    assert [r.run_id for r in runquery.stable_unique(runs, ["workflow"], "run_id").orderBy("run_id").collect()] == ["a", "c"]
    assert {r.workflow: r.position for r in runquery.index_map(runs, "workflow", "run_id").collect()} == {"w": 0, "v": 1}


def test_a_rewrite_that_broke_off_loses_no_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    events = spark.createDataFrame([(f"r{n}", s, float(s), "task_started", "t", None, None) for n in range(6) for s in range(3)], EVENT)
    store.append(events, path)
    count = lambda: store.load(spark, path).count()
    assert count() == 18
    live = sorted(p for p in (tmp_path / "store").iterdir() if p.name.startswith("bucket="))
    aside = tmp_path / "store__aside"
    aside.mkdir()
    live[0].rename(aside / live[0].name)  # set aside, and no new one in its place yet
    assert count() == 18 and not aside.exists()
    aside.mkdir()
    (aside / live[1].name).mkdir()  # the new one is in its place
    assert count() == 18 and not aside.exists()
    store.replace(events.where("run_id = 'r1' and seq < 1"), path)
    store.delete(spark, path, "r2")
    assert count() == 13 and not aside.exists()


def test_disorder_inside_a_batch_is_seen(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 2, 2.0), ("a", 1, 3.0), ("b", 0, 1.0), ("b", 1, 2.0)]
    spark.createDataFrame([(r, s, at, "task_started", "t", None, None) for r, s, at in rows], EVENT).coalesce(1).write.json(str(tmp_path / "in"))
    found = streaming.sequence_violations(streaming.read_stream(spark, str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("disorder").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("disorder").collect())) == [("a", 1, 3), ("a", 2, 1)]


def test_histograms_and_moments_merge(spark):
    values = [0.05, 0.5, 7.0, 50.0, 1e4]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "d double")
    parts = [frame(values[:2]), frame(values[2:]), frame([])]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(metrics.merge_histograms(*[metrics.histogram(p, "d") for p in parts]).orderBy("bucket").drop("upper")) == rows(metrics.histogram(frame(values), "d").drop("upper"))
    assert rows(metrics.merge_moments(*[metrics.moments(p, "d") for p in parts])) == rows(metrics.moments(frame(values), "d"))
    assert rows(metrics.merge_moments(metrics.moments(parts[2], "d"))) == [(0, 0.0, 0.0, 0.0, 0.0)]
