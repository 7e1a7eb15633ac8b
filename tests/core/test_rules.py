"""Policies, graphs, metrics, timelines, scalars and definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import dsl, runtime
from tidemark.functions import scalars
from tidemark.functions.schema import TASK_STATES
from tidemark.operators import graph, metrics, policy, replay, timeline


def test_trigger_rules_in_tables_and_on_the_driver(spark):
    rnd = random.Random(1)
    cases = [[rnd.choice(TASK_STATES) for _ in range(rnd.randint(1, 3))] for _ in range(150)]
    rows = spark.createDataFrame([(n, s) for n, c in enumerate(cases) for s in c], "n int, state string")
    got = rows.groupBy("n").agg(*[policy.rule_decision(F.lit(r), F.col("state")).alias(r) for r in policy.RULES]).collect()
    for r in got:
        for rule in policy.RULES:
            assert r[rule] == dsl.rule_decision_of(rule, cases[r.n]), (rule, cases[r.n])
    stated = [("all_success", ["succeeded", "upstream_failed"], "skip"), ("none_failed", ["upstream_failed", "succeeded"], "run"), ("always", ["pending"], "run"), ("any_success", ["failed"], "skip"), ("all_failed", ["failed", "failed"], "run")]
    assert all(dsl.rule_decision_of(rule, s) == want for rule, s, want in stated)


def test_decisions(spark):
    edges = spark.createDataFrame([("x", "a", 0, "all_success", "succeeded"), ("x", "b", 1, "all_success", "failed"), ("y", "a", 0, "all_success", "running"), ("z", None, None, "all_success", None), ("w", "a", 0, "all_success", "skipped")],
                                  "task string, upstream string, pos int, rule string, effective string")
    got = {r.task: (r.verdict, r.reason) for r in policy.decide(edges, ["task"]).collect()}
    assert got == {"x": ("upstream_failed", "upstream b did not succeed"), "y": ("wait", "waiting for a"), "z": ("run", "no upstreams"), "w": ("skip", "trigger rule all_success not satisfied (a)")}


def test_retries(spark):
    rows = spark.createDataFrame([("t", 0.0)], "task string, start double")
    assert [r["at"] for r in policy.Retry(max_attempts=3).schedule(rows, "task", "start").orderBy("attempt").collect()] == [0.0, 1.0, 3.0]
    p = policy.Retry(max_attempts=5, backoff="linear", delay=2.0, max_delay=5.0, jitter=0.5, retry_on=("OSError",))
    got = spark.range(1, 5).select("id", p.delay_after(F.col("id"), F.lit("k")).alias("d")).collect()
    assert all(r.d == pytest.approx(dsl.retry_delay(p, "k", r.id)) for r in got)
    decide = lambda n, classes, stop=False: spark.range(1).select(p.decision(F.lit(n), F.array(*map(F.lit, classes)), F.lit(stop))).first()[0]
    assert [decide(1, ["OSError"]), decide(5, ["OSError"]), decide(1, ["X"]), decide(1, ["OSError"], True)] == ["retry", "exhausted", "not_listed", "cancelled"]
    assert spark.range(1).select(policy.jitter_fraction(F.lit("t"), F.lit(1))).first()[0] == 2895501271 / 2**32


def test_admission(spark):
    tasks = spark.createDataFrame([("r", 1, 0, "a", {"p": 1}), ("r", 1, 1, "b", {"p": 2}), ("r", 1, 2, "c", {"p": 1}), ("r", 0, 9, "q", {"z": 1}), ("r", 2, 3, "d", {})], "run_id string, priority int, pos int, task string, requests map<string,int>")
    got = policy.admit(tasks, F.create_map(F.lit("p"), F.lit(2))).first()
    assert got.admitted == ["a", "c", "d"] and [(b.task, b.short) for b in got.blocked] == [("q", ["z"]), ("b", ["p"])] and got.free == {"p": 0}
    assert policy.admit(tasks, F.create_map(F.lit("p"), F.lit(2)), in_flight=1, most=2).first().admitted == ["a"]
    assert [r.task for r in policy.order_tasks(tasks).collect()][:2] == ["q", "a"]


def test_graphs(spark):
    nodes = ["root", "left", "right", "join", "alone"]
    ups = {"left": ["root"], "right": ["root"], "join": ["left", "right", "root"]}
    edges = spark.createDataFrame([(u, d, i) for i, (u, d) in enumerate((u, d) for d, us in ups.items() for u in us)], "up string, down string, pos int")
    table = spark.createDataFrame([(n, i) for i, n in enumerate(nodes)], "node string, pos int")
    assert graph.topological(nodes, ups) == ["root", "left", "right", "join", "alone"] and graph.topological(list(reversed(nodes)), ups) == ["alone", "root", "right", "left", "join"]
    assert graph.find_cycle(["a", "b", "c"], {"a": ["b"], "b": ["c"], "c": ["b"]}) == ["b", "c", "b"] and graph.find_cycle(nodes, ups) is None
    with pytest.raises(ValueError):
        graph.topological(["a", "b"], {"a": ["b"], "b": ["a"]})
    assert {r.node: r.level for r in graph.levels(table, edges).collect()} == {"root": 0, "alone": 0, "left": 1, "right": 1, "join": 2}
    assert graph.longest_path(graph.levels(table, edges)).first()[0] == 2
    with pytest.raises(ValueError):
        graph.levels(table, edges.unionByName(spark.createDataFrame([("join", "root", 9)], edges.schema)))
    closed = graph.closure(edges)
    assert {(r.up, r.down) for r in graph.reduction(edges, closed).collect()} == {("root", "left"), ("root", "right"), ("left", "join"), ("right", "join")}
    assert {r.node for r in graph.ancestors(closed, "join").collect()} == {"root", "left", "right"} and {r.node for r in graph.descendants(closed, "left").collect()} == {"join"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "up string, down string")
    assert graph.closure(loop).count() == 4
    assert {r.level: r.tasks for r in graph.waves(table, graph.levels(table, edges)).collect()} == {0: ["root", "alone"], 1: ["left", "right"], 2: ["join"]}
    states = spark.createDataFrame([("root", "failed"), ("left", "pending"), ("right", "skipped"), ("join", "pending")], "node string, state string")
    assert {r.node for r in graph.affected(edges, states).collect()} == {"left", "join"}
    assert {r.node: r.neighbours for r in graph.adjacency(edges).collect()}["join"] == ["left", "right", "root"]
    inner, kept = graph.subgraph(table, edges, table.where("node in ('root', 'left')"))
    assert inner.count() == 2 and kept.count() == 1
    assert graph.clean(table, edges.unionByName(spark.createDataFrame([("x", "left", 9)], edges.schema))).count() == 5
    assert graph.prefixed(table, edges, "w")[0].first().node.startswith("w.")


def test_metrics(spark):
    values = spark.createDataFrame([(v,) for v in (0.05, 0.5, 5.0, 50.0, 500.0, 5000.0)], "v double")
    assert [r.n for r in metrics.histogram(values, "v").orderBy("bucket").collect()] == [1, 1, 1, 1, 0, 1, 1]
    four = spark.createDataFrame([(v,) for v in (4.0, 1.0, 3.0, 2.0, None)], "v double")
    assert [r.value for r in metrics.quantiles(four, "v", (0.0, 0.5, 1.0)).orderBy("fraction").collect()] == [1.0, 3.0, 4.0]
    assert tuple(metrics.moments(four, "v").first()) == (4, 10.0, 2.5, 1.0, 4.0) and tuple(metrics.moments(four.limit(0), "v").first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert metrics.quantiles(four.limit(0), "v", (0.5,)).first().value == 0.0
    with pytest.raises(ValueError):
        metrics.quantiles(four, "v", (1.5,))
    rnd = random.Random(3)
    many = [round(rnd.gauss(0, 1), 2) for _ in range(3001)]
    got = {r.fraction: r.value for r in metrics.quantiles(spark.createDataFrame([(v,) for v in many], "v double"), "v", (0.1, 0.5, 0.95)).collect()}
    assert got == {f: sorted(many)[round(f * 3000)] for f in got}
    t = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    assert {r.k: r.share for r in metrics.shares(t, "k").collect()} == {"a": 0.75, "b": 0.25} and metrics.shares(t.limit(0), "k").count() == 0
    assert [r.k for r in metrics.top(t.unionByName(t.replace("b", "0")), "k", 2).collect()] == ["a", "a"]


def test_timeline_and_critical_path(spark):
    tasks = spark.createDataFrame([("r", "extract", 0, "succeeded", 1, 0.0, 2.0), ("r", "transform", 1, "succeeded", 1, 2.0, 5.0), ("r", "load", 2, "failed", 1, 5.0, 10.0), ("r", "archive", 3, "skipped", 0, None, 10.0)],
                                  "run_id string, task string, pos int, state string, attempts int, started_at double, finished_at double")
    runs = spark.createDataFrame([("r", 0.0, 10.0)], "run_id string, started_at double, finished_at double")
    rows = timeline.timeline(runs, tasks)
    assert {r.task: r.bar for r in timeline.bars(rows, 11).collect()} == {"extract": "===        ", "transform": "  ====     ", "load": "     !!!!!!", "archive": " " * 11}
    assert tuple(timeline.busiest_moment(rows, 11).first()) == ("r", 2.0, 2)
    edges = spark.createDataFrame([("extract", "transform"), ("transform", "load"), ("extract", "load"), ("load", "archive")], "up string, down string")
    assert [r.task for r in graph.critical_path(tasks, edges).orderBy("pos").collect()] == ["extract", "transform", "load"]


def test_scalars(spark):
    cases = {"90s": 90.0, "1h30m": 5400.0, "-5m": -300.0, "250ms": 0.25, "1h 30m5": 5405.0, "2": 2.0, "+1.5h": 5400.0, "1w1d": 691200.0}
    assert {k: scalars.parse_duration(k) for k in cases} == pytest.approx(cases)
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", scalars.duration_seconds(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == pytest.approx({**cases, None: None})
    for bad in ("", "x", "-", "1y", "1h-2m", None):
        with pytest.raises(ValueError):
            scalars.parse_duration(bad)
    assert [scalars.format_duration(x) for x in (5400, 0.25, 0, 3661.5, -90, 0.0005, 59.5)] == ["1h30m", "250ms", "0s", "1h1m", "-1m30s", "500us", "59.5s"] and scalars.format_duration(3661.5, 3) == "1h1m1.5s"
    assert [scalars.humanize_duration(x) for x in (5400, 1, 0.5)] == ["1 hour 30 minutes", "1 second", "500 milliseconds"]
    assert scalars.canonical({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}' and scalars.json_equal({"a": 1, "b": 2}, {"b": 2, "a": 1})
    assert scalars.join_human(["a", "b", "c"]) == "a, b and c" and scalars.truncate("orchestration", 8) == "orche..." and scalars.bar(0.5, 10) == "#####....." and scalars.pluralize(2, "task") == "2 tasks"
    assert scalars.wrap("aa bb cccc d", 5) == ["aa bb", "cccc", "d"] and scalars.columnize([["a", "bb"], ["ccc", "d"]]) == ["a    bb", "ccc  d"] and scalars.indent("a\n\nb") == "  a\n\n  b"
    schema = {"n": {"type": "integer", "required": True}, "flag": {"type": "boolean", "default": "yes"}, "env": {"choices": ["dev", "prod"], "default": "dev"}}
    assert scalars.bind_params(schema, {"n": "4"}) == {"n": 4, "flag": True, "env": "dev"}
    for bad in ({}, {"n": True}, {"n": 1, "env": "x"}, {"n": 1, "more": 1}, {"n": 1.5}):
        with pytest.raises(ValueError):
            scalars.bind_params(schema, bad)
    names = spark.createDataFrame([("w::t",), ("w",), ("::t",), ("a::b::c",)], "q string").select(scalars.split_qualified(F.col("q")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in names] == [("w", "t"), None, None, None]
    ids = spark.createDataFrame([("Daily Rollup (EU)", 1772182800.0, 1), ("daily rollup eu", 1772182800.0, 2), ("--", 0.0, 3)], "w string, t double, n int")
    assert [r.run_id for r in scalars.run_ids(ids, "w", "t", "n").orderBy("n").collect()] == ["daily-rollup-eu-20260227T090000Z-0001", "daily-rollup-eu-20260227T090000Z-0002", "x-19700101T000000Z-0001"]


def etl():
    w = dsl.Workflow("etl", {"region": {"default": "eu"}})
    w.pool("wh", 1)
    a = w.task("extract", lambda: {"rows": 150})
    b = w.task("transform", lambda c: c.results["extract"]["rows"] * 2, resources={"wh": 1})
    c, d = w.task("load", lambda: None), w.task("archive", lambda: "kept")
    a >> b >> c
    a.when("results.extract.rows > 100 and params.region == 'eu'") >> d
    return w


def test_definitions(spark):
    w = etl()
    assert dsl.validate(w) == [] and w.waves() == [["extract"], ["transform", "archive"], ["load"]]
    tasks, edges, pools = w.tables(spark)
    assert tasks.count() == 4 and edges.where("condition is not null").count() == 1 and pools.first().capacity == 1
    assert set(w.subgraph(["transform"]).tasks) == {"extract", "transform"} and set(dsl.merge("m", [w]).tasks) >= {"etl.load"}
    bad = dsl.Workflow("bad")
    x, y = bad.task("x", print, resources={"none": 1}), bad.task("y", None, rule="any_failed")
    x >> y
    y >> x
    bad.pool("spare", 1)
    bad.task("big", print, resources={"spare": 2})
    bad.task("leaf", None)
    for up, down, condition in (("x", "gone", None), ("gone", "x", None), ("big", "leaf", "1 +"), ("leaf", "big", "odd(results.zzz) + params.p + wrong")):
        bad.edge(up, down, condition)
    bad.task("loner", print, rule="all_done")
    codes = {i.code for i in dsl.validate(bad)}
    assert codes == {"unknown_upstream", "unknown_downstream", "dependency_cycle", "unknown_pool", "resource_capacity", "condition_syntax", "condition_unknown_variable", "condition_unknown_function", "condition_unknown_task",
                     "condition_unknown_param", "trigger_rule_without_upstreams", "isolated_task"}
    forward = etl()
    forward.edges.append(dsl.Edge("transform", "archive", "results.load == 1"))
    assert "condition_forward_reference" in {i.code for i in dsl.validate(forward)}
    assert {i.code for i in dsl.validate(dsl.Workflow("none"))} == {"empty_workflow"}
    idle = dsl.Workflow("idle").pool("p", 1)
    idle.gate("g")
    assert {i.code for i in dsl.validate(idle)} == {"noop_leaf", "unused_pool"}
    with pytest.raises(dsl.DefinitionError):
        dsl.assert_valid(bad)


def test_runs_equal_their_replay(spark):
    now = [100.0]

    def tick():
        now[0] += 0.5
        return now[0]

    engine = dsl.Engine(spark, clock=tick, sleep=lambda s: now.__setitem__(0, now[0] + s))
    out = engine.run(etl())
    assert out.state == "succeeded" and out.results["transform"] == 300 and out.states["archive"] == "succeeded"
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return 1

    w = dsl.Workflow("shaky")
    a = w.task("a", flaky, retry=policy.Retry(max_attempts=3, delay=4.0))
    b = w.task("b", lambda: 1 / 0)
    c = w.task("c", print)
    [a, b] >> c
    w.task("d", lambda: "always", after=[b], rule="all_done")
    second = engine.run(w)
    assert second.states == {"a": "succeeded", "b": "failed", "c": "upstream_failed", "d": "succeeded"} and second.state == "failed"
    with pytest.raises(dsl.RunFailed):
        second.raise_for_status()
    for o in (out, second):
        events = o.log(spark)
        assert replay.check_log(events).count() == 0
        assert {r.task: r.state for r in replay.replay_tasks(events).collect()} == o.states and replay.replay_runs(events).first().state == o.state
    stop = dsl.Workflow("stop", failure="fail_fast")
    stop.task("x", lambda: 1 / 0, priority=1)
    stop.task("y", print) >> stop.task("z", print)
    assert engine.run(stop).states["z"] == "cancelled"


def test_clocks_tokens_and_rehearsals(spark):
    clock = runtime.ManualClock(10.0)
    late = runtime.Deadline.after(clock, 5)
    assert late.remaining == 5.0 and not late.expired and runtime.Deadline(clock).remaining is None
    clock.advance(7)
    assert late.expired and runtime.OffsetClock(3.0, clock)() == 20.0
    heard = []
    token = runtime.CancelToken()
    token.listen(heard.append)
    assert token.cancel("stop") and not token.cancel("again")
    token.listen(heard.append)
    assert heard == ["stop", "stop"]
    with pytest.raises(ValueError):
        clock.advance(-1)
    w, recorder = etl(), runtime.Recorder({"extract": {"rows": 101}, "transform": OSError("no")})
    recorder.rehearse(w)
    out = dsl.Engine(spark, clock=clock).run(w)
    assert recorder.calls == [("extract", 1), ("transform", 1), ("archive", 1)] and out.states["load"] == "upstream_failed"
    stop, engine = dsl.Workflow("stopping"), dsl.Engine(spark, clock=clock)
    stop.task("a", lambda: engine.cancel("enough")) >> stop.task("b", print)
    out = engine.run(stop)
    assert out.state == "cancelled" and out.states == {"a": "succeeded", "b": "cancelled"}
    assert replay.replay_runs(out.log(spark)).first().state == "cancelled"
