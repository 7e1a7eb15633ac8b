"""The queries of the run-log engine and their SQL, by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr, scalars
from tidemark.functions.schema import TASK_MOVES, TASK_STATES
from tidemark.operators import graph, metrics, policy, replay, runquery, schedule, timeline
from tidemark.plans import views
from tidemark.plans.views import EVENTS_SQL, RUNS_SQL, TASKS_SQL
from tidemark.sinks import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with the SQL for the same rows."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, _quoted(sql)
        return fn

    return add


def _quoted(sql: str) -> str:
    """The column "at" is a keyword there."""
    return re.sub(r'(?<![\w"])at(?![\w"])', '"at"', sql)


# Events --------------------------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT run_id, seq, at, kind, task FROM ev WHERE kind IN ('task_started', 'task_failed')")
def events_of_kind(spark, d):
    return runquery.of_kind(views.events(spark, d), "task_started", "task_failed").select("run_id", "seq", "at", "kind", "task")


@query(f"WITH {EVENTS_SQL} SELECT run_id, seq, at, kind FROM ev WHERE task = 'k7' AND seq >= 10")
def events_for_task_since(spark, d):
    return runquery.since(runquery.for_task(views.events(spark, d), "k7"), 10).select("run_id", "seq", "at", "kind")


@query(f"WITH {EVENTS_SQL} SELECT run_id, seq, kind FROM ev WHERE task = 'k3' AND kind IN ('task_failed', 'task_succeeded')")
def events_matching(spark, d):
    return runquery.matching(views.events(spark, d), "k3", ("task_failed", "task_succeeded")).select("run_id", "seq", "kind")


@query(f"WITH {EVENTS_SQL} SELECT run_id, arg_min(at, seq) AS first_at, arg_max(at, seq) AS last_at FROM ev GROUP BY run_id")
def events_span(spark, d):
    return runquery.span(views.events(spark, d))


@query(f"WITH {EVENTS_SQL} SELECT run_id, min(seq) AS first_seq, arg_min(kind, seq) AS first_kind, max(seq) AS last_seq, arg_max(kind, seq) AS last_kind FROM ev GROUP BY run_id")
def events_first_last(spark, d):
    return runquery.ends(views.events(spark, d))


@query(f"WITH {EVENTS_SQL}, m AS (SELECT run_id, task, min(seq) AS s FROM ev WHERE task IS NOT NULL GROUP BY ALL) SELECT run_id, task, CAST(row_number() OVER (PARTITION BY run_id ORDER BY s) - 1 AS INTEGER) AS pos FROM m")
def events_first_mention(spark, d):
    return runquery.first_mentions(views.events(spark, d))


@query(f"WITH {EVENTS_SQL} SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def events_by_kind(spark, d):
    return metrics.tally(views.events(spark, d), "kind")


@query(f"WITH {EVENTS_SQL} SELECT at, run_id, seq, kind FROM ev WHERE kind IN ('task_started', 'resource_blocked') ORDER BY at, run_id, seq")
def merge_logs_order(spark, d):
    e = views.events(spark, d).select("at", "run_id", "seq", "kind")
    return runquery.merge_logs(runquery.of_kind(e, "task_started"), runquery.of_kind(e, "resource_blocked"))


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT run_id FROM ev ORDER BY run_id")
def run_ids(spark, d):
    from tidemark.sources.event_log import run_ids as listed

    return listed(views.events(spark, d))


@query(f"""WITH {EVENTS_SQL}, j AS (SELECT run_id, seq, '{{"at":' || CAST(CAST(at AS BIGINT) AS VARCHAR) || ',"kind":"' || kind || '","run_id":"' || run_id || '","seq":' || seq || ',"task":"' || task || '"}}' AS line FROM ev)
SELECT run_id, left(sha256('[' || string_agg(line, ',' ORDER BY seq) || ']'), 16) AS checksum FROM j GROUP BY run_id""")
def log_checksums(spark, d):
    e = views.events(spark, d).select("run_id", "seq", F.rint("at").cast("long").alias("at"), "kind", "task", "attempt", F.lit(None).cast("string").alias("payload"))
    return store.checksums(e)


# Replay --------------------------------------------------------------------------------------------------------------

_STATE = "CASE arg_max(kind, seq) FILTER (kind <> 'resource_blocked') WHEN 'task_scheduled' THEN 'ready' WHEN 'task_started' THEN 'running' WHEN 'task_succeeded' THEN 'succeeded' WHEN 'task_failed' THEN 'failed' ELSE 'pending' END"
REPLAY_SQL = f"""{EVENTS_SQL}, replayed AS (
  SELECT run_id, task, {_STATE} AS state, CAST(count(*) FILTER (kind = 'task_started') AS INTEGER) AS attempts, 0 AS retries, arg_min(at, seq) FILTER (kind = 'task_started') AS started_at,
         arg_max(at, seq) FILTER (kind IN ('task_succeeded', 'task_failed')) AS finished_at, arg_max(result, seq) FILTER (kind = 'task_succeeded') AS result,
         CAST(count(*) FILTER (kind = 'resource_blocked') AS INTEGER) AS resource_waits, coalesce(sum(elapsed) FILTER (kind IN ('task_succeeded', 'task_failed')), 0) AS running_seconds,
         min(seq) AS mentioned
  FROM ev WHERE task IS NOT NULL GROUP BY run_id, task),
timed AS (SELECT *, CASE WHEN started_at IS NOT NULL AND finished_at IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), finished_at - started_at) END AS duration,
                 CAST(row_number() OVER (PARTITION BY run_id ORDER BY mentioned) - 1 AS INTEGER) AS pos FROM replayed)"""


def _replayed(spark, d):
    return replay.replay_tasks(views.events(spark, d))


@query(f"WITH {REPLAY_SQL} SELECT run_id, task, pos, state, attempts, retries, started_at, finished_at, duration, result, resource_waits, running_seconds FROM timed")
def replay_tasks(spark, d):
    return _replayed(spark, d).select("run_id", "task", "pos", "state", "attempts", "retries", "started_at", "finished_at", "duration", "result", "resource_waits", "running_seconds")


@query(f"""WITH {REPLAY_SQL}, r AS (SELECT run_id, count(*) AS tasks, sum(attempts) AS attempts, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed,
 CASE WHEN count(*) FILTER (state NOT IN ('succeeded', 'failed')) > 0 THEN 'pending' WHEN count(*) FILTER (state = 'failed') > 0 THEN 'failed' ELSE 'succeeded' END AS state FROM timed GROUP BY run_id)
SELECT r.run_id, r.state, n AS event_count, r.tasks, CAST(r.attempts AS BIGINT) AS attempts, r.succeeded, r.failed FROM r JOIN (SELECT run_id, count(*) AS n FROM ev GROUP BY run_id) c ON r.run_id = c.run_id""")
def replay_runs(spark, d):
    return replay.replay_runs(views.events(spark, d)).select("run_id", "state", "event_count", "tasks", "attempts", "succeeded", "failed")


@query(f"WITH {REPLAY_SQL} SELECT run_id, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in TASK_STATES)} FROM timed GROUP BY run_id")
def replay_state_counts(spark, d):
    return replay.state_counts(_replayed(spark, d))


@query(f"WITH {EVENTS_SQL} SELECT run_id, task, seq FROM (SELECT *, lag(kind) OVER (PARTITION BY run_id, task ORDER BY seq) AS before FROM ev WHERE kind <> 'resource_blocked' AND task IS NOT NULL) WHERE kind IN ('task_succeeded', 'task_failed') AND before IS DISTINCT FROM 'task_started'")
def check_running(spark, d):
    e = views.events(spark, d)
    return replay.check_running(e).join(e.select("run_id", "seq", "task"), ["run_id", "seq"]).select("run_id", "task", "seq")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events) WHERE event_id <> nth")
def check_sequence(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"))
    return replay.check_sequence(e).select("run_id", "seq")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT run_id, task, seq, CASE kind WHEN 'task_scheduled' THEN 'ready' WHEN 'task_started' THEN 'running' WHEN 'task_succeeded' THEN 'succeeded' ELSE 'failed' END AS state
 FROM ev WHERE kind <> 'resource_blocked' AND task IS NOT NULL), b AS (SELECT *, lag(state) OVER (PARTITION BY run_id, task ORDER BY seq) AS before FROM s)
SELECT run_id, task, seq, before, state FROM b WHERE before <> state AND NOT (before = 'ready' AND state = 'running' OR before = 'running' AND state IN ('succeeded', 'failed'))""")
def check_transitions(spark, d):
    e = views.events(spark, d).where("kind <> 'resource_blocked' and task is not null")
    state = F.create_map(*[F.lit(x) for kv in {"task_scheduled": "ready", "task_started": "running", "task_succeeded": "succeeded", "task_failed": "failed"}.items() for x in kv])
    return replay.check_moves(e.select("run_id", "task", "seq", state[F.col("kind")].alias("state")), TASK_MOVES, ["run_id", "task"], "seq").select("run_id", "task", "seq", "before", "state")


# Runs ----------------------------------------------------------------------------------------------------------------


def _run_query(**spec):
    def fn(spark, d):
        needs = "contains_task" in spec or "task_state" in spec
        return runquery.RunQuery(**spec).apply(views.runs(spark, d), views.tasks(spark, d) if needs else None)

    return fn


def _register(name: str, sql: str, **spec) -> None:
    QUERIES[name], ORACLE_SQL[name] = _run_query(**spec), _quoted(sql)


_register("runquery_failed_top", f"WITH {RUNS_SQL} SELECT * FROM runs WHERE state = 'failed' ORDER BY started_at DESC NULLS LAST, run_id DESC LIMIT 20", failed_only=True, descending=True, limit=20)
_register("runquery_since_until", f"WITH {RUNS_SQL} SELECT * FROM runs WHERE started_at >= 820000000 AND started_at <= 850000000", since=820000000.0, until=850000000.0)
_register("runquery_workflow_states", f"WITH {RUNS_SQL} SELECT * FROM runs WHERE workflow = '1-URGENT' AND state IN ('succeeded', 'running')", workflow="1-URGENT", states=("succeeded", "running"), sort="run_id")
_register("runquery_longest", f"WITH {RUNS_SQL} SELECT * FROM runs ORDER BY duration DESC NULLS LAST, CASE WHEN duration IS NOT NULL THEN run_id END DESC NULLS LAST, run_id LIMIT 100", sort="duration", descending=True, limit=100)
_register("runquery_shortest", f"WITH {RUNS_SQL} SELECT * FROM runs ORDER BY duration ASC NULLS LAST, run_id LIMIT 50", sort="duration", limit=50)
_register("runquery_contains_task", f"WITH {RUNS_SQL}, {TASKS_SQL} SELECT * FROM runs WHERE run_id IN (SELECT run_id FROM tasks WHERE task = 't7')", contains_task="t7")
_register("runquery_task_state", f"WITH {RUNS_SQL}, {TASKS_SQL} SELECT * FROM runs WHERE run_id IN (SELECT run_id FROM tasks WHERE state = 'failed') AND run_id IN (SELECT run_id FROM tasks WHERE task = 't2')", task_state="failed", contains_task="t2")
_register("runquery_min_duration", f"WITH {RUNS_SQL} SELECT * FROM runs WHERE duration >= 5000000", min_duration=5e6, sort="finished")


@query(f"WITH {RUNS_SQL} SELECT run_id, workflow, tasks FROM runs WHERE tasks % 2 = 1 AND workflow LIKE '%LOW%'")
def runquery_predicate(spark, d):
    q = runquery.RunQuery().where(F.col("tasks") % 2 == 1).where(F.col("workflow").contains("LOW"))
    return q.apply(views.runs(spark, d)).select("run_id", "workflow", "tasks")


@query(f"WITH {TASKS_SQL} SELECT run_id, task, state, attempts FROM tasks WHERE state = 'failed'")
def snapshot_failures(spark, d):
    return views.tasks(spark, d).where("state = 'failed'").select("run_id", "task", "state", "attempts")


@query(f"""WITH {RUNS_SQL}, {TASKS_SQL}, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (state = 'succeeded') AS good, count(*) FILTER (state = 'failed') AS bad, count(*) FILTER (state = 'skipped') AS skips, CAST(sum(attempts) AS BIGINT) AS attempts FROM tasks GROUP BY run_id)
SELECT r.run_id, r.workflow, r.state, strftime(make_timestamp(CAST(floor(r.started_at) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS started_at, coalesce(strftime(make_timestamp(CAST(floor(r.finished_at) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '') AS finished_at,
 coalesce(printf('%.6f', r.duration), '') AS duration, coalesce(c.n, 0) AS tasks, coalesce(c.good, 0) AS succeeded, coalesce(c.bad, 0) AS failed, coalesce(c.skips, 0) AS skipped, coalesce(c.attempts, 0) AS attempts FROM runs r LEFT JOIN c ON r.run_id = c.run_id""")
def export_runs_csv(spark, d):
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = views.tasks(spark, d).groupBy("run_id").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state").isin("skipped", "upstream_failed")).alias("skipped"), F.sum("attempts").alias("attempts"),
    )
    runs = views.runs(spark, d).drop("tasks").join(counts, "run_id", "left")
    return store.runs_csv(runs.select("run_id", "workflow", "state", "started_at", "finished_at", "duration", *map(zero, ("tasks", "succeeded", "failed", "skipped", "attempts"))))


@query(f"""WITH {RUNS_SQL}, {TASKS_SQL} SELECT t.run_id, workflow, task, t.state, t.attempts, t.retries, strftime(make_timestamp(CAST(floor(t.started_at) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
 strftime(make_timestamp(CAST(floor(t.finished_at) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS finished_at, printf('%.6f', t.duration) AS duration, CASE WHEN t.attempts > 6 THEN 'yes' ELSE 'no' END AS timed_out,
 CASE WHEN t.state = 'skipped' THEN 'not needed' ELSE '' END AS detail, pos FROM tasks t JOIN runs r ON t.run_id = r.run_id""")
def export_tasks_csv(spark, d):
    t = views.tasks(spark, d).withColumns({"timed_out": F.col("attempts") > 6, "error": F.lit(None).cast("string"), "skip_reason": F.when(F.col("state") == "skipped", "not needed")})
    return store.tasks_csv(t, views.runs(spark, d))


# Metrics -------------------------------------------------------------------------------------------------------------


@query(f"WITH {RUNS_SQL} SELECT state, count(*) AS n FROM runs GROUP BY state")
def metrics_state_tally(spark, d):
    return metrics.tally(views.runs(spark, d), "state")


@query(f"WITH {TASKS_SQL} SELECT state, count(*) AS n FROM tasks GROUP BY state")
def metrics_task_states(spark, d):
    return metrics.tally(views.tasks(spark, d), "state")


@query(f"WITH {RUNS_SQL}, t AS (SELECT state, count(*) AS n FROM runs GROUP BY state) SELECT state, CAST(n AS DOUBLE) / (SELECT sum(n) FROM t) AS share FROM t")
def metrics_shares(spark, d):
    return metrics.shares(metrics.tally(views.runs(spark, d), "state"), "state")


@query(f"WITH {RUNS_SQL}, {TASKS_SQL}, t AS (SELECT sum(attempts) AS a, sum(retries) AS r FROM tasks) SELECT count(*) AS runs, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, CAST(count(*) FILTER (state = 'succeeded') AS DOUBLE) / count(*) AS success_rate, (SELECT CAST(a AS BIGINT) FROM t) AS attempts, (SELECT CAST(r AS BIGINT) FROM t) AS retries FROM runs")
def metrics_success_rate(spark, d):
    sums = views.tasks(spark, d).groupBy("run_id").agg(F.sum("attempts").alias("attempts"), F.sum("retries").alias("retries"))
    return metrics.run_summary(views.runs(spark, d).join(sums, "run_id", "left"))


@query(f"WITH {TASKS_SQL}, b(bucket, upper) AS (VALUES (0, CAST(0.1 AS DOUBLE)), (1, 1), (2, 10), (3, 60), (4, 300), (5, 3600), (6, NULL)), c AS (SELECT CASE WHEN duration <= 0.1 THEN 0 WHEN duration <= 1 THEN 1 WHEN duration <= 10 THEN 2 WHEN duration <= 60 THEN 3 WHEN duration <= 300 THEN 4 WHEN duration <= 3600 THEN 5 ELSE 6 END AS bucket, count(*) AS n FROM tasks WHERE duration IS NOT NULL AND attempts > 0 GROUP BY 1) SELECT b.bucket, upper, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bucket = c.bucket")
def metrics_histogram(spark, d):
    return metrics.histogram(metrics.ran(views.tasks(spark, d)), "duration")


@query(f"WITH {RUNS_SQL}, o AS (SELECT duration, row_number() OVER (ORDER BY duration) - 1 AS place, count(*) OVER () AS n FROM runs WHERE duration IS NOT NULL), f(fraction) AS (VALUES (CAST(0 AS DOUBLE)), (0.25), (0.5), (0.95), (1)) SELECT fraction, duration AS value FROM f JOIN o ON place = CAST(round_even(fraction * (n - 1), 0) AS BIGINT)")
def metrics_quantiles(spark, d):
    return metrics.quantiles(views.runs(spark, d), "duration", (0.0, 0.25, 0.5, 0.95, 1.0))


@query(f"WITH {RUNS_SQL} SELECT count(duration) AS count, min(duration) AS least, max(duration) AS greatest, round(avg(duration), 3) AS mean FROM runs")
def metrics_moments(spark, d):
    return metrics.moments(views.runs(spark, d), "duration").select("count", "least", "greatest", F.round("mean", 3).alias("mean"))


@query(f"WITH {TASKS_SQL} SELECT task, sum(duration) AS total FROM tasks WHERE attempts > 0 GROUP BY task ORDER BY total DESC, task LIMIT 5")
def metrics_slowest(spark, d):
    return metrics.slowest(views.tasks(spark, d))


@query(f"WITH {TASKS_SQL} SELECT task, CAST(sum(retries) AS BIGINT) AS n FROM tasks GROUP BY task HAVING sum(retries) > 0 ORDER BY n DESC, task LIMIT 5")
def metrics_flakiest(spark, d):
    return metrics.flakiest(views.tasks(spark, d))


@query(f"WITH {TASKS_SQL} SELECT task, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(resource_waits) AS BIGINT) AS waits FROM tasks GROUP BY task")
def metrics_task_tallies(spark, d):
    return metrics.task_tallies(views.tasks(spark, d))


@query(f"WITH {RUNS_SQL} SELECT workflow, count(*) AS n FROM runs GROUP BY workflow")
def metrics_merge(spark, d):
    runs = views.runs(spark, d)
    return metrics.merge_tallies(*[metrics.tally(runs.where(F.col("state") == s), "workflow") for s in ("succeeded", "failed", "running")])


@query("WITH m AS (SELECT l_orderkey AS run_id, l_returnflag AS pool, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(floor(l_quantity) AS BIGINT) AS change FROM lineitem), s AS (SELECT *, sum(change) OVER (PARTITION BY run_id, pool ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS used FROM m) SELECT run_id, pool, CAST(greatest(0, max(used)) AS BIGINT) AS peak FROM s GROUP BY ALL")
def pool_peaks(spark, d):
    from pyspark.sql import Window

    l = views.table(spark, d, "lineitem")  # noqa: E741
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    kind = F.when(F.col("l_linestatus") == "O", "resource_acquired").otherwise("resource_released")
    moves = l.select(F.col("l_orderkey").alias("run_id"), seq.alias("seq"), kind.alias("kind"), F.col("l_returnflag").alias("pool"), F.floor("l_quantity").alias("units"))
    return metrics.pool_peaks(moves).select("run_id", "pool", "peak")


# Timelines and graphs ------------------------------------------------------------------------------------------------

_SPAN_SQL = f"""{RUNS_SQL}, {TASKS_SQL}, e AS (SELECT run_id, max(finished_at) AS last FROM tasks GROUP BY run_id),
tl AS (SELECT t.run_id, t.task, t.state, t.started_at, t.finished_at, r.started_at AS origin, greatest(CAST(0 AS DOUBLE), coalesce(r.finished_at, e.last) - r.started_at) AS span FROM tasks t JOIN runs r ON t.run_id = r.run_id JOIN e ON e.run_id = t.run_id)"""


@query(f"WITH {_SPAN_SQL} SELECT run_id, task, origin, span FROM tl")
def timeline_rows(spark, d):
    return timeline.timeline(views.runs(spark, d), views.tasks(spark, d)).select("run_id", "task", "origin", "span")


@query(f"""WITH {_SPAN_SQL}, c AS (SELECT *, greatest(0, least(23, CAST(trunc((started_at - origin) / span * 23) AS INTEGER))) AS a, greatest(0, least(23, CAST(trunc((finished_at - origin) / span * 23) AS INTEGER))) AS b, CASE state WHEN 'succeeded' THEN '=' WHEN 'failed' THEN '!' ELSE '.' END AS m FROM tl WHERE span > 0)
SELECT run_id, task, rpad(repeat(' ', a) || repeat(m, greatest(a, b) - a + 1), 24, ' ') AS bar FROM c""")
def timeline_bars(spark, d):
    return timeline.bars(timeline.timeline(views.runs(spark, d), views.tasks(spark, d)).where("span > 0"), 24).select("run_id", "task", "bar")


@query(f"""WITH {_SPAN_SQL}, s AS (SELECT run_id, i, any_value(origin + span * i / CAST(63 AS DOUBLE)) AS at, count(*) FILTER (started_at <= origin + span * i / CAST(63 AS DOUBLE) AND origin + span * i / CAST(63 AS DOUBLE) <= finished_at) AS running FROM tl, range(64) AS g(i) WHERE span > 0 GROUP BY run_id, i)
SELECT run_id, at, running FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY running DESC, i) AS rn FROM s) WHERE rn = 1""")
def timeline_busiest(spark, d):
    return timeline.busiest_moment(timeline.timeline(views.runs(spark, d), views.tasks(spark, d)).where("span > 0"))


#: A definition to ask graph questions about: each line of an order depends on the two before it.
_EDGES_SQL = "edges AS (SELECT 't' || (i - k) AS up, 't' || i AS down, CAST(i * 2 + k AS INTEGER) AS pos FROM range(1, 8) AS a(i), range(1, 3) AS b(k) WHERE i - k >= 1)"
_CLOSURE_SQL = f"RECURSIVE {_EDGES_SQL}, paths AS (SELECT up, down FROM edges UNION SELECT p.up, e.down FROM paths p JOIN edges e ON p.down = e.up)"


_EDGES = [(f"t{i - k}", f"t{i}", i * 2 + k) for i in range(1, 8) for k in (1, 2) if i - k >= 1]


def _each_run_with_edges(runs: DataFrame) -> DataFrame:
    """run_id, up, down, pos: the one definition's edges for each run."""
    edges = F.array(*[F.struct(F.lit(u).alias("up"), F.lit(v).alias("down"), F.lit(p).alias("pos")) for u, v, p in _EDGES])
    return runs.select("run_id").distinct().select("run_id", F.inline(edges))


def _graph(spark):
    nodes = [(f"t{i}", i) for i in range(1, 8)]
    return spark.createDataFrame(nodes, "node string, pos int"), spark.createDataFrame(_EDGES, "up string, down string, pos int")


@query(f"WITH {_CLOSURE_SQL} SELECT up, down FROM paths")
def graph_closure(spark, d):
    return graph.closure(_graph(spark)[1])


@query(f"WITH {_CLOSURE_SQL} SELECT up AS node FROM paths WHERE down = 't5'")
def graph_ancestors(spark, d):
    return graph.ancestors(graph.closure(_graph(spark)[1]), "t5")


@query(f"WITH {_CLOSURE_SQL} SELECT down AS node FROM paths WHERE up = 't4' UNION SELECT 't4'")
def graph_reachable(spark, d):
    nodes, edges = _graph(spark)
    return graph.reachable_from(graph.closure(edges), nodes, ["t4"])


@query(f"WITH RECURSIVE {_EDGES_SQL}, walk AS (SELECT 't1' AS node, 0 AS level UNION SELECT e.down, level + 1 FROM walk JOIN edges e ON e.up = node) SELECT node, max(level) AS level FROM walk GROUP BY node")
def graph_levels(spark, d):
    return graph.levels(*_graph(spark))


@query(f"WITH {_CLOSURE_SQL} SELECT up, down, pos FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o JOIN paths p ON p.down = o.up WHERE o.down = e.down AND p.up = e.up AND o.up <> e.up)")
def graph_reduction(spark, d):
    edges = _graph(spark)[1]
    return graph.reduction(edges, graph.closure(edges))


@query(f"WITH {_EDGES_SQL} SELECT DISTINCT 'root' AS kind, up AS node FROM edges WHERE up NOT IN (SELECT down FROM edges) UNION SELECT DISTINCT 'leaf', down FROM edges WHERE down NOT IN (SELECT up FROM edges)")
def graph_ends(spark, d):
    nodes, edges = _graph(spark)
    return graph.roots(nodes, edges).select(F.lit("root").alias("kind"), "node").unionByName(graph.leaves(nodes, edges).select(F.lit("leaf").alias("kind"), "node"))


@query(f"""WITH RECURSIVE {TASKS_SQL}, {_EDGES_SQL}, best AS (SELECT t.run_id, e.down AS task, arg_max(e.up, (t.finished_at, e.up)) AS up FROM tasks t JOIN edges e ON t.task = e.up GROUP BY ALL),
walk AS (SELECT run_id, arg_max(task, (finished_at, task)) AS task, 0 AS back FROM tasks GROUP BY run_id UNION ALL SELECT w.run_id, b.up, back + 1 FROM walk w JOIN best b ON w.run_id = b.run_id AND w.task = b.task)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY back DESC) - 1 AS INTEGER) AS pos, task FROM walk""")
def critical_path(spark, d):
    return graph.critical_path(views.tasks(spark, d), _graph(spark)[1].select("up", "down"))


# Expressions ---------------------------------------------------------------------------------------------------------

#: Expressions over customer rows (name, key, balance, segment) and the same in SQL.
EXPRESSIONS = {
    "arithmetic": ("c_custkey * 2 + 1 - c_nationkey", "c_custkey * 2 + 1 - c_nationkey"),
    "division": ("c_custkey / 4", "CAST(c_custkey AS DOUBLE) / 4"),
    "floor_div": ("(c_nationkey - 10) // 3", "CAST(floor(CAST(c_nationkey - 10 AS DOUBLE) / 3) AS BIGINT)"),
    "floor_mod": ("(c_nationkey - 10) % 3", "c_nationkey - 10 - CAST(floor(CAST(c_nationkey - 10 AS DOUBLE) / 3) AS BIGINT) * 3"),
    "negative": ("-c_nationkey", "CAST(-c_nationkey AS BIGINT)"),
    "compare": ("c_acctbal > 0 and c_mktsegment <= 'F'", "c_acctbal > 0 AND c_mktsegment <= 'F'"),
    "deciding": ("c_nationkey or c_custkey", "CASE WHEN c_nationkey <> 0 THEN c_nationkey ELSE c_custkey END"),
    "negation": ("not c_nationkey", "c_nationkey = 0"),
    "coalesced": ("null ?? c_mktsegment", "c_mktsegment"),
    "equality": ("c_mktsegment == 'BUILDING' or c_nationkey != 3", "c_mktsegment = 'BUILDING' OR c_nationkey <> 3"),
    "membership": ("c_nationkey in [1, 2, 3] and 'I' in c_mktsegment", "c_nationkey IN (1, 2, 3) AND contains(c_mktsegment, 'I')"),
    "concatenation": ("c_name + '/' + c_mktsegment", "c_name || '/' || c_mktsegment"),
    "indexing": ("c_mktsegment[0] + c_mktsegment[-1]", "left(c_mktsegment, 1) || right(c_mktsegment, 1)"),
    "length": ("len(c_name)", "length(c_name)"),
    "containing": ("contains(c_mktsegment, 'E')", "contains(c_mktsegment, 'E')"),
    "list_sum": ("sum([c_nationkey, 1, 2])", "CAST(c_nationkey + 3 AS DOUBLE)"),
    "extremes": ("max([c_nationkey, 7]) - min([c_nationkey, 7])", "CAST(greatest(c_nationkey, 7) - least(c_nationkey, 7) AS BIGINT)"),
    "to_int": ("int(c_acctbal) + int('12')", "CAST(trunc(c_acctbal) AS BIGINT) + 12"),
    "to_text": ("string(c_nationkey) + string(true)", "CAST(c_nationkey AS VARCHAR) || 'true'"),
    "truth": ("bool(c_nationkey)", "c_nationkey <> 0"),
    "null_test": ("is_null(c_name)", "c_name IS NULL"),
    "joining": ("join([c_nationkey, 5], '-')", "CAST(c_nationkey AS VARCHAR) || '-5'"),
    "splitting": ("len(split(c_name, '0'))", "length(c_name) - length(replace(c_name, '0', '')) + 1"),
    "cases": ("lower(c_mktsegment) + upper('x')", "lower(c_mktsegment) || 'X'"),
    "trimming": ("trim('  ' + c_mktsegment + '\\t')", "c_mktsegment"),
    "affixes": ("starts_with(c_mktsegment, 'B') or ends_with(c_mktsegment, 'Y')", "starts_with(c_mktsegment, 'B') OR ends_with(c_mktsegment, 'Y')"),
    "replacing": ("replace(c_mktsegment, 'U', '_')", "replace(c_mktsegment, 'U', '_')"),
    "rounding": ("round(c_nationkey / 2)", "CAST(round_even(CAST(c_nationkey AS DOUBLE) / 2, 0) AS DOUBLE)"),
    "absolute": ("abs(c_nationkey - 10)", "CAST(abs(c_nationkey - 10) AS DOUBLE)"),
    "any_all": ("any([c_nationkey, 0]) and all([c_custkey, 1])", "c_nationkey <> 0 AND c_custkey <> 0"),
    "counting": ("count(c_mktsegment, 'U')", "length(c_mktsegment) - length(replace(c_mktsegment, 'U', ''))"),
    "durations": ("duration(string(c_nationkey) + 'm30s')", "CAST(c_nationkey * 60 + 30 AS DOUBLE)"),
    "list_get": ("get([10, 20, 30], c_nationkey, -1)", "CAST(CASE WHEN c_nationkey < 3 THEN (c_nationkey + 1) * 10 ELSE -1 END AS BIGINT)"),
    "ordered": ("sorted([c_nationkey, 5, 9])[1]", "CAST(list_sort([c_nationkey, 5, 9])[2] AS BIGINT)"),
}


def _expression(source: str):
    def fn(spark, d):
        rows = views.table(spark, d, "customer")
        found = expr.Compiler(expr.environment(rows)).compile(source)
        return rows.select("c_custkey", found.col.alias("value"))

    return fn


for _name, (_source, _sql) in EXPRESSIONS.items():
    QUERIES[f"expr_{_name}"] = _expression(_source)
    ORACLE_SQL[f"expr_{_name}"] = f"SELECT c_custkey, {_sql} AS value FROM customer"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT contains(o_orderpriority, 'LOW')")
def expr_condition_filter(spark, d):
    rows = views.table(spark, d, "orders")
    return rows.where(expr.Compiler(expr.environment(rows)).test("(o_orderstatus == 'F' or o_totalprice > 300000) and not contains(o_orderpriority, 'LOW')")).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CAST(props::JSON ->> '$.k' AS BIGINT) AS k FROM events WHERE CAST(props::JSON ->> '$.k' AS BIGINT) % 7 = 0")
def expr_payload_path(spark, d):
    rows = views.table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("results"))
    return rows.where(expr.Compiler(expr.environment(rows)).test("results.k % 7 == 0")).select("event_id", F.col("results.k").alias("k"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS compact, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, left(sha256(o_orderpriority), 8) AS hash, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM orders")
def scalar_ids(spark, d):
    at = views.epoch("o_orderdate")
    return views.table(spark, d, "orders").select("o_orderkey", scalars.compact(at).alias("compact"), scalars.iso(at).alias("iso"), scalars.short_hash(F.col("o_orderpriority")).alias("hash"), scalars.slug(F.col("o_orderpriority")).alias("slug"))


@query("WITH k AS (SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS s, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS t FROM orders) SELECT o_orderkey, s || '-' || t || '-' || lpad(CAST(row_number() OVER (PARTITION BY s, t ORDER BY o_orderkey) AS VARCHAR), 4, '0') AS run_id FROM k")
def scalar_run_ids(spark, d):
    rows = views.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", views.epoch("o_orderdate").alias("at"))
    return scalars.run_ids(rows, "o_orderpriority", "at", "o_orderkey").select("o_orderkey", "run_id")


# Schedules -----------------------------------------------------------------------------------------------------------

_T0, _T1 = 1767225600.0, 1798761600.0  # 2026
_MINUTES_SQL = f"minutes AS (SELECT make_timestamp(({int(_T0)} + i * 60) * 1000000) AS t FROM range(0, 366 * 1440) AS g(i))"
_AT_SQL = "CAST(epoch_us(t) AS DOUBLE) / CAST(1000000 AS DOUBLE)"


@query(f"WITH {_MINUTES_SQL} SELECT {_AT_SQL} AS at FROM minutes WHERE minute(t) IN (0, 15, 30, 45) AND hour(t) BETWEEN 9 AND 17 AND dayofweek(t) BETWEEN 1 AND 5 AND epoch(t) > {_T0} AND epoch(t) <= {_T1}")
def cron_expand(spark, d):
    return schedule.Cron.parse("*/15 9-17 * * mon-fri").fires(spark, _T0, _T1)


@query(f"WITH {_MINUTES_SQL} SELECT {_AT_SQL} AS at FROM minutes WHERE minute(t) = 0 AND hour(t) = 0 AND (day(t) = 1 OR dayofweek(t) = 1) AND epoch(t) > {_T0} AND epoch(t) <= {_T1}")
def cron_day_or(spark, d):
    return schedule.Cron.parse("0 0 1 * mon").fires(spark, _T0, _T1)


@query("SELECT o_orderkey, CAST(epoch(CAST(CASE WHEN dayofweek(n) = 6 THEN n + INTERVAL 2 DAY WHEN dayofweek(n) = 0 THEN n + INTERVAL 1 DAY ELSE n END AS TIMESTAMP)) AS DOUBLE) AS next FROM (SELECT o_orderkey, CASE WHEN o_orderdate < date_trunc('day', o_orderdate) + INTERVAL 9 HOUR THEN date_trunc('day', o_orderdate) + INTERVAL 9 HOUR ELSE date_trunc('day', o_orderdate) + INTERVAL 33 HOUR END AS n FROM orders)")
def cron_next(spark, d):
    cron = schedule.Cron.parse("0 9 * * mon-fri")
    return views.table(spark, d, "orders").select("o_orderkey", cron.next_fire(views.epoch("o_orderdate")).alias("next"))


@query("SELECT event_id FROM events WHERE minute(ts) % 10 = 0 AND hour(ts) BETWEEN 6 AND 20 AND month(ts) IN (1, 2, 3) AND dayofweek(ts) IN (1, 3, 5)")
def cron_matches(spark, d):
    cron = schedule.Cron.parse("*/10 6-20 * jan-mar mon,wed,fri")
    return views.table(spark, d, "events").where(cron.matches_at(views.epoch("ts"))).select("event_id")


@query("SELECT event_id, CAST(100 AS DOUBLE) + (CAST(floor((CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000 AS DOUBLE) - 100) / 900 + CAST(0.000000001 AS DOUBLE)) AS BIGINT) + 1) * CAST(900 AS DOUBLE) AS next FROM events")
def interval_next(spark, d):
    trigger = schedule.Interval("15m", anchor=100.0)
    return views.table(spark, d, "events").select("event_id", trigger.next_fire(views.epoch("ts")).alias("next"))


@query("SELECT CAST(i * 5400 + 100 AS DOUBLE) AS at FROM range(1, 50) AS g(i)")
def interval_fires(spark, d):
    return schedule.Interval(5400.0, anchor=100.0, limit=50).fires(spark, 200.0, 1e9)


_CALENDAR = schedule.Calendar.of(holidays=["1996-12-25", "1997-01-01"], windows=["09:00-17:00", "22:00-02:00"])
_OPEN_SQL = "(dayofweek(t) BETWEEN 1 AND 5 AND CAST(t AS DATE) NOT IN (DATE '1996-12-25', DATE '1997-01-01'))"


@query(f"SELECT event_id FROM (SELECT event_id, ts AS t, hour(ts) * 60 + minute(ts) AS m FROM events) WHERE {_OPEN_SQL} AND (m >= 540 AND m < 1020 OR m >= 1320 OR m < 120)")
def calendar_open(spark, d):
    return views.table(spark, d, "events").where(_CALENDAR.open_at(views.epoch("ts"))).select("event_id")


@query("""WITH o AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m FROM events), c AS (SELECT event_id, ts, m, day, k, day + CAST(k AS INTEGER) AS dd FROM o, range(0, 8) AS g(k)),
x AS (SELECT event_id, CASE WHEN k = 0 AND m >= 540 AND m < 1020 THEN CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000 AS DOUBLE) WHEN k = 0 AND m >= 1020 THEN NULL ELSE CAST(epoch(CAST(dd AS TIMESTAMP)) + 32400 AS DOUBLE) END AS at FROM c WHERE dayofweek(dd) BETWEEN 1 AND 5)
SELECT event_id, min(at) AS at FROM x GROUP BY event_id""")
def calendar_align(spark, d):
    calendar = schedule.Calendar.of(windows=["09:00-17:00"])
    return views.table(spark, d, "events").select("event_id", calendar.aligned(views.epoch("ts")).alias("at"))


@query("SELECT o_orderkey, CAST((SELECT count(*) FROM range(0, 60) AS g(i) WHERE CAST(o_orderdate AS DATE) + CAST(i AS INTEGER) < CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AND dayofweek(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)) BETWEEN 1 AND 5) AS INTEGER) AS days FROM orders")
def business_days(spark, d):
    at = views.epoch("o_orderdate")
    days = schedule.Calendar.of().business_days(at, at + (F.col("o_orderkey") % 60) * schedule.DAY)
    return views.table(spark, d, "orders").select("o_orderkey", days.alias("days"))


@query(f"WITH {_MINUTES_SQL}, f AS (SELECT {_AT_SQL} AS at, 'quarterly' AS schedule, 0 AS pos FROM minutes WHERE minute(t) % 15 = 0 AND hour(t) = 3 UNION ALL SELECT {_AT_SQL}, 'nightly', 1 FROM minutes WHERE hour(t) = 3 AND minute(t) = 0 AND dayofweek(t) BETWEEN 1 AND 5) SELECT at, schedule, pos FROM f WHERE at > {_T0} AND at <= {_T0 + 90 * 86400} ORDER BY at, pos")
def timetable_merge(spark, d):
    entries = [schedule.Entry("quarterly", "w", schedule.make_trigger("*/15 3 * * *")), schedule.Entry("nightly", "w", schedule.make_trigger("0 3 * * *"), schedule.Calendar.of())]
    return schedule.Timetable(entries).between(spark, _T0, _T0 + 90 * 86400).select("at", "schedule", "pos")


# Policies ------------------------------------------------------------------------------------------------------------

_DECIDE = {
    "all_success": "CASE WHEN bad > 0 OR unrun THEN 'skip' WHEN good = n THEN 'run' ELSE 'wait' END", "all_done": "CASE WHEN open = 0 THEN 'run' ELSE 'wait' END",
    "any_success": "CASE WHEN good > 0 THEN 'run' WHEN open = 0 THEN 'skip' ELSE 'wait' END", "any_failed": "CASE WHEN bad > 0 THEN 'run' WHEN open = 0 THEN 'skip' ELSE 'wait' END",
    "all_failed": "CASE WHEN good > 0 OR unrun THEN 'skip' WHEN bad = n THEN 'run' ELSE 'wait' END", "none_failed": "CASE WHEN bad > 0 THEN 'skip' WHEN open = 0 THEN 'run' ELSE 'wait' END",
    "always": "'run'",
}


@query(f"""WITH s AS (SELECT l_orderkey AS run_id, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'running' WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'skipped' END AS state FROM lineitem),
a AS (SELECT run_id, count(*) AS n, count(*) FILTER (state = 'succeeded') AS good, count(*) FILTER (state = 'failed') AS bad, count(*) FILTER (state = 'running') AS open, count(*) FILTER (state = 'skipped') > 0 AS unrun FROM s GROUP BY run_id)
{' UNION ALL '.join(f"SELECT run_id, '{r}' AS rule, {c} AS decision FROM a" for r, c in _DECIDE.items())}""")
def trigger_rules(spark, d):
    l = views.table(spark, d, "lineitem")  # noqa: E741
    state = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "running").when(F.col("l_returnflag") == "A", "succeeded").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped")
    rows = l.select(F.col("l_orderkey").alias("run_id"), state.alias("state"))
    grouped = rows.groupBy("run_id").agg(*[policy.rule_decision(F.lit(r), F.col("state")).alias(r) for r in policy.RULES])
    return grouped.unpivot("run_id", list(policy.RULES), "rule", "decision")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'failed' WHEN o_totalprice < 50000 THEN 'upstream_failed' WHEN o_totalprice > 200000 THEN 'succeeded' ELSE 'skipped' END AS state FROM orders")
def effective_edges(spark, d):
    up = F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    holds = F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice") > 200000)
    return views.table(spark, d, "orders").select("o_orderkey", policy.effective_state(up, F.lit(True), holds).alias("state"))


@query("SELECT n_name AS task, attempt, CAST(CASE attempt WHEN 1 THEN n_nationkey WHEN 2 THEN n_nationkey + 2 WHEN 3 THEN n_nationkey + 6 ELSE n_nationkey + 11 END AS DOUBLE) AS at FROM nation, (VALUES (1), (2), (3), (4)) AS t(attempt)")
def retry_schedule(spark, d):
    rows = views.table(spark, d, "nation").select(F.col("n_name").alias("task"), F.col("n_nationkey").cast("double").alias("start"))
    return policy.Retry(max_attempts=4, delay=2.0, max_delay=5.0).schedule(rows, "task", "start")


@query("SELECT c_custkey, CAST(CAST('0x' || left(sha256(c_name || '#' || (c_custkey % 5 + 1)), 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS jitter FROM customer")
def jitter_fraction(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", policy.jitter_fraction(F.col("c_name"), F.col("c_custkey") % 5 + 1).alias("jitter"))


@query(f"WITH {TASKS_SQL} SELECT run_id, CASE WHEN count(*) FILTER (state = 'failed') > 0 THEN 'failed' ELSE 'succeeded' END AS state FROM tasks GROUP BY run_id")
def derived_run_state(spark, d):
    return views.tasks(spark, d).groupBy("run_id").agg(replay.derived_state().alias("state"))


@query(f"""WITH {TASKS_SQL}, o AS (SELECT *, attempts % 3 AS priority, attempts % 2 + 1 AS units FROM tasks),
q AS (SELECT run_id, list({{'task': task, 'units': units}} ORDER BY priority, pos, task) AS items FROM o GROUP BY run_id),
r AS (SELECT run_id, list_reduce(list_prepend({{'free': 4, 'names': ''}}, list_transform(items, lambda x: {{'free': x.units, 'names': x.task}})), lambda a, x: CASE WHEN a.free >= x.free THEN {{'free': a.free - x.free, 'names': a.names || ' ' || x.names}} ELSE a END) AS d FROM q)
SELECT run_id, trim(d.names) AS admitted, CAST(d.free AS INTEGER) AS left_over FROM r""")
def admission(spark, d):
    t = views.tasks(spark, d).select("run_id", "task", "pos", (F.col("attempts") % 3).alias("priority"), F.create_map(F.lit("p"), (F.col("attempts") % 2 + 1).cast("int")).alias("requests"))
    out = policy.admit(t, F.create_map(F.lit("p"), F.lit(4)))
    return out.select("run_id", F.array_join("admitted", " ").alias("admitted"), F.element_at("free", F.lit("p")).alias("left_over"))


# More of the inventory -----------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(CAST(props::JSON ->> '$.k' AS BIGINT) * 3600 + event_id % 60 * 60 + 30 AS DOUBLE) AS seconds FROM events")
def scalar_durations(spark, d):
    text = F.concat(F.get_json_object("props", "$.k"), F.lit("h "), (F.col("event_id") % 60).cast("string"), F.lit("m30"))
    return views.table(spark, d, "events").select("event_id", scalars.duration_seconds(text).alias("seconds"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS DOUBLE) AS compact, CAST(epoch(o_orderdate) AS DOUBLE) AS iso FROM orders")
def scalar_parse_timestamps(spark, d):
    from tidemark.sources.event_log import parse_timestamp

    rows = views.table(spark, d, "orders").select("o_orderkey", scalars.compact(views.epoch("o_orderdate")).alias("c"), scalars.iso(views.epoch("o_orderdate")).alias("i"))
    return rows.select("o_orderkey", parse_timestamp(F.col("c")).alias("compact"), parse_timestamp(F.col("i")).alias("iso"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z][A-Za-z0-9_.-]*') AND length(p_name) <= 96 AS valid, p_brand || '::' || p_type AS qualified, p_brand AS workflow FROM part")
def scalar_names(spark, d):
    qualified = scalars.qualify(F.col("p_brand"), F.col("p_type"))
    return views.table(spark, d, "part").select("p_partkey", scalars.valid_name(F.col("p_name")).alias("valid"), qualified.alias("qualified"), scalars.split_qualified(qualified)["workflow"].alias("workflow"))


@query("SELECT event_id, CAST(epoch(CAST(min(dd) AS TIMESTAMP)) AS DOUBLE) AS next FROM (SELECT event_id, CAST(ts AS DATE) + CAST(k AS INTEGER) AS dd FROM events, range(1, 8) AS g(k)) WHERE dayofweek(dd) BETWEEN 1 AND 5 GROUP BY event_id")
def calendar_next_business_day(spark, d):
    return views.table(spark, d, "events").select("event_id", schedule.Calendar.of().next_business_at(views.epoch("ts")).alias("next"))


@query(f"WITH {_MINUTES_SQL}, f AS (SELECT {_AT_SQL} AS at, t FROM minutes WHERE minute(t) = 0 AND hour(t) % 6 = 0 AND epoch(t) > {_T0} AND epoch(t) <= {_T0 + 60 * 86400}), a AS (SELECT CASE WHEN dayofweek(t) BETWEEN 1 AND 5 AND hour(t) = 12 THEN at ELSE (SELECT min(epoch(CAST(CAST(f.t AS DATE) + CAST(k AS INTEGER) AS TIMESTAMP)) + 32400) FROM range(0, 5) AS g(k) WHERE dayofweek(CAST(f.t AS DATE) + CAST(k AS INTEGER)) BETWEEN 1 AND 5 AND epoch(CAST(CAST(f.t AS DATE) + CAST(k AS INTEGER) AS TIMESTAMP)) + 32400 >= epoch(f.t)) END AS at FROM f) SELECT DISTINCT CAST(at AS DOUBLE) AS at FROM a WHERE at <= {_T0 + 60 * 86400}")
def timetable_defer(spark, d):
    entry = schedule.Entry("e", "w", schedule.make_trigger("0 */6 * * *"), schedule.Calendar.of(windows=["09:00-17:00"]), on_closed="defer")
    return entry.fires(spark, _T0, _T0 + 60 * 86400)


@query(f"""WITH {TASKS_SQL}, {_EDGES_SQL}, s AS (SELECT r.run_id, e.down AS task, coalesce(t.state, 'pending') AS state, e.pos, e.up FROM (SELECT DISTINCT run_id FROM tasks) r, edges e LEFT JOIN tasks t ON t.task = e.up AND t.run_id = r.run_id),
a AS (SELECT run_id, task, count(*) AS n, count(*) FILTER (state = 'succeeded') AS good, count(*) FILTER (state = 'failed') AS bad, count(*) FILTER (state = 'skipped') AS skips, string_agg(up, ', ' ORDER BY pos) FILTER (state = 'pending') AS open,
 string_agg(up, ', ' ORDER BY pos) FILTER (state = 'failed') AS blamed, string_agg(up, ', ' ORDER BY pos) FILTER (state <> 'succeeded') AS unmet FROM s GROUP BY ALL)
SELECT run_id, task, CASE WHEN bad > 0 THEN 'upstream_failed' WHEN skips > 0 THEN 'skip' WHEN good = n THEN 'run' ELSE 'wait' END AS verdict,
 CASE WHEN bad > 0 THEN 'upstream ' || blamed || ' did not succeed' WHEN skips > 0 THEN 'trigger rule all_success not satisfied (' || unmet || ')' WHEN good = n THEN 'all_success' ELSE 'waiting for ' || open END AS reason FROM a""")
def task_verdicts(spark, d):
    tasks = views.tasks(spark, d)
    into = _each_run_with_edges(tasks)
    seen = into.join(tasks.select("run_id", F.col("task").alias("up"), "state"), ["run_id", "up"], "left")
    rows = seen.select("run_id", F.col("down").alias("task"), F.col("up").alias("upstream"), "pos", F.lit("all_success").alias("rule"), F.coalesce("state", F.lit("pending")).alias("effective"))
    return policy.decide(rows, ["run_id", "task"])


@query("SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'cancelled' WHEN c_custkey % 4 + 1 >= 3 THEN 'exhausted' WHEN c_mktsegment <> 'BUILDING' AND c_mktsegment <> 'MACHINERY' THEN 'not_listed' ELSE 'retry' END AS decision FROM customer")
def retry_decisions(spark, d):
    p = policy.Retry(max_attempts=3, retry_on=("BUILDING", "MACHINERY"))
    return views.table(spark, d, "customer").select("c_custkey", p.decision(F.col("c_custkey") % 4 + 1, F.array("c_mktsegment"), F.col("c_nationkey") == 7).alias("decision"))


@query(f"WITH {RUNS_SQL} SELECT run_id, CASE WHEN workflow = '5-LOW' AND state = 'failed' THEN 'succeeded' ELSE state END AS outcome FROM runs")
def failure_policies(spark, d):
    kind = F.when(F.col("workflow") == "5-LOW", "isolate").otherwise("continue")
    return views.runs(spark, d).select("run_id", policy.run_outcome(F.col("state"), kind).alias("outcome"))


@query(f"WITH {REPLAY_SQL} SELECT run_id, task, state FROM timed WHERE state NOT IN ('succeeded', 'failed')")
def cancellable_tasks(spark, d):
    return policy.cancellable(_replayed(spark, d)).select("run_id", "task", "state")


@query(f"""WITH RECURSIVE {TASKS_SQL}, {_EDGES_SQL}, st AS (SELECT run_id, task AS node, CASE state WHEN 'skipped' THEN 'pending' ELSE state END AS state FROM tasks),
hit AS (SELECT s.run_id, e.down AS node FROM st s JOIN edges e ON s.node = e.up AND s.state = 'failed' JOIN st o ON o.run_id = s.run_id AND o.node = e.down AND o.state = 'pending'
 UNION SELECT h.run_id, e.down FROM hit h JOIN edges e ON h.node = e.up JOIN st o ON o.run_id = h.run_id AND o.node = e.down AND o.state = 'pending') SELECT run_id, node FROM hit""")
def affected_by_failure(spark, d):
    states = views.tasks(spark, d).select("run_id", F.col("task").alias("node"), F.when(F.col("state") == "skipped", "pending").otherwise(F.col("state")).alias("state"))
    edges = _each_run_with_edges(states).drop("pos")
    return graph.affected(edges, states, ["run_id"])


@query(f"WITH {_EDGES_SQL} SELECT down AS node, string_agg(up, ',' ORDER BY pos) AS neighbours FROM edges GROUP BY down")
def graph_adjacency(spark, d):
    return graph.adjacency(_graph(spark)[1]).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query("SELECT i - 1 AS level, 't' || i AS tasks FROM range(1, 8) AS a(i)")
def graph_waves(spark, d):
    nodes, edges = _graph(spark)
    return graph.waves(nodes, graph.levels(nodes, edges)).select(F.col("level").cast("long").alias("level"), F.array_join("tasks", ",").alias("tasks"))


@query(f"WITH {_EDGES_SQL} SELECT up, down FROM edges WHERE up IN ('t2', 't3', 't4') AND down IN ('t2', 't3', 't4')")
def graph_subgraph(spark, d):
    nodes, edges = _graph(spark)
    return graph.subgraph(nodes, edges, nodes.where("node in ('t2', 't3', 't4')"))[1].select("up", "down")


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'O') AND p_size > 10 AND p_brand IS NOT NULL")
def task_spec_filter(spark, d):
    specs = views.table(spark, d, "part").select("p_partkey", F.filter(F.split("p_type", ""), lambda c: c != "").alias("tags"), F.create_map(F.when(F.col("p_size") > 10, "big").otherwise("small"), F.col("p_size")).alias("resources"))
    return runquery.specs_matching(specs, tag="O", pool="big").select("p_partkey")


@query(f"WITH {RUNS_SQL} SELECT count(*) AS count, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed FROM runs")
def export_summary(spark, d):
    return store.runs_summary(views.runs(spark, d))


@query(f"WITH {EVENTS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY seq) AS n FROM ev) SELECT run_id, kind, seq FROM e WHERE n = 1")
def first_of_each_kind(spark, d):
    return runquery.stable_unique(views.events(spark, d), ["run_id", "kind"], "seq").select("run_id", "kind", "seq")


# The queries over a log of all kinds and over graphs from tables register themselves here.
from tidemark.plans import stored, whole  # noqa: E402, F401
