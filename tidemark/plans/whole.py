"""Queries over a log with events of all kinds, over graphs made from the tables, and over what else the tables can try."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions.schema import KINDS, PAYLOAD, RUN_KINDS, TASK_KINDS, TASK_STATE_OF, TASK_STATES, TERMINAL_KINDS
from tidemark.operators import graph, metrics, policy, replay, runquery, schedule
from tidemark.plans import views
from tidemark.plans.registry import _AT_SQL, _MINUTES_SQL, _T0, query
from tidemark.plans.views import RUNS_SQL, TASKS_SQL
from tidemark.sinks import store
from tidemark.sources import event_log

# A log of all kinds ----------------------------------------------------------------------------------------------------


def whole_log(spark: SparkSession, d: str) -> DataFrame:
    """EVENT rows of each user's events: the first starts the run, the others take their kind and payload from their id."""
    e = views.table(spark, d, "events")
    e = e.withColumn("seq", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")).withColumn("x", F.floor(F.col("event_id") / 16))
    kind = F.when(F.col("seq") == 0, "run_started").when(F.col("event_id") % 16 == 0, "task_scheduled").otherwise(F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 16).cast("int")))
    e = e.withColumn("kind", kind)
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("x") % len(values)).cast("int"))
    is_kind = lambda k: F.col("kind") == k
    fields = {
        "workflow": F.concat(F.lit("w"), F.col("event_id") % 4), "params": F.concat(F.lit('{"p":'), F.col("event_id") % 10, F.lit("}")),
        "tasks": F.when(is_kind("run_started"), F.array(F.concat(F.lit("k"), F.col("event_id") % 5), F.concat(F.lit("d"), F.col("event_id") % 3))),
        "state": pick("succeeded", "failed", "cancelled", None), "reason": F.col("event_type"),
        "result": F.when(is_kind("condition_evaluated"), pick("true", "false", "maybe")).otherwise(F.concat(F.lit("r"), "event_id")),
        "error": pick(None, "{}", '{"type":"E"}'), "elapsed": F.floor("value").cast("double"), "upstream": F.concat(F.lit("u"), F.col("x") % 6), "condition": F.concat(F.lit("c"), F.col("x") % 2),
    }
    payload = F.to_json(F.struct(*[fields[f.name].alias(f.name) for f in PAYLOAD.fields]))
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("run_id"), "seq", views.epoch("ts").alias("at"), "kind", F.when(~F.col("kind").isin(*RUN_KINDS), F.concat(F.lit("k"), F.col("x") % 7)).alias("task"),
        F.when(F.col("x") % 4 < 3, (F.col("x") % 4).cast("int")).alias("attempt"), payload.alias("payload"),
    )


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _pick(*values: str) -> str:
    return f"([{', '.join('NULL' if v is None else f"'{v}'" for v in values)}])[x % {len(values)} + 1]"


_WHOLE_SQL = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id // 16 AS x FROM events),
kinds AS (SELECT *, CASE WHEN seq = 0 THEN 'run_started' WHEN event_id % 16 = 0 THEN 'task_scheduled' ELSE ([{_listed(KINDS)}])[event_id % 16 + 1] END AS kind FROM numbered),
wl AS (SELECT 'u' || user_id AS run_id, seq, CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS at, kind, CASE WHEN kind NOT IN ({_listed(RUN_KINDS)}) THEN 'k' || (x % 7) END AS task,
  CASE WHEN x % 4 < 3 THEN x % 4 END AS attempt, 'w' || (event_id % 4) AS workflow, '{{"p":' || (event_id % 10) || '}}' AS params,
  CASE WHEN kind = 'run_started' THEN ['k' || (event_id % 5), 'd' || (event_id % 3)] END AS tasks, {_pick("succeeded", "failed", "cancelled", None)} AS state, event_type AS reason,
  CASE WHEN kind = 'condition_evaluated' THEN {_pick("true", "false", "maybe")} ELSE 'r' || event_id END AS result, {_pick(None, "{}", '{"type":"E"}')} AS error,
  CAST(floor(value) AS DOUBLE) AS elapsed, 'u' || (x % 6) AS upstream, 'c' || (x % 2) AS condition FROM kinds)"""
_STATE_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASK_STATE_OF.items())
_RECORDS_SQL = f"""{_WHOLE_SQL}, declared AS (SELECT run_id, unnest(tasks) AS task, unnest([0, 1]) AS declared FROM wl WHERE kind = 'run_started'),
found AS (SELECT run_id, task, seq, at, kind, reason, result, error, elapsed, NULL AS declared FROM wl WHERE task IS NOT NULL
  UNION ALL SELECT run_id, task, NULL, NULL, NULL, NULL, NULL, NULL, NULL, declared FROM declared),
grouped AS (SELECT run_id, task, coalesce(CASE arg_max(kind, seq) FILTER (kind IN ({_listed(TASK_STATE_OF)})) {_STATE_CASE} END, 'pending') AS state,
  CAST(count(*) FILTER (kind = 'task_started') AS INTEGER) AS attempts, CAST(count(*) FILTER (kind = 'task_retry_scheduled') AS INTEGER) AS retries,
  min(at) FILTER (kind = 'task_started') AS started_at, arg_max(at, seq) FILTER (kind IN ({_listed(TERMINAL_KINDS)})) AS finished_at, arg_max(result, seq) FILTER (kind = 'task_succeeded') AS result,
  nullif((arg_max({{'v': error}}, seq) FILTER (kind = 'task_failed' OR kind = 'task_retry_scheduled' AND error = '{{"type":"E"}}')).v, '{{}}') AS error,
  count(*) FILTER (kind = 'task_timed_out') > 0 AS timed_out, arg_max(reason, seq) FILTER (kind IN ('task_skipped', 'task_upstream_failed', 'task_cancelled')) AS skip_reason,
  CAST(count(*) FILTER (kind = 'resource_blocked') AS INTEGER) AS resource_waits, coalesce(sum(elapsed) FILTER (kind IN ('task_succeeded', 'task_failed')), 0) AS running_seconds,
  min(declared) AS declared, min(seq) AS mentioned FROM found GROUP BY run_id, task),
records AS (SELECT *, CASE WHEN started_at IS NOT NULL AND finished_at IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), finished_at - started_at) END AS duration,
  CAST(row_number() OVER (PARTITION BY run_id ORDER BY declared NULLS LAST, mentioned) - 1 AS INTEGER) AS pos FROM grouped)"""
_RECORD = ["run_id", "task", "pos", "state", "attempts", "retries", "started_at", "finished_at", "duration", "result", "error", "timed_out", "skip_reason", "resource_waits", "running_seconds"]


@query(f"WITH {_RECORDS_SQL} SELECT {', '.join(_RECORD)} FROM records")
def whole_task_records(spark, d):
    return replay.replay_tasks(whole_log(spark, d)).select(*_RECORD)


@query(f"""WITH {_RECORDS_SQL}, r AS (SELECT run_id, coalesce(arg_max(workflow, seq) FILTER (kind = 'run_started'), '') AS workflow, coalesce(arg_max(params, seq) FILTER (kind = 'run_started'), '{{}}') AS params,
  arg_max(at, seq) FILTER (kind = 'run_started') AS started_at, arg_max(at, seq) FILTER (kind IN ('run_finished', 'run_cancelled')) AS finished_at, arg_max(kind, seq) FILTER (kind IN ({_listed(RUN_KINDS)})) AS last_kind,
  (arg_max({{'v': state}}, seq) FILTER (kind = 'run_finished')).v AS said, count(*) AS event_count FROM wl GROUP BY run_id),
s AS (SELECT run_id, CASE WHEN count(*) FILTER (state IN ('pending', 'ready', 'running', 'retry_wait')) > 0 THEN 'running' WHEN count(*) FILTER (state IN ('failed', 'upstream_failed')) > 0 THEN 'failed'
  WHEN count(*) FILTER (state = 'cancelled') > 0 THEN 'cancelled' ELSE 'succeeded' END AS derived, count(*) AS tasks, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(retries) AS BIGINT) AS retries,
  count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state IN ('skipped', 'upstream_failed')) AS skipped FROM records GROUP BY run_id),
j AS (SELECT *, CASE last_kind WHEN 'run_cancelled' THEN 'cancelled' WHEN 'run_finished' THEN coalesce(said, derived) WHEN 'run_started' THEN 'running' ELSE 'pending' END AS own FROM r JOIN s USING (run_id))
SELECT run_id, workflow, params, CASE WHEN own IN ('pending', 'running') AND derived <> 'running' THEN derived ELSE own END AS state, started_at, finished_at,
  CASE WHEN finished_at IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), finished_at - started_at) END AS duration, event_count, tasks, attempts, retries, succeeded, failed, skipped FROM j""")
def whole_run_records(spark, d):
    return replay.replay_runs(whole_log(spark, d))


@query(f"WITH {_RECORDS_SQL} SELECT run_id, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in TASK_STATES)} FROM records GROUP BY run_id")
def whole_state_counts(spark, d):
    return replay.state_counts(replay.replay_tasks(whole_log(spark, d)))


@query(f"WITH {_WHOLE_SQL} SELECT run_id, seq, upstream, task AS downstream, condition, CASE result WHEN 'true' THEN true WHEN 'false' THEN false END AS result FROM wl WHERE kind = 'condition_evaluated'")
def whole_conditions(spark, d):
    return replay.conditions(whole_log(spark, d))


@query(f"WITH {_WHOLE_SQL} SELECT kind, count(*) AS n FROM wl GROUP BY kind")
def whole_by_kind(spark, d):
    return metrics.tally(whole_log(spark, d), "kind")


@query(f"WITH {_WHOLE_SQL} SELECT kind FROM wl")
def whole_kinds_in_order(spark, d):
    return runquery.kinds_in_order(whole_log(spark, d))


@query(f"""WITH {_WHOLE_SQL} SELECT run_id, seq, '{{"at":' || CAST(round_even(at, 0) AS BIGINT) || coalesce(',"attempt":' || attempt, '') || ',"kind":"' || kind || '","run_id":"' || run_id || '","seq":' || seq
  || coalesce(',"task":"' || task || '"', '') || '}}' AS line FROM wl""")
def whole_lines(spark, d):
    return store.event_lines(whole_log(spark, d).withColumns({"at": F.rint("at").cast("long"), "payload": F.lit("{}")}))


# Checks of a log, each on rows of which some break its rule --------------------------------------------------------------


@query(f"""WITH {_WHOLE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, task ORDER BY seq) AS nth FROM wl WHERE kind = 'task_started')
SELECT run_id, seq, 'attempt' AS rule FROM n WHERE attempt > 0 AND attempt <> nth""")
def whole_check_attempts(spark, d):
    return replay.check_attempts(whole_log(spark, d))


@query(f"""WITH {_WHOLE_SQL}, n AS (SELECT *, lag(kind) OVER (PARTITION BY run_id, task ORDER BY seq) AS before FROM wl WHERE kind IN ({_listed(TASK_STATE_OF)}))
SELECT run_id, seq, 'running' AS rule FROM n WHERE kind IN ('task_succeeded', 'task_failed', 'task_retry_scheduled') AND before IS DISTINCT FROM 'task_started'""")
def whole_check_running(spark, d):
    return replay.check_running(whole_log(spark, d))


@query(f"WITH {_WHOLE_SQL} SELECT run_id, seq, 'task' AS rule FROM wl WHERE kind IN ({_listed(TASK_KINDS)}) AND task = 'k3'")
def whole_check_task_named(spark, d):
    return replay.check_task_named(whole_log(spark, d).withColumn("task", F.when(F.col("task") != "k3", F.col("task"))))


@query(f"WITH {_WHOLE_SQL} SELECT run_id, seq, 'kind' AS rule FROM wl WHERE seq % 13 IN (0, 5)")
def whole_check_kinds(spark, d):
    return replay.check_kinds(whole_log(spark, d).withColumn("kind", F.when(F.col("seq") % 13 == 0, "mystery").when(F.col("seq") % 13 != 5, F.col("kind"))))


@query(f"WITH {_WHOLE_SQL} SELECT run_id, CASE seq WHEN 7 THEN NULL WHEN 9 THEN -1 ELSE seq END AS seq, 'envelope' AS rule FROM wl WHERE seq IN (7, 9) OR seq % 17 = 0 OR attempt = 0")
def whole_check_envelope(spark, d):
    bad = {"seq": F.when(F.col("seq") == 9, -1).when(F.col("seq") != 7, F.col("seq")), "at": F.when(F.col("seq") % 34 == 0, None).when(F.col("seq") % 17 == 0, float("nan")).otherwise(F.col("at"))}
    return replay.check_envelope(whole_log(spark, d).withColumns(bad))


@query("SELECT 'u' || c_custkey AS run_id, CAST(NULL AS BIGINT) AS seq, 'empty' AS rule FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def whole_check_empty(spark, d):
    return replay.check_empty(views.table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("run_id")), whole_log(spark, d))


@query(f"WITH {_WHOLE_SQL} SELECT 'u1' AS file_run, run_id, seq FROM wl WHERE seq % 5 = 2 AND run_id <> 'u1'")
def whole_mixed_runs(spark, d):
    return event_log.mixed_runs(whole_log(spark, d).withColumn("file_run", F.when(F.col("seq") % 5 == 2, "u1").otherwise(F.col("run_id"))))


# Partial metrics ---------------------------------------------------------------------------------------------------------

_BUCKETS = "b(bucket, upper) AS (VALUES (0, CAST(0.1 AS DOUBLE)), (1, 1), (2, 10), (3, 60), (4, 300), (5, 3600), (6, NULL))"
_BUCKET_OF = "CASE WHEN duration <= 0.1 THEN 0 WHEN duration <= 1 THEN 1 WHEN duration <= 10 THEN 2 WHEN duration <= 60 THEN 3 WHEN duration <= 300 THEN 4 WHEN duration <= 3600 THEN 5 ELSE 6 END"


@query(f"WITH {RUNS_SQL}, {_BUCKETS}, c AS (SELECT {_BUCKET_OF} AS bucket, count(*) AS n FROM runs WHERE duration IS NOT NULL GROUP BY 1) SELECT b.bucket, upper, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bucket = c.bucket")
def metrics_run_histogram(spark, d):
    return metrics.histogram(views.runs(spark, d), "duration")


@query(f"WITH {TASKS_SQL}, {_BUCKETS}, c AS (SELECT {_BUCKET_OF} AS bucket, count(*) AS n FROM tasks WHERE duration IS NOT NULL GROUP BY 1) SELECT b.bucket, upper, CAST(coalesce(n, 0) AS BIGINT) AS n FROM b LEFT JOIN c ON b.bucket = c.bucket")
def metrics_merge_histograms(spark, d):
    t = views.tasks(spark, d)
    return metrics.merge_histograms(*[metrics.histogram(t.where(F.col("state") == s), "duration") for s in ("succeeded", "failed", "skipped", "running")])


@query(f"WITH {TASKS_SQL} SELECT count(duration) AS count, sum(duration) AS total, sum(duration) / count(duration) AS mean, min(duration) AS least, max(duration) AS greatest FROM tasks")
def metrics_merge_moments(spark, d):
    t = views.tasks(spark, d)
    return metrics.merge_moments(*[metrics.moments(t.where(F.col("state") == s), "duration") for s in ("succeeded", "failed", "skipped", "running")])


# A graph from the tables: regions, nations, customers and suppliers, orders -----------------------------------------------

_TABLE_EDGES_SQL = """edges AS (SELECT 'R' || n_regionkey AS up, 'N' || n_nationkey AS down FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION SELECT 'S' || l_suppkey, 'O' || l_orderkey FROM lineitem
  UNION SELECT 'R' || n_regionkey, 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
nodes AS (SELECT up AS node FROM edges UNION SELECT down FROM edges)"""
_TABLE_PATHS_SQL = f"RECURSIVE {_TABLE_EDGES_SQL}, paths AS (SELECT up, down FROM edges UNION SELECT p.up, e.down FROM paths p JOIN edges e ON p.down = e.up)"
_TABLE_LEVELS_SQL = f"""RECURSIVE {_TABLE_EDGES_SQL}, walk AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT down FROM edges) UNION SELECT e.down, level + 1 FROM walk JOIN edges e ON e.up = walk.node),
  levels AS (SELECT node, max(level) AS level FROM walk GROUP BY node)"""


def _table_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = {n: views.table(spark, d, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}
    named = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    parts = [
        t["nation"].select(named("R", "n_regionkey").alias("up"), named("N", "n_nationkey").alias("down")),
        t["customer"].select(named("N", "c_nationkey"), named("C", "c_custkey")), t["supplier"].select(named("N", "s_nationkey"), named("S", "s_suppkey")),
        t["orders"].select(named("C", "o_custkey"), named("O", "o_orderkey")), t["lineitem"].select(named("S", "l_suppkey"), named("O", "l_orderkey")),
        t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).select(named("R", "n_regionkey"), named("C", "c_custkey")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    edges = edges.distinct()
    return edges.select(F.col("up").alias("node")).union(edges.select("down")).distinct(), edges


@query(f"WITH {_TABLE_PATHS_SQL} SELECT up, down FROM paths")
def table_graph_closure(spark, d):
    return graph.closure(_table_graph(spark, d)[1])


@query(f"WITH {_TABLE_PATHS_SQL} SELECT down AS node FROM paths WHERE up = 'N3'")
def table_graph_descendants(spark, d):
    return graph.descendants(graph.closure(_table_graph(spark, d)[1]), "N3")


@query(f"WITH {_TABLE_PATHS_SQL} SELECT up, down FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o JOIN paths p ON p.down = o.up WHERE o.down = e.down AND p.up = e.up AND o.up <> e.up)")
def table_graph_reduction(spark, d):
    edges = _table_graph(spark, d)[1]
    return graph.reduction(edges, graph.closure(edges)).select("up", "down")


@query(f"WITH {_TABLE_EDGES_SQL} SELECT 'root' AS kind, node FROM nodes WHERE node NOT IN (SELECT down FROM edges) UNION ALL SELECT 'leaf', node FROM nodes WHERE node NOT IN (SELECT up FROM edges)")
def table_graph_ends(spark, d):
    nodes, edges = _table_graph(spark, d)
    return graph.roots(nodes, edges).select(F.lit("root").alias("kind"), "node").union(graph.leaves(nodes, edges).select(F.lit("leaf"), "node"))


@query(f"WITH {_TABLE_LEVELS_SQL} SELECT node, level FROM levels")
def table_graph_levels(spark, d):
    return graph.levels(*_table_graph(spark, d))


@query(f"WITH {_TABLE_LEVELS_SQL} SELECT max(level) AS length FROM levels")
def table_graph_longest_path(spark, d):
    return graph.longest_path(graph.levels(*_table_graph(spark, d)))


@query(f"WITH {_TABLE_LEVELS_SQL} SELECT level, string_agg(node, ',' ORDER BY node) AS tasks FROM levels WHERE left(node, 1) <> 'O' GROUP BY level")
def table_graph_waves(spark, d):
    nodes, edges = _table_graph(spark, d)
    inner, between = graph.subgraph(nodes, edges, nodes.where("left(node, 1) <> 'O'"))
    return graph.waves(inner.withColumn("pos", F.col("node")), graph.levels(inner, between)).select("level", F.array_join("tasks", ",").alias("tasks"))


@query(f"WITH {_TABLE_EDGES_SQL} SELECT down AS node, string_agg(up, ',' ORDER BY up) AS neighbours FROM edges GROUP BY down")
def table_graph_upstreams(spark, d):
    return graph.adjacency(_table_graph(spark, d)[1].withColumn("pos", F.col("up"))).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query("SELECT row_number() OVER (ORDER BY kind DESC, key) - 1 AS pos, kind || key AS node FROM (SELECT DISTINCT 'R' AS kind, n_regionkey AS key FROM nation UNION SELECT 'N', n_nationkey FROM nation)")
def table_graph_topological(spark, d):
    rows = views.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()  # a definition's few nodes
    nodes = [f"R{k}" for k in sorted({r.n_regionkey for r in rows})] + [f"N{k}" for k in sorted(r.n_nationkey for r in rows)]
    found = graph.topological(nodes, {f"N{r.n_nationkey}": [f"R{r.n_regionkey}"] for r in rows})
    return spark.createDataFrame(list(enumerate(found)), "pos long, node string")


# Conditions on objects, schedules, order of dispatch ---------------------------------------------------------------------

_OBJECTS = {
    "has_a": "has(obj, 'a')", "has_z": "has(obj, 'z') or has([1, 2], c_nationkey)", "names": "join(keys(obj), ',')", "contents": "join(values(obj), ',')", "half": "number(string(c_nationkey) + '.5')",
    "first_known": "coalesce(null, nothing, c_mktsegment)",
}


@query("SELECT c_custkey, true AS has_a, c_nationkey < 2 AS has_z, 'a,b' AS names, c_custkey || ',' || c_nationkey AS contents, CAST(c_nationkey AS DOUBLE) + CAST(0.5 AS DOUBLE) AS half, c_mktsegment AS first_known FROM customer")
def expr_objects(spark, d):
    rows = views.table(spark, d, "customer").withColumn("obj", F.create_map(F.lit("b"), F.col("c_nationkey").cast("long"), F.lit("a"), F.col("c_custkey").cast("long"))).withColumn("nothing", F.lit(None).cast("string"))
    compiler = expr.Compiler(expr.environment(rows))
    return rows.select("c_custkey", *[compiler.compile(source).col.alias(name) for name, source in _OBJECTS.items()])


@query("""SELECT event_id, CAST(epoch(CAST(CASE dayofweek(n) WHEN 6 THEN n - INTERVAL 1 DAY WHEN 0 THEN n - INTERVAL 2 DAY ELSE n END AS TIMESTAMP)) AS DOUBLE) AS previous
FROM (SELECT event_id, CASE WHEN ts > date_trunc('day', ts) + INTERVAL 9 HOUR THEN date_trunc('day', ts) + INTERVAL 9 HOUR ELSE date_trunc('day', ts) - INTERVAL 15 HOUR END AS n FROM events)""")
def cron_previous(spark, d):
    cron = schedule.Cron.parse("0 9 * * mon-fri")
    return views.table(spark, d, "events").select("event_id", cron.previous_fire(views.epoch("ts")).alias("previous"))


@query(f"WITH {_MINUTES_SQL} SELECT {_AT_SQL} AS at FROM minutes WHERE minute(t) = 30 AND hour(t) % 6 = 0 AND day(t) <= 7 AND epoch(t) > {_T0} ORDER BY t LIMIT 100")
def cron_next_n(spark, d):
    return spark.createDataFrame([(x,) for x in schedule.iter_fires(schedule.make_trigger("30 */6 1-7 * *"), _T0, 100)], "at double")


@query(f"""WITH {_MINUTES_SQL}, f AS (SELECT {_AT_SQL} AS at, 'often' AS schedule, 0 AS pos FROM minutes WHERE minute(t) % 20 = 0 AND hour(t) = 3
  UNION ALL SELECT {_AT_SQL}, 'weekly', 1 FROM minutes WHERE hour(t) = 3 AND minute(t) = 0 AND dayofweek(t) = 1)
SELECT at, schedule FROM f WHERE at > {_T0} ORDER BY at, pos LIMIT 60""")
def timetable_upcoming(spark, d):
    table = schedule.Timetable([schedule.Entry("often", "w", schedule.make_trigger("*/20 3 * * *")), schedule.Entry("weekly", "w", schedule.make_trigger("0 3 * * mon"))])
    return spark.createDataFrame([(at, e.name) for at, e in table.upcoming(_T0, 60)], "at double, schedule string")


@query("SELECT p_size AS priority, p_partkey AS pos, 'p' || p_partkey AS task FROM part ORDER BY 1, 2 LIMIT 200")
def dispatch_order(spark, d):
    rows = views.table(spark, d, "part").select(F.col("p_size").alias("priority"), F.col("p_partkey").alias("pos"), F.concat(F.lit("p"), "p_partkey").alias("task"))
    return policy.order_tasks(rows).limit(200)
