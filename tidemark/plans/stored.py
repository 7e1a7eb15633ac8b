"""Queries that write a log to a store, to JSON lines or through a stream, and read it back; and those of the helpers that reports use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import graph, replay, runquery, schedule
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views import RUNS_SQL
from tidemark.plans.whole import _RECORD, _RECORDS_SQL, _TABLE_EDGES_SQL, _WHOLE_SQL, _table_graph, whole_log
from tidemark.session import materialize, scratch
from tidemark.sinks import store
from tidemark.sources import event_log
from tidemark.streaming import replay as streams

_PLAIN = ["run_id", "seq", "at", "kind", "task", "attempt"]
_PLAIN_SQL = ", ".join(_PLAIN)
_PAYLOAD = ["workflow", "state", "reason", "elapsed"]


def _with_payload(events: DataFrame) -> DataFrame:
    """The plain columns and some fields of the payload as text."""
    return events.select(*_PLAIN, *[F.get_json_object("payload", f"$.{c}").alias(c) for c in _PAYLOAD])


def _counted(log: DataFrame) -> DataFrame:
    """The log without attempts of 0, which strict reading rejects."""
    return log.withColumn("attempt", F.nullif("attempt", F.lit(0)))


def _store_of(log: DataFrame) -> str:
    path = scratch(log.sparkSession, "store")
    store.append(log, path)
    return path


def _lines_of(log: DataFrame, name: str = "lines") -> str:
    path = scratch(log.sparkSession, name)
    store.write_lines(log, path)
    return path


# Stores ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_WHOLE_SQL} SELECT {_PLAIN_SQL}, workflow, state, reason, CAST(CAST(elapsed AS DECIMAL(18, 1)) AS VARCHAR) AS elapsed FROM wl")
def store_scan(spark, d):
    return _with_payload(store.load(spark, _store_of(whole_log(spark, d))))


@query(f"WITH {_WHOLE_SQL} SELECT {_PLAIN_SQL} FROM wl")
def store_flush(spark, d):
    """A third of the log, then all of it twice: no event comes in again."""
    log = materialize(whole_log(spark, d), "log")
    path = _store_of(log.where("seq % 3 = 0"))
    for _ in range(2):
        store.flush(log, path)
    return store.load(spark, path).select(*_PLAIN)


@query(f"WITH {_WHOLE_SQL} SELECT {_PLAIN_SQL} FROM wl WHERE seq < 5 OR run_id[-1] <> '5'")
def store_replace(spark, d):
    """Of the runs whose id ends in 5, only the first five events stay."""
    log = materialize(whole_log(spark, d), "log")
    path = _store_of(log)
    store.replace(log.where("run_id like '%5' and seq < 5"), path)
    return store.load(spark, path).select(*_PLAIN)


@query(f"WITH {_WHOLE_SQL} SELECT {_PLAIN_SQL} FROM wl WHERE run_id <> (SELECT min(run_id) FROM wl)")
def store_delete(spark, d):
    path = _store_of(whole_log(spark, d))
    store.delete(spark, path, event_log.run_ids(store.load(spark, path)).first().run_id)
    return store.load(spark, path).select(*_PLAIN)


@query(f"WITH {_WHOLE_SQL} SELECT {_PLAIN_SQL} FROM wl")
def store_adopt(spark, d):
    log = whole_log(spark, d)
    odd = F.col("run_id").rlike("[13579]$")
    return event_log.adopt(log.where(odd), log.where(~odd)).select(*_PLAIN)


@query(f"WITH {_WHOLE_SQL}, c AS (SELECT run_id, min(at) AS created FROM wl GROUP BY run_id) SELECT run_id, row_number() OVER (ORDER BY created, run_id) - 1 AS pos FROM c ORDER BY pos LIMIT 40")
def store_runs_by_creation(spark, d):
    found = event_log.run_ids_by_creation(whole_log(spark, d), "at").limit(40).collect()
    return spark.createDataFrame([(r.run_id, n) for n, r in enumerate(found)], "run_id string, pos long")


@query(f"WITH {_WHOLE_SQL} SELECT run_id, seq + 2 AS seq, seq + 1 AS expected FROM wl WHERE seq % 4 = 3")
def store_ingest(spark, d):
    """Two places are left out at the start and some doubled, so that the arrivals aren't dense."""
    log = whole_log(spark, d).withColumn("expected_at", F.col("seq"))
    rows = log.select("run_id", F.when(F.col("seq") % 4 == 3, F.col("seq") + 2).otherwise(F.col("seq") + 1).alias("seq"), "expected_at")
    first = log.where("seq = 0").select("run_id", F.lit(0).cast("long").alias("seq"), F.lit(-1).cast("long").alias("expected_at"))
    return event_log.ingest(rows.union(first), "expected_at").select("run_id", "seq", F.col("expected").cast("long").alias("expected"))


@query(f"WITH {_WHOLE_SQL}, n AS (SELECT run_id, max(seq) AS last FROM wl WHERE seq < 4 GROUP BY run_id) SELECT {_PLAIN_SQL} FROM wl JOIN n USING (run_id) WHERE seq > last OR seq < 4")
def store_number(spark, d):
    """The first four events keep their places; the others get theirs anew, in order of time and old place."""
    log = whole_log(spark, d)
    late = log.where("seq >= 4").withColumn("came", F.struct("at", "seq"))
    return log.where("seq < 4").select(*_PLAIN).unionByName(store.number(late, "came", log.where("seq < 4").select("run_id", "seq")).select(*_PLAIN))


# JSON lines ------------------------------------------------------------------------------------------------------------


_COUNTED_SQL = _PLAIN_SQL.replace("attempt", "nullif(attempt, 0) AS attempt")


@query(f"WITH {_WHOLE_SQL} SELECT {_COUNTED_SQL}, workflow, state, reason, CAST(CAST(elapsed AS BIGINT) AS VARCHAR) AS elapsed FROM wl")
def lines_round_trip(spark, d):
    return _with_payload(event_log.read_events(spark, _lines_of(_counted(whole_log(spark, d))))).withColumn("elapsed", F.col("elapsed").cast("double").cast("long").cast("string"))


@query(f"WITH {_WHOLE_SQL} SELECT {_COUNTED_SQL} FROM wl WHERE run_id = (SELECT max(run_id) FROM wl)")
def lines_of_one_run(spark, d):
    log = materialize(_counted(whole_log(spark, d)), "log")
    last = log.agg(F.max("run_id")).first()[0]
    root = event_log.open_store(spark, scratch(spark, "runs"))
    store.write_lines(log.where(F.col("run_id") == last), f"{root}/{last}.jsonl")
    return event_log.read_run(spark, root, last).select(*_PLAIN)


#: How every ninth event's line is spoiled, the problem that a check sees in it, and how the line looks.
_SPOILED = {
    0: ("not an object", "[{n}]"), 1: ("not an object", "event {n}"), 2: ("seq is missing", '{{"at":{n},"kind":"run_started","run_id":"r"}}'),
    3: ("unknown kind", '{{"at":{n},"kind":"other","run_id":"r","seq":1}}'), 4: ("seq is not an integer", '{{"at":{n},"kind":"run_started","run_id":"r","seq":true}}'),
    5: ("seq is below 0", '{{"at":{n},"kind":"run_started","run_id":"r","seq":-1}}'), 6: ("at is not a number", '{{"at":"{n}","kind":"run_started","run_id":"r","seq":1}}'),
    7: ("attempt is below 1", '{{"at":{n},"attempt":0,"kind":"run_started","run_id":"r","seq":1}}'), 8: ("payload is not an object", '{{"at":{n},"kind":"run_started","payload":[{n}],"run_id":"r","seq":1}}'),
}


def _spoiled_sql(n: int) -> str:
    problem, line = _SPOILED[n][0].replace("at is", "a' || 't is"), _SPOILED[n][1]
    return f"SELECT '{line.format(n="' || event_id || '")}' AS line, '{problem}' AS problem FROM events WHERE event_id % 11 = {n}"


@query(" UNION ALL ".join(map(_spoiled_sql, _SPOILED)))
def lines_malformed(spark, d):
    line, n = F.concat(F.lit('{"at":'), F.col("event_id"), F.lit(',"kind":"run_started","run_id":"r","seq":1}')), F.col("event_id")
    for k, (_, text) in _SPOILED.items():
        parts = text.format(n="\0").split("\0")
        own = F.lit(parts[0])
        for p in parts[1:]:
            own = F.concat(own, n.cast("string"), F.lit(p))
        line = F.when(n % 11 == k, own).otherwise(line)
    path = scratch(spark, "spoiled")
    views.table(spark, d, "events").select(line).write.text(path)
    return event_log.malformed(event_log.read_lines(spark, path)).select("line", "problem")


# Streams ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_RECORDS_SQL} SELECT {', '.join(_RECORD)} FROM records")
def stream_flushed_records(spark, d):
    """Lines that a stream flushes to a store, replayed."""
    path, lines = scratch(spark, "store"), _lines_of(whole_log(spark, d))
    streams.flush_stream(streams.read_stream(spark, lines, files_at_once=3), path, scratch(spark, "progress")).awaitTermination()
    return replay.replay_tasks(store.load(spark, path)).select(*_RECORD)


@query(f"WITH {_WHOLE_SQL} SELECT run_id, seq, seq - 1 AS expected FROM wl WHERE seq % 6 = 4")
def stream_gaps(spark, d):
    """Every sixth event is left out; the one after each isn't the next of its run."""
    lines, out = _lines_of(whole_log(spark, d).where("seq % 6 <> 3")), scratch(spark, "gaps")
    found = streams.sequence_violations(streams.read_stream(spark, lines))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


# Reports ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_RECORDS_SQL}, t AS (SELECT run_id, count(*) AS tasks, arg_min(task, pos) AS first_task, arg_min(state, pos) AS first_state FROM records GROUP BY run_id), "
       "e AS (SELECT run_id, count(*) AS event_count FROM wl GROUP BY run_id) SELECT run_id, CAST(event_count AS VARCHAR) AS event_count, CAST(tasks AS INTEGER) AS tasks, first_task, first_state FROM t JOIN e USING (run_id)")  # fmt: skip
def export_run_json(spark, d):
    log = materialize(whole_log(spark, d), "log")
    made = store.run_json(replay.replay_runs(log), replay.replay_tasks(log))
    field = lambda p: F.get_json_object("json", p)
    return made.select("run_id", field("$.event_count").alias("event_count"), F.json_array_length(field("$.tasks")).alias("tasks"), field("$.tasks[0].name").alias("first_task"), field("$.tasks[0].state").alias("first_state"))


@query(f"WITH {_RECORDS_SQL}, r AS (SELECT DISTINCT run_id FROM wl) SELECT 0 AS part, NULL AS run_id, '{{' AS opens, false AS follows UNION ALL SELECT 1, run_id, '{{', run_id <> (SELECT min(run_id) FROM r) FROM r UNION ALL SELECT 2, NULL, ']', false")
def export_runs_document(spark, d):
    log = materialize(whole_log(spark, d), "log")
    lines = store.runs_document(replay.replay_runs(log), replay.replay_tasks(log))
    return lines.select("part", "run_id", F.left(F.regexp_replace("line", "^,", ""), F.lit(1)).alias("opens"), F.col("line").startswith(",").alias("follows"))


_SECONDS_SQL = "(SELECT l_orderkey, l_linenumber, l_partkey * l_linenumber AS n FROM lineitem)"


def _units_sql(names: list[str], words: bool) -> str:
    """The non-zero units of n as a list of texts."""
    sizes, left, out = [604800, 86400, 3600, 60, 1], "n", []
    for size, name in zip(sizes, names):
        count = f"({left} // {size})"
        text = f"{count} || CASE WHEN {count} = 1 THEN ' {name}' ELSE ' {name}s' END" if words else f"{count} || '{name}'"
        out.append(f"CASE WHEN {count} > 0 THEN {text} END")
        left = f"({left} % {size})"
    return f"[x FOR x IN [{', '.join(out)}] IF x IS NOT NULL]"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN '0s' ELSE array_to_string(({_units_sql(["w", "d", "h", "m", "s"], False)})[1:2], '') END AS short,
CASE WHEN n = 0 THEN '0 milliseconds' ELSE array_to_string({_units_sql(["week", "day", "hour", "minute", "second"], True)}, ' ') END AS words,
CASE WHEN l_linenumber = 1 THEN '1ms' ELSE l_linenumber || 'ms' END AS below FROM {_SECONDS_SQL}""")
def scalar_duration_texts(spark, d):
    n = (F.col("l_partkey") * F.col("l_linenumber")).cast("double")
    rows = views.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", scalars.duration_text(n).alias("short"), scalars.duration_words(n).alias("words"), scalars.duration_text(F.col("l_linenumber") / 1000).alias("below"))


_SORTS = {"finished": ("finished_at", True), "workflow": ("workflow", False), "run_id": ("run_id", True), "tasks": ("tasks", True)}


@query(f"WITH {RUNS_SQL} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{k}' AS key, row_number() OVER (ORDER BY {c} {'DESC' if down else 'ASC'} NULLS LAST, {f'CASE WHEN {c} IS NOT NULL THEN run_id END DESC NULLS LAST, run_id' if down else 'run_id'}) - 1 AS pos, run_id FROM runs) WHERE pos < 25"
    for k, (c, down) in _SORTS.items()))
def runquery_sort_keys(spark, d):
    runs, out = views.runs(spark, d), []
    for key, (_, down) in _SORTS.items():
        found = runquery.RunQuery(sort=key, descending=down, limit=25).apply(runs).collect()
        out += [(key, n, r.run_id) for n, r in enumerate(found)]
    return spark.createDataFrame(out, "key string, pos long, run_id long")


# Graphs, calendars and triggers ------------------------------------------------------------------------------------------


@query(f"WITH {_TABLE_EDGES_SQL} SELECT w || '.' || up AS up, w || '.' || down AS down FROM edges, (VALUES ('a'), ('b')) AS v(w) WHERE left(down, 1) IN ('N', 'S')")
def graph_prefixed(spark, d):
    nodes, edges = _table_graph(spark, d)
    own = edges.where("left(down, 1) in ('N', 'S')")
    return graph.prefixed(nodes, own, "a")[1].select("up", "down").union(graph.prefixed(nodes, own, "b")[1].select("up", "down"))


@query("SELECT event_id FROM (SELECT event_id, ts, hour(ts) * 60 + minute(ts) AS m FROM events) WHERE dayofweek(ts) BETWEEN 1 AND 5 AND CAST(ts AS DATE) NOT IN (DATE '1996-12-25', DATE '1997-01-01') AND m >= 600 AND m < 1020")
def calendar_merged(spark, d):
    a = schedule.Calendar.of("a", holidays=["1996-12-25"], windows=["09:00-17:00"])
    b = schedule.Calendar.of("b", weekend=(), holidays=["1997-01-01"], windows=["10:00-20:00"])
    return views.table(spark, d, "events").where(schedule.merge_calendars("c", [a, b]).open_at(views.epoch("ts"))).select("event_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n >= 600 AND (n - 600) % 90 = 0 AND (n - 600) // 90 < 500 THEN (n - 600) // 90 END AS nth FROM (SELECT l_orderkey, l_linenumber, l_partkey * l_linenumber AS n FROM lineitem)")
def interval_occurrences(spark, d):
    trigger = schedule.Interval(90.0, anchor=600.0, limit=500)
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", trigger.occurrence_at(F.col("l_partkey") * F.col("l_linenumber")).alias("nth"))


@query("WITH m AS (SELECT CAST(epoch(date_trunc('second', CAST(quantile_disc(ts, 0.5) AS TIMESTAMP))) AS BIGINT) AS at FROM events) SELECT event_id, CASE WHEN epoch_us(ts) < (SELECT at FROM m) * 1000000 THEN CAST((SELECT at FROM m) AS DOUBLE) END AS next, CAST(NULL AS DOUBLE) AS never FROM events")
def once_and_never(spark, d):
    events = views.table(spark, d, "events")
    half = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(cast(ts as timestamp)))").alias("t"))
    at = float(half.first().t // 1_000_000)
    return events.select("event_id", schedule.Once(at).next_fire(views.epoch("ts")).alias("next"), schedule.Never().next_fire(views.epoch("ts")).alias("never"))
