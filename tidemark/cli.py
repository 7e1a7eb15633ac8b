"""Command line: definitions, runs, history and schedules over the API."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import __version__, dsl, errors
from tidemark.faults import UnknownRun
from tidemark.functions.scalars import canonical, iso_text
from tidemark.operators import graph, metrics, replay, runquery, schedule, timeline
from tidemark.session import local_session
from tidemark.sinks import store
from tidemark.sources.event_log import open_store, parse_assignment, parse_timestamp

EXPORTS = ("json", "csv", "tasks-csv")


def load_workflows(path: str) -> dict[str, dsl.Workflow]:
    """Workflows that a Python file defines, also those in a registry."""
    spec = importlib.util.spec_from_file_location("workflow_file", path)
    if spec is None or spec.loader is None:
        raise dsl.DefinitionError(f"cannot load {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found: dict[str, dsl.Workflow] = {}
    for value in vars(module).values():
        if isinstance(value, dsl.Workflow):
            found[value.name] = value
        elif isinstance(value, dsl.Registry):
            found |= value.workflows
    if not found:
        raise dsl.DefinitionError(f"{path} defines no workflow")
    return found


def select_workflow(found: dict[str, dsl.Workflow], name: str | None) -> dsl.Workflow:
    if name is None and len(found) == 1:
        return next(iter(found.values()))
    if name not in found:
        raise dsl.DefinitionError(f"choose one of {', '.join(sorted(found))}")
    return found[name]


class App:
    def __init__(self, args: argparse.Namespace, spark: SparkSession | None = None):
        self.args, self._spark = args, spark

    @property
    def spark(self) -> SparkSession:
        self._spark = self._spark or local_session("*", 8, "tidemark")
        return self._spark

    def say(self, text: str = "") -> None:
        if not getattr(self.args, "quiet", False):
            print(text)

    def workflow(self) -> dsl.Workflow:
        return select_workflow(load_workflows(self.args.file), self.args.workflow)

    def events(self) -> DataFrame:
        open_store(self.spark, self.args.store, create=False)
        return store.load(self.spark, self.args.store)

    def run_id(self, runs: DataFrame) -> str:
        if self.args.run != "last":
            wanted = runs.where(F.col("run_id") == self.args.run)
        else:
            wanted = runquery.sort_runs(runs, "started", True)
        found = wanted.select("run_id").first()
        if found is None:
            raise UnknownRun(f"no run {self.args.run!r} in {self.args.store}")
        return found.run_id

    # Definitions

    def describe(self) -> int:
        w = self.workflow()
        self.say(f"{w.name}: {len(w.tasks)} tasks, {len(w.edges)} edges")
        for e in w.edges:
            self.say(f"  {e.up} -> {e.down}" + (f" when {e.condition}" if e.condition else ""))
        return self.plan()

    def validate(self) -> int:
        found, worst = load_workflows(self.args.file), errors.OK
        for name in [self.args.workflow] if self.args.workflow else sorted(found):
            issues = dsl.validate(select_workflow(found, name))
            bad = [i for i in issues if i.severity == "error"]
            self.say(f"{name}: {len(bad)} error(s), {len(issues) - len(bad)} warning(s)")
            for i in issues:
                self.say(f"  {i.severity} {i.code} at {i.where}: {i.message}")
            if bad or issues and self.args.strict:
                worst = errors.DEFINITION
        return worst

    def plan(self) -> int:
        w = self.workflow()
        waves = w.waves()
        self.say(store.render_table(["wave", "tasks"], [[n, ", ".join(t)] for n, t in enumerate(waves)]))
        self.say(f"{len(w.tasks)} task(s) in {len(waves)} wave(s); the widest holds {max(map(len, waves), default=0)}")
        return errors.OK

    def run(self) -> int:
        w = self.workflow()
        if self.args.strict:
            dsl.assert_valid(w, strict=True)
        if self.args.only:
            w = w.subgraph(self.args.only)
        params = dict(map(parse_assignment, self.args.param or []))
        now = [time.time() if self.args.at is None else self.spark.range(1).select(parse_timestamp(F.lit(self.args.at))).first()[0]]
        engine = dsl.Engine(self.spark) if self.args.real_time else dsl.Engine(self.spark, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
        run_id = f"{w.name}-{int(engine.clock())}-{int(time.time() * 1000) % 10_000:04d}"
        out = engine.run(w, params, run_id)
        events = out.log(self.spark)
        if self.args.store:
            store.flush(events, open_store(self.spark, self.args.store))
        self.report(events, out.run_id)
        return errors.OK if out.state == "succeeded" else errors.RUN_FAILED

    # History

    def report(self, events: DataFrame, run_id: str) -> None:
        one = events.where(F.col("run_id") == run_id)
        runs, tasks = replay.replay_runs(one), replay.replay_tasks(one)
        if self.args.json:
            print(store.run_json(runs, tasks).first().json)
        else:
            self.say(store.summarise(runs.first(), tasks.collect()))

    def runs(self) -> int:
        a, runs = self.args, replay.replay_runs(self.events())
        found = runquery.RunQuery(workflow=a.workflow, failed_only=a.failed, limit=a.limit, sort=a.sort, descending=a.desc).apply(runs)
        rows = found.collect()
        if a.json:
            print(canonical({"count": len(rows), "succeeded": sum(r.state == "succeeded" for r in rows), "failed": sum(r.state == "failed" for r in rows), "runs": [r.asDict() for r in rows]}, 2))
        else:
            self.say(store.render_table(["run", "workflow", "state", "tasks", "duration"], [[r.run_id, r.workflow, r.state, r.tasks, r.duration] for r in rows]))
            self.say(f"{len(rows)} run(s), {sum(r.state == 'failed' for r in rows)} failed")
        return errors.OK

    def show(self) -> int:
        events = self.events()
        self.report(events, self.run_id(replay.replay_runs(events)))
        return errors.OK

    def events_(self) -> int:
        own = self.events().where(F.col("run_id") == self.args.run)
        rows = runquery.matching(own, self.args.task, tuple(self.args.kind or ())).orderBy("seq")
        if self.args.json:
            for r in store.event_lines(rows).orderBy("seq").collect():
                print(r.line)
            return errors.OK
        for r in rows.collect():
            who = f" {r.task}" + (f"#{r.attempt}" if r.attempt else "") if r.task else ""
            self.say(f"{iso_text(r['at'])} #{r.seq:04d} {r.kind}{who} {r.payload or ''}".rstrip())
        self.say(f"\n{rows.count()} event(s) of {own.count()} in run {self.args.run}")
        return errors.OK

    def timeline(self) -> int:
        events = self.events()
        run_id = self.run_id(replay.replay_runs(events))
        one = events.where(F.col("run_id") == run_id)
        runs, tasks = replay.replay_runs(one), replay.replay_tasks(one)
        rows = timeline.bars(timeline.timeline(runs, tasks), self.args.width).orderBy("pos").collect()
        self.say(timeline.ruler(rows[0].origin, rows[0].span) if rows else "no tasks")
        self.say(store.render_table(["task", "timeline", "attempts"], [[r.task, r.bar, r.attempts or None] for r in rows]))
        self.say(timeline.legend(rows))
        if self.args.file:
            edges = self.workflow().tables(self.spark)[1].select("up", "down")
            path = [r.task for r in graph.critical_path(tasks, edges).orderBy("pos").collect()]
            self.say("critical path: " + " -> ".join(path))
        return errors.OK

    def metrics(self) -> int:
        events = self.events()
        if self.args.workflow:
            events = runquery.only_runs_of(events, self.args.workflow)
        tasks = replay.replay_tasks(events)
        runs = replay.replay_runs(events, tasks)
        told = {
            "runs": metrics.run_summary(runs).first().asDict(),
            "states": {r.state: r.n for r in metrics.tally(runs, "state").collect()},
            "tasks": {r.state: r.n for r in metrics.tally(tasks, "state").collect()},
            "durations": [r.n for r in metrics.histogram(metrics.ran(tasks), "duration").orderBy("bucket").collect()],
            "quantiles": {str(r.fraction): r.value for r in metrics.quantiles(metrics.ran(tasks), "duration", (0.5, 0.95)).collect()},
            "slowest": [[r.task, r.total] for r in metrics.slowest(tasks, self.args.top).collect()],
            "flakiest": [[r.task, r.n] for r in metrics.flakiest(tasks, self.args.top).collect()],
        }
        if self.args.json:
            print(canonical(told, 2))
            return errors.OK
        self.say(store.render_pairs([*told["runs"].items(), *told["quantiles"].items()]))
        for name in ("slowest", "flakiest"):
            if told[name]:
                self.say(f"\n{name} tasks:\n" + store.render_bars([(k, float(v)) for k, v in told[name]]))
        return errors.OK

    def export(self) -> int:
        events = self.events()
        tasks = replay.replay_tasks(events)
        runs = replay.replay_runs(events, tasks)
        if self.args.run:
            runs, tasks = (x.where(F.col("run_id") == self.args.run) for x in (runs, tasks))
            if runs.isEmpty():
                raise UnknownRun(f"no run {self.args.run!r} in {self.args.store}")
        if self.args.format == "json":
            rows = [json.loads(r.json) for r in store.run_json(runs, tasks).orderBy("run_id").collect()]
            print(canonical({"runs": rows, **store.runs_summary(runs).first().asDict()}, 2))
            return errors.OK
        report = store.runs_csv(runs).orderBy("run_id") if self.args.format == "csv" else store.tasks_csv(tasks, runs).orderBy("run_id", "pos").drop("pos")
        import csv

        writer = csv.writer(sys.stdout, lineterminator="\n")
        writer.writerow(report.columns)
        writer.writerows(report.collect())
        return errors.OK

    # Schedules

    def schedule(self) -> int:
        trigger = schedule.make_trigger(self.args.expression)
        self.say(trigger.describe())
        if isinstance(trigger, schedule.Cron):
            self.say(store.render_table(["field", "matches"], list(map(list, trigger.summary().items()))))
        start = 0.0 if self.args.after is None else self.spark.range(1).select(parse_timestamp(F.lit(self.args.after))).first()[0]
        for t in schedule.iter_fires(trigger, start, self.args.count):
            self.say(iso_text(t))
        return errors.OK


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description="Run workflows and ask questions of their logs.")
    top.add_argument("--version", action="version", version=f"tidemark {__version__}")
    top.add_argument("-q", "--quiet", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *options: tuple) -> None:
        p = commands.add_parser(name, help=help_)
        for names, spec in options:
            p.add_argument(*names, **spec)

    o = lambda *names, **spec: (names, spec)
    flag = {"action": "store_true"}
    definition = [o("file"), o("--workflow")]
    kept, as_json = o("--store", required=True), o("--json", **flag)
    command("describe", "a workflow's structure", *definition)
    command("validate", "the static checks", *definition, o("--strict", **flag))
    command("plan", "the waves of a run", *definition)
    command("run", "run a workflow once", *definition, o("--param", action="append"), o("--store"), o("--only", nargs="+"), o("--at"), o("--real-time", **flag), o("--strict", **flag), o("-v", "--verbose", **flag), as_json)
    command("runs", "list runs", kept, o("--workflow"), o("--failed", **flag), o("--limit", type=int), o("--sort", choices=list(runquery.SORT_KEYS), default="started"), o("--desc", **flag), as_json)
    command("show", "one run in full", o("run", nargs="?", default="last"), kept, as_json)
    command("events", "a run's log", o("run"), kept, o("--task"), o("--kind", nargs="+"), as_json)
    command("timeline", "a run's timeline", o("run", nargs="?", default="last"), kept, o("--width", type=int, default=48), o("--file"), o("--workflow"))
    command("metrics", "a store's figures", kept, o("--workflow"), o("--top", type=int, default=5), as_json)
    command("export", "runs for other tools", kept, o("--run"), o("--format", choices=EXPORTS, default="json"))
    command("schedule", "explain a schedule", o("expression"), o("--count", type=int, default=5), o("--after"))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return errors.USAGE if e.code else errors.OK
    try:
        app = App(args, spark)
        return (app.events_ if args.command == "events" else getattr(app, args.command))()
    except (Exception, KeyboardInterrupt) as e:  # noqa: BLE001  every error has its exit code
        code, family = errors.classify(e)
        print(f"{family} error ({code}): {e}", file=sys.stderr)
        return errors.exit_code(e)


if __name__ == "__main__":
    sys.exit(main())
