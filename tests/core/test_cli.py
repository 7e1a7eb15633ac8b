"""Every command on a small store, and the exit codes."""

import json

import pytest

from tidemark import cli

FLOW = '''
from tidemark.dsl import Registry, Workflow
w = Workflow("etl", {"n": {"type": "integer", "default": 1}})
a = w.task("extract", lambda c: {"rows": c.params["n"]})
b = w.task("load", lambda: 1)
a.when("results.extract.rows > 0") >> b
bad = Workflow("bad")
x = bad.task("x", lambda: 1 / 0)
r = Registry()
@r.task("registered")
def one():
    return 1
'''


@pytest.fixture
def flow(tmp_path):
    path = tmp_path / "flow.py"
    path.write_text(FLOW)
    return str(path)


def test_commands(spark, flow, tmp_path, capsys):
    root = str(tmp_path / "store")
    run = lambda *a: cli.main(list(a), spark)
    out = lambda: capsys.readouterr().out
    assert run("describe", flow, "--workflow", "etl") == 0 and "extract -> load when" in out()
    assert run("validate", flow) == 0 and "etl: 0 error(s)" in out()
    assert run("plan", flow, "--workflow", "registered") == 0
    assert run("run", flow, "--workflow", "etl", "--param", "n=3", "--store", root, "--at", "2026-03-11T09:00:00Z") == 0
    assert run("run", flow, "--workflow", "bad", "--store", root, "--json") == 1
    assert run("run", flow, "--workflow", "etl", "--only", "extract") == 0
    out()
    assert run("runs", "--store", root, "--json") == 0
    told = json.loads(out())
    assert (told["count"], told["failed"]) == (2, 1)
    good = next(r["run_id"] for r in told["runs"] if r["state"] == "succeeded")
    assert run("runs", "--store", root, "--failed", "--sort", "duration", "--desc", "--limit", "1") == 0 and "1 run(s), 1 failed" in out()
    assert run("show", good, "--store", root) == 0 and "succeeded" in out()
    assert run("events", good, "--store", root, "--task", "load", "--kind", "task_succeeded") == 0 and "1 event(s) of" in out()
    assert run("events", good, "--store", root, "--json") == 0 and json.loads(out().splitlines()[0])["kind"] == "run_started"
    assert run("timeline", good, "--store", root, "--file", flow, "--workflow", "etl") == 0 and "extract -> load" in out()
    assert run("metrics", "--store", root, "--json") == 0 and json.loads(out())["runs"]["runs"] == 2
    assert run("metrics", "--store", root, "--workflow", "etl") == 0 and "slowest" in out()
    for form in cli.EXPORTS:
        assert run("export", "--store", root, "--format", form) == 0 and good in out()
    assert run("schedule", "0 9 * * mon-fri", "--count", "2", "--after", "2026-03-13T09:00:00Z") == 0 and "2026-03-16T09:00:00Z" in out()
    assert run("show", "nothing", "--store", root) == 4 and run("runs", "--store", str(tmp_path / "none")) == 4
    assert run("schedule", "often") == 3 and run("describe", flow) == 3 and run("nonsense") == 2 and run("export", "--store", root, "--run", "zz") == 4
