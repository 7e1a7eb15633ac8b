"""What the package promises about itself."""

import ast
import pathlib

from tidemark.plans import registry

ROOT = pathlib.Path(__file__).resolve().parents[2]
CORE = [p for p in (ROOT / "tidemark").rglob("*.py") if "llm" not in p.parts]


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""


def test_the_core_does_without_the_corpus_operators():
    assert not [(p, m) for p in CORE for m in imports(p) if m.startswith(("tidemark.llm", "corpus_pipeline"))]


def test_lower_layers_do_not_import_higher_ones():
    order = ["functions", "sources", "operators", "sinks", "streaming", "plans"]
    for p in CORE:
        if p.parent.name in order:
            above = order[order.index(p.parent.name) + 1 :]
            assert not [m for m in imports(p) for a in above if m.startswith(f"tidemark.{a}")], p


def test_nothing_is_kept_on_one_executor_alone():
    for p in (ROOT / "tidemark").rglob("*.py"):
        assert "localCheckpoint(" not in p.read_text(), p


def test_every_core_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
