"""Spans against a plain reading of the rules; the ledger over several runs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets


def plain(text):
    found = []
    rules = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    for n, (kind, p, g, least) in enumerate(rules):
        found += [(m.start(), n, kind, m.end()) for m in p.finditer(text) if len(m.group(g)) >= least]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_kinds_on_random_texts():
    rnd = random.Random(8)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "ſecret", "=", ": ", " ", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "deadbeef", "é", "😀", ".", "-", "secret: x"]
    for _ in range(4000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 12)))
        assert [s for s in secrets.scan(text) if s[0] in secrets.BASE] == plain(text), repr(text)


def test_ledger_scans_a_blob_once_and_joins_back_to_all_paths(spark):
    key = "token = abcdefghijklmnop"
    rows = [(1, key), (2, key), (2, key), (3, None), (4, ""), (None, "AKIA" + "X" * 16), (5, "x" * 50_000 + key)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as blob", "'b' as spans", "3 as id")
    ledger = secrets.scan_unseen(docs).cache()
    assert ledger.count() == 4
    out = [(r.id, r.spans) for r in secrets.findings(docs, ledger).collect()]
    assert len(out) == len(rows)
    assert [s["start"] for i, s in out if i == 5 for s in s] == [50_000]
    assert sorted(i or 0 for i, s in out if s) == [0, 1, 2, 2, 5]
    more = docs.union(docs.limit(1).withColumn("text", F.lit("new deadbeefdeadbeef")))
    new = secrets.scan_unseen(more, ledger).collect()
    assert len(new) == 1 and new[0].spans[0]["kind"] == "hex"
    assert secrets.scan_unseen(docs, ledger).count() == 0
    assert secrets.scan_unseen(docs.limit(0)).count() == 0


def test_a_new_rule_version_alone_is_scanned(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "secret=abcdefghijkl deadbeefdeadbeef"), (2, "nothing")], "doc_id long, text string")
    ledger = secrets.scan_unseen(docs).cache()
    rules = [(k, v + (k == "hex"), *r) for k, v, *r in secrets.RULES]
    monkeypatch.setattr(secrets, "RULES", rules)
    new = secrets.scan_unseen(docs, ledger).cache()
    assert [r.rules for r in new.collect()] == [["hex@2"]] * 2 and sorted(s.kind for r in new.collect() for s in r.spans) == ["hex"]
    kinds = lambda of: sorted(s.kind for r in secrets.findings(docs, of).collect() for s in r.spans)
    assert kinds(ledger) == ["assign"] and kinds(ledger.unionByName(new)) == ["assign", "hex"]
    assert secrets.scan_unseen(docs, ledger.unionByName(new)).count() == 0


def test_the_stored_ledger_scans_nothing_twice(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(i, f"secret=abcdefghijkl{i % 5}") for i in range(40)], "doc_id long, text string")
    assert secrets.update(docs, path).count() == 5
    assert secrets.update(docs.withColumn("doc_id", F.col("doc_id") + 1000), path).count() == 5
    more = docs.unionByName(spark.createDataFrame([(99, "AKIA" + "Z" * 20)], "doc_id long, text string"))
    found = secrets.findings(more, secrets.update(more, path)).collect()
    assert spark.read.parquet(path).count() == 6 and len(found) == 41 and all(len(r.spans) == 1 for r in found)


def test_rows_of_null_ids_are_scanned_once_a_blob(spark):
    rows = [(None, "secret=abcdefghijkl")] * 50 + [(None, None)] * 50 + [(3, "secret=abcdefghijkl")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = secrets.scan_unseen(docs).cache()
    assert ledger.count() == 2
    out = secrets.findings(docs, ledger).collect()
    assert len(out) == 120 and sum(len(r.spans) for r in out) == 70


@pytest.mark.parametrize("part", ["eyJ", "eyJa.", "eyJa.eyJ", "-----BEGIN ", "-----BEGIN A B ", "password ", "token=", "AKIA", "ghp_", "a0", "secret'", "api_key = ", "A "])
def test_repeating_prefixes_take_linear_time(part):
    text = part * (10_000_000 // len(part))
    began = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - began < 60


def test_added_kinds():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abc-DEF_123"
    text = f"x {jwt} -----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY----- -----BEGIN PUBLIC KEY----- ghp_" + "a1" * 20
    assert [(k, text[a:b][:30]) for k, a, b in secrets.scan(text) if k not in secrets.BASE] == [
        ("jwt", jwt[:30]), ("pem", "-----BEGIN RSA PRIVATE KEY----"), ("pem", "-----BEGIN PRIVATE KEY-----"), ("forge", ("ghp_" + "a1" * 20)[:30]),
    ]


def test_redaction_covers_overlaps(spark):
    text = "é secret=abcdef0123456789abcdef end deadbeefdeadbeefdead"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, "")], "doc_id long, text string")
    found = secrets.findings(docs, secrets.scan_unseen(docs))
    out = docs.join(found, docs.doc_id == found.id).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t"))
    assert dict((r.doc_id, r.t) for r in out.collect()) == {1: "é [secret] end [secret]", 2: "clean", 3: ""}
