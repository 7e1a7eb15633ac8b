"""Lines against a plain count, both ways of meeting the lists, and no Python in the plan."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import line_dedup


def plain(rows, ratio, least):
    pages, total = defaultdict(int), defaultdict(int)
    for _, host, text in rows:
        total[host or ""] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            pages[host or "", line] += 1
    out = []
    for i, host, text in rows:
        bad = lambda x, h=host or "": pages.get((h, x.strip(" \t\r")), 0) >= least and pages[h, x.strip(" \t\r")] > ratio * total[h]
        lines = (text or "").split("\n")
        kept = [x for x in lines if not bad(x)]
        out.append((i, host or "", None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_a_plain_count(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "a", "b", None]), "\n".join(rnd.choice(["menu", " menu\t", "rights reserved", "", f"own line {i}", f"line {i % 50}"]) for _ in range(rnd.randint(0, 8)))) for i in range(300)]
    rows += [(1, "a", None), (None, "c", "menu"), (None, "c", "menu"), (900, "b", "x" * 100_000 + "\nmenu")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as host", "2 as keys", "3 as lines", "4 as salt")
    run = lambda: line_dedup.line_dedup(docs, F.col("source"), 0.1, 5)
    want = plain(rows, 0.1, 5)
    assert sorted(map(tuple, run().collect()), key=str) == want
    assert any(r[4] for r in want) and any(not r[4] for r in want)
    assert "Python" not in run()._jdf.queryExecution().toString()
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, run().collect()), key=str) == want
    assert line_dedup.line_dedup(docs.limit(0), F.col("source")).count() == 0


def test_host_of(spark):
    rows = spark.createDataFrame([("https://User@Blog.Example.com:8080/a",), ("http://x",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in rows.select(line_dedup.host_of(F.col("url"))).collect()] == ["blog.example.com", "x", "", None]
