"""Order, edits, lexicon and likeness against plain versions; no Python in the plan."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import imatch, queries


def corpus(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}x" for i in range(400)]
    return [" ".join(rnd.choice(vocabulary[: rnd.choice([20, 400])]) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


ID_LISTS = [
    [1, 2, 3, 9, 10, 11, 500, 501, 9000, -7, -100], [5], [3, 4], list(range(0, 40, 3)), list(range(60)) + [2**62], [-9 * 10**18, 5, 9 * 10**18],
    [None, 4, 5, 6, 7, 8, 9, 10, 11, 12], [-(2**63), 2**63 - 1, 0, None],
]


@pytest.mark.parametrize("ids", ID_LISTS)
def test_following_rows_over_ranges(spark, monkeypatch, ids):
    monkeypatch.setattr(imatch, "RANGE", 3)
    monkeypatch.setattr(imatch, "STEP", 2)
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in imatch.with_following(rows, ["text"]).collect()}
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 100)
    for ids in (list(range(2000)) + [2**62], [None] * 1000 + list(range(1000)), [7] * 1500 + list(range(500))):
        rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, n long").select("id", F.xxhash64("n").alias("order"))
        cuts = sorted((i is not None, i or 0, o) for i, o in imatch.cuts_of(rows))
        keys = sorted((r.id is not None, r.id or 0, r.order) for r in rows.collect())
        sizes = [sum(a <= k < b for k in keys) for a, b in zip(cuts, cuts[1:] + [(2,)])]
        assert len(cuts) >= 15 and cuts[0] == keys[0] and max(sizes) <= 300


def test_edits_and_fingerprints(spark):
    texts = corpus(120) + ["", "é中 😀 only few", "é中 😀 only few"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hashes", "2 as edited", "3 as next_text")
    lexicon = imatch.lexicon(docs)
    frame = imatch.neighbours(docs, lexicon)
    assert "Python" not in frame._jdf.queryExecution().toString()
    out = {r.doc_id: r for r in frame.withColumns({"near": imatch.likeness(F.col("hashes"), F.col("edited_hashes")), "far": imatch.likeness(F.col("hashes"), F.col("next_hashes"))}).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        assert out[i].n_chars == len(t) and out[i].edited == t[: len(t) - cut] + following[:cut]
    assert out[121 * 3].hashes == out[122 * 3].hashes and out[121 * 3].far == 1.0
    long = [i for i, t in rows if t and len(t) > 200]
    assert sum(out[i].near for i in long) > 4 * sum(out[i].far for i in long)


def test_terms_are_sorted_by_value_without_an_expression(spark):
    docs = spark.createDataFrame([(1, "one two three two"), (2, "three four"), (3, None)], "doc_id long, text string")
    frame = imatch.neighbours(docs, imatch.lexicon(docs, least_share=0, most_share=1))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan and "shiftright" not in plan.lower()


def test_likeness_evaluates_its_levels_once(spark):
    columns = spark.createDataFrame([], "a array<long>, b array<long>")
    plan = columns.select(imatch.likeness(F.col("a"), F.col("b")).alias("share"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("zip_with(") <= 2 * imatch.LEVELS


def term(word):
    return int.from_bytes(xxhash.xxh64_digest(word.encode(), 42), "big", signed=True)


def hash_of(terms):
    """Spark's hash of an array of longs."""
    seed = 42
    for t in terms:
        seed = xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), seed)
    return seed & 0xFFFFFFFF


def plain_terms(text):
    return sorted({term(w) for w in re.findall(r"[^\W_]+", text.lower())})


def plain_fingerprint(text, band):
    terms = plain_terms(text)
    terms, out = [t for t in terms if t in band] or terms, []
    for level in range(imatch.LEVELS):
        terms = [t for t in terms if t >> 15 + level & 1 == 0] if level else terms
        for k in range(imatch.PARTS):
            own = [t for t in terms if t >> 27 + 3 * level & 7 == k]
            out.append(hash_of(own) if own else None)
    return out


def plain_likeness(a, b):
    levels = []
    for n in range(0, len(a), imatch.PARTS):
        x, y = a[n : n + imatch.PARTS], b[n : n + imatch.PARTS]
        pairs = [(p, q) for p, q in zip(x, y) if p is not None or q is not None]
        levels.append((sum(p == q for p, q in pairs), len(pairs), sum(p is not None and q is not None for p, q in pairs)))
    used = [v for v in levels if v[1] and v[2] < imatch.PARTS] or levels
    either = sum(v[1] for v in used)
    return sum(v[0] for v in used) / either if either else 1.0


def test_the_query_against_brute_force(spark, tmp_path):
    texts = [t for t in corpus(150, 4)] + ["", "Some  words, not in\nany band!", "ÄÖ é中 x_y 12 ab12"]
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)] + [(5000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = Counter(t for _, x in rows for t in plain_terms(x or ""))
    band = {t for t, n in df.items() if max(2, 0.001 * len(rows)) <= n <= 0.1 * len(rows)}
    prints = [plain_fingerprint(t or "", band) for _, t in rows]
    shown = lambda p: "".join(f"{h or 0:08x}" for h in p)
    out = {r.doc_id: r for r in queries.op9_imatch(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, n = t or "", (k + 1) % len(rows)
        cut = len(t) // 4
        edited = t[: len(t) - cut] + (rows[n][1] or "")[:cut]
        other = plain_fingerprint(edited, band)
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (shown(prints[k]), shown(other))
        assert abs(out[i].near_edited - plain_likeness(prints[k], other)) < 1e-9 and abs(out[i].near_next - plain_likeness(prints[k], prints[n])) < 1e-9


def test_the_lexicon_holds_the_band(spark):
    texts = corpus(200, 2)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    df = Counter(w for t in texts for w in set(t.split()))
    for least, most in ((0.015, 0.2), (0.001, 0.1), (0.9, 1.0)):
        places = imatch.lexicon(docs, least_share=least, most_share=most)
        held = {t for p in places for t in p}
        assert held == {term(w) for w, n in df.items() if max(2, least * 200) <= n <= most * 200}
        assert all(t & len(places) - 1 == n for n, p in enumerate(places) for t in p)


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (2, None), (3, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = imatch.neighbours(docs, imatch.lexicon(docs))
    assert out.count() == 5 and out.where("edited is null or hashes is null").count() == 0
    assert imatch.neighbours(docs.limit(0), imatch.lexicon(docs.limit(0))).count() == 0
    assert docs.limit(1).select(imatch.likeness(F.array(F.lit(None).cast("long")), F.array(F.lit(None).cast("long")))).first()[0] == 1.0
