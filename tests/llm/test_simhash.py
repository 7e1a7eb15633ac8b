"""Golay code, fingerprints, keys, links and components against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash

from tidemark.llm import components as stars
from tidemark.llm import golay, simhash
from tidemark.llm.components import components


def test_the_code_is_perfect():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 23, 3000)
    codes = np.arange(4096) << 11 | np.array([golay.remainder(n << 11) for n in range(4096)])
    assert min(int(np.bitwise_count(codes[:, None] ^ codes[None, :])[~np.eye(4096, dtype=bool)].min()), 7) == 7
    distance = np.bitwise_count(words[:, None] ^ codes[None, :])
    assert (distance.min(axis=1) <= 3).all() and (golay.index(words) == distance.argmin(axis=1)).all()
    found, first = golay.nearby(words, 23)
    assert first.sum(axis=1).max() == 6


def plain_print(text, size):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rnd = random.Random(3)
    for text in ["", " \t", "One", "one two", "É K x y z", "a b c d e f", "x " * 9000] + ["".join(rnd.choices(["Ab", " ", "\n", "c", "é", "\x0b", "\x1c", "zz "], k=rnd.randint(0, 60))) for _ in range(200)]:
        for size in (1, 3, 5):
            assert simhash.majority(simhash.shingle_hashes(simhash.words_of(text), size)) & (1 << 64) - 1 == plain_print(text, size)


def test_every_pair_of_up_to_three_errors_shares_a_key():
    rnd = random.Random(5)
    errors = [e for n in (1, 2, 3) for e in combinations(range(64), n)]
    for e in rnd.sample(errors, 3000) + errors[:64]:
        x = rnd.getrandbits(64)
        y = x ^ sum(1 << b for b in e)
        a, b = (np.array([v], np.uint64).view(np.int64) for v in (x, y))
        assert set(simhash.link_keys(a, False)[1].tolist()) & set(simhash.link_keys(b, True)[1].tolist())


def test_links_and_components(spark):
    rnd = random.Random(2)
    values = [rnd.getrandbits(64) for _ in range(150)]
    values += [v ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, 4))) for v in values for _ in range(2)] + [0, 1, 7, (1 << 64) - 1]
    values = np.unique(np.array(values, np.uint64)).view(np.int64)
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(int(v),) for v in values], "v long")).collect()}
    close = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :]) <= 3
    assert found == {(int(min(values[i], values[j])), int(max(values[i], values[j]))) for i, j in zip(*np.nonzero(close)) if i != j}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (301, 302), (302, 301), (302, 301), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)} | {302: 301}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(4, "One two three four"), (2, "one  two\nthree four"), (9, None), (7, ""), (7, ""), (None, "lonely text here"), (None, "one two three four"), (1, "quite another text about things"), (12, "x " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as f", "3 as least")
    out = sorted(((r.doc_id, simhash_hex(r.fingerprint), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(out) == len(rows)
    assert {(i, c) for i, _, c in out} == {(4, 2), (2, 2), (9, 7), (7, 7), (None, None), (None, 2), (1, 1), (12, 12)}
    assert {f for i, f, _ in out if i in (7, 9)} == {"0" * 16}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_no_join_broadcasts_and_tables_leave_no_marks(spark, monkeypatch):
    seen, write = [], simhash.materialize

    def noted(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(df, name)
        folder = spark._jvm.org.apache.hadoop.fs.Path(out.inputFiles()[0]).getParent()
        assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))
        return out

    for module in (simhash, stars):
        monkeypatch.setattr(module, "materialize", noted)
    rows = [(i, f"one two three four five six seven eight nine ten {i // 3 if i % 3 else 'x'}") for i in range(60)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1)
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 60 and any("Join" in p for p in seen) and not any("BroadcastExchange" in p for p in seen)


def simhash_hex(value):
    return f"{value & (1 << 64) - 1:016x}"
