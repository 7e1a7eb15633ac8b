"""Each stage on its own input: what must go goes, what must stay stays, columns keep."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from tidemark.llm import simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def classes_by_brute_force(rows):
    sets, root = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(900)]
    rows = []
    for n in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 250))]
        rows.append((10 * n, " ".join(words), "s"))
        for k in range(rnd.randint(0, 3)):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 1, 30])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((10 * n + k + 1, " ".join(copy), "s"))
    rows += [(9001, "", "s"), (9002, None, "s"), (9003, "one", "s"), (9004, "One ", "s")]
    out = p.near_dedup_stage(spark, frame(spark, rows), SF)
    assert out.columns == p.COLUMNS
    want = classes_by_brute_force(rows)
    got = {r.doc_id for r in out.collect()}
    assert got == want and {9001, 9003} <= got and not {9002, 9004} & got


def test_near_copies_are_found_by_their_golay_keys(spark, monkeypatch):
    """Without any band key: those within 3 bits go, also where only the rest of a class is alike."""
    rnd = random.Random(9)
    rows = []
    for n in range(25):
        words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]
        rows.append((10 * n, " ".join(words), "s"))
        for k in range(3):
            words[rnd.randrange(len(words))] = f"other{k}"
            rows.append((10 * n + k + 1, " ".join(words), "s"))
    rows += [(9001, "", "s"), (9002, None, "s"), (9003, "one", "s"), (9004, "One ", "s")]
    prints = {i: simhash.majority(simhash.shingle_hashes(simhash.words_of(t or ""), 5)) for i, t, _ in rows}
    root = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    want = {i for i in root if root[i] == i}
    assert len(rows) - len(want) >= 40
    described = simhash._described
    monkeypatch.setattr(simhash, "_described", lambda *a: described(*a).withColumn("f", F.array().cast("array<long>")))
    got = {r.doc_id for r in p.near_dedup_stage(spark, frame(spark, rows), SF).collect()}
    assert got <= want and classes_by_brute_force(rows) <= got


def test_fingerprints_alone_join_nothing_that_differs(spark):
    nodes = spark.createDataFrame([(1, b"a", 7, [5]), (2, b"b", 7, []), (3, b"c", 6, []), (4, b"d", 4, [5]), (9, b"e", -1, [])], "id long, words binary, print long, f array<long>")
    keyed, found = simhash.by_prints(nodes)
    assert {tuple(r) for r in found.collect()} >= {(1, 2), (1, 3), (3, 4), (1, 4)}
    keys = {r.id: r.f for r in keyed.collect()}
    assert len({keys[i][-1] for i in (1, 2, 3, 4)}) == 1 and keys[9][-1] != keys[1][-1] and keys[1][0] == keys[4][0] == 5
    alike = lambda pairs: pairs.where("a = 2 and b = 3")  # noqa: E731  behind the first one and the one before
    rest = lambda left: spark.createDataFrame([(2, 3)], "a long, b long") if left.count() == 4 else None
    assert [tuple(r) for r in simhash._classes(simhash._shared(keyed), alike, rest, found).collect()] == [(3, 2)]


def test_repeated_and_null_rows(spark):
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (None, "x", "s"), (None, None, "s")]
    assert sorted(map(str, (r.doc_id for r in p.near_dedup_stage(spark, frame(spark, rows), SF).collect()))) == ["1", "None", "None"]


def test_lines_and_secrets(spark):
    rows = [(i, f"own text {i}\nall rights reserved\nsecret = abcdefghijkl{i:04d}", "site") for i in range(40)] + [(100, None, "x"), (101, "", "x")]
    lines = p.line_dedup_stage(spark, frame(spark, rows), SF)
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == p.COLUMNS and len(got) == 42
    assert got[3].text == "own text 3\nsecret = abcdefghijkl0003" and got[3].n_chars == len(got[3].text) and got[100].text is None
    masked = {r.doc_id: r.text for r in p.secrets_stage(spark, lines, SF).collect()}
    assert masked[3] == "own text 3\n[secret]" and masked[100] is None and masked[101] == ""


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = p.toxicity_stage(spark, docs, SF)
    assert kept.columns == p.COLUMNS and docs.count() - kept.count() <= 3 * max(1, len(toxic)) + 5
    out = p.run(spark, SF).collect()
    t, by = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 1024 for s in by.values()) and len({r.doc_id for r in out}) <= docs.count()
    first = min((r for r in out if r.doc_tokens < 1024), key=lambda r: r.doc_id)
    text = next(r.text for r in docs.collect() if r.doc_id == first.doc_id)
    assert set(t.decode(memoryview(bytes(first.ids)).cast("I").tolist()[:-1]).split()) <= set(text.split()) | {"[secret]"}


def test_a_hot_group_of_near_copies_is_one_class_and_meets_in_few_pairs(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghijkl", k=rnd.randint(3, 8))) for _ in range(700)]
    base = [rnd.choice(vocabulary) for _ in range(180)]
    rows = []
    for n in range(400):
        copy = list(base)
        for _ in range(2):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        rows.append((n, " ".join(copy), "s"))
    docs = frame(spark, rows)
    classes = simhash.similar_classes(docs).collect()
    assert len(classes) == 400 and sum(r.component_id == 0 for r in classes) >= 396
    nodes = simhash._described(docs, 5, "doc_id", "text").selectExpr("doc_id as id", "f")
    assert simhash._ends(simhash._shared(nodes)).count() <= 25 * 400
