"""Near copies by their shingles: candidates, the rest and the comparison against brute force."""

import random

import numpy as np

from tidemark.llm import simhash


def prose(rnd, n):
    return ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(n)]


def hashes(words):
    return np.unique(simhash.shingle_hashes([w.encode() for w in words], 5))


def jaccard(a, b):
    both = len(np.intersect1d(hashes(a), hashes(b)))
    return both / (len(hashes(a)) + len(hashes(b)) - both)


def edited(rnd, words, kind, k):
    at = rnd.randrange(len(words) - k)
    if kind == "block":
        return words[:at] + prose(rnd, k) + words[at + k :]
    if kind == "append":
        return words + prose(rnd, k)
    if kind == "truncate":
        return words[:-k]
    return [rnd.choice(prose(rnd, 1)) if rnd.random() < 0.02 else w for w in words]


def test_contiguous_edits_share_a_key():
    rnd = random.Random(8)
    for kind, share in (("block", 0.08), ("append", 0.2), ("truncate", 0.16), ("scattered", 0)):
        pairs = met = 0
        while pairs < 150:
            words = prose(rnd, rnd.randint(60, 600))
            copy = edited(rnd, words, kind, max(1, int(share * len(words))))
            if jaccard(words, copy) >= 0.8:
                pairs += 1
                met += bool(set(simhash.band_keys(hashes(words))) & set(simhash.band_keys(hashes(copy))))
        assert met == pairs, (kind, met)


def test_one_shared_key_is_a_meeting_whatever_else_a_document_meets(spark):
    nodes = spark.createDataFrame([(1, [10, 11, 12]), (2, [20, 21]), (3, [10, 11, 12, 20]), (4, [21, 30])], "id long, f array<long>")
    assert sorted(map(tuple, simhash._ends(simhash._shared(nodes)).collect())) == [(1, 3), (2, 3), (2, 4)]


def family(rnd, n):
    """Copies of a text, each with one block replaced: most pairs are below 0.8, and keys are shared by many."""
    base = prose(rnd, 200)
    out = []
    for _ in range(n):
        at = rnd.randrange(0, 170)
        out.append(base[:at] + prose(rnd, 20) + base[at + 20 :])
    return out


def brute_force(sets, least=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(sets)):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def test_families_whose_keys_are_shared_by_many_get_the_classes_of_brute_force(spark, monkeypatch):
    rnd = random.Random(21)
    sets = [hashes(w) for _ in range(8) for w in family(rnd, 30)]
    nodes = spark.createDataFrame([(i, simhash.band_keys(s)) for i, s in enumerate(sets)], "id long, f array<long>")

    def alike(pairs):
        kept = [(r.a, r.b) for r in pairs.collect() if (both := len(np.intersect1d(sets[r.a], sets[r.b]))) >= 0.8 * (len(sets[r.a]) + len(sets[r.b]) - both)]
        return spark.createDataFrame(kept, "a long, b long")

    def rest(open_docs):
        rows = [(r.id, r.root, len(sets[r.id]), int(h)) for r in open_docs.collect() for h in sets[r.id].view(np.int64)]
        pairs = simhash.rare_pairs(spark.createDataFrame(rows, "id long, root long, n long, h long"), 0.8)
        assert pairs.count() <= 10 * len(sets)  # of 3480 pairs in the families
        return pairs

    want = brute_force(sets)
    for run in (1024, 4):
        monkeypatch.setattr(simhash, "RUN", run)
        roots = {r.node: r.root for r in simhash._classes(simhash._shared(nodes), alike, rest).collect()}
        assert [roots.get(i, i) for i in range(len(sets))] == want


def test_rare_shingles_find_every_pair(spark):
    rnd = random.Random(3)
    for least in (0.8, 0.5):
        sets = [set(rnd.sample(range(25), rnd.randint(1, 20))) for _ in range(150)]
        rows = [(i, i % 7, len(s), h) for i, s in enumerate(sets) for h in s]
        got = set(map(tuple, simhash.rare_pairs(spark.createDataFrame(rows, "id long, root long, n long, h long"), least).collect()))
        near = {(a, b) for b in range(150) for a in range(b) if a % 7 != b % 7 and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        assert near and near <= got and all(a % 7 != b % 7 and a < b for a, b in got)


def test_a_pair_behind_the_first_and_the_one_before_is_compared(spark):
    nodes = spark.createDataFrame([(i, [7]) for i in range(1, 9)] + [(20, [8]), (21, [8])], "id long, f array<long>")
    alike = lambda pairs: pairs.where("(a = 2 and b = 6) or (a = 4 and b = 8) or a = 20")
    assert sorted(map(tuple, alike(simhash._ends(simhash._shared(nodes))).collect())) == [(20, 21)]

    def rest(open_docs):
        ids = sorted(r.id for r in open_docs.collect())
        assert ids == list(range(1, 9))
        return spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")

    assert sorted(map(tuple, simhash._classes(simhash._shared(nodes), alike, rest).collect())) == [(6, 2), (8, 4), (21, 20)]


def test_long_texts_next_to_the_limit_fall_on_the_right_side(spark):
    rnd = random.Random(5)
    rows, want = [], set()
    for n in range(30):
        words = prose(rnd, 804)  # 800 shingles; 200 more make 0.8, 206 more 0.795
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words + prose(rnd, 200 if n % 2 else 206)))]
        want |= {2 * n + 1} if n % 2 else set()
    out = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.component_id != r.doc_id} == want
