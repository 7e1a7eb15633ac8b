"""What the queries return, column by column, against brute force over a small table with odd rows."""

import hashlib
import random
import re
import zlib
from array import array

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from tidemark.llm import queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    out = [(r["doc_id"], r["text"]) for r in table]
    parts = ["password", "Secret", "api_key", "=", ": ", " ", "'", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "eyJhbGci.eyJzdWIi.sig", "é", "😀", "\n", "<|endoftext|>"]
    out += [(1000 + n, "".join(rnd.choices(parts, k=rnd.randint(0, 25)))) for n in range(80)]
    base = [rnd.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(rnd.randint(0, 30)) for _ in range(300)]
    out += [(2000 + n, " ".join(base[:150] + [f"x{n}"] + base[151:])) for n in range(12)]
    return out + [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "One"), (3004, "one "), (3005, "a b \x1c c"), (3006, "word " * 9000), (3007, " " * 30_000), (5, out[0][1])]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("contracts")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def by_text(rows, of):
    return sorted((i, *of(t or "")) for i, t in rows)


def test_op1(spark, rows, folder):
    rules = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]

    def want(text):
        found = sorted((m.start(), n, kind, m.end()) for n, (kind, p, g, least) in enumerate(rules) for m in p.finditer(text) if len(m.group(g)) >= least)
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        every = ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.scan(text))
        return *[sum(f[2] == k for f in found) for k in ("assign", "access", "hex")], hashlib.sha256(base.encode()).hexdigest(), every

    out = queries.op1_secret_scans(spark, folder).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out) == by_text(rows, want)


def test_op3(spark, rows, folder):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        sums = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for bit in range(64):
                sums[bit] += h >> bit & 1
        return sum(1 << bit for bit in range(64) if 2 * sums[bit] > len(shingles))

    prints = [fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(rows)):
        for a in range(b):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(i, least.get(find(n), i))
    want = sorted((i, f"{prints[n]:016x}", least[find(n)]) for n, (i, _) in enumerate(rows))
    out = queries.op3_simhash(spark, folder).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == want and len({w[2] for w in want}) < len(want)


def test_op4(spark, rows, folder):
    out = queries.op4_sharding(spark, folder).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == by_text(rows, lambda t: (len(t.encode()) + 1, zlib.crc32(t.encode())))
    slots, sizes = {}, {}
    for r in out:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(r.size for r in out)


def test_op5_and_op7(spark, rows, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = lambda t: library.encode(t, add_special_tokens=False).ids
    want = []
    for i, t in rows:
        ids = ids_of(t or "") + [0]
        want += [(i, at, len(ids[at : at + 1024]), zlib.crc32(array("I", ids[at : at + 1024]).tobytes()), len(ids)) for at in range(0, len(ids), 1024)]
    out = queries.op5_packing(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    counts = queries.op7_token_counts(spark, folder).groupBy("doc_id").sum("n_tokens").collect()
    total = {}
    for i, t in rows:
        total[i] = total.get(i, 0) + len(ids_of(t or ""))
    assert {r[0]: r[1] for r in counts} == total


def test_op10(spark, rows, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def want(text):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    out = queries.op10_bpe(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == by_text(rows, want)


def test_op6_on_held_out_labels(spark):
    path = SF.replace("0.001", "0.01")
    toxic = {}
    for r in pq.read_table(f"{path}/labels.parquet").to_pylist():
        toxic[r["doc_id"]] = max(r["toxic"] or 0, toxic.get(r["doc_id"], 0))
    out = queries.op6_toxicity(spark, path).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [(r.score, toxic[r.doc_id]) for r in out if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert len(good) >= 3 and sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.9 * len(good) * len(bad)
