"""Windows against the tokenizers library, packing against a plain search for the tightest window."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(lengths, capacity):
    room, out = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            out.append(min(fits))
            room.append(min(fits) - n)
        else:
            out.append(capacity)
            room.append(capacity - n)
    return out


def test_the_tree_takes_the_tightest_window():
    rnd = random.Random(2)
    for capacity in (1, 7, 64, 100):
        for _ in range(60):
            lengths = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))), reverse=True)
            _, offset = packing.best_fit(lengths, capacity)
            assert [capacity - o for o in offset] == plain(lengths, capacity)


def test_every_id_lies_in_one_piece_and_windows_hold(spark):
    rnd, tok = random.Random(4), Tokenizer.from_file(PATH)
    texts = [None, "", " ", "a  b \n", "<|endoftext|> x  <|endoftext|>"] + ["".join(rnd.choices(["the ", "xyz", "\n", "é "], k=rnd.randint(1, 900))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as start", "2 as sequence_id")
    windows = packing.cut_windows(docs.where("doc_id <> 7 or doc_id is null"), PATH, 128)
    out = packing.pack(windows, 128, group=20).collect()
    of = {}
    for r in out:
        of.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if i == 7:
            continue
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(of[i], key=lambda r: r.start)
        assert memoryview(b"".join(bytes(r.ids) for r in got)).cast("I").tolist() == want
        assert [r.start for r in got] == [128 * k for k in range(len(got))] and {r.doc_tokens for r in got} == {len(want)}
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(s == [(0, 128)] for k, s in sequences.items() if k >= packing.FULL)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 128
    assert packing.pack(packing.cut_windows(docs.limit(0), PATH)).count() == 0
    twice = packing.pack(packing.cut_windows(docs.where("doc_id = 7"), PATH, 128), 128).collect()
    assert len(twice) == 2 * len({r.start for r in twice})


def test_null_and_repeated_ids_are_dealt_to_all_groups(spark):
    rows = [(None, 0, 50)] * 1000 + [(7, 0, 60)] * 1000 + [(i, 0, 128) for i in range(200)]
    windows = spark.createDataFrame(rows, "doc_id long, start long, length long")
    out = packing.pack(windows, 128, group=100).collect()
    sizes = {}
    for r in out:
        if r.length < 128:
            sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(out) == 2200 and len(sizes) == 20 and max(sizes.values()) < 200
    assert len({r.sequence_id for r in out if r.length == 128}) == 200


def test_very_long_texts_of_one_kind(spark):
    library, n = Tokenizer.from_file(PATH), 300_000
    from tidemark.llm.tokens import encoder

    for part, end in ((" ", ""), (" ", "x"), ("\n", "x y"), ("\n", ""), (" \n\t", "é"), ("a", ""), ("-", " "), ("\u3000", "b"), ("\x1c", "")):
        text = "begin" + part * n + end + part * 20_000 + "done"
        assert encoder(PATH).one(text).tolist() == library.encode(text, add_special_tokens=False).ids, part
    for part in (" ", "\n", "a", "-"):
        text = part * 5_000_000
        ids = encoder(PATH).one(text)
        assert library.decode(ids.tolist(), skip_special_tokens=False) == text
    docs = spark.createDataFrame([(1, " " * 2_000_000), (2, "\n" * 2_000_000 + "x")], "doc_id long, text string")
    out = packing.pack(packing.cut_windows(docs, PATH))
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").sum("length").toDF("doc_id", "n").collect()} == {1: 2_000_001, 2: len(encoder(PATH).one("\n" * 2_000_000 + "x")) + 1}
