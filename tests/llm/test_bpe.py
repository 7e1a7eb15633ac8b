"""The transducer against the tokenizers library, whole and in small pieces."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "23", "é", "ß", "中", "文", "😀", "<|endoftext|>", "<|", "-", "----", " ", "　", "\x1c", "\x85", "ing", "er", "ſ", "²", "́", "\x00", "aaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def mine(text):
    return memoryview(b"".join(bpe.codec(PATH).encode(text))).cast("I").tolist()


def test_random_texts_have_the_librarys_ids(library):
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choices(PARTS, k=rnd.randint(0, 14)))
        assert mine(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("parts", [["a", "th", "ing"], ["-", "=", "*"], [" ", "\n"], ["0", "12"], ["é", "中", "a"], ["a"], ["'", "r", "e", " "]])
def test_feeds_of_any_size_give_the_same_ids(library, parts, monkeypatch):
    monkeypatch.setattr(bpe, "OPEN", 20)
    rnd, v = random.Random(5), bpe.codec(PATH).v
    for size in (0, 1, 7, 60, 700, 3000):
        text, machine, out, at = "".join(rnd.choices(parts, k=size)), bpe.StreamEncoder(v), b"", 0
        while at < len(text):
            step = rnd.choice([1, 3, 17, 400])
            out += machine.feed(text[at : at + step])
            at += step
        assert memoryview(out + machine.finish()).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_stream_keeps_a_bounded_window():
    v = bpe.codec(PATH).v
    word, most, rnd = bpe.Word(v), 0, random.Random(1)
    for _ in range(20_000):
        word.push(rnd.choice([b"th", b"e", b"ing", b"xq", b"\xc3"]))
        most = max(most, len(word.tail))
    assert most <= 5 * v.longest + v.lookahead()


def test_what_the_lookahead_lets_out_no_later_byte_changes():
    """All back-pointer chains that a later encoding can run through share the tokens that `stable` bytes follow."""
    v = bpe.codec(PATH).v
    for parts in ([b"a"], [b"-", b"="], [b"th", b"e", b"ing", b"er"], [b"\xc3", b"\x82"], [b"0", b"00"], [b"\xc3\x83", b"\xc3\x82"]):
        rnd, word = random.Random(7), bpe.Word(v)
        word._step(b"".join(rnd.choices(parts, k=4000))[:3000])
        chains = []
        for end in range(3000 - v.longest + 1, 3001):
            at, cuts = end, set()
            while at > 0:
                cuts.add(at)
                at -= len(v.bytes_of[word.last[at]])
            chains.append({c for c in cuts if c <= 3000 - v.stable})
        assert all(c == chains[0] for c in chains)


def test_decoder_takes_characters_apart_and_marks_what_is_not_utf8(library):
    v = bpe.codec(PATH).v
    for ids in ([], [222], [447, 247, 12, 222, 222], [50256, 262], [v.ids[b"\xe4"], v.ids[b"\xb8"], v.ids[b"a"]]):
        machine = bpe.StreamDecoder(v)
        assert "".join(machine.feed([i]) for i in ids) + machine.finish() == library.decode(ids, skip_special_tokens=False)


def test_operator_on_odd_rows(spark, library):
    text = "x" * 30_000 + " end"
    rows = [(1, "some  text\n"), (1, "some  text\n"), (2, None), (None, ""), (3, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as decoded")
    out = bpe.round_trip(docs, PATH).collect()
    assert sorted(r.decoded for r in out) == sorted(t or "" for _, t in rows)
    assert {bytes(r.ids) for r in out if r.doc_id == 1} == {b"".join(i.to_bytes(4, "little") for i in library.encode("some  text\n").ids)}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    encoded = bpe.encode(docs, PATH)
    assert sorted(r.text for r in bpe.decode(encoded, PATH).collect()) == sorted(t or "" for _, t in rows)
