"""Attribution against the tokenizers library's offsets, token by token."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text, bounds, offsets, rule):
    counts = [0.0] * (len(bounds) - 1)
    for a, b in offsets:
        inside = [max(0, min(b, hi) - max(a, lo)) for lo, hi in zip(bounds, bounds[1:])]
        if rule == "start":
            counts[max(i for i in range(len(counts)) if bounds[i] <= a)] += 1
        elif rule == "end":
            counts[max(i for i in range(len(counts)) if bounds[i] <= max(b - 1, a))] += 1
        elif rule == "most":
            counts[inside.index(max(inside))] += 1
        else:
            for i, x in enumerate(inside):
                counts[i] += x / sum(inside)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, rule):
    rnd, tok = random.Random(7), Tokenizer.from_file(PATH)
    texts = [None, "", "\n", "a\n\n\n\nb", "é中\n😀 x", "no end"] + ["".join(rnd.choices(["the ", "\n", "\n\n  ", " ", "é", "xyz", "😀", "<|endoftext|>"], k=rnd.randint(1, 60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as section", "2 as n_tokens")
    out = {}
    for r in token_counts.section_counts(docs, PATH, rule=rule).collect():
        out.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        text = text or ""
        rows = sorted(out[i], key=lambda r: r.section)
        bounds = [rows[0].start, *[r.end for r in rows]]
        offsets = tok.encode(text, add_special_tokens=False).offsets
        assert bounds[0] == 0 and bounds[-1] == len(text) and "".join(text[r.start : r.end] for r in rows) == text
        assert [r.n_tokens for r in rows] == pytest.approx(plain(text, bounds, offsets, rule))
        assert {r.doc_tokens for r in rows} == {len(offsets)} and sum(r.n_tokens for r in rows) == pytest.approx(len(offsets))


def test_fields_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, "user", "hello  "), (1, "user", "hello  "), (2, None, None), (None, "a", "b")], "doc_id long, role string, text string")
    out = token_counts.field_counts(rows, PATH, ["role", "text"]).collect()
    assert len(out) == 8 and {r.field for r in out} == {"role", "text"}
    tok = Tokenizer.from_file(PATH)
    assert sum(r.n_tokens for r in out if r.doc_id == 1) == 2 * len(tok.encode("user\nhello  ").ids)
    assert token_counts.section_counts(rows.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_counts(rows, PATH, rule="other")
