"""Token counts of fields or sections, from one encoding of the whole document.

A document is encoded once; the character spans of its tokens are joined with the intervals of its sections (both
ordered, so each join is a binary search over sorted starts). A token that crosses a boundary is allocated by a rule:

* "start": to the section that holds its first character,
* "end": to the section that holds its last character,
* "most": to the section with most of its characters, of equals the first,
* "share": to each section in proportion to its characters (counts become fractions).

Sections tile the document: a separator belongs to the section that it ends.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_rows, schema_of, text_rows
from tidemark.llm.tokens import encoder

RULES = ("start", "end", "most", "share")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section. bounds: the sections' starts, ascending from 0, and the document's end.

    The parts of a character that several tokens share count as tokens that span the whole character.
    """
    sections = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, sections - 1)
    last = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, 0, sections - 1)
    if rule == "start" or rule == "end":
        return np.bincount(first if rule == "start" else last, minlength=sections).astype(float)
    counts = np.bincount(first[first == last], minlength=sections).astype(float)
    for n in np.flatnonzero(first != last):
        span = np.arange(first[n], last[n] + 1)
        inside = np.minimum(bounds[span + 1], ends[n]) - np.maximum(bounds[span], starts[n])
        if rule == "share":
            counts[span] += inside / inside.sum()
        else:
            counts[span[np.argmax(inside)]] += 1
    return counts


def section_counts(docs: DataFrame, path: str, separator: str = r"\n", rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (from 0), start, end (code points, end exclusive), n_tokens, doc_tokens.

    Sections end after each match of separator; what follows the last one is a section too unless it is empty and
    others are there. A null or empty text has one empty section. Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    rows, ends_at = text_rows(docs, id_col, text_col), re.compile(separator)
    kind = "double" if rule == "share" else "long"
    names = ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"]

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in names}
        for doc, text, (a, b) in zip(c["doc_id"], c["text"], encoder(path).spans(c["text"])):
            bounds = [0, *(m.end() for m in ends_at.finditer(text) if m.end() > m.start())]
            if bounds[-1] < len(text) or len(bounds) == 1:
                bounds.append(len(text))
            counts = attribute(a, b, np.array(bounds), rule)
            out["doc_id"] += [doc] * len(counts)
            out["section"] += range(len(counts))
            out["start"] += bounds[:-1]
            out["end"] += bounds[1:]
            out["n_tokens"] += (counts if rule == "share" else counts.astype(int)).tolist()
            out["doc_tokens"] += [len(a)] * len(counts)
        return out

    return map_rows(rows, run, schema_of(rows, ["doc_id"], f"section int, start long, end long, n_tokens {kind}, doc_tokens long"))


def field_counts(rows: DataFrame, path: str, fields: list[str], glue: str = "\n", rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """doc_id, field, n_tokens: each row's fields, glued to one document that is encoded once.

    The glue belongs to the field before it; a null field is an empty one, and has no tokens of its own but the glue's.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    source = rows.select(F.col(id_col).alias("doc_id"), F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("parts"))
    kind = "double" if rule == "share" else "long"

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "field": [], "n_tokens": []}
        for doc, parts, (a, b) in zip(c["doc_id"], c["parts"], encoder(path).spans([glue.join(p) for p in c["parts"]])):
            sizes = [len(p) + len(glue) for p in parts]
            sizes[-1] -= len(glue)
            counts = attribute(a, b, np.cumsum([0, *sizes]), rule)
            out["doc_id"] += [doc] * len(fields)
            out["field"] += fields
            out["n_tokens"] += (counts if rule == "share" else counts.astype(int)).tolist()
        return out

    return map_rows(source, run, schema_of(source, ["doc_id"], f"field string, n_tokens {kind}"))
