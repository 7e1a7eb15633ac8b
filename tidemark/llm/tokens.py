"""Token ids and character offsets of byte-level BPE files, as the tokenizers library gives them.

The file's merges are run by tiktoken's core, which takes a third of the library's time for the same ids: a token's rank
in that core is its id, which is right for files whose ids follow the order of the merges (checked on loading).
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import regex
import tiktoken

from tidemark.llm.bpe import PATTERN, Vocabulary


def _by_rank(path: str) -> Vocabulary | None:
    """The vocabulary if ranks can stand for ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        return None
    v = Vocabulary(path)
    made = [spec["model"]["vocab"][("".join(m) if isinstance(m, list) else m.replace(" ", ""))] for m in spec["model"]["merges"]]
    return v if made == sorted(made) else None


#: Runs of white space that the core's pattern search would follow too deep; each is one pre-token, but that its last
#: character may belong to the next one.
LONG_SPACE = regex.compile(r"\p{White_Space}{10000,}+")


class Encoder:
    """Ids and character spans by one vocabulary file."""

    def __init__(self, path: str):
        v = _by_rank(path)
        if v is None:
            raise ValueError("only byte-level BPE files whose ids follow the merges are supported")
        self.special = v.special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens={})
        self.size = np.zeros(max(v.bytes_of) + 1, np.int64)
        for i, b in v.bytes_of.items():
            self.size[i] = len(b)

    def one(self, text: str) -> array:
        """Ids of a text, special tokens' strings as these tokens."""
        out = array("I")
        for n, part in enumerate(self.cut.split(text) if self.special and any(s in text for s in self.special) else [text]):
            out.extend([self.special[part]] if n % 2 else self._plain(part))
        return out

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if len(text) < 10_000:
            return self.core.encode_ordinary(text)
        out, at = [], 0
        for m in LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self.core.encode_ordinary(text[at : m.start()]) + self.core._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.core.encode_ordinary(text[at:])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self.one(t).tobytes() for t in texts]

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Start and end (exclusive) of each token of each text in characters; parts of one character share its span."""
        out = []
        for t in texts:
            ends = np.cumsum(self.size[np.frombuffer(self.one(t), np.uint32)]) if t else np.zeros(0, np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            if not t.isascii():
                character = np.cumsum(np.frombuffer(t.encode(), np.uint8) & 0xC0 != 0x80) - 1
                starts, ends = character[starts], character[ends - 1] + 1
            out.append((starts, ends))
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(path)
