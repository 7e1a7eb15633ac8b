"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

Encoding. A prefix of a stream has exactly one BPE encoding, and every prefix of an encoding is the encoding of the
bytes that it covers. So one number for each stream position is state enough: the last token of the encoding of the
prefix that ends there. It is the only vocabulary token t ending there that may stand after the last token of the prefix
before t; two tokens may stand side by side iff the merge list, applied to their joint bytes, leaves the seam uncut by
any merge. Merges can reach back only through a chain of overlapping rules of rising rank; lookahead() computes from the
merge list how many bytes such a chain spans at most. A token is final ("stable") and is emitted once as many bytes
follow it. Memory is the window of these bytes, whatever the length of the stream.

Decoding. Token bytes go through an incremental UTF-8 automaton; invalid sequences become U+FFFD as they are found.
"""

from __future__ import annotations

import codecs
import functools
import json
from array import array
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Memo, map_rows, pieces, schema_of, text_rows

#: The pre-tokenization pattern and the byte-to-character table of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Stands before the first token of a stream; any token may follow it.
START = 1 << 23
#: Longest contraction or context that a match can depend on after its end.
CONTEXT = 3
#: Characters of an unfinished match that are held back before they are passed on as an open run.
OPEN = 1024
#: Entries of a generation of a memo: of pre-tokens (some 200 bytes each), and of pairs of tokens.
MEMO, PAIRS = 500_000, 250_000
#: Pieces above this length go through the stream and aren't kept in the memo.
MEMO_PIECE = 64


def byte_characters() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_characters()
        if spec.get("normalizer") or model.get("ignore_merges") or (spec.get("pre_tokenizer") or {}).get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {t: bytes(of[c] for c in t) for t, i in model["vocab"].items() if t not in self.special}
        self.ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = model["vocab"][a], model["vocab"][b]
            self.rank[pair] = n
            self.parts[model["vocab"][a + b]] = (n, *pair)
        self.longest = max(map(len, self.ids))
        self.stable = self.lookahead()
        self._automaton()
        self.right = {i: self._spine(i, 2) for i in self.ids.values()}
        self.left = {i: self._spine(i, 1) for i in self.ids.values()}
        self.pairs = Memo(PAIRS)
        self.spaced, self.plain, self.now = Memo(MEMO), Memo(MEMO), Word(self)

    def word(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        if piece[0] == " " and len(piece) > 1:
            memo, key = self.spaced, piece[1:]
        else:
            memo, key = self.plain, piece
        found = memo.get(key) or memo.recall(key)
        if found is None:
            found = self.fresh(piece)
            if len(key) <= MEMO_PIECE:
                memo.keep(key, found)
        return found

    def fresh(self, piece: str) -> bytes:
        """The same, without a look at the memo."""
        now = self.now
        return array("I", now.push(piece.encode()) + now.end()).tobytes()

    def _automaton(self) -> None:
        """A suffix automaton over the tokens: a state is the longest part of a token that the bytes so far end with.

        move: state * 256 + byte -> state (other moves follow the fall-back states and are kept once found);
        ending: state -> (token, -length) of all tokens that the bytes so far end with, the longest first.
        """
        move, token_at, children = {}, {}, {0: []}
        for b, i in sorted(self.ids.items()):
            state = 0
            for x in b:
                nxt = move.get(state << 8 | x)
                if nxt is None:
                    nxt = move[state << 8 | x] = len(children)
                    children[nxt] = []
                    children[state].append((x, nxt))
                state = nxt
            token_at[state] = (i, -len(b))
        self.move, self.fall, self.ending, level = move, [0] * len(children), [()] * len(children), [0]
        while level:
            after = []
            for state in level:
                for x, child in children[state]:
                    back = self.fall[state]
                    while back and back << 8 | x not in move:
                        back = self.fall[back]
                    self.fall[child] = move[back << 8 | x] if state else 0
                    self.ending[child] = ((token_at[child],) if child in token_at else ()) + self.ending[self.fall[child]]
                    after.append(child)
            level = after
        self.trie_moves, self.most_moves = len(move), len(move) + PAIRS

    def step(self, state: int, byte: int) -> int:
        """The move of a state that isn't in move yet."""
        found = state
        while (nxt := self.move.get(found << 8 | byte)) is None:
            found = self.fall[found]
        if len(self.move) < self.most_moves:
            self.move[state << 8 | byte] = nxt
        return nxt

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token while it grows, from its byte up: (token, rank of the merge that absorbs it)."""
        found, absorbed = [], 1 << 60
        while True:
            found.append((token, absorbed))
            if token not in self.parts:
                return found[::-1]
            absorbed = self.parts[token][0]
            token = self.parts[token][side]

    def lookahead(self) -> int:
        """Bytes after which a token boundary can't change any more.

        A merge across a seam needs a rule whose left part ends there; its effect travels on only through rules of
        higher rank, each longer than what it absorbs. The longest chain of rules (by rank) in which each one's result
        is a part of the next gives the number of merges, and no token is longer than longest.
        """
        depth = {i: 0 for i in self.ids.values()}
        for token, (_, a, b) in sorted(self.parts.items(), key=lambda x: x[1][0]):
            depth[token] = 1 + max(depth[a], depth[b])
        return (1 + max(depth.values())) * self.longest

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is [a, b].

        Both edges grow by their own merges in rank order; the seam is merged if a rule joins the two edges of a
        moment before either is absorbed (of equal ranks the one further left is applied first).
        """
        key = a << 24 | b
        if (found := self.pairs.recall(key)) is None:
            self.pairs.keep(key, found := a == START or self._seam(a, b))
        return found

    def _seam(self, a: int, b: int) -> bool:
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            rule = self.rank.get((x, y))
            if rule is not None and rule < x_until and rule <= y_until:
                return False
            if x_until == y_until == 1 << 60:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


class Word:
    """One pre-token's bytes as a stream: push() bytes, get the tokens that have become stable; end() gives the rest.

    last[n] is the last token of the encoding of the first n bytes of tail.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.tail, self.last, self.state = vocabulary, b"", [START], 0

    def push(self, data: bytes) -> list[int]:
        """Tokens that no later byte can change."""
        out = []
        for at in range(0, len(data), self.v.longest):
            self._step(data[at : at + self.v.longest])
            if len(self.tail) >= self.v.stable + 4 * self.v.longest:
                out += self._settle()
        return out

    def _step(self, data: bytes) -> None:
        """Find the last token of each new prefix: of the tokens that end there just one fits its own predecessor."""
        v, last, state = self.v, self.last, self.state
        self.tail += data
        move, pairs, ending, fits, append = v.move.get, v.pairs.get, v.ending, v.side_by_side, last.append
        for byte in data:
            if (nxt := move(state << 8 | byte)) is None:
                nxt = v.step(state, byte)
            state = nxt
            for token, back in ending[state]:
                before = last[back]
                known = pairs(before << 24 | token)
                if known or known is None and fits(before, token):
                    break
            append(token)
        self.state = state

    def _settle(self) -> list[int]:
        """Emit the tokens that `stable` bytes follow, and forget their bytes."""
        v, end = self.v, len(self.tail)
        limit = end - v.stable
        while end > limit:
            end -= len(v.bytes_of[self.last[end]])
        if end <= 0:
            return []
        out = self._chain(end)
        # What follows must know its predecessor: the last stable token stays as the window's first.
        keep = end - len(v.bytes_of[out[-1]])
        held = out.pop()
        self.tail, self.last = self.tail[keep:], self.last[keep:]
        assert self.last[len(v.bytes_of[held])] == held
        return out

    def _chain(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.last[end])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]

    def end(self) -> list[int]:
        out = self._chain(len(self.tail))
        self.tail, self.last, self.state = b"", [START], 0
        return out


class StreamEncoder:
    """Text in, ids out (little-endian unsigned 32-bit integers), in pieces of any size: feed() text, then finish().

    Matches of the pre-tokenizer pass on once CONTEXT characters follow them; a match that stays open for over OPEN
    characters goes to its Word as it comes. Special tokens are cut out by the caller (Codec.segments).
    """

    _match = regex.compile(PATTERN)
    _more = {k: regex.compile(p) for k, p in (("L", r"\p{L}*"), ("N", r"\p{N}*"), ("O", r"[^\s\p{L}\p{N}]*"), ("S", r"\s*"))}

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held, self.open, self.run = vocabulary, "", "", None

    def feed(self, text: str) -> bytes:
        out = []
        self.held += text
        if self.open:
            out.append(self._go_on())
            if self.open:
                return out[0]
        at, size = 0, len(self.held)
        for m in self._match.finditer(self.held):
            if m.end() > size - CONTEXT:
                break
            out.append(self.v.word(m.group()))
            at = m.end()
        self.held = self.held[at:]
        if len(self.held) > OPEN:
            space = self.held[0] == " " and not self.held[1].isspace()
            self.open = next(k for k in "LNSO" if self._more[k].match(self.held[space]).end())
            self.run = Word(self.v)
            if space:
                self.run.push(b" ")
                self.held = self.held[1:]
            out.append(self._go_on())
        return b"".join(out)

    def _go_on(self) -> bytes:
        """Pass on what surely belongs to the open run; its last characters wait for what follows them."""
        end = self._more[self.open].match(self.held).end()
        over = end < len(self.held)
        if over:  # of white space the last character may belong to the next word
            end -= self.open == "S" and end > 1
        else:
            end = max(0, end - CONTEXT)
        out = self.run.push(self.held[:end].encode())
        self.held = self.held[end:]
        if over:
            out += self.run.end()
            self.open, self.run = "", None
        return array("I", out).tobytes()

    def finish(self) -> bytes:
        if self.open:
            out = array("I", self.run.push(self.held.encode()) + self.run.end()).tobytes()
        else:
            out = b"".join(map(self.v.word, self._match.findall(self.held)))
        self.held, self.open, self.run = "", "", None
        return out


class StreamDecoder:
    """Token ids in, text out, in pieces of any size; a character comes out with its last byte."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.v.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    #: Characters, words and ids that go through the machines at a time.
    FEED, WORDS, IDS = 1 << 16, 1 << 14, 1 << 15

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary text and the special token after it."""
        at = 0
        for m in self.special.finditer(text) if self.special and any(s in text for s in self.v.special) else ():
            yield text[at : m.start()], self.v.special[m.group()]
            at = m.end()
        yield text[at:], None

    def _stream(self, text: str) -> Iterator[bytes]:
        machine = StreamEncoder(self.v)
        for at in range(0, len(text), self.FEED):
            yield machine.feed(text[at : at + self.FEED])
        yield machine.finish()

    def _spaced(self, piece: str) -> bytes:
        """A piece that stands after a space and isn't in the memo's present generation."""
        memo = self.v.spaced
        found = memo.recall(piece)
        if found is None:
            text = " " + piece
            # Letters alone are one pre-token.
            found = self.v.fresh(text) if piece.isalpha() and len(piece) <= MEMO_PIECE else b"".join(self._stream(text))
            if len(piece) <= MEMO_PIECE:
                memo.keep(piece, found)
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, some at a time."""
        for part, special in self.segments(text):
            if part:
                first, *words = pieces(part)
                yield from self._stream(first)
                get, missing = self.v.spaced.get, self._spaced
                for at in range(0, len(words), self.WORDS):
                    yield b"".join([get(w) or missing(w) for w in words[at : at + self.WORDS]])
            if special is not None:
                yield special.to_bytes(4, "little")

    def decode(self, ids: bytes) -> Iterator[str]:
        machine, view = StreamDecoder(self.v), memoryview(ids).cast("I")
        for at in range(0, len(view), self.IDS):
            yield machine.feed(view[at : at + self.IDS])
        yield machine.finish()


@functools.cache
def codec(path: str) -> Codec:
    """One a worker process and vocabulary file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of each text.

    A null or empty text has no ids; repeated rows are encoded each; other columns of docs are left out.
    """
    rows = text_rows(docs, id_col, text_col)

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "ids": [b"".join(codec(path).encode(t)) for t in c["text"]]}

    return map_rows(rows, run, schema_of(rows, ["doc_id"], "ids binary"))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids (null: empty); bytes that aren't UTF-8 become U+FFFD."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "text": ["".join(codec(path).decode(i or b"")) for i in c["ids"]]}

    return map_rows(rows, run, schema_of(rows, ["doc_id"], "text string"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: encode() and decode() in one pass, without a second trip to the workers."""
    rows = text_rows(docs, id_col, text_col)

    def run(c: dict[str, list]) -> dict[str, list]:
        ids = [b"".join(codec(path).encode(t)) for t in c["text"]]
        return {"doc_id": c["doc_id"], "ids": ids, "decoded": ["".join(codec(path).decode(i)) for i in ids]}

    return map_rows(rows, run, schema_of(rows, ["doc_id"], "ids binary, decoded string"))
