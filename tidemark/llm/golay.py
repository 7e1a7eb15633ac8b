"""The perfect binary Golay code of 23 bits: every word lies within 3 bits of exactly one of its 4096 codewords."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Fixed value: the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, DATA = 23, 12


def remainder(word: int) -> int:
    """Of a polynomial over two elements, after division by the generator."""
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - (LENGTH - DATA)
    return word


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte in each of three places; the pattern of up to 3 bits that has each remainder."""
    parts = np.array([[remainder(b << 8 * place) if b << 8 * place < 1 << LENGTH else 0 for b in range(256)] for place in range(3)], np.uint32)
    leader = np.zeros(1 << LENGTH - DATA, np.uint32)
    for n in range(1, 4):
        for bits in combinations(range(LENGTH), n):
            pattern = sum(1 << b for b in bits)
            leader[remainder(pattern)] = pattern
    return parts, leader


def index(words: np.ndarray) -> np.ndarray:
    """The number (its 12 data bits) of the codeword next to each word of 23 bits."""
    parts, leader = _tables()
    words = words.astype(np.uint32)
    rest = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    return (words ^ leader[rest]) >> LENGTH - DATA


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codewords next to each word and next to what one flip of its lowest `bits` bits makes of it.

    Two arrays with a row for each word: numbers, ascending, and whether each is the first of its kind. There are six
    at most: a word that is 3 bits off its codeword is 4 bits off five others.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = np.sort(index(words.astype(np.uint32)[:, None] ^ flips), axis=1)
    return found, np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
