"""Words of raw UTF-8 buffers and their fingerprints, a whole block of texts at a time."""

from __future__ import annotations

import numpy as np

from .bytehash import MULT_A, MULT_B, SHIFT, U64

#: Byte tables of the two word definitions.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
ALNUM[0x41:0x5B] = True  # A-Z are lower-cased first
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SALT = U64(0xD6E8FEB86659FD93)


def word_table(data: np.ndarray, starts: np.ndarray, is_word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each word's begin, end and hash (A-Z lower-cased), and the number of words before each text.

    A text ends any word, as if a blank followed it."""
    is_word = is_word_byte[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], is_word])
    after = np.concatenate([is_word, [False]])
    begins = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    if not len(begins):
        return begins, ends, np.zeros(0, U64), np.searchsorted(begins, starts)
    lengths = ends - begins
    low = LOWER[data]
    # eight bytes a step: word k's next eight bytes, those past its end masked away
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = low
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    h = lengths.astype(U64) * SALT
    todo, at = np.arange(len(begins)), begins.copy()
    while len(todo):
        rest = ends[todo] - at
        chunk = np.ascontiguousarray(eight[at]).view("<u8").ravel()
        short = rest < 8
        chunk[short] &= (U64(1) << (rest[short] * 8).astype(U64)) - U64(1)
        g = (h[todo] ^ chunk) * MULT_A
        g ^= g >> SHIFT
        h[todo] = g * MULT_B
        more = rest > 8
        todo, at = todo[more], at[more] + 8
    h ^= h >> SHIFT
    return begins, ends, h, np.searchsorted(begins, starts)


def roll(hashes: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint of each ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * MULT_A
        out ^= out >> SHIFT
    return out
