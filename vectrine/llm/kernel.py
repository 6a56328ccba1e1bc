"""Vectorised text kernel: Arrow string buffers to word hashes, without a Python loop over words.

A word is a maximal run of Unicode letters and digits, lower-cased by the simple
one-to-one mapping. Its hash is a polynomial over code points modulo 2**64, mixed
by the finaliser of splitmix64, so that SQL can restate it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 1_000_003
#: One more than the last code point.
TOP = 0x110000
U64 = np.uint64
#: Bytes of text that are worked on at once; a longer document is worked on alone.
BLOCK_BYTES = 1 << 20


@lru_cache(None)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code point, is a letter or digit) by code point."""
    kinds = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "No"))
    word, lower = np.zeros(TOP, bool), np.arange(TOP, dtype=np.uint32)
    for plane in range(0, TOP, 1 << 16):
        every = "".join(map(chr, range(plane, plane + (1 << 16))))
        if re.search(r"[^\W_]", every):  # most planes have nothing assigned
            word[plane : plane + (1 << 16)] = [k in kinds for k in map(unicodedata.category, every)]
            folded = every.lower()
            if len(folded) != len(every):
                folded = "".join(x if len(x := c.lower()) == 1 else c for c in every)
            lower[plane : plane + (1 << 16)] = list(map(ord, folded))
    return lower, word


@lru_cache(None)
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, U64)
    np.multiply.accumulate(np.full(n - 1, BASE, U64), out=out[1:])
    return out


def powers(longest: int) -> np.ndarray:
    return _powers(1 << max(6, int(longest).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_array(a: pa.Array) -> pa.Array:
    """Strings without nulls (null as empty) that are valid UTF-8."""
    a = a.fill_null("") if a.null_count else a
    if pa.types.is_large_string(a.type):
        a = a.cast(pa.string())
    return a


def blocks(a: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK_BYTES of text each."""
    off = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4) if len(a) else np.zeros(1, np.int32)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        yield i, j
        i = j


def code_points(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, offset of each text and the end)."""
    if not len(a):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    raw = a.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])).to_pybytes() if a.buffers()[2] is not None else b""
    off -= off[0]
    try:
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return code_points(pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(off, off[1:])], pa.string()))
    firsts = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return cp, firsts[off]


class Words:
    """Words of a block of texts: ``hash``, ``start`` and ``end`` in code points of the block, and
    ``first``: index of each text's first word, and the end. ``lower`` and ``at`` are the block's
    lower-cased code points and the texts' offsets in them."""

    def __init__(self, a: pa.Array) -> None:
        low_of, word_of = tables()
        cp, self.at = code_points(a)
        self.lower = low_of[cp]
        is_word = word_of[cp]
        n = len(cp)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        self.start = np.flatnonzero(is_word & (~before | edge[:n]))
        self.end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        lens = self.end - self.start
        if len(lens):
            begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
            pos = np.arange(int(lens.sum())) - np.repeat(begin, lens)
            value = self.lower[is_word].astype(U64) + U64(1)
            self.hash = mix(np.add.reduceat(value * powers(int(lens.max()) + 1)[pos], begin))
        else:
            self.hash = np.zeros(0, U64)
        self.first = np.searchsorted(self.start, self.at)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every run of n words inside one text, index of its first word)."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = np.zeros(m, U64)
        for k in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + self.hash[k : k + m]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        inside = np.flatnonzero(text[:m] == text[n - 1 :])
        return mix(h[inside]), inside

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of each text: (hash, count, index of each text's first and the end)."""
        return distinct(self.hash, self.first)


class Grams:
    """Runs of n words of a block of texts, in the place of its words."""

    def __init__(self, w: Words, n: int) -> None:
        self.hash, at = w.ngrams(n)
        self.first = np.searchsorted(at, w.first)

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return distinct(self.hash, self.first)


def distinct(hash_: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text: (hash, count, index of each text's first and the end)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(hash_, kind="stable")
    if len(first) > 2:
        order = order[np.argsort(text[order].astype(np.uint16 if len(first) < 65536 else np.int64), kind="stable")]
    h, t = hash_[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(t[at], np.arange(len(first)))


def weights(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)), exactly."""
    return np.frexp(count.astype(np.float64))[1].astype(np.float32)


def simhash_bits(w: Words | Grams, salts: tuple[int, ...]) -> np.ndarray:
    """Signed votes of weighted term hashes: a row of 64 * len(salts) bits for each text.

    Salt 0 votes with the word hash itself. A tie gives 0; a text without words gives zeros.
    """
    h, count, first = w.terms()
    n, wide = len(first) - 1, 64 * len(salts)
    out = np.zeros((n, wide), np.uint8)
    if not len(h):
        return out
    hashes = np.stack([h if s == 0 else mix(h + U64(s)) for s in salts], axis=1)
    weight = weights(count)
    step = 1 << 14
    for i in np.flatnonzero(np.diff(first)):
        votes = np.zeros(wide, np.float64)
        for a in range(first[i], first[i + 1], step):
            b = min(a + step, first[i + 1])
            bits = np.unpackbits(hashes[a:b].view(np.uint8), axis=1, bitorder="little")
            votes += weight[a:b] @ bits.astype(np.float32)
        out[i] = 2 * votes > weight[first[i] : first[i + 1]].sum(dtype=np.float64)
    return out
