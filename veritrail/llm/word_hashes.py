"""Words of many texts at once, as positions in one byte array and as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .batches import kept

_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))

#: Bytes of words stay (A-Z in lower case), all others become spaces. Bytes from 0x80 on belong to characters that are
#: words' characters too, so the class of characters can be told byte by byte.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: Places of which the powers are kept.
KEPT = 1 << 22


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept while the operator that reads words has its turn, but not for a very long text."""
    held = kept(("word_hashes",), list)
    if held and len(held[0]) >= n:
        return held[0][:n], held[1][:n]
    both = []
    for base in (_PRIME, _INVERSE):
        p = np.full(max(n, 5 << 18), base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    if n <= KEPT:
        held[:] = both
    return both[0][:n], both[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of some texts: ``raw`` bytes, ``start``/``stop`` of each word in it, its hash, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join([*texts, b""]).translate(TABLE)
        a = np.frombuffer(self.raw, np.uint8)
        inside = np.zeros(len(a) + 1, np.int8)
        inside[1:] = a != 0x20
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.stop = np.flatnonzero(edge == -1)  # the array ends in a space, so every word ends in it
        power, inverse = _upto(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
        self.hash = mixed((total[self.stop] - total[self.start]) * inverse[self.start])
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)

    def word(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.stop[k]]

    def joined(self, k: int, n: int) -> bytes:
        return b" ".join([self.word(j) for j in range(k, k + n)])


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from each word on."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out) + h[k : len(h) - n + 1 + k] * np.uint64(2 * k + 3)
    return out
