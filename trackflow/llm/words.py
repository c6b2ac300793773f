"""Words and word sequences as 64-bit hashes, for many texts at once.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r. Its hash
is a polynomial in its bytes; the hash of a sequence is a polynomial in its mixed word
hashes, taken from running sums. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASE = 0xD6E8FEB86659FD93
LENGTH_STEP = 0xA0761D6478BD642F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1); the longest list asked for is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1024), base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


class Words:
    """The words of some texts in order: ``first[d]`` is the number of the first word of text ``d``."""

    def __init__(self, texts: list[bytes], bases: tuple[int, ...] = BYTE_BASES[:1]):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = ~_SPACE[buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]  # the last byte is a space
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.first = np.searchsorted(starts, begins)
        self.n = len(starts)
        self.starts, self.ends, self.buffer = starts, ends, buf
        if not self.n:
            self.hashes = [np.zeros(0, np.uint64) for _ in bases]
            return
        sizes = ends - starts
        at = np.cumsum(sizes) - sizes
        letters = buf[inside].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - np.repeat(at, sizes)
        longest = int(sizes.max())
        self.hashes = [mixed(np.add.reduceat(letters * powers(b, longest)[place], at)) for b in bases]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Sequences:
    """Hashes of word sequences from running sums over word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(WORD_BASE, n), out=self.sums[1:], dtype=np.uint64)
        self.back = powers(pow(WORD_BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """The hash of ``length`` words from each ``start``."""
        start = np.asarray(start, np.int64)
        length = np.asarray(length, np.int64)
        raw = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mixed(raw + length.astype(np.uint64) * np.uint64(LENGTH_STEP))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word numbers where a window of ``width`` words of one text begins."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first)) - width
    at = np.arange(n)
    return at[at <= last]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` words from one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0
