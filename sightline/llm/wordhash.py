"""Words and word shingles of Arrow text batches as 64-bit hashes, computed with numpy over whole batches.

A word is a maximal run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z: ASCII letters and digits and all
characters beyond ASCII. In UTF-8 the latter are just the bytes from 0x80, so words can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import spans_of, text_buffer

SEPARATOR = 0
#: Bytes handled at once; bounds the memory of the arrays below at about 60 bytes for each.
CHUNK = 400_000


def _table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z":
            out[b] = b
        elif "A" <= c <= "Z":
            out[b] = b + 32
    return out


FOLD = _table()
_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = [int(x) | 1 for x in np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; those that a text beyond a chunk needs are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(max(n, CHUNK + 1), base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if n <= CHUNK + 1:
        _powers[:] = out
    return out[0], out[1]


@dataclass
class Words:
    """The words of rows lo..hi-1 of a batch, in order."""

    lo: int
    hi: int
    bytes: np.ndarray  # folded; SEPARATOR where no word is
    start: np.ndarray  # of each word in bytes
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray  # from lo
    first: np.ndarray  # index of each row's first word, and the number of words at the end
    total: np.ndarray  # running sums of which the hash of any stretch of bytes is made
    inverse: np.ndarray  # powers that move a stretch to the beginning

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the bytes a..b-1."""
        return mix((self.total[b] - self.total[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1, joined by a space."""
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


def words_of(column: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    return words_in(*text_buffer(column), chunk)


def words_in(raw: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, fold: np.ndarray = FOLD, separator: int = SEPARATOR) -> Iterator[Words]:
    """The words of texts that lie one after the other in `raw`: maximal runs of bytes that `fold` doesn't map to the separator."""
    for lo, hi in spans_of(offsets, chunk):
        a = fold[raw[offsets[lo] : offsets[hi]]]
        n, off = len(a), offsets[lo : hi + 1] - offsets[lo]
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = a != separator
        step = np.diff(inside)
        cuts = off[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # rows that touch within what looks like one word
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        power, inverse = _grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[a] * power[:n], out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, off, side="left")
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Words(lo, hi, a, start, end, h, row, first, total, inverse)


def joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` consecutive word hashes; the caller drops runs across rows."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += h[i : i + n] * np.uint64(_MIX[i % 64]) + (h[i : i + n] >> np.uint64(29 + i % 3)) * np.uint64(_MIX[(i + 31) % 64])
    return mix(out + np.uint64(size))


def shingles_of(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `size` words; a row with fewer words, but not none, has one run of them all."""
    h = joined(w.hash, size)
    keep = w.row[: len(h)] == w.row[size - 1 :] if len(h) else np.zeros(0, bool)
    h, row = h[keep], w.row[: len(keep)][keep]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([joined(w.hash[w.first[r] : w.first[r] + count[r]], int(count[r]))[0] for r in short], np.uint64)
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row
