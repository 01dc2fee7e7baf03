"""Vectorised word and hash kernels over Arrow string buffers.

All functions work on a flat uint8 array plus document offsets, so a batch of
documents is handled by a few numpy passes. Texts are never cut: a slice of a
batch always holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_RAND = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) | U64(1)
#: Bytes of text handled by one numpy pass; bounds the memory of a worker.
SLICE_BYTES = 1 << 20

_pow_cache: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow_cache[0]) < n:
        size = max(n, SLICE_BYTES * 5 // 4)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, U64(base))
            p[0] = 1
            _pow_cache[k] = np.multiply.accumulate(p)
    return _pow_cache[0][:n], _pow_cache[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte -> 0 for a separator, else the byte (A-Z lowered when asked)."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: words are [^\x20\x09-\x0D]+ ; NUL counts as a word character, so it is kept apart from 0.
WORD_RAW = byte_table(SPACES, lower=False)
WORD_LOWER = byte_table(SPACES, lower=True)
#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered.
WORD_ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


@dataclass
class Text:
    """A slice of whole documents: bytes, offsets, and the rows they came from."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Text]:
    """Runs of whole documents of about ``limit`` bytes (one longer document is one run)."""
    data, off = flat(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield Text(data[off[a] : off[b]], off[a : b + 1] - off[a], a)
        a = b


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    norm: np.ndarray
    first: np.ndarray  # of each document: index of its first word; one more at the end

    def key(self, i: int, j: int) -> bytes:
        """The normalised words i..j-1 joined by one space."""
        return b" ".join(self.norm[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def words(t: Text, table: np.ndarray) -> Words:
    norm = table[t.data]
    is_sep = np.ones(256, bool)
    is_sep[np.flatnonzero(table)] = False
    if table[0] == 0 and table is not WORD_ALNUM:
        is_sep[0] = False  # NUL is a word character of the white-space tables
    inside = ~is_sep[t.data]
    n = len(inside)
    s, e = inside.copy(), inside.copy()
    if n:
        s[1:] &= ~inside[:-1]
        e[:-1] &= ~inside[1:]
        cut = t.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        s[cut] = inside[cut]
        e[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    first = np.searchsorted(start, t.offsets)
    doc = np.repeat(np.arange(len(t)), np.diff(first))
    return Words(start, end, doc, norm, first)


def prefix_hash(norm: np.ndarray) -> np.ndarray:
    """P with P[i] = hash of the first i bytes; differences give hashes of substrings."""
    up, _ = _powers(len(norm) + 1)
    p = np.zeros(len(norm) + 1, U64)
    np.cumsum(_RAND[norm] * up[:-1], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(p))
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(U64))


def run_hash(p: np.ndarray, k: int) -> np.ndarray:
    """span_hash of every k bytes in a row."""
    n = len(p) - k
    _, inv = _powers(len(p))
    return mix((p[k:] - p[:-k]) * inv[:n] + U64(k)) if n > 0 else np.empty(0, U64)


def word_hash(w: Words) -> np.ndarray:
    return span_hash(prefix_hash(w.norm), w.start, w.end)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes (also across documents; callers mask those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, U64(k))
    c = 1
    for j in range(k):
        c = c * 0xD6E8FEB86659FD93 + 2 * j + 1 & (1 << 64) - 1 | 1
        out += h[j : j + n] * U64(c)
    return mix(out)


def same_doc(doc: np.ndarray, k: int) -> np.ndarray:
    n = len(doc) - k + 1
    return doc[: max(n, 0)] == doc[k - 1 :] if n > 0 else np.empty(0, bool)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean cover of [0, n) by the half-open intervals."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    x = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(x == 1), np.flatnonzero(x == -1)
