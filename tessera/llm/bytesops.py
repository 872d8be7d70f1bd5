"""Vectorised work on many UTF-8 texts at once: words, lines, rolling hashes.

A ``Block`` is a run of texts of one Arrow batch, laid end to end in one byte array. All
functions return flat arrays with the text's index beside, so that nothing loops over words.
A span's hash sums a keyed, mixed value of each eight bytes of it (``span_hash``): unlike a polynomial
modulo 2**64, it has no structured collisions. Rolling hashes of windows are such polynomials over a
random byte table; they only bring strings together, and decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(12, (n + 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Block:
    """Texts first..first+n-1 of a batch: bytes ``buf``; text i is buf[edges[i]:edges[i+1]]."""

    first: int
    buf: np.ndarray
    edges: np.ndarray

    @property
    def n(self) -> int:
        return len(self.edges) - 1

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The index of the text that holds byte position ``at``."""
        return np.searchsorted(self.edges, at, side="right") - 1

    def prefix(self) -> np.ndarray:
        """prefix[i] = sum of code(b_j) * BASE**j for j < i."""
        out = np.empty(len(self.buf) + 1, dtype=U64)
        out[0] = 0
        np.cumsum(BYTE_CODE[self.buf] * powers(BASE, len(self.buf))[: len(self.buf)], out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of the words (runs without ASCII white space)."""
        solid = ~SPACE[self.buf]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = self.edges[1:-1]
        inner = inner[inner < len(self.buf)]
        begin[inner] = solid[inner]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:]
        last = self.edges[1:-1] - 1
        last = last[last >= 0]
        stop[last] = solid[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        return starts, ends, self.text_of(starts)


_LOW_BYTES = np.array([2 ** (8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=U64)
_keys = np.empty(0, dtype=U64)


def chunk_keys(n: int) -> np.ndarray:
    """A fixed random number for each place of eight bytes in a span; kept and grown by doubling."""
    global _keys
    if len(_keys) < n:
        _keys = mix(np.arange(1, (1 << max(10, n.bit_length())) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return _keys[:n]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each byte span (none empty), equal for equal bytes wherever they stand."""
    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    counts = (sizes + 7) >> 3
    out = np.empty(len(starts), dtype=U64)
    edges = np.concatenate(([0], np.cumsum(counts)))
    lo = 0
    while lo < len(starts):  # some spans at a time, so that overlapping ones don't add up in memory
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + most, side="right")) - 1)
        n = counts[lo:hi]
        if int(n.max()) == 1:
            h = eight[starts[lo:hi]] & _LOW_BYTES[sizes[lo:hi]]
            out[lo:hi] = mix(mix(h ^ chunk_keys(1)) + sizes[lo:hi].astype(U64) * U64(0xD6E8FEB86659FD93))
        else:
            first = edges[lo:hi] - edges[lo]
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            left = np.minimum(np.repeat(sizes[lo:hi], n) - 8 * place, 8)
            h = eight[np.repeat(starts[lo:hi], n) + 8 * place] & _LOW_BYTES[left]
            h = np.add.reduceat(mix(h ^ chunk_keys(int(n.max()))[place]), first)
            out[lo:hi] = mix(h + sizes[lo:hi].astype(U64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` bytes, by start."""
    n = len(prefix) - size
    if n <= 0:
        return np.empty(0, dtype=U64)
    h = prefix[size:] - prefix[:-size]
    h *= powers(INVERSE, n - 1)
    return mix(h)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of a string column; null is the empty text."""
    column = column.fill_null("").cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def blocks(column: pa.Array, most: int = 1 << 19) -> Iterator[Block]:
    """Whole texts in runs of about ``most`` bytes (more where one text has more)."""
    buf, edges = utf8(column)
    i, n = 0, len(edges) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, side="right")) - 1)
        j = min(j, n)
        yield Block(i, buf[edges[i] : edges[j]], edges[i : j + 1] - edges[i])
        i = j


def per_text(text: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of whole-number weights, by text index."""
    return np.bincount(text, weights=weights, minlength=n).astype(np.int64)


def shingle_hash(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each run of ``size`` consecutive words of one text."""
    if len(words) < size:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    m = len(words) - size + 1
    h = np.zeros(m, dtype=U64)
    for k in range(size):
        h *= U64(0xC2B2AE3D27D4EB4F)
        h += words[k : k + m]
    same = text[:m] == text[size - 1 :]
    return mix(h[same] + U64(size)), text[:m][same]
