"""Words and shingles of whole Arrow batches, hashed with numpy on the UTF-8 bytes.

A batch is taken in pieces of bounded bytes (one long document is one piece), so memory follows the longest
document and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: The bytes that part words in the contracts: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def free_prefix(columns: list[str], prefix: str = "_") -> str:
    """``prefix``, made longer until no column's name begins with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, b, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


class Rolling:
    """Hashes of any run of a sequence from one prefix sum."""

    def __init__(self, values: np.ndarray, powers: _Powers) -> None:
        n = len(values)
        up, self.down = powers.get(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # byte positions in buf
    ends: np.ndarray
    first: np.ndarray  # for each document, and one past the last, the index of its first word
    buf: np.ndarray


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most ``limit`` bytes, or of one longer row."""
    buf, offsets = flat(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n), buf[offsets[lo] : offsets[min(hi, n)]], offsets[lo : min(hi, n) + 1] - offsets[lo]
        lo = min(hi, n)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of the two-byte Latin-1 letters in lower case."""
    low = lower_ascii(buf)
    if len(buf) > 1:
        cap = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][cap] += 32
    return low


def words(buf: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACES) -> Words:
    """The words of several documents laid end to end; no word crosses from one document to the next."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(_U), none, none, np.zeros(len(offsets), np.int64), buf)
    inside = ~parts[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    rolled = Rolling(buf.astype(_U) + _U(1), _BYTES)
    return Words(rolled.runs(starts, ends), starts, ends, np.searchsorted(starts, offsets), buf)


def word_runs(w: Words) -> Rolling:
    return Rolling(w.hashes, _WORDS)


def byte_runs(buf: np.ndarray) -> Rolling:
    return Rolling(buf.astype(_U) + _U(1), _BYTES)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, _U).view(np.int64)
