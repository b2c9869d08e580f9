"""Array arithmetic on batches of texts, used inside Arrow tasks.

A batch of strings is seen as one byte array with document offsets.  Words,
lines and n-grams become index ranges into it and are hashed with a prefix sum
of a 64-bit polynomial, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)

#: Bytes of text handled at once; one longer text is handled alone.
PIECE_BYTES = 1 << 19

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE_BYTES
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), PIECE_BYTES + 2)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers[:n], _inverses[:n]


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if len(texts) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    limit = limit or PIECE_BYTES
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Text:
    """Some whole texts side by side."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets - offsets[0], len(offsets) - 1
        self._sums = None

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end byte of each run of bytes of a kind, and the number of the first word of each text."""
        hit = kind[self.data]
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        full = self.offsets[1:] > self.offsets[:-1]
        heads, tails = self.offsets[:-1][full], self.offsets[1:][full] - 1
        first, last = hit.copy(), hit.copy()
        first[1:] &= ~hit[:-1]
        last[:-1] &= ~hit[1:]
        first[heads], last[tails] = hit[heads], hit[tails]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(start, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end byte of each newline-split line, and the text it is in."""
        at = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.offsets, at, "right") - 1
        start = np.concatenate([self.offsets[:-1], at + 1])
        end = np.concatenate([at, self.offsets[1:]])
        s_owner = np.concatenate([np.arange(self.n), owner])
        e_owner = np.concatenate([owner, np.arange(self.n)])
        s = np.lexsort((start, s_owner))
        e = np.lexsort((end, e_owner))
        return start[s], end[e], s_owner[s]

    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_BYTE_VALUES[self.data] * up[:-1], out=self._sums[1:])
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes have equal hashes wherever they stand."""
        s = self.sums()
        _, down = powers(len(self.data) + 1)
        return mix((s[end] - s[start]) * down[start] + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))

    def count(self, hit: np.ndarray) -> np.ndarray:
        """Number of set bytes by text."""
        c = np.zeros(len(hit) + 1, np.int64)
        np.cumsum(hit, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]


def run_hashes(items: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As Text.hashes, for ranges of a sequence of 64-bit items."""
    up, down = powers(len(items) + 1)
    s = np.zeros(len(items) + 1, U64)
    np.cumsum(items * up[: len(items)], out=s[1:])
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def grams(items: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive items; the last n - 1 places are left out."""
    size = len(items) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    h = items[:size].copy()
    for j in range(1, n):
        h *= U64(0x9FB21C651E98DF25)
        h += items[j : j + size]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def texts_of(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[tuple[int, int, Text]]:
    """The texts of a batch in row ranges of bounded size."""
    data, offsets = as_bytes(batch.column(batch.schema.get_field_index(column)))
    for i, j in pieces(offsets, limit):
        yield i, j, Text(data[offsets[i] : offsets[j]], offsets[i : j + 1])
    # workers live on between tasks: what Arrow holds for reuse goes back
    pa.default_memory_pool().release_unused()
