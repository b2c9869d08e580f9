"""Periodic runs of words, by Lyndon roots from the grouping phase of a suffix sorter.

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends.  Every run holds, under one of the two orders of the words, a root that
is the longest Lyndon word at its place.  The grouping phase yields the longest Lyndon
word at every place, once for each order; a root is extended to both sides through the
longest common extension of its place and the next one's, and so becomes its run.

A run of at least e periods and m words repeats some g = ceil(m (e - 1) / e) words at
the distance of its period, and every word of it is inside such a repeat.  So only
stretches of words covered by g words that occur twice in the document are grouped:
no run is lost, and texts without repeats cost a hash for each word.

Defined cases: a null, empty or blank text has no words and no runs, and collapses to
an empty text; runs of one document may overlap, and a word is dropped if any of them
says so; repeated rows give repeated results; a null id stays null; an empty table
gives no rows; further columns are not read.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouping import grouped
from .scratch import bound_batches
from .textnum import NOT_SPACE, Text, grams, texts_of

MIN_WORDS, MIN_PERIODS = 24, 3

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
_ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


class Extensions:
    """Longest common extensions of places of a sequence, from the names of all blocks of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.names = len(symbols), [symbols.astype(np.int64)]
        while (size := 1 << len(self.names)) <= self.n:
            before = self.names[-1]
            pair = before[: self.n - size + 1] * (self.n + 1) + before[size // 2 :]
            self.names.append(np.unique(pair, return_inverse=True)[1])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For a < b: how many symbols from a on equal those from b on."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            live = np.flatnonzero(b + out + (1 << k) <= self.n)
            at = out[live]
            out[live] += (self.names[k][a[live] + at] == self.names[k][b[live] + at]).astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For a < b: how many symbols before a equal those before b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            live = np.flatnonzero(a - out - (1 << k) >= 0)
            at = out[live] + (1 << k)
            out[live] += (self.names[k][a[live] - at] == self.names[k][b[live] - at]).astype(np.int64) << k
        return out


def runs_of(items: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period; at least 2 periods are asked for."""
    n = len(items)
    if n < max(min_words, 2, min_periods):
        return []
    _, symbols = np.unique(items, return_inverse=True)
    roots = []
    for order in (symbols + 1, symbols.max() + 1 - symbols):
        _, _, length = grouped(np.append(order, 0))
        period = np.array(length[:n], np.int64)
        i = np.flatnonzero(np.arange(n) + period < n)
        i = i[(period[i] * min_periods <= n) & (symbols[i] == symbols[i + period[i]])]
        roots.append(np.stack([i, period[i]]))
    i, p = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not len(i):
        return []
    lce = Extensions(symbols)
    start = i - lce.backward(i, i + p)
    length = i + p + lce.forward(i, i + p) - start
    good = length >= np.maximum(min_words, min_periods * p)
    return sorted(set(zip(start[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True)), key=lambda r: (r[0], r[2]))


def _stretches(hashes: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end word) of each maximal stretch of words covered by width words that occur twice in their text."""
    g = grams(hashes, width)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.flatnonzero(owner[: len(g)] == owner[width - 1 :]) if len(g) else np.zeros(0, np.int64)
    key = g[place] + owner[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(place), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, place[twice], 1)
    np.add.at(edge, place[twice] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    first, last = covered.copy(), covered.copy()
    change = owner[1:] != owner[:-1]
    first[1:] &= ~covered[:-1] | change
    last[:-1] &= ~covered[1:] | change
    for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist(), strict=True):
        yield int(owner[a]), a, b + 1


def _collapsed(t: Text, start: np.ndarray, end: np.ndarray, at: np.ndarray, dropped: np.ndarray) -> list[bytes]:
    """The words of each text that are not dropped, joined by one space."""
    kept = np.flatnonzero(~dropped)
    size = end[kept] - start[kept]
    to = np.cumsum(size + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    inside = np.repeat(start[kept] - (to - size - 1), size) + (slots := np.delete(np.arange(len(out)), to - 1))
    out[slots] = t.data[inside]
    ends = np.append(0, to)[np.searchsorted(kept, at)]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def text_runs(t: Text, min_words: int, min_periods: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[bytes]]:
    """Words, runs and collapsed text of each text."""
    start, end, at = t.words(NOT_SPACE)
    hashes = t.hashes(start, end)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(t.n)]
    edge = np.zeros(len(start) + 1, np.int64)
    for d, a, b in _stretches(hashes, at, max(1, -(-min_words * (min_periods - 1) // min_periods))):
        for s, length, period in runs_of(hashes[a:b], min_words, min_periods):
            runs[d].append((int(a - at[d]) + s, length, period))
            edge[a + s + period] += 1
            edge[a + s + length] -= 1
    return np.diff(at), runs, _collapsed(t, start, end, at, np.cumsum(edge[:-1]) > 0)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed,
    the text without the words of a run after its first period.  No exchange: a document is whole in its task."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in texts_of(batch, "text"):
                n_words, runs, texts = text_runs(t, min_words, min_periods)
                told = pa.array([[dict(zip(_RUN.names, r, strict=True)) for r in x] for x in runs], _ARROW_RUNS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_words), told, pa.array(texts, pa.binary()).cast(pa.string())], _FOUND.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _FOUND)


def looped(words: list[bytes], number: int) -> list[bytes]:
    """The words, from some place on replaced by repeats of those from there; where and how long follow from the number."""
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the crc32 of their ids, end in repeats; the others, and null ids, are as they were."""
    bound_batches(docs.sparkSession)
    space = bytes([0x20, *range(0x09, 0x0E)])
    split = bytes.maketrans(space, b" " * len(space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            told = {k: h for k, x in enumerate(ids) if x is not None and (h := zlib.crc32(str(x).encode())) % 10 == 0}
            if told:
                new = texts.to_pylist()
                for k, h in told.items():
                    if new[k]:
                        new[k] = b" ".join(looped([w for w in new[k].encode().translate(split).split(b" ") if w], h)).decode()
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")
