"""Benchmark decontamination with an FM-index per training shard.

A shard is some whole documents.  Words that no test item holds cannot be part of
a match, so a shard's index covers its runs of test words that are long enough.
All test phrases are searched backwards through wavelet-tree ranks at once,
occurrences are located by sampled suffix positions, and the spans of a document
are merged.  Each task builds and drops its own indexes: nothing is gathered.

A window is 13 consecutive words of an item; an item of fewer words is one window.

Defined cases: a null or empty text has no words and is not contaminated; an item
without words matches nothing; repeated rows of documents give repeated results; items
with equal text all count, and rows with equal ids are one item, however the benchmark
is cut into blocks; a null item id is left out of the id list; an empty benchmark hits
nothing; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .scratch import as_table, bound_batches, unused, with_rows
from .textnum import ALNUM, LOWER, Text, as_bytes, texts_of

WINDOW = 13
#: A document is contaminated if this share of its words is hit, in percent.
MIN_HIT_PERCENT = 5
#: Characters of test text that the driver holds and broadcasts at once; a larger benchmark is searched in
#: blocks of items, one pass over the documents for each.
BLOCK_CHARS = 2 << 20

_HITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


class Phrases:
    """The windows of some test items as rows of word numbers, with the items of each window."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        t = Text(*as_bytes(pa.array(texts, pa.string())))
        low = Text(LOWER[t.data], t.offsets)
        start, end, at = low.words(ALNUM)
        h = low.hashes(start, end)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        number = number + 1
        # rows with equal ids are one item; null ids are none
        numbers: dict[str, int] = {}
        owner = [numbers.setdefault(i, len(numbers)) for i in ids]
        windows: dict[tuple[int, ...], set[int]] = {}
        for d in range(t.n):
            own = number[at[d] : at[d + 1]].tolist()
            for k in range(max(1, len(own) - width + 1) if own else 0):
                windows.setdefault(tuple(own[k : k + width]), set()).add(owner[d])
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.matrix = np.array([w + (0,) * (width - len(w)) for w in windows], np.int64).reshape(len(windows), width)
        owners = [sorted(x) for x in windows.values()]
        self.owner_counts = np.array([len(x) for x in owners], np.int64)
        self.owners = np.array([i for x in owners for i in x], np.int64)
        self.ids, self.shortest = list(numbers), int(self.lengths.min()) if len(windows) else 0

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each test word, 0 for all others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... counts[i] of them, for each i."""
    return np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def shard_hits(t: Text, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[int]], list[list[str]]]:
    """Words and hit words of each text, first and end bytes of its merged spans, and the items that occur in it."""
    low = Text(LOWER[t.data], t.offsets)
    start, end, at = low.words(ALNUM)
    n_words = np.diff(at)
    starts: list[list[int]] = [[] for _ in range(t.n)]
    ends: list[list[int]] = [[] for _ in range(t.n)]
    items: list[list[str]] = [[] for _ in range(t.n)]
    number = phrases.word_numbers(low.hashes(start, end)) if len(phrases.lengths) else np.zeros(len(start), np.int64)
    owner = np.repeat(np.arange(t.n), n_words)
    inside = number > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    run0 = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1])
    size = np.flatnonzero(last) + 1 - run0
    long = size >= max(1, phrases.shortest)
    run0, size = run0[long], size[long]
    if not len(run0):
        return n_words, np.zeros(t.n, np.int64), starts, ends, items
    # one sequence: the runs, each with a 0 after it; its places map back to words
    place = _spread(run0, size + 1)
    text = number[np.minimum(place, len(number) - 1)]
    text[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    low_row, high_row = index.search(phrases.matrix, phrases.lengths)
    found = np.flatnonzero(high_row > low_row)
    times = (high_row - low_row)[found]
    which = np.repeat(found, times)
    word = place[index.locate(_spread(low_row[found], times))]
    # spans of words, merged through a running count
    edge = np.zeros(len(start) + 1, np.int32)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + phrases.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    first, stop = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    stop[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(stop).tolist(), strict=True):
        d = owner[a]
        starts[d].append(int(start[a] - t.offsets[d]))
        ends[d].append(int(end[b] - t.offsets[d]))
    pair = np.unique(np.stack([np.repeat(owner[word], phrases.owner_counts[which]), phrases.owners[_spread((np.cumsum(phrases.owner_counts) - phrases.owner_counts)[which], phrases.owner_counts[which])]], axis=1), axis=0)
    for d, i in pair.tolist():
        if phrases.ids[i] is not None:
            items[d].append(phrases.ids[i])
    return n_words, np.bincount(owner[hit], minlength=t.n), starts, ends, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[tuple[list[str], list[str]]]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if row[1]:
            if ids and size + len(row[1]) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(row[0])
            texts.append(row[1])
            size += len(row[1])
    yield ids, texts


def _searched(texts: DataFrame, block: tuple[list[str], list[str]], width: int) -> tuple[DataFrame, Broadcast]:
    """The hits of one block of items in (doc_id, text)."""
    phrases = texts.sparkSession.sparkContext.broadcast(Phrases(*block, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = pa.list_(pa.int64())
        for batch in batches:
            for i, j, t in texts_of(batch, "text"):
                n_words, n_hit, starts, ends, found = shard_hits(t, phrases.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_words), pa.array(n_hit), pa.array(starts, long), pa.array(ends, long), pa.array(found, pa.list_(pa.string()))], _HITS.names)

    return texts.mapInArrow(run, _HITS), phrases


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, found) with the hits of all blocks as those of one."""
    long = pa.list_(pa.int64())
    for batch in batches:
        out = []
        for i, j, t in texts_of(batch, "text"):
            out += _joined(t, [x or () for x in batch.column(2).slice(i, j - i).to_pylist()])
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(x), k) for x, k in zip(columns, (pa.int64(), pa.int64(), long, long, pa.list_(pa.string())), strict=True)]], _HITS.names)


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, merged spans (byte starts and ends) and items of each document."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _searched(texts, block, width)[0]
    rows, row = with_rows(texts, "searched_rows")
    keyed = rows.select(F.col(row).alias("doc_id"), "text")
    parts = None
    while block:
        hits, phrases = _searched(keyed, block, width)
        part = as_table(hits.filter("n_hit > 0"), "block_hits")
        phrases.destroy()
        parts = part if parts is None else parts.union(part)
        block, following = following, next(blocks, None)
    found = parts.groupBy(F.col("doc_id").alias("f_row")).agg(F.collect_list(F.struct("starts", "ends", "items")).alias("found"))
    return rows.join(found, F.col(row) == F.col("f_row"), "left").select("doc_id", "text", "found").mapInArrow(_merge, _HITS)


def _joined(t: Text, each: list[list[dict]]) -> list[tuple]:
    """Words, hit words, spans and items of each text, from its hits in several blocks of items."""
    start, _, at = Text(LOWER[t.data], t.offsets).words(ALNUM)
    out = []
    for d, own in enumerate(each):
        spans: list[list[int]] = []
        words = start[at[d] : at[d + 1]] - t.offsets[d]
        for a, b in sorted((a, b) for x in own for a, b in zip(x["starts"], x["ends"], strict=True)):
            # spans that touch have no word between them
            if spans and np.searchsorted(words, a) <= np.searchsorted(words, spans[-1][1]):
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        n_hit = sum(int(np.searchsorted(words, b) - np.searchsorted(words, a)) for a, b in spans)
        out.append((len(words), n_hit, [a for a, _ in spans], [b for _, b in spans], sorted({i for x in own for i in x["items"]})))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, min_percent: int = MIN_HIT_PERCENT, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans of bytes, contaminated."""
    hits = occurrences(docs, benchmark, **options)
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")))


def _cut(raw: bytes, starts: list[int], ends: list[int]) -> str:
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)).decode()


def _cut_batch(batch: pa.RecordBatch, text_col: str, keep: np.ndarray, spans: dict[int, tuple[list[int], list[int]]]) -> pa.RecordBatch:
    """The rows to keep, without the spans of their texts."""
    at = batch.schema.get_field_index(text_col)
    if any(keep[k] for k in spans):
        texts = batch.column(at).to_pylist()
        for k, (starts, ends) in spans.items():
            texts[k] = _cut(texts[k].encode(), starts, ends)
        batch = batch.set_column(at, text_col, pa.array(texts, pa.string()))
    return batch.filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_percent: int = MIN_HIT_PERCENT, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that are not contaminated, with all columns; what they hold of the test phrases is cut from their texts.

    One block of items needs no exchange: a task searches, judges and cuts its own rows.
    """
    bound_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(*block, width))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, spans = np.ones(batch.num_rows, bool), {}
                for i, j, t in texts_of(batch, text_col):
                    n_words, n_hit, starts, ends, _ = shard_hits(t, phrases.value)
                    keep[i:j] = (n_hit == 0) | (100 * n_hit < min_percent * n_words)
                    spans |= {i + int(d): (starts[d], ends[d]) for d in np.flatnonzero(n_hit)}
                yield _cut_batch(batch, text_col, keep, spans)

        return docs.mapInArrow(clean, docs.schema)
    rows, row = with_rows(docs, "decontamination_rows")
    c_id, c_starts, c_ends, c_all = unused(rows, "found_id", "starts", "ends", "contaminated")
    found = contamination(rows, benchmark, min_percent, width=width, id_col=row, text_col=text_col, item_col=item_col, item_text_col=item_text_col, block_chars=block_chars).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias(c_id), F.col("contaminated").alias(c_all), F.col("starts").alias(c_starts), F.col("ends").alias(c_ends))
    kept = rows.join(found, F.col(row) == F.col(c_id), "left").filter(F.coalesce(~F.col(c_all), F.lit(True))).select(*docs.columns, c_starts, c_ends)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, e = (batch.column(batch.schema.get_field_index(x)) for x in (c_starts, c_ends))
            spans = {k: (s[k].as_py(), e[k].as_py()) for k in np.flatnonzero(s.is_valid().to_numpy(zero_copy_only=False)).tolist()}
            yield _cut_batch(batch.drop_columns([c_starts, c_ends]), text_col, np.ones(batch.num_rows, bool), spans)

    return kept.mapInArrow(cut, docs.schema)
