"""Ranked lexical search with bit-sliced Bloom signatures.

Documents of one task with about as many distinct terms share a signature: each of its
rows is a bitmap over these documents, and a term sets its document's bit in some rows
that its hash names.  The rows of a query term, taken together by AND, overestimate
which documents hold it.  Terms are entered once more for each band of frequencies that
they reach, so a term's frequency is overestimated too.  The sum of a query's bitmaps,
weighted by what a term of that frequency adds at most, is a bound on every document's
score; a document is rescored exactly unless its bound is below the k-th best score found
so far for that query.  Tasks hand on their k best; the best of those are the result.

    weight(t) = floor(1000 ln((2 N + 2) / (2 df + 1)))
    score(d)  = sum of weight(t) * ((10^9 tf) div (1000 tf + 8 m)),  m = 25 + (75 n N) div L

Queries are taken in blocks of bounded size, which the driver holds and broadcasts; each
block is two passes over the documents, one for the frequencies of its terms.

Defined cases: a null or empty text has no terms and is found by no query; a query
without terms, or whose terms no document holds, has no rows; a term repeated in a query
counts as often; repeated rows of either table count as rows of their own; a null id of a
document ranks after the others of its score; empty tables give no rows; further columns
are not read.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import as_table, bound_batches
from .textnum import ALNUM, LOWER, Text, as_bytes, mix, signed, texts_of

#: Characters of query text that the driver holds and broadcasts at once.
BLOCK_CHARS = 4 << 20
#: Rows of a signature that a term sets its bit in, and rows for each distinct term of the largest document.
ROWS, ROWS_A_TERM = 3, 8
#: Frequencies from which a term is entered once more.
BANDS = (1, 2, 4, 8)
#: Cells of query terms by documents that are held at once.
CELLS = 4 << 20

_LAST_ID = np.iinfo(np.int64).max
_STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("term", "n")])
_FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def term_pairs(t: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs by text: the text, the term's hash and its frequency; and the number of terms of each text."""
    low = Text(LOWER[t.data], t.offsets)
    start, end, at = low.words(ALNUM)
    size = np.diff(at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), size
    h, owner = low.hashes(start, end), np.repeat(np.arange(t.n), size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
    return owner[new], h[new], np.diff(np.append(new, len(h))), size


class Queries:
    """The terms of some queries: sorted hashes, and for each query the numbers and repeats of its terms."""

    def __init__(self, numbers: list[int], texts: list[str]):
        owner, h, times, _ = term_pairs(Text(*as_bytes(pa.array(texts, pa.string()))))
        self.numbers, self.times = np.array(numbers, np.int64), times
        self.terms, self.term = np.unique(h, return_inverse=True)
        self.first = np.searchsorted(owner, np.arange(len(numbers) + 1))

    def weigh(self, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        self.weight = weight[self.term] * self.times if len(self.term) else np.zeros(0, np.int64)

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are of query terms, and the numbers of those terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == h)
        return hit, at[hit]

    def ranges(self, cells: int) -> Iterator[tuple[int, int]]:
        """Ranges of queries with at most so many terms, or one query."""
        a = 0
        while a < len(self.numbers):
            b = max(a + 1, int(np.searchsorted(self.first, self.first[a] + cells, "right")) - 1)
            yield a, min(b, len(self.numbers))
            a = b


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Signature:
    """Bit slices of the terms of some documents: a bitmap of documents for each row."""

    def __init__(self, n: int, doc: np.ndarray, h: np.ndarray, tf: np.ndarray, largest: int):
        self.n, self.rows = n, 1 << max(6, int(ROWS_A_TERM * largest - 1).bit_length())
        bits = np.zeros((self.rows, n), bool)
        for band, least in enumerate(BANDS):
            held = tf >= least
            for row in self._rows(h[held], band):
                bits[row, doc[held]] = True
        self.slices = np.packbits(bits, axis=1)

    def _rows(self, h: np.ndarray, band: int) -> Iterator[np.ndarray]:
        x = mix(h + np.uint64(band))
        for k in range(ROWS):
            yield ((x >> np.uint64(20 * k)) & np.uint64(self.rows - 1)).astype(np.int64)

    def holders(self, h: np.ndarray, band: int) -> np.ndarray:
        """A row of bits over the documents for each term: set where it may occur so often, and wherever it does."""
        found = None
        for row in self._rows(h, band):
            found = self.slices[row] if found is None else found & self.slices[row]
        return found


class Best:
    """The k best (score, document) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.doc, self.null = np.zeros((n, k), np.int64), np.full((n, k), _LAST_ID), np.ones((n, k), bool)
        self.rescored = self.bounded = 0

    def add(self, q: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.append(self.score[q], score), np.append(self.doc[q], doc), np.append(self.null[q], null)
        top = np.lexsort((doc, null, -score))[: self.score.shape[1]]
        self.score[q], self.doc[q], self.null[q] = score[top], doc[top], null[top]


def search_texts(t: Text, ids: np.ndarray, null: np.ndarray, queries: Queries, best: Best) -> None:
    """Adds the texts to the best of each query."""
    doc, h, tf, n_terms = term_pairs(t)
    if not len(queries.terms) or not len(doc):
        return
    m = 25 + (75 * n_terms.astype(np.int64) * queries.n_docs) // queries.n_terms
    distinct = np.bincount(doc, minlength=t.n)
    kind = np.array([int(x).bit_length() for x in distinct])
    hit, term = queries.place(h)
    most = max(1, CELLS // len(queries.terms))
    for size in np.unique(kind[kind > 0]):
        members = np.flatnonzero(kind == size)
        for a in range(0, len(members), most):
            _search_group(members[a : a + most], doc, h, tf, hit, term, m, distinct, ids, null, queries, best)


def _search_group(members, doc, h, tf, hit, term, m, distinct, ids, null, queries, best) -> None:
    n = len(members)
    local = np.full(len(distinct), -1)
    local[members] = np.arange(n)
    own = local[doc] >= 0
    sliced = Signature(n, local[doc[own]], h[own], tf[own], int(distinct[members].max()))
    m = m[members]
    most_tf = np.zeros(n, np.int64)
    np.maximum.at(most_tf, local[doc[own]], tf[own])
    counted = hit[own[hit]]
    exact = np.zeros((len(queries.terms), n), np.int64)
    exact[term[own[hit]], local[doc[counted]]] = tf[counted]
    # what a term of a band adds beyond the band below, at most
    tops = [np.minimum(most_tf, b - 1) for b in BANDS[1:]] + [most_tf]
    gains = [_gain(x, m) for x in tops]
    steps = [gains[0]] + [g - f for f, g in zip(gains[:-1], gains[1:], strict=True)]
    held, bands = None, []
    for band, step in enumerate(steps):
        if band and not step.any():
            continue
        now = sliced.holders(queries.terms, band)
        held = now if held is None else held & now
        bands.append((np.unpackbits(held, axis=1, count=n).astype(np.float32), step))
    for a, b in queries.ranges(max(1, CELLS // n)):
        first, last = queries.first[a], queries.first[b]
        if first == last:
            continue
        rows, weight = queries.term[first:last], queries.weight[first:last].astype(np.float32)[:, None]
        some = np.flatnonzero(np.diff(queries.first[a : b + 1]))
        bound = np.zeros((len(some), n))
        for bits, step in bands:
            bound += np.add.reduceat(bits[rows] * weight, queries.first[a:b][some] - first, axis=0).astype(np.float64) * step
        bound = bound * (1 + 1e-4) + 1  # above what sums of single precision lose
        open_ = (bound >= best.score[a + some, -1][:, None]) & (bound > 1)
        best.bounded += open_.size
        # the largest bounds first: they raise the score to beat
        for k in np.flatnonzero(open_.any(axis=1)).tolist():
            q = a + int(some[k])
            left = np.flatnonzero(open_[k])
            left = left[np.argsort(-bound[k, left], kind="stable")]
            own_terms, own_weights = queries.term[queries.first[q] : queries.first[q + 1]], queries.weight[queries.first[q] : queries.first[q + 1]]
            for c in range(0, len(left), 64):
                part = left[c : c + 64]
                part = part[bound[k, part] >= best.score[q, -1]]
                if not len(part):
                    break
                best.rescored += len(part)
                score = own_weights @ _gain(exact[own_terms][:, part], m[part])
                good = score > 0
                if good.any():
                    at = members[part[good]]
                    best.add(q, score[good], np.where(null[at], _LAST_ID, ids[at]), null[at])


def _blocks(rows: Iterator, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    numbers, texts, size = [], [], 0
    for number, text in rows:
        if text:
            if numbers and size + len(text) > limit:
                yield numbers, texts
                numbers, texts, size = [], [], 0
            numbers.append(number)
            texts.append(text)
            size += len(text)
    if numbers:
        yield numbers, texts


def _counted(texts: DataFrame, queries: Queries) -> tuple[np.ndarray, int, int]:
    """Documents that hold each query term, documents with a term, and all their terms."""
    told = texts.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(told.value.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, t in texts_of(batch, "text"):
                _, h, _, size = term_pairs(t)
                _, term = told.value.place(h)
                df += np.bincount(term, minlength=len(df))
                n_docs += int((size > 0).sum())
                n_terms += int(size.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n_docs, n_terms]))], _STATS.names)

    df, rest = np.zeros(len(queries.terms), np.int64), {}
    for term, n in texts.mapInArrow(run, _STATS).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each query term
        if term >= 0:
            df[term] = n
        else:
            rest[term] = n
    told.destroy()
    return df, rest.get(-1, 0), rest.get(-2, 0)


def _searched(texts: DataFrame, queries: Queries, k: int) -> DataFrame:
    told = texts.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(told.value.numbers), k)
        for batch in batches:
            ids = batch.column(0)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for i, j, t in texts_of(batch, "text"):
                search_texts(t, ids[i:j], null[i:j], told.value, best)
        q, c = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(told.value.numbers[q]), pa.array(best.doc[q, c], pa.int64(), mask=best.null[q, c]), pa.array(best.score[q, c])], _FOUND.names)

    return texts.mapInArrow(run, _FOUND)


def best_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """query_col, rank, doc_id, score: the k documents of the highest scores above 0 for each row of queries, equal scores by id."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = as_table(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_col).alias("asked"), F.col(query_text_col).cast("string").alias("text")), "queries")
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for numbers, words in _blocks(asked.select("query", "text").toLocalIterator(), block_chars):
        block = Queries(numbers, words)
        block.weigh(*_counted(texts, block))
        found = found.union(_searched(texts, block, k))
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(asked.select("query", "asked"), "query").select(F.col("asked").alias(query_col), "rank", "doc_id", "score")
