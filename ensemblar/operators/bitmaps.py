"""Item sets of many short sessions at once, on bitmaps of their transactions in Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions.shared import bound_batches, checkpointed

#: A short session has at most so many transactions, and items in all of them.
TRANSACTIONS, OCCURRENCES = 1024, 1 << 16
#: Items in transactions that are solved in one stack, and words of bitmaps that a step holds at once.
STACK, WORDS = 1 << 18, 1 << 21


def by_size(rows: DataFrame, by: Sequence[str], sizes: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of short and of long sessions; None for those that there are none of.  sizes: (by or some of it, short) where known."""
    if sizes is None:
        n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("items")).alias("o"))
        sizes = n.select(*by, ((F.col("n") <= TRANSACTIONS) & (F.col("o") <= OCCURRENCES)).alias("short"))
    sizes = checkpointed(sizes)
    keys = [c for c in sizes.columns if c != "short"]
    kinds = {r.short for r in sizes.select("short").distinct().collect()}
    # where all are of one kind no row is moved to learn of which
    short, long = (rows if kinds == {x} else rows.join(sizes.filter(F.col("short") == x).select(*keys), keys, "left_semi") if x in kinds else None for x in (True, False))
    return short, long


def gathered(transactions: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """One row (by, x) for each session, with its transactions (items and more) as a list."""
    return transactions.filter("items IS NOT NULL").groupBy(*by).agg(F.collect_list(F.struct(F.array_compact("items").alias("items"), *more)).alias("x"))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row k, n[k] times: k, and 0 to n[k] - 1."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _cuts(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that cost about so much, one row at least."""
    total, a = np.cumsum(cost), 0
    while a < len(cost):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


class Stack:
    """Transactions of several sessions: for each item of a session, which of its transactions hold it, as bits."""

    def __init__(self, x: pa.ListArray):
        lengths = pc.list_value_length(x).to_numpy()
        items = x.flatten().field("items")
        of, number = _spread(lengths)
        t, _ = _spread(pc.list_value_length(items).to_numpy())
        self.values = items.flatten()
        self.codes, code = np.unique(self.values.to_numpy(zero_copy_only=False), return_inverse=True)
        key, row = np.unique(of[t] * max(1, len(self.codes)) + code, return_inverse=True)
        self.key = key
        self.session, self.item = np.divmod(key, max(1, len(self.codes)))
        self.bits = np.zeros((len(key), (max(lengths, default=0) + 63) // 64), np.uint64)
        np.bitwise_or.at(self.bits, (row, number[t] >> 6), np.uint64(1) << (number[t] & 63).astype(np.uint64))
        self.start = np.cumsum(lengths) - lengths

    def frequent(self, least: int) -> None:
        """Leaves out items of fewer transactions."""
        kept = np.bitwise_count(self.bits).sum(axis=1) >= least
        self.key, self.session, self.item, self.bits = self.key[kept], self.session[kept], self.item[kept], self.bits[kept]

    def together(self, session: np.ndarray, sets: pa.ListArray) -> np.ndarray:
        """The transactions of its session that hold all of each set, as bits."""
        n = pc.list_value_length(sets).to_numpy()
        of, _ = _spread(n)
        items = sets.flatten().to_numpy(zero_copy_only=False)
        code = np.searchsorted(self.codes, items)
        # what is in no transaction has a row of no bits after the others
        known = np.isin(items, self.codes)
        key = session[of] * max(1, len(self.codes)) + np.where(known, code, 0)
        row = np.searchsorted(self.key, key)
        row = np.where(known & (self.key[np.minimum(row, len(self.key) - 1)] == key), row, len(self.key)) if len(self.key) else np.zeros(len(of), np.int64)
        bits = np.concatenate([self.bits, np.zeros((1, self.bits.shape[1]), np.uint64)])
        return np.bitwise_and.reduceat(bits[row], np.cumsum(n) - n, axis=0) if len(n) else bits[:0]

    def items_of(self, codes: np.ndarray, size: int) -> pa.ListArray:
        values = pa.array(self.codes[codes.ravel()], self.values.type)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, max(1, size), dtype=np.int32)), values)

    def common(self, session: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """How many items of its session are in all transactions of each bitmap."""
        first, end = (np.searchsorted(self.session, session, side) for side in ("left", "right"))
        out = np.zeros(len(session), np.int64)
        for a, b in _cuts((end - first) * max(1, bits.shape[1]), WORDS):
            row, k = _spread((end - first)[a:b])
            inside = ~(bits[a:b][row] & ~self.bits[first[a:b][row] + k]).any(axis=1)
            out[a:b] = np.bincount(row[inside], minlength=b - a)
        return out

    def sets(self, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(session, items, bits, count) of all sets of at most ``most`` items in ``least`` transactions, some of one size at a time."""
        n = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        yield self.session, self.item[:, None], self.bits, n
        yield from self._grow(self.session, self.session, self.item[:, None], self.bits, least, most)

    def _grow(self, group, session, items, bits, least, most):
        # sets of a group differ in their last item only: each meets those after it, and what it makes is a group
        if items.shape[1] >= most or not len(items):
            return
        after = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1
        for a, b in _cuts(after * max(1, bits.shape[1]), WORDS):
            i, k = _spread(after[a:b])
            i = i + a
            j = i + 1 + k
            both = bits[i] & bits[j]
            n = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            kept = n >= least
            i, j, both, n = i[kept], j[kept], both[kept], n[kept]
            if len(i):
                wide = np.concatenate([items[i], items[j][:, -1:]], axis=1)
                yield session[i], wide, both, n
                yield from self._grow(i, session[i], wide, both, least, most)


def _stacks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, as many as make a stack."""
    x = batch.column("x")
    n = pc.list_value_length(x).to_numpy()
    row, _ = _spread(n)
    cost = np.bincount(row, pc.list_value_length(x.flatten().field("items")).to_numpy(), len(n)).astype(np.int64)
    for a, b in _cuts(cost, STACK):
        yield batch.slice(a, b - a)


def mined(sessions: DataFrame, by: Sequence[str], least: int, min_size: int, max_size: int, closed: bool) -> DataFrame:
    """(by, items, size, cnt) of the sets found at least ``least`` times in gathered sessions; closed: no further item is in all their transactions."""
    by = list(by)
    schema = StructType([*(sessions.schema[c] for c in by), StructField("items", ArrayType(sessions.schema["x"].dataType.elementType["items"].dataType.elementType)), StructField("size", IntegerType()), StructField("cnt", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stacks(batch):
                s = Stack(part.column("x"))
                s.frequent(least)
                for session, items, bits, n in s.sets(least, max_size):
                    size = items.shape[1]
                    if size < min_size:
                        continue
                    if closed:
                        kept = s.common(session, bits) == size
                        session, items, n = session[kept], items[kept], n[kept]
                    keys = [part.column(c).take(pa.array(session)) for c in by]
                    yield pa.RecordBatch.from_arrays([*keys, s.items_of(items, size), pa.array(np.full(len(n), size, np.int32)), pa.array(n)], names=[*by, "items", "size", "cnt"])

    bound_batches(sessions.sparkSession)
    return sessions.mapInArrow(run, schema)


def stable(sessions: DataFrame, by: Sequence[str], n: int, draw: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(by, items, hits): of n random subsets of a pattern's windows, how many have just its items in common.

    sessions: (by, x, p): gathered transactions (items, window), and patterns (items, h) of one item at least.
    draw: of a pattern's h, a window and a subset's number, whether the window is in it.
    """
    by = list(by)
    schema = StructType([*(sessions.schema[c] for c in by), StructField("items", sessions.schema["p"].dataType.elementType["items"].dataType), StructField("hits", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stacks(batch):
                s = Stack(part.column("x"))
                window = part.column("x").flatten().field("window").to_numpy()
                session, _ = _spread(pc.list_value_length(part.column("p")).to_numpy())
                items, h = (part.column("p").flatten().field(c) for c in ("items", "h"))
                bits, size, h = s.together(session, items), pc.list_value_length(items).to_numpy(), h.to_numpy()
                hits = np.zeros(len(session), np.int64)
                for a, b in _cuts((np.bitwise_count(bits).sum(axis=1, dtype=np.int64) + bits.shape[1]) * n, WORDS):
                    pattern, t = np.nonzero(np.unpackbits(bits[a:b].view(np.uint8), axis=1, bitorder="little"))
                    drawn, k = np.nonzero(draw(h[a:b][pattern, None], window[s.start[session[a:b][pattern]] + t][:, None], np.arange(n)[None]))
                    subsets = np.zeros(((b - a) * n, bits.shape[1]), np.uint64)
                    np.bitwise_or.at(subsets, (pattern[drawn] * n + k, t[drawn] >> 6), np.uint64(1) << (t[drawn] & 63).astype(np.uint64))
                    just = (s.common(np.repeat(session[a:b], n), subsets) == np.repeat(size[a:b], n)) & subsets.any(axis=1)
                    hits[a:b] = just.reshape(b - a, n).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(session)) for c in by), items, pa.array(hits)], names=[*by, "items", "hits"])

    bound_batches(sessions.sparkSession)
    return sessions.mapInArrow(run, schema)
