"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

    P(word | before) = P(class of the word | before) P(word | class)

Classes of the most frequent words come from the company they keep; every other word has
a class by its last two bytes, and the end of a text has a class of its own.  The first
factor is a softmax over the classes: the sum of a bias and of one row of weights for each
feature of what stands before: the word before, the two before (n-grams), the second and
the third before (skips), and the classes of three before, the last two kinds hashed to rows.
The second factor has the bias features of words alone, whose maximum-entropy weights are
the logarithms of their counts plus one.  A class of rare words keeps a share for unknown
ones, so that all words together have probability 1.

Training is one pass over all training texts in a few rounds.  In each, tasks sum what the
features expect under the weights so far and what is there; the difference is the gradient
of the likelihood, and each weight moves along it on the logarithmic scale of its expected
count.  All features follow from the contexts of the three tokens before, so the softmax is
worked out once for each three that differ among the tokens held, and weighs as often as
they occur.  Sums go through partial sums by block, and only tables of the sizes below reach
the driver.  Scores are made in numpy batches; counts of rare words, however many, are joined.

Defined cases: a null or empty text is its end alone; a null id trains; without training
texts every word is unknown and no feature has a weight; repeated rows are rows of their
own; empty tables give no rows; further columns are not read.  Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import as_table, bound_batches
from .textnum import LOWER, NOT_SPACE, Text, mix, signed, texts_of

#: Words with a count in the tables that are broadcast, and those of them that are context by themselves.
TOP_WORDS, CONTEXT_WORDS = 1 << 17, 1024
#: Classes of top words, of ends of texts, and of other words by their last bytes.
CLUSTERS, ENDINGS = 31, 32
CLASSES = CLUSTERS + 1 + ENDINGS
#: Rows of weights, and the size of the step of each round of training: features overlap, so steps shrink.
ROWS, STEPS = 1 << 13, (0.4, 0.3, 0.25, 0.2)
#: Numbers of a word's company, and words to either side that make it.
COMPANY, NEAR = 8, 16
#: Added to what is there and to what is expected before they are compared.
DAMPING = 4.0
#: Contexts that are handled at once, and tokens that are held until then; numbers in a block of a sum; partial sums of each block.
BATCH, HELD, BLOCK, SALTS = 1 << 13, 1 << 19, 1 << 16, 4
#: Rows that are added one after another before sums are added.
RUN = 16

_CONTEXTS = CONTEXT_WORDS + CLASSES + 1
#: Bits of a context in the number of three, and of the first bits of a hash that find a word.
_BITS, _FIND = 11, 20
_END = np.uint64(0)
#: Features of a pair before alone, and those of three.
_OF_PAIRS, _OF_THREES = [0, 1, 3], [2, 4]
_FEATURES = [*_OF_PAIRS, *_OF_THREES]

_COUNTED = T.StructType([T.StructField("word", T.LongType()), T.StructField("ending", T.IntegerType()), T.StructField("n", T.LongType())])
_PART = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("data", T.BinaryType())])
_RARE = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.IntegerType())])
_SCORED = T.StructType([T.StructField("score_row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_top", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()), T.StructField("rare", T.ArrayType(_RARE))])


def tokens(t: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, each text's end after them: hashes, endings (-1 for an end), and the place of each text's first token."""
    low = Text(LOWER[t.data], t.offsets)
    start, end, at = low.words(NOT_SPACE)
    owner = np.repeat(np.arange(t.n), np.diff(at))
    place = np.arange(len(start)) + owner
    first = at[:-1] + np.arange(t.n)
    h, ending = np.full(len(start) + t.n, _END), np.full(len(start) + t.n, -1, np.int64)
    h[place] = low.hashes(start, end)
    if len(start):
        ending[place] = (low.data[end - 1].astype(np.int64) * 29 + low.data[np.maximum(end - 2, start)]) % ENDINGS
    return h, ending, np.append(first, len(h))


class Vocabulary:
    """Top words with their counts and, once they are known, classes."""

    def __init__(self, word: np.ndarray, n: np.ndarray, ends: int, rest: dict[int, tuple[int, int]], total: int, distinct: int):
        """word, n: hashes and counts, the most frequent first; rest: count and number of the other words of each ending."""
        self.order = np.argsort(word)
        self.word, self.n, self.ends, self.rest, self.total, self.distinct = word[self.order], n[self.order], ends, rest, total, distinct
        self.rank = self.order
        # the place of the first word from each beginning of a hash on, and the most words with the same
        self.find = np.searchsorted(self.word, np.arange(1 << _FIND, dtype=np.uint64) << np.uint64(64 - _FIND)).astype(np.int32)
        self.crowd = int(np.diff(self.find, append=len(self.word)).max())

    def place(self, h: np.ndarray) -> np.ndarray:
        """The number of each top word, -1 for others and for ends."""
        if not len(self.word):
            return np.full(len(h), -1)
        at = self.find.take((h >> np.uint64(64 - _FIND)).astype(np.int64))
        top = np.where(self.word.take(at, mode="clip") == h, at, -1)
        left = np.flatnonzero(top < 0)
        for k in range(1, self.crowd):
            hit = self.word.take(at[left] + k, mode="clip") == h[left]
            top[left[hit]] = at[left[hit]] + k
            left = left[~hit]
        return top

    def classify(self, company: np.ndarray) -> None:
        """Classes from the sums of each top word's company; then everything that scores need."""
        self.cls = _clusters(company, self.n)
        inside = np.bincount(self.cls, self.n, CLUSTERS).astype(np.float64)
        types = np.bincount(self.cls, minlength=CLUSTERS)
        rest = np.array([self.rest.get(b, (0, 0)) for b in range(ENDINGS)], np.float64).reshape(ENDINGS, 2)
        mass = np.concatenate([inside, [self.ends], rest[:, 0]])
        self.bias = np.log((mass + 1) / (mass.sum() + CLASSES)).astype(np.float32)
        self.within = np.log10((self.n + 1) / (inside + types)[self.cls]) if len(self.n) else np.zeros(0)
        self.rare_within = -np.log10(rest.sum(axis=1) + 1)
        self.base = np.log10(self.n + 1) - np.log10(self.total + self.distinct + 1)
        self.base_rare = -np.log10(self.total + self.distinct + 1)
        self.base_end = np.log10(self.ends + 1) + self.base_rare
        self.context = np.where(self.rank < CONTEXT_WORDS, self.rank, CONTEXT_WORDS + self.cls)


def _clusters(company: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A class for each word: k-means of the directions in which its company differs from that of all words."""
    if not len(n):
        return np.zeros(0, np.int64)
    seen = np.maximum(company[:, -1:], 1)
    x = company[:, :-1] / seen - company[:, :-1].sum(axis=0) / max(1, company[:, -1].sum())
    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    weight = np.sqrt(n).astype(np.float32)
    draw = np.random.default_rng(7)
    centre = x[draw.choice(len(x), min(CLUSTERS, len(x)), replace=False, p=weight.astype(np.float64) / weight.sum(dtype=np.float64))]
    for _ in range(12):
        cls = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([np.bincount(cls, weight * x[:, d], len(centre)) for d in range(x.shape[1])], axis=1)
        centre = (centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return np.argmax(x @ centre.T, axis=1)


class Model:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.weight = vocabulary, np.zeros((ROWS, CLASSES), np.float32)
        #: The class of each context.
        self.kind = np.arange(_CONTEXTS) - CONTEXT_WORDS
        alone = vocabulary.rank < CONTEXT_WORDS
        self.kind[vocabulary.rank[alone]] = vocabulary.cls[alone]

    def contexts(self, h: np.ndarray, ending: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number among the top words, class, and the contexts of the three before as one number, of each token."""
        v = self.vocabulary
        top = v.place(h)
        cls = np.where(ending < 0, CLUSTERS, CLUSTERS + 1 + ending)
        known = np.flatnonzero(top >= 0)
        cls[known] = v.cls[top[known]]
        context = CONTEXT_WORDS + cls
        context[known] = v.context[top[known]]
        three = np.zeros(len(h), np.int64)
        for k in (1, 2, 3):
            before = np.empty(len(h), np.int64)
            before[k:] = context[:-k]
            for j in range(k):
                outside = first[:-1] + j
                before[outside[outside < len(h)]] = _CONTEXTS - 1
            three = three << _BITS | before
        return top, cls, three

    def rows(self, three: np.ndarray) -> np.ndarray:
        """The rows of the features of some contexts of three."""
        last = (1 << _BITS) - 1
        a, b, c = three >> 2 * _BITS, three >> _BITS & last, three & last
        x, y, z = (self.kind.take(k) for k in (a, b, c))
        hashed = 3 * _CONTEXTS
        pair = hashed + _spread(a * _CONTEXTS + b) % (ROWS - hashed)
        kinds = hashed + _spread((1 << 40) + (x * (CLASSES + 1) + y) * (CLASSES + 1) + z) % (ROWS - hashed)
        return np.stack([a, _CONTEXTS + b, 2 * _CONTEXTS + c, pair, kinds]).astype(np.int32)

    def features(self, h: np.ndarray, ending: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number among the top words, class, and the rows of the features of each token."""
        top, cls, three = self.contexts(h, ending, first)
        return top, cls, self.rows(three)

    def classes(self, rows: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of all classes for some columns of rows."""
        x = sum((self.weight.take(r, axis=0) for r in rows), self.vocabulary.bias)
        x -= x.max(axis=1, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        return x

    def logits(self, three: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For contexts of three in ascending order, some at a time: where they start, their rows, the number of the pair of the first two, and the sums of weights."""
        far = len(_FEATURES) * np.abs(self.weight).max() + np.abs(self.vocabulary.bias).max() > 60
        for at in range(0, len(three), BATCH):
            rows = self.rows(three[at : at + BATCH])
            new = _changes(three[at : at + BATCH] >> _BITS)
            pair = np.repeat(np.arange(len(new)), np.diff(new, append=rows.shape[1]))
            x = sum((self.weight.take(r[new], axis=0) for r in rows[_OF_PAIRS]), self.vocabulary.bias).take(pair, axis=0)
            for r in rows[_OF_THREES]:
                x += self.weight.take(r, axis=0)
            if far:  # beyond what exp can hold
                x -= x.max(axis=1, keepdims=True)
            yield at, rows, pair, x


def _changes(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _sums(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key below 2**16 once, and the sum of its rows of x."""
    while True:
        order = np.argsort(key.astype(np.uint16), kind="stable")
        key = key[order]
        new = _changes(key)
        size = np.diff(new, append=len(key))
        # up to RUN rows of a key are added, then their sums
        nth = np.arange(len(key)) - np.repeat(new, size)
        head = np.flatnonzero(nth % RUN == 0)
        size = np.diff(head, append=len(key))
        head = head[np.argsort(-size, kind="stable")]
        there = np.bincount(size, minlength=RUN + 1)[::-1].cumsum()[::-1]
        total = x.take(order[head], axis=0)
        for k in range(1, RUN):
            total[: there[k + 1]] += x.take(order[head[: there[k + 1]] + k], axis=0)
        key, x = key[head], total
        if len(head) == len(new):
            return key, x


def _spread(x: np.ndarray) -> np.ndarray:
    return (mix(x.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)


def add_company(v: Vocabulary, texts: Iterable[Text], total: np.ndarray) -> None:
    """Adds to each top word's column the signs of the words around it, and how often it was seen."""
    for t in texts:
        h, _, first = tokens(t)
        start, stop = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
        at = np.arange(len(h))
        top = v.place(h)
        here = np.flatnonzero(top >= 0)
        low, high = np.maximum(at - NEAR, start)[here], np.minimum(at + NEAR + 1, stop)[here]
        signs, word = mix(h), top[here]
        running = np.zeros(len(h) + 1, np.int64)
        for d in range(COMPANY):
            sign = ((signs >> np.uint64(d)) & np.uint64(1)).astype(np.int64) * 2 - 1
            np.cumsum(sign, out=running[1:])
            total[d] += np.bincount(word, running[high] - running[low] - sign[here], total.shape[1])
        total[COMPANY] += np.bincount(word, minlength=total.shape[1])


def add_gradient(model: Model, t: Text, total: np.ndarray) -> None:
    """Adds for each row and class what is there (total[0]), and the sum of the probabilities of the class (total[1])."""
    add_gradients(model, [t], total)


def add_gradients(model: Model, texts: Iterable[Text], total: np.ndarray) -> None:
    """As add_gradient, for many texts: the tokens of up to HELD, or of one text, are taken together."""
    held, n = [], 0
    for t in texts:
        _, cls, three = model.contexts(*tokens(t))
        if n + len(cls) > HELD:
            _add_tokens(model, held, total)
            held, n = [], 0
        held.append(three * CLASSES + cls)
        n += len(cls)
    _add_tokens(model, held, total)


def _add_tokens(model: Model, held: list[np.ndarray], total: np.ndarray) -> None:
    if not held:
        return
    token = np.concatenate(held)
    token.sort()
    new = _changes(token)
    times, token = np.diff(new, append=len(token)).astype(np.float64), token[new]
    three, there = token // CLASSES, total[0].reshape(-1)
    for a in range(0, len(token), BLOCK):
        own = slice(a, a + BLOCK)
        for r in model.rows(three[own]):
            np.add.at(there, r.astype(np.int64) * CLASSES + token[own] % CLASSES, times[own])
    new = _changes(three)
    three, times = three[new], np.add.reduceat(times, new).astype(np.float32)
    for at, rows, pair, p in model.logits(three):
        np.exp(p, out=p)
        p *= (times[at : at + BATCH] / np.einsum("ij->i", p))[:, None]
        sums = [_sums(r, p) for r in rows[_OF_THREES]]
        which, p = _sums(pair, p)
        own = rows[:, _changes(pair)[which]]
        for r, x in sums + [_sums(r, p) for r in own[_OF_PAIRS]]:
            total[1][r] += x


def _summed(texts: DataFrame, told, shape: tuple[int, ...], add: Callable) -> np.ndarray:
    """The sum over all texts of what add(told, texts, total) adds to an array of a shape."""
    value = texts.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        add(value.value, (t for batch in batches for _, _, t in texts_of(batch, "text")), total)
        flat, salt = total.reshape(-1), TaskContext.get().partitionId() % SALTS
        for k in range(0, len(flat), BLOCK):
            if flat[k : k + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([flat[k : k + BLOCK].astype(np.float32).tobytes()])], _PART.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(data.as_buffer(), np.float32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([x.astype(np.float32).tobytes()])], _PART.names)

    out = np.zeros(int(np.prod(shape)))
    for row in texts.mapInArrow(run, _PART).repartition("block", "salt").mapInArrow(merge, _PART).collect():  # SALTS arrays at most
        out[row.block : row.block + len(row.data) // 4] += np.frombuffer(row.data, np.float32)
    value.destroy()
    return out.reshape(shape)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(hash, ending, count) with each hash once."""
    h, ending, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    h, at, to = np.unique(h, return_index=True, return_inverse=True)
    return h, ending[at], np.bincount(to, n, len(h)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        for _, _, t in texts_of(batch, "text"):
            h, ending, _ = tokens(t)
            parts.append(_merged([(h, ending, np.ones(len(h), np.int64))]))
            held += len(parts[-1][0])
            if held > 1 << 20:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > 1 << 19:
                    yield _counts(parts.pop())
                    held = 0
    if parts:
        yield _counts(_merged(parts))


def _counts(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    h, ending, n = part
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(ending, pa.int32()), pa.array(n)], _COUNTED.names)


class Trained:
    """A model and the table (word, ending, n) of all counts."""

    def __init__(self, model: Model, counts: DataFrame):
        self.model, self.counts = model, counts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: tuple[float, ...] = STEPS) -> Trained:
    """Counts all tokens of the texts, finds classes and trains the weights."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(len(steps))).alias("round"), F.col(text_col).cast("string").alias("text"))
    counts = as_table(texts.select("text").mapInArrow(_count, _COUNTED).groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")), "word_counts")
    sums = {r.ending: (r.n, r.words) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}  # a row for each ending
    top = counts.filter("ending >= 0").orderBy(F.desc("n"), "word").limit(TOP_WORDS).toArrow()
    word, ending, n = (top.column(c).to_numpy() for c in ("word", "ending", "n"))
    rest = {b: (c - int(n[ending == b].sum()), m - int((ending == b).sum())) for b, (c, m) in sums.items() if b >= 0}
    v = Vocabulary(np.ascontiguousarray(word).view(np.uint64), n, sums.get(-1, (0, 0))[0], rest, sum(c for c, _ in sums.values()), sum(m for _, m in sums.values()))
    part = [texts.filter(F.col("round") == k).select("text") for k in range(len(steps))]
    v.classify(_summed(texts.select("text"), v, (COMPANY + 1, len(word)), add_company).T.copy())
    model = Model(v)
    for step, own in zip(steps, part, strict=True):
        there, expected = _summed(own, model, (2, ROWS, CLASSES), add_gradients)
        model.weight += step * np.clip(np.log((there + DAMPING) / (expected + DAMPING)), -2, 2).astype(np.float32)
    return Trained(model, counts)


def score_texts(model: Model, t: Text) -> tuple[np.ndarray, ...]:
    """Tokens, known top tokens, base and model log10 of each text without the counts of rare words; the rare words (text, hash, times)."""
    v = model.vocabulary
    h, ending, first = tokens(t)
    top, cls, three = model.contexts(h, ending, first)
    order = np.argsort(three)
    three = three[order]
    new = np.append(_changes(three), len(three))
    own = np.empty(len(h), np.float32)
    for a, _, _, x in model.logits(three[new[:-1]]):
        places = new[a : a + BATCH + 1]
        i, j = places[0], places[-1]
        of = np.repeat(np.arange(len(x)), np.diff(places))
        own[i:j] = x.ravel().take(of * CLASSES + cls[order[i:j]])
        own[i:j] -= np.log(np.einsum("ij->i", np.exp(x, out=x))).take(of)
    p = np.empty(len(h))
    p[order] = own
    p /= np.log(10)
    known, end = top >= 0, ending < 0
    rare = ~known & ~end
    base = np.full(len(h), v.base_rare)
    base[end] = v.base_end
    base[known], p[known] = v.base[top[known]], p[known] + v.within[top[known]]
    p[rare] += v.rare_within[ending[rare]]
    owner = np.repeat(np.arange(t.n), np.diff(first))
    n_top = np.bincount(owner[known], minlength=t.n) + (v.ends > 0)
    at = np.flatnonzero(rare)
    order = np.lexsort((h[at], owner[at]))
    word, of = h[at][order], owner[at][order]
    new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (of[1:] != of[:-1]))) if len(word) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(word)))
    return np.diff(first), n_top, np.add.reduceat(base, first[:-1]), np.add.reduceat(p, first[:-1]), of[new], word[new], times


def score(docs: DataFrame, trained: Trained, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    bound_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(trained.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("word", pa.int64()), ("n", pa.int32())])
        for batch in batches:
            for i, j, t in texts_of(batch, "text"):
                size, n_top, base, p, of, word, times = score_texts(told.value, t)
                pairs = pa.StructArray.from_arrays([pa.array(signed(word)), pa.array(times, pa.int32())], fields=list(kind))
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(t.n + 1)), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(size), pa.array(n_top), pa.array(base), pa.array(p), rare], _SCORED.names)

    rows = docs.select(F.monotonically_increasing_id().alias("score_row"), F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = as_table(rows.mapInArrow(run, _SCORED), "scored")
    v = trained.model.vocabulary
    # no top word is among the rare ones: no word has more than a TOP_WORDS-th of all tokens
    rare = scored.select("score_row", F.explode("rare").alias("r")).select("score_row", "r.word", "r.n")
    count = F.coalesce("c", F.lit(0))
    more = rare.join(trained.counts.select("word", F.col("n").alias("c")), "word", "left").groupBy("score_row").agg(F.sum(F.col("n") * F.log10(count + 1.0)).alias("more"), F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("n_more"))
    total = scored.drop("rare").join(more, "score_row", "left")
    added = F.coalesce("more", F.lit(0.0))
    return total.select("doc_id", "held_out", "n_tokens", (F.col("n_top") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(int(v.total)).cast("long").alias("train_tokens"), (F.col("base") + added).alias("base_score"), (F.col("model") + added).alias("score"))


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether a document is not for training, by the crc32 of its id; a null id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
