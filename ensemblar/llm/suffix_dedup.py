"""Removal of repeated strings by suffix arrays over parts of the corpus.

A byte goes if a string of ``width`` bytes around it also starts earlier: in an
earlier document, or further left in its own.  One suffix array of a corpus fits
no machine, so the strings are dealt out such that equal ones meet:

1. The k-gram with the smallest hash inside a window of ``width`` bytes is the
   window's anchor.  Equal windows have equal anchors, so each anchor's windows are
   a problem of their own.  Neighbouring windows with one anchor are a segment.
2. Anchors that occur once are done.  Segments with equal bytes are one class: all
   but the first lie wholly in an earlier copy.
3. Where an anchor has several classes, their windows are dealt again by the bytes
   next to the anchor on the side where they reach further, and classed again.
4. What is left are texts that share some windows and not others.  Each task
   sorts the suffixes of its groups, by linear-time grouping (see grouping.py);
   neighbours that agree over the width are equal windows, the first stays.

All stages are joins and grouping with partial sums, so a frequent passage is
spread.  Groups of more than ``BIG_GROUP`` classes are dealt out further, window by
window by the next bytes beside the anchor, until a task can sort each of them.

Equal segments and equal parts are told by 64-bit hashes; the sorted rest is
compared by its bytes.

Defined cases: a null or empty text has no bytes; texts below the width lose
nothing; strings do not cross documents; rows that repeat id and text count once
and get the same result; a null id takes no part and loses nothing; further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouping import sort_suffixes
from .scratch import as_table, durable, unused
from .textnum import U64, Text, mix, powers, signed, texts_of

WIDTH = 100
ANCHOR = 32
#: Classes of a group above which its windows are dealt out by DEAL more bytes.
BIG_GROUP, DEAL = 4000, 16
#: Symbols after which a task sorts the groups that it holds.
CHUNK = 100_000
#: An anchor in more rows than HOT_ROWS is grouped apart; a list of at most HOT_ANCHORS of them is broadcast.
HOT_ROWS, HOT_ANCHORS = 20_000, 10_000

_SEGMENTS = "doc_id long, anchor long, content long, start long, windows int, lead int"
_PARTS = "part_key long, part_content long, doc_id long, start long, windows int, lead int, need int, bytes binary"
_GONE = "doc_id long, first long, end long"


def segments(t: Text, width: int, k: int) -> tuple[np.ndarray, ...]:
    """First window, last window and anchor place (byte positions) of each segment, and the anchor's hash."""
    n, span = len(t.data), width - k + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(U64)
    s = t.sums()
    _, down = powers(n + 1)
    g = mix((s[k:] - s[:-k]) * down[: n - k + 1])
    # the high half of the hash decides, the place breaks ties to the left
    v = ((g >> U64(32)) << U64(32)) | np.arange(len(g), dtype=U64)
    rows = np.concatenate([v, np.full(-len(v) % span, ~U64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    at = (np.minimum(back[:m], ahead[span - 1 : span - 1 + m]) & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.arange(m) + width <= np.repeat(t.offsets[1:], np.diff(t.offsets))[:m]
    first, last = inside.copy(), inside.copy()
    change = at[1:] != at[:-1]
    first[1:] &= ~inside[:-1] | change
    last[:-1] &= ~inside[1:] | change
    j0 = np.flatnonzero(first)
    return j0, np.flatnonzero(last), at[j0], g[at[j0]]


def _segment_rows(width: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, j, t in texts_of(batch, "text"):
            j0, j1, at, key = segments(t, width, k)
            d = np.searchsorted(t.offsets, j0, "right") - 1
            rows = (ids[i:j][d], signed(key), signed(t.hashes(j0, j1 + width)), j0 - t.offsets[d], (j1 - j0 + 1).astype(np.int32), (at - j0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["doc_id", "anchor", "content", "start", "windows", "lead"])


def _part_rows(width: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals the windows of some segments by the bytes left (half of what a window has beside the anchor) or right of it."""
    half = (width - k) // 2
    other = width - k - half + 1
    for batch in batches:
        ids = batch.column(0).to_numpy()
        lists = batch.column(2)
        at, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        start, windows, lead = (flat.field(x).to_numpy().astype(np.int64) for x in ("start", "windows", "lead"))
        at = at - at[0]
        for i, j, t in texts_of(batch, "text"):
            own = slice(at[i], at[j])
            d = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
            j0 = start[own] + t.offsets[d]
            j1, a = j0 + windows[own] - 1, j0 + lead[own]
            out: list[list] = [[] for _ in range(8)]
            raw = t.data.tobytes()
            for f, l, key0, key1, salt in ((j0, np.minimum(j1, a - half), a - half, a + k, 1), (np.maximum(j0, a - half + 1), j1, a, a + k + other, 2)):
                some = np.flatnonzero(l >= f)
                f, l, key0, key1, dd = f[some], l[some], key0[some], key1[some], d[some]
                if not len(some):
                    continue
                keys = signed(mix(t.hashes(key0, key1) + U64(salt)))
                contents = signed(t.hashes(f, l + width))
                out[0].append(keys)
                out[1].append(contents)
                out[2].append(ids[i:j][dd])
                out[3].append(f - t.offsets[dd])
                out[4].append((l - f + 1).astype(np.int32))
                out[5].append((key0 - f).astype(np.int32))
                out[6].append((width - (key1 - key0) + 1).astype(np.int32))
                out[7].extend(raw[x:y] + raw[z:w] for x, y, z, w in zip(f.tolist(), key0.tolist(), key1.tolist(), (l + width).tolist(), strict=True))
            if out[0]:
                columns = [pa.array(np.concatenate(x)) for x in out[:7]] + [pa.array(out[7], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PARTS.split(", ")])


def repeated_windows(keys: list[int], docs: list[int], starts: list[int], windows: list[int], leads: list[int], needs: list[int], contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of each window that an earlier one equals.  Texts with one key hold it after ``lead`` bytes; it is one symbol here."""
    number = {k: 258 + i for i, k in enumerate(dict.fromkeys(keys))}
    flat = b"".join(c[:lead] + b"\0" + c[lead:] + b"\0" for c, lead in zip(contents, leads, strict=True))
    size = np.array([len(c) + 2 for c in contents])
    base = np.cumsum(size) - size
    deepest = max(needs)
    text = np.frombuffer(flat, np.uint8).astype(np.int64) + 2
    text[base + np.array(leads)] = [number[k] for k in keys]
    text[base + size - 1] = 1
    text = np.append(text, 0)
    order = sort_suffixes(text)

    count = np.array(windows)
    owner = np.full(len(text), -1)
    place = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    owner[place] = np.repeat(np.arange(len(count)), count)
    order = order[owner[order] >= 0]
    padded = np.append(text, np.zeros(deepest, np.int64))
    need = np.array(needs)[owner[order]]
    new = np.ones(len(order), bool)
    new[1:] = need[1:] != need[:-1]
    for c in range(deepest):
        new[1:] |= (padded[order[1:] + c] != padded[order[:-1] + c]) & (need[1:] > c)
    group = np.cumsum(new)
    own = owner[order]
    window = order - base[own]
    rank = np.lexsort((np.array(starts)[own] + window, np.array(docs)[own], group))
    later = np.append(False, group[rank][1:] == group[rank][:-1])
    hit = rank[later]
    return own[hit], window[hit]


def _spans(docs: np.ndarray, starts: np.ndarray, width: int) -> pa.RecordBatch:
    """Byte ranges covered by some windows, neighbours joined; none of no windows."""
    o = np.lexsort((starts, docs))
    docs, starts = docs[o], starts[o]
    new = np.append(True, (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1))[: len(docs)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(docs))[: len(head)] - 1
    return pa.RecordBatch.from_arrays([pa.array(docs[head]), pa.array(starts[head]), pa.array(starts[tail] + width)], ["doc_id", "first", "end"])


def _sort_groups(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of part_key; whole groups are sorted together."""
    held: list[list] = [[] for _ in range(7)]
    symbols = 0

    def flush() -> pa.RecordBatch:
        own, window = repeated_windows(*held)
        out = _spans(np.array(held[1])[own], np.array(held[2])[own] + window, width)
        for x in held:
            x.clear()
        return out

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part_key", "doc_id", "start", "windows", "lead", "need", "bytes")]
        for row in zip(*columns, strict=True):
            if symbols > CHUNK and row[0] != held[0][-1]:
                yield flush()
                symbols = 0
            for x, v in zip(held, row, strict=True):
                x.append(v)
            symbols += len(row[6]) + 2
    if held[0]:
        yield flush()


def _dealt_further(level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of some parts, keyed by their place around the old key and DEAL of their bytes."""
    names = [x.split()[0] for x in _PARTS.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
    hashed = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True)
    for batch in batches:
        out: list[list] = [[] for _ in names]
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part_key", "doc_id", "start", "windows", "lead", "need", "bytes")]
        for key, doc, start, windows, lead, need, content in zip(*columns, strict=True):
            for w in range(windows):
                own = content[w : w + need - 1]
                head = b"%d:%d:" % (key, lead - w)
                row = (hashed(head + own[level * DEAL : (level + 1) * DEAL]), hashed(head + own), doc, start + w, 1, lead - w, need, own)
                for x, v in zip(out, row, strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _later(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The classes of rows with equal keys, each with its first row, and the rows that are not the first."""
    others = [c for c in rows.columns if c not in (*keys, "doc_id", "start")]
    classes = rows.groupBy(*keys).agg(F.min(F.struct("doc_id", "start", *others)).alias("x")).select(*keys, "x.*")
    top = classes.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("doc_id").alias("c_doc"), F.col("start").alias("c_start"))
    same = [F.col(k) == F.col(f"c_{k}") for k in keys]
    met = rows.join(top, same[0] if len(same) == 1 else same[0] & same[1])
    return classes, met.filter("doc_id <> c_doc OR start <> c_start").select(rows.columns)


def _marked(found: DataFrame, width: int, k: int) -> DataFrame:
    """Segments of anchors that occur again: those that an earlier one equals (later) and, of anchors with several contents, the first of each (open).

    Anchors meet in one exchange and are compared there; those of more than HOT_ROWS rows, a fixed number however
    large the corpus is, are grouped with partial sums instead.
    """
    counts = as_table(found.groupBy(F.col("anchor").alias("c_anchor")).agg(F.count("anchor").alias("n")).filter("n > 1"), "anchors")
    hot = counts.filter(F.col("n") > HOT_ROWS).select("c_anchor")
    n_hot = hot.count()
    # their rows leave before the exchange where the list of them is short enough to be sent to all tasks
    sent = F.broadcast(hot) if n_hot <= HOT_ANCHORS else hot
    cool = found.join(sent, F.col("anchor") == F.col("c_anchor"), "left_anti") if n_hot else found
    met = cool.join(counts.filter(F.col("n") <= HOT_ROWS), F.col("anchor") == F.col("c_anchor"))
    same = W.partitionBy("anchor", "content").orderBy("doc_id", "start")
    place = F.struct("doc_id", "start")
    first = F.first(place).over(same)
    whole = W.partitionBy("anchor")
    marked = met.select("doc_id", "start", "windows", "lead", (first != place).alias("later"), (F.min("content").over(whole) != F.max("content").over(whole)).alias("open"))
    out = marked.filter("later OR open")
    if not n_hot:
        return as_table(out, "segments")
    rows = as_table(found.join(sent, F.col("anchor") == F.col("c_anchor")).drop("c_anchor"), "hot_segments")
    classes, later = _later(rows, ["anchor", "content"])
    several = classes.groupBy(F.col("anchor").alias("s_anchor")).agg(F.count("anchor").alias("n")).filter("n > 1")
    firsts = classes.join(several, F.col("anchor") == F.col("s_anchor"), "left_semi")
    side = lambda d, is_later: d.select("doc_id", "start", "windows", "lead", F.lit(is_later).alias("later"), F.lit(True).alias("open"))
    return as_table(out.unionByName(side(later, True)).unionByName(side(firsts, False)), "segments")


def repeated_spans(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, first, end): byte ranges of documents (doc_id, text) that lie in strings found earlier; they may overlap."""
    found = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(partial(_segment_rows, width, k), _SEGMENTS)
    marked = _marked(found, width, k)
    end = F.col("start") + F.col("windows") + (width - 1)
    gone = marked.filter("later").select("doc_id", F.col("start").alias("first"), end.alias("end"))

    by_doc = marked.filter("NOT later").groupBy(F.col("doc_id").alias("b_id")).agg(F.collect_list(F.struct("start", "windows", "lead")).alias("segments"))
    texts = docs.select("doc_id", "text").join(by_doc, F.col("doc_id") == F.col("b_id")).select("doc_id", "text", "segments")
    parts = as_table(texts.mapInArrow(partial(_part_rows, width, k), _PARTS), "parts")
    part_classes, part_later = _later(parts.drop("bytes"), ["part_key", "part_content"])
    part_classes = durable(part_classes)
    gone = gone.union(part_later.select("doc_id", "start", end))

    columns = ["part_key", "doc_id", "start", "windows", "lead", "need", "bytes"]

    def opened(parts: DataFrame, classes: DataFrame) -> DataFrame:
        """The first of each class where a key has several, with their number."""
        sizes = classes.groupBy(F.col("part_key").alias("z_key")).agg(F.count("part_key").alias("n")).filter("n > 1")
        sized = classes.join(sizes, F.col("part_key") == F.col("z_key")).select(F.col("part_key").alias("y_key"), F.col("doc_id").alias("y_id"), F.col("start").alias("y_start"), "n")
        same = (F.col("part_key") == F.col("y_key")) & (F.col("doc_id") == F.col("y_id")) & (F.col("start") == F.col("y_start"))
        # repeated rows of one document give equal parts: one of them is enough
        return as_table(parts.join(sized, same).dropDuplicates(["part_key", "doc_id", "start"]).select(*columns, "n"), "open")

    open_, level = opened(parts, part_classes), 0
    while True:
        small = open_.filter(F.col("n") <= BIG_GROUP).select(columns).repartition("part_key").sortWithinPartitions("part_key", "doc_id", "start")
        gone = gone.union(small.mapInArrow(partial(_sort_groups, width), _GONE))
        big = open_.filter(F.col("n") > BIG_GROUP).select(columns)
        if big.isEmpty():
            return gone
        # once all bytes have been dealt by, a key has one class
        parts = as_table(big.mapInArrow(partial(_dealt_further, level), _PARTS), "parts")
        classes, later = _later(parts.drop("bytes"), ["part_key", "part_content"])
        gone = gone.union(later.select("doc_id", "start", F.col("start") + width))
        open_, level = opened(parts, durable(classes)), level + 1


def _merged(firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(firsts, kind="stable")
    firsts, reach = firsts[o], np.maximum.accumulate(ends[o])
    new = np.append(True, firsts[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return firsts[head], reach[np.append(head[1:], len(firsts)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        texts, lists = batch.column(1), batch.column(2)
        for k in range(batch.num_rows):
            raw = (texts[k].as_py() or "").encode()
            spans, kept = ([], []), raw
            if lists[k].is_valid and len(lists[k]):
                v = lists[k].values
                spans = _merged(v.field("first").to_numpy(), v.field("end").to_numpy())
                spans = spans[0].tolist(), spans[1].tolist()
                kept = b"".join(raw[a:b] for a, b in zip([0, *spans[1]], [*spans[0], len(raw)], strict=True))
            for x, v in zip(out, (len(raw), len(raw) - len(kept), len(spans[0]), hashlib.sha256(kept).hexdigest(), *spans), strict=True):
                x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "firsts", "ends"])


def suffix_dedup(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs (their firsts and ends), and a digest of what is left."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = as_table(repeated_spans(texts, width, k), "spans")
    by_doc = spans.groupBy(F.col("doc_id").alias("g_id")).agg(F.collect_list(F.struct("first", "end")).alias("gone"))
    joined = texts.join(by_doc, F.col("doc_id") == F.col("g_id"), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, firsts array<long>, ends array<long>")


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all columns, without the repeated bytes.  A character of which a byte is repeated goes as a whole."""
    r_id, r_firsts, r_ends = unused(docs, "found_id", "firsts", "ends")
    found = suffix_dedup(docs, width, k, id_col, text_col).filter("n_removed > 0").select(F.col("doc_id").alias(r_id), F.col("firsts").alias(r_firsts), F.col("ends").alias(r_ends)).dropDuplicates([r_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, f, e = (names.index(x) for x in (text_col, r_firsts, r_ends))
            texts = batch.column(at).to_pylist()
            for row in np.flatnonzero(batch.column(f).is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw, firsts, ends = texts[row].encode(), batch.column(f)[row].as_py(), batch.column(e)[row].as_py()
                texts[row] = b"".join(raw[a:b] for a, b in zip([0, *ends], [*firsts, len(raw)], strict=True)).decode(errors="ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(len(names)) if c not in (f, e)], [n for c, n in enumerate(names) if c not in (f, e)])

    return docs.join(found, F.col(id_col).cast("long") == F.col(r_id), "left").select(*docs.columns, r_firsts, r_ends).mapInArrow(cut, docs.schema)
