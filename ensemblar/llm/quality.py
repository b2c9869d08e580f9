"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lowered, white space runs equal) and hashed.  For each
host the number of distinct documents that hold a line is counted; lines above a
limit are boilerplate and are taken out; documents that lose most of their words
that way are depleted and rejected, as are those that fail the base rules.

Copies must not make a clean text look like boilerplate, so documents that hold
the same set of normalised lines count as one document; all others count each.

Defined cases: a null or empty text has no words and fails the base rules; a
null host is a host of its own; rows with equal ids are judged alike; a null id
gets the base rules only; keep_good judges each row by its text and host, whatever its id;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import as_table, bound_batches, content_key, unused
from .textnum import LOWER, NOT_SPACE, Text, grams, mix, run_hashes, signed, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more distinct documents of one host than this is boilerplate.
MAX_DOCS_PER_HOST = 30
#: A document is depleted if less than this share of its words is left, in percent.
MIN_LEFT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, digest long, lines array<long>, line_words array<int>"


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _measure(t: Text) -> list[pa.Array]:
    start, end, at = t.words(NOT_SPACE)
    n_words = np.diff(at)
    in_word = NOT_SPACE[t.data] & ((t.data & 0xC0) != 0x80)
    owner = np.repeat(np.arange(t.n), n_words)
    plain = t.hashes(start, end)

    # words inside a three-word window that the same text holds twice
    key = grams(plain, 3)
    covered = np.zeros(len(start), bool)
    if len(key):
        whole = np.flatnonzero(owner[: len(key)] == owner[2:])
        k = mix(key[whole] + owner[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, where, times = np.unique(k, return_inverse=True, return_counts=True)
        hit = whole[times[where] > 1]
        for j in range(3):
            covered[hit + j] = True

    # lines that hold a word, as they stand and normalised
    l_start, l_end, l_owner = t.lines()
    w0, w1 = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
    held = w1 > w0
    l_start, l_end, l_owner, w0, w1 = l_start[held], l_end[held], l_owner[held], w0[held], w1[held]
    raw = mix(t.hashes(l_start, l_end) + l_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(raw, return_index=True)
    n_dup = np.bincount(l_owner, minlength=t.n) - np.bincount(l_owner[once], minlength=t.n)

    low = Text(LOWER[t.data], t.offsets)
    line = run_hashes(low.hashes(start, end), w0, w1)
    # one entry for each line of a text, with the words in all its places
    _, first, where = np.unique(mix(line + l_owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), return_index=True, return_inverse=True)
    words = np.bincount(where, weights=w1 - w0, minlength=len(first)).astype(np.int32)
    order = np.argsort(first)
    first, words = first[order], words[order]
    counts = np.bincount(l_owner[first], minlength=t.n)
    # a text's set of lines as one number
    sums = np.zeros(len(first) + 1, np.uint64)
    np.cumsum(mix(line[first] + np.uint64(1)), out=sums[1:])
    end_at = np.cumsum(counts)
    digest = mix(sums[end_at] - sums[end_at - counts])
    numbers = [n_words, t.count(in_word), t.count(_SYMBOL[t.data]), n_dup, _sums(covered, at)]
    return [pa.array(x.astype(np.int64)) for x in numbers] + [pa.array(signed(digest)), _lists(signed(line[first]), counts, pa.int64()), _lists(words, counts, pa.int32())]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        for i, j, t in texts_of(batch, "text"):
            ids, host = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
            yield pa.RecordBatch.from_arrays([ids, host, *_measure(t)], names)


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", id_type: str = "long") -> DataFrame:
    """Counts of each text, with its distinct normalised lines, their words and a digest of their set."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).mapInArrow(_stats, STATS.replace("doc_id long", f"doc_id {id_type}"))


#: Frequent lines that are sent to all tasks; with more of them, the tasks that share the rows of one line.
SENT_LINES, LINE_PARTS = 100_000, 32


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(host, line, n_docs) of the lines above the limit; lines has host, line and digest."""
    once = lines.groupBy("host", "line", "digest").agg(F.lit(1).alias("one"))
    return once.groupBy("host", "line").agg(F.count("one").alias("n_docs")).filter(F.col("n_docs") > max_docs)


def quality_rules(
    docs: DataFrame,
    max_docs: int = MAX_DOCS_PER_HOST,
    min_left_percent: int = MIN_LEFT_PERCENT,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    id_type: str = "long",
) -> DataFrame:
    """One row per document: counts, base_failed, the boilerplate lines found in it, and kept."""
    # three steps read them: texts are measured once
    stats = as_table(text_stats(docs, id_col, text_col, host_col, id_type), "text_stats")
    lines = (
        stats.select("doc_id", F.coalesce("host", F.lit("\0")).alias("host"), "digest", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
        .select("doc_id", "host", "digest", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    )
    often = as_table(frequent_lines(lines, max_docs).select(F.col("host").alias("o_host"), F.col("line").alias("o_line")), "frequent_lines")
    met = (F.col("host") == F.col("o_host")) & (F.col("line") == F.col("o_line"))
    if often.count() <= SENT_LINES:
        found = lines.join(F.broadcast(often), met)
    else:
        # a line may be in all documents of a host: its rows are dealt to some tasks, each of which gets the line
        parts = often.withColumn("o_part", F.explode(F.sequence(F.lit(0), F.lit(LINE_PARTS - 1))))
        found = lines.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(LINE_PARTS))).join(parts, met & (F.col("part") == F.col("o_part")))
    lost = (
        found
        .groupBy(F.col("doc_id").alias("lost_id"))
        .agg(F.sum("words").alias("lost"), F.count_distinct("line").alias("n_boilerplate_lines"), F.collect_set("line").alias("boilerplate"), F.count("line").alias("n_found"))
        # rows with equal ids are counted together above: their shares are those of one row
        .withColumn("lost", F.expr("lost * n_boilerplate_lines div n_found"))
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost_words = F.coalesce("lost", F.lit(0))
    return (
        stats.drop("digest", "lines", "line_words")
        .join(lost, F.col("doc_id") == F.col("lost_id"), "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
            (~base & (100 * (F.col("n_words") - lost_words) >= min_left_percent * F.col("n_words"))).alias("kept"),
            F.coalesce("n_boilerplate_lines", F.lit(0)).alias("n_boilerplate_lines"), lost_words.alias("n_boilerplate_words"), "boilerplate",
        )
    )


def _without(text_col: str, gone_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        at_text, at_gone = names.index(text_col), names.index(gone_col)
        out, gone = [], batch.column(at_gone)
        for i, j, t in texts_of(batch, text_col):
            l_start, l_end, l_owner = t.lines()
            start, end, _ = t.words(NOT_SPACE)
            line = signed(run_hashes(Text(LOWER[t.data], t.offsets).hashes(start, end), np.searchsorted(start, l_start), np.searchsorted(start, l_end)))
            first = np.searchsorted(l_owner, np.arange(t.n + 1))
            for d in range(t.n):
                drop = gone[i + d].as_py()
                whole = batch.column(at_text)[i + d].as_py()
                if drop and whole is not None:
                    own = slice(first[d], first[d + 1])
                    keep = ~np.isin(line[own], np.array(drop, np.int64))
                    raw = t.data[t.offsets[d] : t.offsets[d + 1]].tobytes()
                    base = t.offsets[d]
                    whole = b"\n".join(raw[s - base : e - base] for s, e, k in zip(l_start[own], l_end[own], keep, strict=True) if k).decode()
                out.append(whole)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at_text else batch.column(k) for k in range(len(names)) if k != at_gone], [n for n in names if n != gone_col])


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The documents that the rules keep, with all their columns; boilerplate lines are gone from their texts.

    The verdict depends on text and host alone, so rows meet it by these, not by their ids.
    """
    key, v_key, gone = unused(docs, "content_key", "verdict_key", "boilerplate")
    rows = docs.withColumn(key, content_key(F.col(text_col).cast("string"), F.col(host_col).cast("string")))
    verdict = quality_rules(rows, **(options | {"id_col": key, "id_type": "string", "text_col": text_col, "host_col": host_col})).filter("kept")
    verdict = verdict.groupBy(F.col("doc_id").alias(v_key)).agg(F.first("boilerplate").alias(gone))
    kept = rows.join(verdict, F.col(key) == F.col(v_key)).select(*docs.columns, gone)
    return kept.mapInArrow(partial(_without, text_col, gone), docs.schema)
