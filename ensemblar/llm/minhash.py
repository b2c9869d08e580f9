"""Near-duplicate documents by circulant MinHash.

A document is its set of distinct five-word shingles.  A first permutation of
the 32-bit ring places the shingles; a second one, shifted circularly by k,
gives coordinate k of the signature, so two permutations make all coordinates.
Bands of the signature give candidates; full sets confirm each link.

Copies (equal sets) are one class with one representative.  Inside a band's
bucket every document meets the smallest one; small buckets also meet all round.
In large buckets what is not yet in one component is split further by rare
shingles (a pair at the threshold shares one of its rarest quarter), so that no
pair is given up and no bucket is expanded into all its pairs.

Two documents at the threshold miss all bands with probability
(1 - 0.75**3)**24 = 2e-6, and fewer above it.  Before the sets are read, pairs go whose 72
coordinates agree in fewer than 44 %: at the threshold that happens with probability 8e-9.

Defined cases: a null or blank text has an empty set, links with nothing and is
kept; a text of one to four words is one shingle; rows that repeat id and text
count once and all get the same result; a null id is kept and linked with nothing;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import joined, roots
from .scratch import as_table, durable, unused
from .textnum import LOWER, NOT_SPACE, Text, grams, mix, run_hashes, signed, texts_of

WORDS = 5
PERCENT = 75
BANDS, ROWS = 24, 3
#: Pairs whose signatures agree in a smaller share are not near: six standard deviations below 0.75.
LEAST_AGREEMENT = 0.44
#: Buckets up to this size are compared all round.
SMALL_BUCKET = 4

_SIGNED = "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary"


def shingle_sets(t: Text, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    low = Text(LOWER[t.data], t.offsets)
    start, end, at = low.words(NOT_SPACE)
    words = low.hashes(start, end)
    g = grams(words, width)
    n_words = np.diff(at)
    short = (n_words > 0) & (n_words < width)
    lone = run_hashes(words, at[:-1][short], at[1:][short])
    sets, k = [], 0
    for d in range(t.n):
        if n_words[d] >= width:
            sets.append(np.unique(g[at[d] : at[d + 1] - width + 1]))
        elif short[d]:
            sets.append(lone[k : k + 1])
            k += 1
        else:
            sets.append(g[:0])
    return (np.concatenate(sets) if sets else g[:0]), np.array([len(s) for s in sets], np.int64)


def signatures(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """(documents, size) minima of the second permutation at each circular shift of the first."""
    place = (mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), size), np.uint32)
    for k in range(size):
        v = place + np.uint32(k)
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v *= np.uint32(0xC2B2AE35)
        v ^= v >> np.uint32(16)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def _sign(width: int, bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, t in texts_of(batch, "text"):
            values, n = shingle_sets(t, width)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            d1, d2 = np.zeros(t.n, np.uint64), np.zeros(t.n, np.uint64)
            keys = np.zeros((t.n, bands), np.int64)
            low = np.zeros((t.n, bands * rows), np.uint8)
            if len(full):
                d1[full] = np.add.reduceat(mix(values), starts)
                d2[full] = np.add.reduceat(mix(values + np.uint64(0x632BE59BD9B4E019)), starts)
                sig = signatures(values, starts, bands * rows)
                low[full] = sig.astype(np.uint8)
                for b in range(bands):
                    h = np.full(len(full), b + 1, np.uint64)
                    for c in range(b * rows, (b + 1) * rows):
                        h = mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, c])
                    keys[full, b] = signed(h)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            sigs = pa.array([low[d].tobytes() for d in range(t.n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(signed(d1)), pa.array(signed(d2)), flat, sigs], ["doc_id", "n", "d1", "d2", "bands", "sig"])


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, t in texts_of(batch, "text"):
            values, n = shingle_sets(t, width)
            at = np.concatenate([[0], np.cumsum(n)])
            sets = pa.array([values[at[d] : at[d + 1]].tobytes() for d in range(t.n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sets], ["doc_id", "shingles"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = batch.column(1), np.array([0] + [len(x) // 8 for x in batch.column(1).to_pylist()], np.int64).cumsum().astype(np.int32)
        flat = np.frombuffer(b"".join(data.to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "shingles"])


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


# so that the filter on it is not pushed below and the agreement computed twice, by a second Python worker
_agreement = _agreement.asNondeterministic()


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        both.sort()
        out.append(int((both[1:] == both[:-1]).sum()))
    return pd.Series(out, dtype="int64")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link, with their agreement."""
    side = {x: reps.select(F.col("doc_id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("sig").alias(f"{x}_sig")) for x in "ab"}
    near = pairs.join(side["a"], F.col("a") == F.col("a_id")).join(side["b"], F.col("b") == F.col("b_id"))
    sized = near.filter(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return sized.select(*pairs.columns, "a_n", "b_n", _agreement("a_sig", "b_sig").alias("agreement")).filter(F.col("agreement") >= LEAST_AGREEMENT)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b, a_n, b_n, ...), by their full sets, with the other columns of the pairs."""
    left = sets.select(F.col("doc_id").alias("l_id"), F.col("shingles").alias("l"))
    right = sets.select(F.col("doc_id").alias("r_id"), F.col("shingles").alias("r"))
    met = pairs.join(left, F.col("a") == F.col("l_id")).join(right, F.col("b") == F.col("r_id"))
    counted = met.select(*pairs.columns, _common("l", "r").alias("common"))
    return counted.filter(100 * F.col("common") >= percent * (F.col("a_n") + F.col("b_n") - F.col("common"))).drop("a_n", "b_n", "common")


def _labelled(hits: DataFrame, parts: DataFrame) -> DataFrame:
    p = parts.select(F.col("node").alias("p_node"), F.col("component").alias("part"))
    return hits.join(p, F.col("doc_id") == F.col("p_node"), "left").drop("p_node").withColumn("part", F.coalesce("part", "doc_id"))


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs that lie in different components so far, with these as a_part and b_part."""
    for x in "ab":
        p = parts.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_part"))
        pairs = pairs.join(p, F.col(x) == F.col(f"{x}_node"), "left").withColumn(f"{x}_part", F.coalesce(f"{x}_part", x)).drop(f"{x}_node")
    return pairs.filter("a_part <> b_part")


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (doc_id, n, part) in different parts that share one of their rarest shingles.

    With shingles in one order, from rare to frequent, documents that reach the threshold
    share one of the first n - ceil(n * percent / 100) + 1 of each.
    """
    own = sets.join(members.select(F.col("doc_id").alias("m_id"), "n", "part"), F.col("doc_id") == F.col("m_id")).select("doc_id", "shingles")
    one = durable(own.mapInArrow(_listed, "doc_id long, shingles array<long>").select("doc_id", F.explode("shingles").alias("h")))
    often = one.groupBy(F.col("h").alias("o_h")).agg(F.count("doc_id").alias("df")).filter("df > 1")
    known = one.join(often, F.col("h") == F.col("o_h"))
    ranked = known.groupBy(F.col("doc_id").alias("k_id")).agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    # shingles of one document only come first in its order: they are never shared
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefix = ranked.join(members, F.col("k_id") == F.col("doc_id")).select("doc_id", "n", "part", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), length).cast("int"))).alias("pos", "x"))
    # from a shared place on, both must still have enough shingles to reach the threshold
    key = durable(prefix.select("doc_id", "n", "part", F.col("x.h").alias("h"), (F.col("n") - F.col("alone") - F.col("pos")).alias("left")))
    other = key.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("part").alias("part2"), F.col("h").alias("h2"), F.col("left").alias("left2"))
    enough = (100 + percent) * F.least("left", "left2") >= percent * (F.col("n") + F.col("n2"))
    met = key.join(other, (F.col("h") == F.col("h2")) & (F.col("doc_id") < F.col("b")) & (F.col("part") != F.col("part2")) & enough)
    return met.select(F.col("doc_id").alias("a"), "b", F.col("part").alias("a_part"), F.col("part2").alias("b_part")).distinct()


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id) and kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = as_table(texts.mapInArrow(partial(_sign, width, bands, rows), _SIGNED), "minhash")
    full = base.filter("n > 0 AND doc_id IS NOT NULL")
    first = full.groupBy(F.col("n").alias("f_n"), F.col("d1").alias("f_1"), F.col("d2").alias("f_2")).agg(F.min("doc_id").alias("rep"))
    classes = full.join(first, (F.col("n") == F.col("f_n")) & (F.col("d1") == F.col("f_1")) & (F.col("d2") == F.col("f_2"))).drop("f_n", "f_1", "f_2", "d1", "d2")
    reps = durable(classes.filter("doc_id = rep").drop("rep").dropDuplicates(["doc_id"]))

    in_band = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = in_band.groupBy(F.col("key").alias("b_key")).agg(F.count("key").alias("size"), F.min("doc_id").alias("centre")).filter("size > 1")
    hits = durable(in_band.join(buckets, F.col("key") == F.col("b_key")).drop("b_key"))
    few = hits.filter(F.col("size") <= SMALL_BUCKET).select("key", "doc_id")
    round_ = few.join(few.select(F.col("key").alias("k2"), F.col("doc_id").alias("b")), (F.col("key") == F.col("k2")) & (F.col("doc_id") < F.col("b"))).select(F.col("doc_id").alias("a"), "b")
    star = hits.filter((F.col("size") > SMALL_BUCKET) & (F.col("doc_id") > F.col("centre"))).select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    likely = durable(_likely(round_.union(star).distinct(), reps, percent))

    crowded = hits.filter(F.col("size") > SMALL_BUCKET).select("doc_id")
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(crowded).distinct()
    sets = as_table(texts.join(wanted.withColumnRenamed("doc_id", "w_id"), F.col("doc_id") == F.col("w_id"), "left_semi").dropDuplicates(["doc_id"]).mapInArrow(partial(_sets, width), "doc_id long, shingles binary"), "shingles")

    # first the likeliest partner of each document, then what still lies between two components
    best = likely.groupBy("b").agg(F.max_by(F.struct("a", "a_n", "b_n"), F.struct("agreement", -F.col("a"))).alias("x")).select("x.a", "b", "x.a_n", "x.b_n")
    parts = roots(_confirmed(best, sets, percent))
    more = durable(_confirmed(_across(likely, parts).drop("agreement"), sets, percent))
    if not more.isEmpty():
        parts = joined(parts, more)

    big = durable(_labelled(hits.filter(F.col("size") > SMALL_BUCKET).select("key", "doc_id", "n"), parts))
    mixed = big.groupBy(F.col("key").alias("m_key")).agg(F.min("part").alias("p0"), F.max("part").alias("p1")).filter("p0 < p1").select("m_key")
    members = durable(big.join(mixed, F.col("key") == F.col("m_key"), "left_semi").select("doc_id", "n", "part").distinct())
    if not members.isEmpty():
        # a table in between: one Python worker for each running task is enough
        rest = durable(_likely(_rare_pairs(members, sets, percent), reps, percent).drop("agreement"))
        parts = joined(parts, _confirmed(rest, sets, percent))

    parts = parts.select(F.col("node").alias("p_node"), "component")
    told = base.select("doc_id", "n", "d1", "d2").join(first, (F.col("n") == F.col("f_n")) & (F.col("d1") == F.col("f_1")) & (F.col("d2") == F.col("f_2")), "left")
    told = told.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    out = told.join(parts, F.col("rep") == F.col("p_node"), "left").withColumn("component", F.coalesce("component", "rep"))
    same = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), same.alias("component_id"), F.coalesce(F.col("doc_id") == same, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near duplicates, with all columns."""
    (gone_id,) = unused(docs, "gone_id")
    gone = near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(options.get("id_col", "doc_id")).cast("long") == F.col(gone_id), "left_anti")
