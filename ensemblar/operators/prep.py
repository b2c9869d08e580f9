"""Preparation of training windows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CELL, grown, names, over
from .intervals import interval_overlap_join


def window_cut(series: DataFrame, length: int, overlap: float = 0.0, keep_last: bool = True) -> DataFrame:
    """Windows (first, last) of n_frames with a step of ceil(length x (1 - overlap)); the last one moved back to end with the series, or left out."""
    step = max(1, ceil(round(length * (1 - overlap), 9)))
    starts = F.sequence(F.lit(0), F.col("n_frames") - length, F.lit(step))
    if keep_last:
        starts = F.array_distinct(F.concat(starts, F.array(F.col("n_frames") - length)))
    d = series.filter(F.col("n_frames") >= length).withColumn("first", F.explode(starts.cast("array<int>")))
    return d.withColumn("last", F.col("first") + length - 1)


def split_by_time(windows: DataFrame, shares: Sequence[tuple[str, float]], length: int) -> DataFrame:
    """Windows by the span of time they begin in; other sets than the first only get windows that do not overlap and lie wholly in their span."""
    low, part, ok = 0.0, F.lit(None).cast("string"), F.lit(False)
    for k, (name, share) in enumerate(shares):
        begin, end = F.floor(F.col("n_frames") * F.lit(round(low, 9))), F.floor(F.col("n_frames") * F.lit(round(low + share, 9)))
        here = (F.col("first") >= begin) & (F.col("first") < end)
        fits = here & (F.col("last") < end)
        ok = ok | (fits if k == 0 else fits & ((F.col("first") - begin) % length == 0))
        part = F.when(here, F.lit(name)).otherwise(part)
        low += share
    return windows.withColumn("part", part).filter(ok)


def seeded(*columns, seed: int = 0) -> Column:
    """A repeatable number from 0 to 999,982 of some integer columns."""
    x = F.lit(seed).cast("long") + 12345
    for c in columns:
        x = F.pmod(x * 48271 + F.col(c).cast("long") * 16807 + 11, F.lit(999983))
    return x


def shuffled(df: DataFrame, part: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """Adds the place of each row in a repeatable random order of its part."""
    return df.withColumn("place", F.row_number().over(over(part, seeded(key, seed=seed), key)))


def merge_window_predictions(predictions: DataFrame) -> DataFrame:
    """By frame and class the largest value over windows (session_id, cell, first, probs: one value a frame) and augmented copies."""
    f = predictions.select(*CELL, "class", "first", F.posexplode("probs").alias("at", "p"))
    return f.groupBy(*CELL, "class", (F.col("first") + F.col("at")).alias("frame")).agg(F.max("p").alias("p"))


def strata(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """Content of each window (session_id, cell, first, last): by runs (first, last, real, amplitude) that lie in it whole or cut.

    kind: true, cut_true, false, cut_false or background, the first that fits; several: more than one run.
    """
    met = interval_overlap_join(windows, runs, CELL)
    whole = (F.col("b_first") >= F.col("first")) & (F.col("b_last") <= F.col("last"))
    c = lambda x: F.max(F.when(x, 1).otherwise(0))
    g = met.groupBy(*CELL, "first", "last").agg(F.count("b_first").alias("n"), F.max("amplitude").alias("amplitude"), c(F.col("real") & whole).alias("a"), c(F.col("real") & ~whole).alias("b"), c(~F.col("real") & whole).alias("c"), c(~F.col("real") & ~whole).alias("d"))
    kind = F.when(F.col("a") == 1, "true").when(F.col("b") == 1, "cut_true").when(F.col("c") == 1, "false").when(F.col("d") == 1, "cut_false").otherwise("background")
    d = grown(windows).join(g, [*CELL, "first", "last"], "left").select(*CELL, "first", "last", kind.alias("kind"), (F.coalesce("n", F.lit(0)) > 1).alias("several"), "amplitude")
    quarter = F.ntile(4).over(over(["session_id", "kind"], "amplitude", "cell", "first"))
    return d.withColumn("quartile", F.when(F.col("amplitude").isNotNull(), quarter))


def strata_shares(strata_: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    n = strata_.groupBy(*names(by), "kind").agg(F.count("first").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(over(by)))


def balance(strata_: DataFrame, ratios: DataFrame, tolerance: float = 0.5, seed: int = 0) -> DataFrame:
    """Copies of windows that bring the kinds' shares near the ratios (kind, ratio): too frequent kinds lose windows, rare ones get augmented copies.

    A kind is left as it is while its share is within ``tolerance`` of its ratio (relatively).
    """
    n = strata_.groupBy("kind").agg(F.count("first").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    plan = n.crossJoin(total).join(ratios, "kind").select("kind", (F.col("ratio") * F.col("t") / F.col("n")).alias("factor"))  # one row of a total
    factor = F.when(F.abs(F.col("factor") - 1) <= tolerance, 1.0).otherwise(F.col("factor"))
    d = strata_.join(plan, "kind").withColumn("_f", factor).withColumn("_u", seeded("cell", "first", seed=seed) / 999983)
    copies = F.floor(F.col("_f")).cast("int") + (F.col("_u") < F.col("_f") - F.floor("_f")).cast("int")
    return d.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("factor", "_f", "_u", "copies")


def sample_weights(strata_: DataFrame) -> DataFrame:
    """Weight 1, +3 for a whole true run, +5 for a true run in the top quartile of amplitude, +50 for several runs of which one is true."""
    w = F.lit(1) + F.when(F.col("kind") == "true", 3).otherwise(0) + F.when((F.col("kind") == "true") & (F.col("quartile") == 4), 5).otherwise(0) + F.when(F.col("several") & F.col("kind").isin("true", "cut_true"), 50).otherwise(0)
    return strata_.withColumn("weight", w)


def shuffle_cells(windows: DataFrame, cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n copies of each window (session_id, window_id) with the session's cells in another order: (session_id, window_id, copy, cell, new_cell)."""
    d = windows.select("session_id", "window_id").join(cells.select(*CELL), "session_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("new_cell", (F.row_number().over(over(["session_id", "window_id", "copy"], seeded("window_id", "copy", "cell", seed=seed), "cell")) - 1).cast("int"))


def blind_ids(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, blind_id): ids in a repeatable random order, the table that undoes the blinding.

    Keys are ranked inside the first three digits of their hash; the 4,096 counts of these give where each begins.
    """
    d = df.select(key).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    begin = d.groupBy("_b").agg(F.count("_h").alias("_n")).withColumn("_before", F.sum("_n").over(over([], "_b")) - F.col("_n")).drop("_n")
    return d.join(begin, "_b").select(key, (F.col("_before") + F.row_number().over(over("_b", "_h", key))).alias("blind_id"))
