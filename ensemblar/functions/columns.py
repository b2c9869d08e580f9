"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ("session_id", "cell")


def names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def over(part: str | Sequence[str], *order) -> WindowSpec:
    w = W.partitionBy(*names(part))
    return w.orderBy(*order) if order else w


def ratio(a, b, default: float | None = None) -> Column:
    """a / b; the default (null) where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    r = F.when(b != 0, a.cast("double") / b)
    return r if default is None else F.coalesce(r, F.lit(default))


def shift(cell, k, n_frames, seed: int = 0) -> Column:
    """A repeatable pseudo-random shift of 1 to n_frames - 1 frames."""
    cell, k, n = (F.col(x) if isinstance(x, str) else x for x in (cell, k, n_frames))
    return F.lit(1) + F.pmod(cell.cast("long") * 7919 + k.cast("long") * 104729 + seed, n.cast("long") - 1)


def grown(df: DataFrame) -> DataFrame:
    """Rows made by explode.  Spark takes them for as many as before it and may send them whole through the driver; their joins shuffle instead."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows that the next steps multiply, by key in a fixed number of tasks.

    Spark merges small partitions by the bytes before rows grow; a number that is asked for stays.
    """
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def frames_of(sessions: DataFrame) -> DataFrame:
    """Every frame of every session, active or not."""
    return grown(sessions.select("session_id", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame")))


def cells_of(sessions: DataFrame) -> DataFrame:
    return grown(sessions.select("session_id", F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("cell")))


def on(a: DataFrame, b: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, names(keys), how)
