"""The driver's tables seen as the engine's tables, in Spark and in SQL.

Events become activity: a session is an event type and ten users, a cell is a user,
a frame is six hours.  Line items become traces and edges, orders intervals and
visits, embeddings cells in space.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CELL, dealt, grown, over
from ..operators import intervals as I

N_FRAMES, N_CELLS = 120, 10


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _ev(self, *more: Column) -> DataFrame:
        e = self.table("events")
        seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
        return e.select(
            F.concat("event_type", F.lit("-"), F.expr("user_id div 10").cast("string")).alias("session_id"), (F.col("user_id") % 10).cast("int").alias("cell"),
            F.floor(seconds / 21600).cast("int").alias("frame"), "event_id", "value", F.expr("cast(ts as timestamp_ntz)").alias("ts"), seconds.cast("double").alias("t"), *more,
        )

    @cached_property
    def ev(self) -> DataFrame:
        return self._ev()

    @cached_property
    def act(self) -> DataFrame:
        return self.ev.select("session_id", "cell", "frame").distinct()

    @cached_property
    def sess(self) -> DataFrame:
        g = self.table("events").select("event_type", F.expr("user_id div 10").alias("g")).distinct()
        return g.select(F.concat("event_type", F.lit("-"), F.col("g").cast("string")).alias("session_id"), F.concat(F.lit("m"), F.col("g").cast("string")).alias("subject_id"), (5 + F.col("g") % 4).cast("int").alias("age"), F.lit(1.0).alias("rate_hz"), F.lit(N_FRAMES).alias("n_frames"), F.lit(N_CELLS).alias("n_cells"))

    @cached_property
    def tr(self) -> DataFrame:
        return I.transients(self.act)

    @cached_property
    def pop(self) -> DataFrame:
        """Population events: runs of frames with three active cells or more."""
        busy = self.act.groupBy("session_id", "frame").agg(F.count("cell").alias("n")).filter("n >= 3")
        return I.runs(busy).withColumn("event_id", F.row_number().over(over("session_id", "first")).cast("long"))

    @cached_property
    def mvt(self) -> DataFrame:
        """Movement: runs of cells 0 and 1, as two labels."""
        r = I.runs(self.act.filter("cell < 2"), CELL)
        return r.select("session_id", F.when(F.col("cell") == 0, "twitch").otherwise("long").alias("label"), "first", "last")

    @cached_property
    def traces(self) -> DataFrame:
        """Sums of all cells and frames, 0 without events; rows are made last, where their session was dealt to."""
        own = ["session_id", "event_type", "_g"]
        e = dealt(self._ev(F.col("event_type"), F.expr("user_id div 10").alias("_g")), "session_id")
        sums = e.groupBy(*own, "cell", "frame").agg(F.round(F.sum("value"), 2).alias("v"))
        known = F.col("session_id").isNotNull() & F.col("cell").between(0, N_CELLS - 1) & F.col("frame").between(0, N_FRAMES - 1)
        sessions = sums.groupBy(*own).agg(F.collect_list(F.when(known, F.struct("cell", "frame", "v"))).alias("x"))
        cells = sessions.select("session_id", "x", F.explode(F.sequence(F.lit(0), F.lit(N_CELLS - 1))).alias("cell"))
        at = F.map_from_entries(F.transform(F.filter("x", lambda r: r["cell"] == F.col("cell")), lambda r: F.struct(r["frame"], r["v"])))
        values = F.transform(F.sequence(F.lit(0), F.lit(N_FRAMES - 1)), lambda f: F.coalesce(F.col("at")[f], F.lit(0.0)))
        return grown(cells.select("session_id", "cell", at.alias("at")).select("session_id", "cell", F.posexplode(values).alias("frame", "value")))

    @cached_property
    def pred(self) -> DataFrame:
        g = self.ev.groupBy("session_id", "cell", "frame").agg(F.max("value").alias("m"), F.round(F.sum("value"), 2).alias("s"))
        a = g.select("session_id", "cell", "frame", F.lit("max").alias("method"), F.least(F.col("m") / 200, F.lit(1.0)).alias("p"))
        return a.unionByName(g.select("session_id", "cell", "frame", F.lit("sum").alias("method"), F.least(F.col("s") / 300, F.lit(1.0)).alias("p")))

    @cached_property
    def truth(self) -> DataFrame:
        return self.ev.groupBy("session_id", "cell", "frame").agg(F.max("value").alias("m")).filter("m > 50").drop("m")

    @cached_property
    def sig(self) -> DataFrame:
        order = F.row_number().over(over("session_id", "ts", "event_id")) - 1
        return self.ev.select("session_id", F.lit("piezo").alias("channel"), order.cast("long").alias("i"), "t", "value")

    @cached_property
    def clock(self) -> DataFrame:
        f = self.act.select("session_id", "frame").distinct()
        order = (F.row_number().over(over("session_id", "frame")) - 1).cast("int")
        return f.select("session_id", order.alias("frame"), (21600.0 * F.col("frame") + F.col("frame") % 7).alias("t"))

    @cached_property
    def ivl(self) -> DataFrame:
        o = self.table("orders")
        day = F.expr("datediff(o_orderdate, date'1995-01-01')")
        return o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("session_id"), F.col("o_orderpriority").alias("label"), day.cast("double").alias("t0"), (day + F.col("o_orderkey") % 5).cast("double").alias("t1"))

    @cached_property
    def edges(self) -> DataFrame:
        e = self.table("lineitem").select(F.col("l_returnflag").alias("session_id"), (F.col("l_suppkey") % 40).cast("int").alias("src"), (F.col("l_partkey") % 40).cast("int").alias("dst")).filter("src <> dst")
        return e.groupBy("session_id", "src", "dst").agg(F.count("src").alias("weight"))

    @cached_property
    def cells(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.concat(F.lit("e"), F.col("label").cast("string")).alias("session_id"), F.col("vec_id").cast("int").alias("cell"), (100 * (F.col("embedding")[0].cast("double") + 1)).alias("cx"), (100 * (F.col("embedding")[1].cast("double") + 1)).alias("cy"))

    @cached_property
    def baskets(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_returnflag").alias("session_id"), F.col("l_orderkey").alias("basket"), (F.col("l_partkey") % 30).cast("int").alias("item")).distinct()

    @cached_property
    def ecells(self) -> DataFrame:
        """Event members from orders: one session of 400 orders, cells are parts."""
        l = self.table("lineitem")
        return l.select(F.concat(F.lit("o"), F.expr("l_orderkey div 40").cast("string")).alias("session_id"), F.col("l_orderkey").alias("event_id"), (F.col("l_partkey") % 20).cast("int").alias("cell")).distinct()

    @cached_property
    def pixels(self) -> DataFrame:
        """Embeddings as movie frames of 8 x 8 pixels, a session for each label and 100 vectors."""
        e = self.table("embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
        return e.select(F.concat(F.lit("e"), F.col("label").cast("string"), F.lit("-"), F.expr("vec_id div 500").cast("string")).alias("session_id"), (F.col("vec_id") % 500).cast("int").alias("frame"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))

    @cached_property
    def masks(self) -> DataFrame:
        """Nine overlapping squares of 4 x 4 pixels in each movie."""
        s = self.pixels.select("session_id").distinct()
        cell = s.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(8))))
        x = F.explode(F.expr("sequence(cast(cell div 3 * 2 as int), cast(cell div 3 * 2 + 3 as int))"))
        y = F.explode(F.sequence(F.col("cell") % 3 * 2, F.col("cell") % 3 * 2 + 3))
        return cell.withColumn("x", x).withColumn("y", y).select("session_id", "cell", "x", "y")

    @cached_property
    def rises(self) -> DataFrame:
        """Frames of each cell with a positive mean in its mask, weighted by it."""
        m = self.pixels.join(self.masks, ["session_id", "x", "y"]).groupBy("session_id", "cell", "frame").agg(F.avg("v").alias("w"))
        return m.filter("w > 0.02")


#: The same tables in SQL; each may use those before it.
SQL_TABLES = {
    "ev": "SELECT event_type || '-' || (user_id // 10) AS session_id, (user_id % 10)::INT AS cell, floor(floor(epoch(ts) - 1704067200) / 21600)::INT AS frame, event_id, value, ts, floor(epoch(ts) - 1704067200)::DOUBLE AS t FROM events",
    "act": "SELECT DISTINCT session_id, cell, frame FROM ev",
    "sess": "SELECT DISTINCT event_type || '-' || (user_id // 10) AS session_id, 'm' || (user_id // 10) AS subject_id, (5 + (user_id // 10) % 4)::INT AS age, 1.0::DOUBLE AS rate_hz, 120 AS n_frames, 10 AS n_cells FROM events",
    "tr": "SELECT session_id, cell, min(frame) AS first, max(frame) AS last, row_number() OVER (PARTITION BY session_id, cell ORDER BY min(frame)) AS transient_id FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, cell ORDER BY frame) AS g FROM act) GROUP BY session_id, cell, g",
    "busy": "SELECT session_id, frame FROM act GROUP BY ALL HAVING count(*) >= 3",
    "pop": "SELECT session_id, min(frame) AS first, max(frame) AS last, row_number() OVER (PARTITION BY session_id ORDER BY min(frame)) AS event_id FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id ORDER BY frame) AS g FROM busy) GROUP BY session_id, g",
    "mvt": "SELECT session_id, CASE WHEN cell = 0 THEN 'twitch' ELSE 'long' END AS label, first, last FROM tr WHERE cell < 2",
    "spine": "SELECT session_id, cell::INT AS cell, frame::INT AS frame FROM sess, range(10) c(cell), range(120) f(frame)",
    "traces": "SELECT session_id, cell, frame, coalesce(v, 0.0) AS value FROM spine LEFT JOIN (SELECT session_id, cell, frame, round(sum(value), 2) AS v FROM ev GROUP BY ALL) USING (session_id, cell, frame)",
    "pred": "SELECT session_id, cell, frame, 'max' AS method, least(max(value) / 200, 1.0) AS p FROM ev GROUP BY ALL UNION ALL SELECT session_id, cell, frame, 'sum', least(round(sum(value), 2) / 300, 1.0) FROM ev GROUP BY ALL",
    "truth": "SELECT session_id, cell, frame FROM ev GROUP BY ALL HAVING max(value) > 50",
    "sig": "SELECT session_id, 'piezo' AS channel, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS i, t, value FROM ev",
    "clock": "SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1)::INT AS frame, 21600.0 * frame + frame % 7 AS t FROM (SELECT DISTINCT session_id, frame FROM act)",
    "ivl": "SELECT 'c' || (o_custkey % 50) AS session_id, o_orderpriority AS label, (o_orderdate::DATE - DATE '1995-01-01')::DOUBLE AS t0, (o_orderdate::DATE - DATE '1995-01-01' + o_orderkey % 5)::DOUBLE AS t1 FROM orders",
    "edges": "SELECT l_returnflag AS session_id, (l_suppkey % 40)::INT AS src, (l_partkey % 40)::INT AS dst, count(*) AS weight FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 GROUP BY ALL",
    "cells": "SELECT 'e' || label AS session_id, vec_id::INT AS cell, 100 * (embedding[1]::DOUBLE + 1) AS cx, 100 * (embedding[2]::DOUBLE + 1) AS cy FROM embeddings",
    "pixels": "SELECT 'e' || label || '-' || (vec_id // 500) AS session_id, (vec_id % 500)::INT AS frame, (i % 8)::INT AS x, (i // 8)::INT AS y, embedding[i + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)",
    "masks": "SELECT session_id, c::INT AS cell, (c // 3 * 2 + a)::INT AS x, (c % 3 * 2 + b)::INT AS y FROM (SELECT DISTINCT session_id FROM pixels), range(9) q(c), range(4) r(a), range(4) s(b)",
    "rises": "SELECT session_id, cell, frame, avg(v) AS w FROM pixels JOIN masks USING (session_id, x, y) GROUP BY ALL HAVING avg(v) > 0.02",
    "baskets": "SELECT DISTINCT l_returnflag AS session_id, l_orderkey AS basket, (l_partkey % 30)::INT AS item FROM lineitem",
    "ecells": "SELECT DISTINCT 'o' || (l_orderkey // 40) AS session_id, l_orderkey AS event_id, (l_partkey % 20)::INT AS cell FROM lineitem",
}
_USES = {"act": ["ev"], "tr": ["act"], "busy": ["act"], "pop": ["busy"], "mvt": ["tr"], "spine": ["sess"], "traces": ["spine", "ev"], "pred": ["ev"], "truth": ["ev"], "sig": ["ev"], "clock": ["act"], "masks": ["pixels"], "rises": ["masks"]}


def with_tables(sql: str) -> str:
    """Puts the common tables that a statement names in front of it."""
    named, todo = set(), [x for x in SQL_TABLES if re.search(rf"\b{x}\b", sql)]
    while todo:
        x = todo.pop()
        if x not in named:
            named.add(x)
            todo += _USES.get(x, [])
    if not named:
        return sql
    head = ",\n".join(f"{x} AS ({SQL_TABLES[x]})" for x in SQL_TABLES if x in named)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},{body[14:]}"
    return f"WITH {head}{',' + body[4:] if body[:5].upper() == 'WITH ' else chr(10) + body}"
