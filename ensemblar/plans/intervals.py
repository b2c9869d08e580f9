"""Queries of runs, intervals and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CELL
from ..operators import intervals as I
from .registry import query

_MARKS = "ons AS (SELECT session_id, cell, frame FROM act WHERE frame % 3 = 0), pks AS (SELECT session_id, cell, frame FROM act WHERE frame % 3 <> 0)"
_RUN = "SELECT session_id, cell, min(frame) AS first, max(frame) AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, cell ORDER BY frame) AS g FROM {}) GROUP BY session_id, cell, g"
_MERGE = "SELECT {part}, min(first) AS first, max(last) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY {part} ORDER BY first, last) AS g FROM (SELECT *, CASE WHEN first - max(last) OVER (PARTITION BY {part} ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS new FROM {of})) GROUP BY {part}, g"


def _marks(t):
    return t.act.filter("frame % 3 = 0"), t.act.filter("frame % 3 <> 0")


@query("o1_runs", "SELECT session_id, cell, first, last FROM tr")
def o1(t):
    return I.runs(t.act, CELL)


@query("o2_transients", "SELECT session_id, cell, transient_id, first AS onset, last AS peak FROM tr")
def o2(t):
    return I.transients(t.act).select(*CELL, "transient_id", F.col("first").alias("onset"), F.col("last").alias("peak"))


@query("o3_activity_from_onsets_peaks", f"WITH {_MARKS} SELECT session_id, cell, first, last, last - first + 1 > 10 AS too_long FROM (SELECT o.session_id, o.cell, o.frame AS first, min(p.frame) AS last FROM ons o JOIN pks p ON o.session_id = p.session_id AND o.cell = p.cell AND p.frame > o.frame GROUP BY ALL)")
def o3(t):
    return I.activity_from_onsets_peaks(*_marks(t), longest=10)


_SLOPES = """d AS (SELECT *, value - lag(value) OVER w AS slope FROM traces WINDOW w AS (PARTITION BY session_id, cell ORDER BY frame)),
    d2 AS (SELECT *, lead(slope) OVER w AS ns FROM d WINDOW w AS (PARTITION BY session_id, cell ORDER BY frame)),
    m AS (SELECT *, lead(slope) OVER (PARTITION BY session_id, cell ORDER BY frame) AS nm FROM d WHERE slope <> 0),
    lv AS (SELECT session_id, cell, min(value) + {k} * stddev_pop(value) AS level FROM traces GROUP BY ALL),
    pk AS (SELECT session_id, cell, frame, value FROM m WHERE slope > 0 AND nm < 0)"""
_JUDGED = """b AS (SELECT session_id, cell, frame, 'peak' AS kind, value < level AS low FROM {of} JOIN lv USING (session_id, cell)
          UNION ALL SELECT session_id, cell, frame, 'onset', NULL FROM d2 WHERE slope < 0 AND ns >= 0),
    c AS (SELECT *, lead(kind) OVER w AS nk, lead(low) OVER w AS nl FROM b WINDOW w AS (PARTITION BY session_id, cell ORDER BY frame, kind))
    SELECT session_id, cell, frame, kind FROM c WHERE NOT (coalesce(low, false) OR (kind = 'onset' AND coalesce(nk, '') = 'peak' AND coalesce(nl, false)))"""


def taken(key: str, of: str, value: str, distance: int) -> str:
    """Common tables: the rows of a table taken one after the other, the highest first, each so far from those before (tk)."""
    k = key.split(", ")
    same = " AND ".join(f"o.{x} = r.{x}" for x in k)
    return f"""od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value} DESC, frame) AS k FROM {of}),
    tk0 AS (SELECT {key}, 0::BIGINT AS k, []::INT[] AS taken FROM od WHERE k = 1
      UNION ALL SELECT {", ".join("r." + x for x in k)}, o.k, CASE WHEN len(list_filter(r.taken, lambda x: abs(x - o.frame) < {distance})) = 0 THEN list_append(r.taken, o.frame) ELSE r.taken END FROM tk0 r JOIN od o ON {same} AND o.k = r.k + 1),
    tk AS MATERIALIZED (SELECT od.* FROM od JOIN (SELECT {key}, arg_max(taken, k) AS taken FROM tk0 GROUP BY {key}) r USING ({key}) WHERE list_contains(r.taken, od.frame))"""


@query("o4_onsets_peaks_from_trace", "WITH " + _SLOPES.format(k=1) + ", " + _JUDGED.format(of="pk"))
def o4(t):
    return I.onsets_peaks_from_trace(t.traces, 1.0)


@query("o4b_spaced_peaks", "WITH RECURSIVE " + _SLOPES.format(k=0.5) + ", " + taken("session_id, cell", "pk", "value", 5) + ", " + _JUDGED.format(of="tk"))
def o4b(t):
    return I.onsets_peaks_from_trace(t.traces, 0.5, distance=5)


@query("o5_merge_periods", _MERGE.format(part="session_id, cell", gap=3, of="tr"))
def o5(t):
    return I.merge_periods(t.tr, 3, CELL)


@query("o6_periods_to_frames", "SELECT session_id, event_id, unnest(range(first, last + 1))::INT AS frame FROM pop")
def o6(t):
    return I.periods_to_frames(t.pop).select("session_id", "event_id", "frame")


@query("o7_fill_short_gaps", f"SELECT session_id, cell, unnest(range(first, last + 1))::INT AS frame FROM ({_MERGE.format(part='session_id, cell', gap=3, of='tr')})")
def o7(t):
    return I.fill_short_gaps(t.act, 2)


_CAND = "cand AS (" + _RUN.format("(SELECT * FROM act WHERE frame % 4 <> 3)") + "), tru AS (" + _RUN.format("truth") + ")"
_HIT = "EXISTS (SELECT 1 FROM tru WHERE tru.session_id = cand.session_id AND tru.cell = cand.cell AND tru.first <= cand.last AND cand.first <= tru.last)"


def _candidates(t):
    return I.runs(t.act.filter("frame % 4 <> 3"), CELL), I.runs(t.truth, CELL)


@query("o8_false_transients", f"WITH {_CAND} SELECT session_id, cell, first, last FROM cand WHERE NOT {_HIT}")
def o8(t):
    return I.false_transients(*_candidates(t))


@query("o9_snap_to_candidates", f"WITH {_CAND} SELECT session_id, cell, first, last FROM cand WHERE {_HIT}")
def o9(t):
    c, p = _candidates(t)
    return I.snap_to_candidates(p, c)


@query(
    "o10_nearest_frame",
    """WITH n AS (SELECT session_id, count(*)::INT AS n FROM clock GROUP BY ALL),
    b AS (SELECT e.session_id, e.event_id, e.t, a.frame AS f0, a.t AS t0 FROM ev e ASOF LEFT JOIN clock a ON e.session_id = a.session_id AND e.t >= a.t),
    c AS (SELECT b.*, z.frame AS f1, z.t AS t1 FROM b ASOF LEFT JOIN clock z ON b.session_id = z.session_id AND b.t <= z.t)
    SELECT c.session_id, event_id, CASE WHEN f0 IS NULL THEN -1 WHEN f1 IS NULL THEN n WHEN c.t - t0 < t1 - c.t THEN f0 ELSE f1 END AS frame FROM c JOIN n USING (session_id)""",
)
def o10(t):
    return I.nearest_frame(t.ev.select("session_id", "event_id", "t"), t.clock).select("session_id", "event_id", "frame")


@query("o11_frames_to_times", "SELECT p.session_id, p.cell, p.first, p.last, a.t AS t0, b.t AS t1 FROM tr p JOIN clock a ON p.session_id = a.session_id AND p.first = a.frame JOIN clock b ON p.session_id = b.session_id AND p.last = b.frame WHERE p.last - p.first >= 1")
def o11(t):
    return I.frames_to_times(t.tr.drop("transient_id"), t.clock, 2).select(*CELL, "first", "last", "t0", "t1")


_DAYS = "days AS (SELECT DISTINCT session_id, t0 AS t, t0::INT AS frame FROM ivl)"


def _days(t):
    return t.ivl.select("session_id", F.col("t0").alias("t"), F.col("t0").cast("int").alias("frame")).distinct()


@query("o12_shortest_label_per_frame", f"WITH {_DAYS}, s AS (SELECT * FROM ivl WHERE label <> '5-LOW'), b AS (SELECT d.session_id, d.frame, arg_min(label, (t1 - t0, label)) AS l FROM days d JOIN s ON s.session_id = d.session_id AND t BETWEEN t0 AND t1 GROUP BY ALL) SELECT d.session_id, d.frame, coalesce(l, 'still') AS label FROM days d LEFT JOIN b USING (session_id, frame)")
def o12(t):
    return I.shortest_label_per_frame(t.ivl.filter("label <> '5-LOW'"), _days(t), bucket=30.0)


@query("o13_union_intervals", "SELECT DISTINCT session_id, label, t0, t1 FROM ivl")
def o13(t):
    return I.union_intervals(t.ivl.filter("t0 < 1500"), t.ivl.filter("t0 > 1000"))


@query("o14_align_clocks", "WITH a AS (SELECT session_id, 'left' AS stream, t FROM ev WHERE cell < 5), b AS (SELECT session_id, 'right' AS stream, t FROM ev WHERE cell >= 5), s AS (SELECT a.session_id, greatest(min(a.t), b0) AS lo, least(max(a.t), b1) AS hi FROM a JOIN (SELECT session_id, min(t) AS b0, max(t) AS b1 FROM b GROUP BY ALL) USING (session_id) GROUP BY a.session_id, b0, b1) SELECT u.* FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u JOIN s USING (session_id) WHERE t BETWEEN lo AND hi")
def o14(t):
    side = lambda c, n: t.ev.filter(c).select("session_id", F.lit(n).alias("stream"), "t")
    return I.align_clocks(side("cell < 5", "left"), side("cell >= 5", "right"))


@query("o15_resolve_annotations", "WITH m AS (SELECT session_id, cell, frame, CASE WHEN frame % 2 = 0 THEN 'onset' ELSE 'peak' END AS kind, count(*) AS score FROM ev GROUP BY ALL) SELECT m.session_id, m.cell, s.first AS x_from, s.last AS x_to, kind, arg_max(frame, (score, frame)) AS frame FROM m JOIN tr s ON s.session_id = m.session_id AND s.cell = m.cell AND frame BETWEEN s.first AND s.last WHERE s.transient_id % 2 = 1 GROUP BY ALL")
def o15(t):
    kind = F.when(F.col("frame") % 2 == 0, "onset").otherwise("peak")
    marks = t.ev.groupBy(*CELL, "frame").agg(F.count("frame").alias("score")).withColumn("kind", kind)
    spans = t.tr.select(*CELL, F.col("first").alias("x_from"), F.col("last").alias("x_to"), (F.col("transient_id") % 2 == 1).alias("accept"))
    return I.resolve_annotations(marks, spans)


@query("o16_onsets_before_peaks", f"WITH {_MARKS} SELECT p.session_id, p.cell, p.frame AS peak, o.frame AS onset FROM pks p JOIN ons o ON o.session_id = p.session_id AND o.cell = p.cell AND o.frame BETWEEN p.frame - 10 AND p.frame")
def o16(t):
    ons, pks = _marks(t)
    return I.onsets_before_peaks(pks, ons, 10)


@query("o17_overlay_segments", "WITH s AS (SELECT session_id, cell, unnest(range(first, last + 1))::INT AS frame FROM tr WHERE transient_id % 3 = 0), b AS (SELECT session_id, cell, frame, 'base' AS label FROM act) SELECT coalesce(b.session_id, s.session_id) AS session_id, coalesce(b.cell, s.cell) AS cell, coalesce(b.frame, s.frame) AS frame, CASE WHEN s.cell IS NULL THEN label ELSE 'segment' END AS label, s.cell IS NOT NULL AS scored FROM b FULL JOIN s ON b.session_id = s.session_id AND b.cell = s.cell AND b.frame = s.frame")
def o17(t):
    return I.overlay_segments(t.act.withColumn("label", F.lit("base")), t.tr.filter("transient_id % 3 = 0").withColumn("label", F.lit("segment")))


@query("j1_event_window_join", "SELECT p.session_id, p.event_id, a.cell, a.frame, a.frame - p.first AS rel FROM pop p JOIN act a ON a.session_id = p.session_id AND a.frame BETWEEN p.first - 3 AND p.first + 4")
def j1(t):
    return I.event_window_join(t.pop.select("session_id", "event_id", F.col("first").alias("frame")), t.act, 3, 4).select("session_id", "event_id", "cell", "frame", "rel")


@query("j2_interval_overlap_join", "SELECT a.session_id, a.event_id, m.label, m.first AS b_first, m.last AS b_last FROM pop a JOIN mvt m ON m.session_id = a.session_id AND m.first <= a.last AND a.first <= m.last")
def j2(t):
    return I.interval_overlap_join(t.pop, t.mvt, bucket=4).select("session_id", "event_id", "label", "b_first", "b_last")


@query("j3_pair_self_join", "SELECT a.session_id, a.cell, b.cell AS cell2, count(*) AS n FROM act a JOIN act b ON a.session_id = b.session_id AND a.frame = b.frame AND a.cell < b.cell GROUP BY ALL")
def j3(t):
    return I.pair_self_join(t.act).groupBy("session_id", "cell", "cell2").agg(F.count("frame").alias("n"))


@query("j4_semi_anti", "SELECT session_id, cell, frame FROM act a WHERE NOT EXISTS (SELECT 1 FROM truth x WHERE x.session_id = a.session_id AND x.cell = a.cell AND x.frame = a.frame)")
def j4(t):
    return t.act.join(t.truth, [*CELL, "frame"], "left_anti")


@query("j5_coactive_frames", "WITH p AS (SELECT a.session_id, a.cell, b.cell AS cell2, a.frame FROM act a JOIN act b ON a.session_id = b.session_id AND a.frame = b.frame AND b.cell = a.cell + 1) SELECT session_id, cell, cell2, min(frame) AS first, max(frame) AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, cell ORDER BY frame) AS g FROM p) GROUP BY session_id, cell, cell2, g")
def j5(t):
    pairs = t.act.select("session_id", "cell").distinct().withColumn("cell2", F.col("cell") + 1)
    return I.coactive_runs(t.act, pairs)
