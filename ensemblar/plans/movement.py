"""Queries of movement and behaviour.  Event values stand for a sensor's samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import movement as B
from .registry import query
from .series import rounded

_W = "WINDOW w AS (PARTITION BY session_id ORDER BY i)"
_ISL = "SELECT session_id, min(frame) AS first, max(frame) AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id ORDER BY frame) AS g FROM {}) GROUP BY session_id, g"
_MERGE = "SELECT {part}, min(first) AS first, max(last) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY {part} ORDER BY first, last) AS g FROM (SELECT *, CASE WHEN first - max(last) OVER (PARTITION BY {part} ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS new FROM {of})) GROUP BY {part}, g"
_EDGE = f"edge AS (SELECT session_id, i, t FROM (SELECT *, lag(value) OVER w AS was FROM sig {_W}) WHERE value >= 60 AND was < 60)"


@query("b1_run_speed", f"WITH {_EDGE} SELECT session_id, i, t, round(100000.0 / nullif(t - lag(t) OVER w, 0), 6) AS speed FROM edge {_W}")
def b1(t):
    return rounded(B.run_speed(t.sig, 60.0, 100000.0, 1.0)[0], "speed")


@query("b1b_run_periods", f"WITH {_EDGE}, k AS (SELECT session_id, lag(t) OVER w AS first, t AS last, 100000.0 / nullif(t - lag(t) OVER w, 0) AS speed FROM edge {_W}), f AS (SELECT session_id, first, last FROM k WHERE speed >= 2) SELECT session_id, first AS t0, last AS t1 FROM ({_MERGE.format(part='session_id', gap=20000, of='f')})")
def b1b(t):
    return B.run_speed(t.sig, 60.0, 100000.0, 2.0, 20000.0)[1]


_QUAD = f"q AS (SELECT session_id, i, t, value AS va, (i * 37) % 100 AS vb FROM sig), qt AS (SELECT session_id, i, t, CASE WHEN va >= 60 AND lag(va) OVER w < 60 THEN CASE WHEN vb < 60 THEN 1 ELSE -1 END ELSE 0 END AS tick FROM q {_W}), qp AS (SELECT *, sum(tick) OVER w * 2.5::DOUBLE AS travelled FROM qt {_W})"


def _quadrature(t):
    other = t.sig.withColumn("value", (F.col("i") * 37 % 100).cast("double"))
    return B.position_from_quadrature(t.sig, other, 60.0, 2.5, 20.0)


@query("b2_position_from_quadrature", f"WITH {_QUAD} SELECT session_id, i, t, tick, travelled, travelled - 20 * floor(travelled / 20) AS position FROM qp")
def b2(t):
    return _quadrature(t)


_LAP = _QUAD + ", lp AS (SELECT qp.session_id, qp.i, travelled, sum((value > 200)::INT) OVER (PARTITION BY qp.session_id ORDER BY qp.i) AS lap FROM qp JOIN sig USING (session_id, i)), lq AS (SELECT session_id, i, lap::BIGINT AS lap, CASE WHEN lap = 0 THEN travelled - last_value(travelled) OVER w + 20 ELSE travelled - first_value(travelled) OVER w END AS position FROM lp WINDOW w AS (PARTITION BY session_id, lap ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def _laps(t):
    return B.laps(_quadrature(t).select("session_id", "i", "travelled"), t.sig.filter("value > 200").select("session_id", "i"), 20.0)


@query("b3_laps", f"WITH {_LAP} SELECT * FROM lq")
def b3(t):
    return _laps(t).select("session_id", "i", "lap", "position")


@query("b4_run_bouts", f"WITH s AS (SELECT session_id, i, t, value AS speed, i * 3.0::DOUBLE AS position FROM sig), e AS (SELECT session_id, min(i) AS lo, max(i) AS hi FROM s GROUP BY ALL), b AS (SELECT session_id, min(i) AS i0, max(i) AS i1, min(t) AS t0, max(t) AS t1, arg_max(position, i) AS stop, arg_min(position, i) AS frm FROM (SELECT *, i - row_number() OVER (PARTITION BY session_id ORDER BY i) AS g FROM s WHERE speed >= 40) GROUP BY session_id, g) SELECT session_id, i0, i1, t0, t1, t1 - t0 AS seconds, stop - frm AS distance, stop FROM b JOIN e USING (session_id) WHERE i0 > lo AND i1 < hi")
def b4(t):
    return B.run_bouts(t.sig.select("session_id", "i", "t", F.col("value").alias("speed"), (F.col("i") * 3.0).alias("position")), 40.0)


@query("b5_position_histogram", f"WITH {_LAP} SELECT session_id, lap, least(floor(position * 20 / 20), 19)::INT AS bin, count(*) AS n FROM lq WHERE position BETWEEN 0 AND 20 GROUP BY ALL")
def b5(t):
    return B.position_histogram(_laps(t), 20.0)


@query("b6_quiet_threshold", "WITH x AS (SELECT session_id, value, unnest([i // 5, i // 5 - 1]) AS w FROM sig), d AS (SELECT session_id, w, stddev_pop(value) AS s, count(*) AS n FROM x WHERE w >= 0 GROUP BY ALL) SELECT session_id, round(3 * min(s), 6) AS threshold FROM d WHERE n = 10 GROUP BY session_id")
def b6(t):
    return rounded(B.quiet_threshold(t.sig, 10, 3.0), "threshold")


@query("b7_detect_movement", f"WITH f AS (SELECT session_id, i AS frame FROM sig WHERE value >= 60), r AS ({_ISL.format('f')}) {_MERGE.format(part='session_id', gap=3, of='r')}")
def b7(t):
    return B.detect_movement(t.sig, t.sess.select("session_id", F.lit(60.0).alias("threshold")), 3)


@query("b8_detect_movement_window", f"WITH s AS (SELECT session_id, i, sum(value) OVER x AS s, count(*) OVER x AS n FROM sig WINDOW x AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), f AS (SELECT session_id, i AS frame FROM s WHERE n = 4 AND s > 4 * 60.005) SELECT session_id, first, last + 3 AS last FROM ({_ISL.format('f')})")
def b8(t):
    return B.detect_movement_window(t.sig, 4, 60.005)


_KIND = "SELECT *, (last - first + 1) * 100.0 AS size, (first - lag(last) OVER w - 1) * 100.0 AS back, (lead(first) OVER w - last - 1) * 100.0 AS ahead FROM pop WINDOW w AS (PARTITION BY session_id ORDER BY first)"


@query("b9_classify_movement", f"SELECT session_id, event_id, first, last, CASE WHEN size >= 400 THEN 'complex' WHEN size <= 200 AND coalesce(back >= 300, true) AND coalesce(ahead >= 200, true) THEN 'twitch' WHEN size <= 200 THEN 'short' ELSE 'intermediate' END AS kind FROM ({_KIND})")
def b9(t):
    return B.classify_movement(t.pop, 10.0, 400, 200, 300, 200).select("session_id", "event_id", "first", "last", "kind")


@query("b10_isolated_twitches", "SELECT session_id, event_id, first, last FROM (SELECT *, first - lag(last) OVER (PARTITION BY session_id ORDER BY first) AS b FROM pop) WHERE last - first + 1 <= 2 AND (b IS NULL OR b >= 5)")
def b10(t):
    return B.isolated_twitches(t.pop, 2, 5).select("session_id", "event_id", "first", "last")


@query("b11_motion_shift_periods", f"WITH d AS (SELECT session_id, frame, round(sum(value), 3) AS value FROM traces GROUP BY ALL), f AS (SELECT session_id, frame FROM (SELECT *, avg(value) OVER p + 1.55 * stddev_pop(value) OVER p AS lim FROM d WINDOW p AS (PARTITION BY session_id)) WHERE value > lim) {_ISL.format('f')}")
def b11(t):
    d = t.traces.groupBy("session_id", "frame").agg(F.round(F.sum("value"), 3).alias("value"))
    return B.motion_shift_periods(d)


_SHIFT = "sh AS (SELECT session_id, frame, max(value) FILTER (cell = 0) AS x, max(value) FILTER (cell = 1) AS y FROM traces GROUP BY ALL), dd AS (SELECT session_id, frame, sqrt(x * x + y * y) AS d FROM sh), da AS (SELECT session_id, frame, abs(d - m) AS d FROM dd JOIN (SELECT session_id, quantile_cont(d, 0.5) AS m FROM dd GROUP BY ALL) USING (session_id)), dz AS (SELECT session_id, frame, (d - avg(d) OVER p) / nullif(stddev_pop(d) OVER p, 0) AS x FROM da WINDOW p AS (PARTITION BY session_id))"


def _shift(t):
    at = lambda c: F.max(F.when(F.col("cell") == c, F.col("value")))
    return t.traces.groupBy("session_id", "frame").agg(at(0).alias("x"), at(1).alias("y"))


@query("b12_displacement", f"WITH {_SHIFT} SELECT session_id, frame, round(x, 6) AS value FROM dz")
def b12(t):
    return rounded(B.displacement(_shift(t)), "value")


@query("b12b_shift_correlations", f"WITH {_SHIFT}, g AS (SELECT session_id, frame, round(sum(value), 3) AS y FROM traces GROUP BY ALL), j AS (SELECT session_id, round(x, 6) AS x, y FROM dz JOIN g USING (session_id, frame) WHERE x IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY session_id ORDER BY x) + (count(*) OVER (PARTITION BY session_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY session_id ORDER BY y) + (count(*) OVER (PARTITION BY session_id, y) - 1) / 2.0 AS ry FROM j) SELECT session_id, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r GROUP BY session_id")
def b12b(t):
    d = rounded(B.displacement(_shift(t)), "value").filter("value IS NOT NULL")
    g = t.traces.groupBy("session_id", "frame").agg(F.round(F.sum("value"), 3).alias("value"))
    return rounded(B.correlations(d, g), "pearson", "spearman")


@query("b13_frame_clock", f"WITH {_EDGE} SELECT session_id, (row_number() OVER w - 1)::INT AS frame, i, t FROM edge {_W}")
def b13(t):
    return B.frame_clock(t.sig, 60.0)


@query("b13b_even_clock", f"WITH {_EDGE}, c AS (SELECT session_id, (row_number() OVER w - 1)::INT AS frame, t FROM edge {_W}) SELECT session_id, frame, round(min(t) OVER p + coalesce((max(t) OVER p - min(t) OVER p) * frame / nullif(count(*) OVER p - 1, 0), 0), 4) AS t FROM c WINDOW p AS (PARTITION BY session_id)")
def b13b(t):
    return rounded(B.even_clock(t.sig, 60.0), "t", digits=4)


@query("b14_resample_at_frames", f"WITH {_EDGE}, c AS (SELECT session_id, (row_number() OVER w - 1)::INT AS frame, i FROM edge {_W}) SELECT c.session_id, c.i, frame, value FROM c JOIN sig ON sig.session_id = c.session_id AND sig.i = c.i WHERE c.i % 2 = 0")
def b14(t):
    return B.resample_at_frames(B.every_kth(t.sig, 2), B.frame_clock(t.sig, 60.0))


_PARTS = "pf AS (SELECT DISTINCT session_id, CASE WHEN cell IN (0, 1) THEN 'paw' ELSE 'part' || cell END AS part, frame FROM traces WHERE value >= 20 + 5 * cell), pp AS (SELECT session_id, part, min(frame) AS first, max(frame) AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, part ORDER BY frame) AS g FROM pf) GROUP BY session_id, part, g)"


def _parts(t):
    signals = t.traces.select("session_id", F.concat(F.lit("part"), F.col("cell").cast("string")).alias("channel"), "frame", "value")
    channels = signals.select("channel").distinct()
    limits = channels.withColumn("threshold", 20.0 + 5 * F.substring("channel", 5, 9).cast("int"))
    return B.bodypart_activity(signals, limits, channels.filter("channel IN ('part0', 'part1')").withColumn("part", F.lit("paw")))


@query("b15_bodypart_activity", f"WITH {_PARTS} SELECT * FROM pf")
def b15(t):
    return _parts(t)


@query(
    "b16_classify_behaviour",
    f"WITH {_PARTS}, m AS ({_MERGE.format(part='session_id', gap=0, of='(SELECT session_id, first, last FROM pp)')}), g AS (SELECT m.session_id, m.first, m.last, count(DISTINCT part) AS n, arg_min(part, (pp.first, part)) AS ld FROM m JOIN pp ON pp.session_id = m.session_id AND pp.first <= m.last AND m.first <= pp.last GROUP BY ALL), l AS (SELECT session_id, CASE WHEN n >= 3 AND last - first + 1 >= 4 THEN 'complex' WHEN n >= 3 THEN 'startle' WHEN last - first + 1 >= 4 THEN 'move_' || ld ELSE 'twitch_' || ld END AS label, first, last FROM g) {_MERGE.format(part='session_id, label', gap=2, of='l')}",
)
def b16(t):
    return B.classify_behaviour(I.runs(_parts(t), ("session_id", "part")), 2, 4, 3)


@query("b17_any_movement", f"WITH {_PARTS}, f AS (SELECT DISTINCT session_id, frame FROM pf) {_ISL.format('f')}")
def b17(t):
    return B.any_movement(_parts(t))


@query("b18_active_from_position", f"WITH p AS (SELECT session_id, frame, count(*) FILTER (cell < 3 AND value > 0) AS position FROM traces GROUP BY ALL), f AS (SELECT session_id, frame FROM (SELECT *, position <> lag(position) OVER (PARTITION BY session_id ORDER BY frame) AS d FROM p) WHERE d), r AS ({_ISL.format('f')}), x AS (SELECT session_id, greatest(0, first - 2) AS first, least(119, last + 1) AS last FROM r) {_MERGE.format(part='session_id', gap=5, of='x')}")
def b18(t):
    p = t.traces.groupBy("session_id", "frame").agg(F.sum(F.when((F.col("cell") < 3) & (F.col("value") > 0), 1).otherwise(0)).alias("position"))
    return B.active_from_position(p, t.sess, 2, 1, 6)
