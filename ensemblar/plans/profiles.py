"""Queries of event-aligned profiles and population events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CELL
from ..operators import events as G
from ..operators import profiles as P
from .intervals import taken
from .registry import query
from .series import rounded

_WIN = "win AS (SELECT p.session_id, event_id, r::INT AS rel, (p.first + r)::INT AS frame FROM pop p, range(-4, 7) t(r) WHERE p.first + r BETWEEN 0 AND 119)"
_EA = _WIN + ", ea AS (SELECT w.session_id, age, event_id, rel, 100.0 * count(a.cell) / 10 AS pct FROM win w JOIN sess USING (session_id) LEFT JOIN act a ON a.session_id = w.session_id AND a.frame = w.frame GROUP BY w.session_id, age, event_id, rel)"
_SPREAD = "round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS std, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.75), 6) AS p75"
_FIVE = ("mean", "std", "p25", "median", "p75")


@query("w1_psth", f"WITH {_EA} SELECT session_id, rel, {_SPREAD.format('pct')} FROM ea GROUP BY ALL")
def w1(t):
    return rounded(P.psth(t.act, t.pop, t.sess, 4, 6), *_FIVE)


@query("w1b_psth_values", f"WITH {_WIN} SELECT session_id, rel, {_SPREAD.format('value')} FROM win JOIN traces USING (session_id, frame) GROUP BY ALL")
def w1b(t):
    return rounded(P.psth_values(t.traces, t.pop, t.sess, 4, 6), *_FIVE)


@query("w2_psth_by_group", f"WITH {_EA}, m AS (SELECT age, session_id, rel, avg(pct) AS m FROM ea GROUP BY ALL) SELECT age, rel, {_SPREAD.format('m')} FROM m GROUP BY ALL")
def w2(t):
    return rounded(P.psth_by_group(t.act, t.pop, t.sess, 4, 6, "age", pooled=False), *_FIVE)


@query("w3_psth_duration", f"WITH {_WIN}, f AS (SELECT session_id, frame, avg(1000.0 * (last - first + 1)) AS ms FROM (SELECT *, unnest(range(first, last + 1)) AS frame FROM tr) GROUP BY ALL), d AS (SELECT w.session_id, rel, coalesce(ms, 0) AS ms FROM win w LEFT JOIN f USING (session_id, frame)) SELECT session_id, rel, round(avg(ms), 5) AS mean_ms, round(stddev_pop(ms), 5) AS std_ms FROM d GROUP BY ALL")
def w3(t):
    return rounded(P.psth_duration(t.tr, t.pop, t.sess, 4, 6), "mean_ms", "std_ms", digits=5)


@query("w4_signal_average", "SELECT a.session_id, r::INT AS rel, round(avg(b.value), 6) AS mean, round(stddev_pop(b.value), 6) AS std, count(*) AS n FROM sig a, range(-5, 6) x(r), sig b WHERE a.value > 150 AND b.session_id = a.session_id AND b.i = a.i + r GROUP BY ALL")
def w4(t):
    return rounded(P.signal_average(t.sig, t.sig.filter("value > 150").select("session_id", "i"), 5, 5), "mean", "std")


@query("w5_trace_windows", f"WITH {_WIN} SELECT session_id, event_id, cell, list(value ORDER BY rel) AS values FROM win JOIN traces USING (session_id, frame) GROUP BY ALL")
def w5(t):
    return P.trace_windows(t.traces, t.pop, t.sess, 4, 6)


_PEAK = "pk AS (SELECT session_id, event_id, arg_max(frame, (n, -frame)) AS peak FROM pop p JOIN (SELECT session_id, frame, count(*) AS n FROM act GROUP BY ALL) USING (session_id) WHERE frame BETWEEN p.first AND p.last GROUP BY ALL)"


@query("w6_nearest_spikes", f"WITH {_PEAK}, e AS (SELECT *, coalesce(lag(peak) OVER w, -1) AS pv, coalesce(lead(peak) OVER w, 100000) AS nx FROM pk WINDOW w AS (PARTITION BY session_id ORDER BY peak)) SELECT e.session_id, event_id, cell, max(frame - peak) FILTER (frame < peak) AS before, min(frame - peak) FILTER (frame >= peak) AS after FROM e JOIN act a ON a.session_id = e.session_id AND frame > pv AND frame < nx AND frame BETWEEN peak - 20 AND peak + 20 GROUP BY ALL")
def w6(t):
    return P.nearest_spikes(t.act, P.event_peak_frame(t.act, t.pop), 20)


@query("w7_cell_lag_response", "WITH d AS (SELECT a.session_id, a.cell, event_id, a.frame FROM pop p JOIN tr0 a ON a.session_id = p.session_id AND a.frame BETWEEN p.first - 3 AND p.first + 3), h AS (SELECT session_id, cell, count(*) AS n, count(DISTINCT event_id) AS e, count(DISTINCT frame) AS f FROM d GROUP BY ALL), n AS (SELECT session_id, count(*) AS ne FROM pop GROUP BY ALL), s AS (SELECT session_id, cell, count(*) AS sp FROM tr0 GROUP BY ALL) SELECT session_id, cell, coalesce(n, 0) AS n_lags, round(100.0 * coalesce(e, 0) / ne, 6) AS pct_events, round(100.0 * coalesce(f, 0) / sp, 6) AS pct_spikes FROM s JOIN n USING (session_id) LEFT JOIN h USING (session_id, cell)".replace("tr0", "(SELECT session_id, cell, first AS frame FROM tr)"))
def w7(t):
    on = t.tr.select(*CELL, F.col("first").alias("frame"))
    return rounded(P.cell_lag_response(on, t.pop, t.sess, 3), "pct_events", "pct_spikes")


@query("w7b_lag_counts", "SELECT p.session_id, cell, (a.first - p.first)::INT AS rel, count(*) AS n FROM pop p JOIN tr a ON a.session_id = p.session_id AND a.first BETWEEN p.first - 3 AND p.first + 3 GROUP BY ALL")
def w7b(t):
    return P.lag_counts(t.tr.select(*CELL, F.col("first").alias("frame")), t.pop, t.sess, 3)


_RESP = "rsp AS (SELECT s.session_id, s.cell, b::INT AS bin, count(a.frame)::DOUBLE AS c FROM (SELECT DISTINCT session_id, cell FROM spine) s CROSS JOIN range(12) x(b) LEFT JOIN act a ON a.session_id = s.session_id AND a.cell = s.cell AND (a.frame % 24) // 2 = b GROUP BY s.session_id, s.cell, b), rz AS (SELECT session_id, cell, bin, (c - avg(c) OVER w) / nullif(stddev_pop(c) OVER w, 0) AS value FROM rsp WINDOW w AS (PARTITION BY session_id, cell))"


@query("w8_binned_response", f"WITH {_RESP} SELECT session_id, cell, bin, round(value, 6) AS value FROM rz")
def w8(t):
    return rounded(P.binned_response(t.act, t.sess, 2, 24), "value")


@query("w9_response_threshold", f"WITH {_RESP}, r AS (SELECT session_id, k, ((bin + 1 + (cell * 7919 + k * 104729) % 11) % 12)::INT AS bin, avg(value) AS m FROM rz, range(20) x(k) GROUP BY ALL) SELECT session_id, round(quantile_cont(m, 0.95), 6) AS threshold FROM r GROUP BY session_id")
def w9(t):
    return rounded(P.response_threshold(P.binned_response(t.act, t.sess, 2, 24), 20), "threshold")


@query("w10_event_peak_frame", f"WITH {_PEAK} SELECT * FROM pk")
def w10(t):
    return P.event_peak_frame(t.act, t.pop)


# -- surrogates and population events ----------------------------------------------------------

_SUR = "sur AS (SELECT session_id, k::INT AS k, cell, ((frame + 1 + (cell * 7919 + k * 104729) % 119) % 120)::INT AS frame FROM act, range(10) x(k))"


@query("g1_circular_surrogates", f"WITH {_SUR} SELECT * FROM sur")
def g1(t):
    return G.circular_surrogates(t.act, t.sess, 10)


_WC = "wc AS (SELECT s.session_id, k, f AS frame, count(DISTINCT cell) AS n FROM (SELECT session_id, k::INT AS k FROM sess, range(10) x(k)) s CROSS JOIN range(119) y(f) LEFT JOIN sur ON sur.session_id = s.session_id AND sur.k = s.k AND sur.frame BETWEEN f AND f + 1 GROUP BY s.session_id, s.k, f)"


@query("g2_activity_threshold", f"WITH {_SUR}, {_WC} SELECT session_id, round(quantile_cont(n, 0.95), 6) AS threshold FROM wc GROUP BY session_id".replace("s.session_id, k, f AS", "s.session_id, s.k, f AS"))
def g2(t):
    return rounded(G.activity_threshold(t.act, t.sess, 2, 10), "threshold")


@query("g2b_threshold_of_maxima", f"WITH {_SUR}, {_WC}, m AS (SELECT session_id, k, max(n) AS n FROM wc GROUP BY ALL) SELECT session_id, round(quantile_cont(n, 0.95), 6) AS threshold FROM m GROUP BY session_id".replace("s.session_id, k, f AS", "s.session_id, s.k, f AS"))
def g2b(t):
    return rounded(G.activity_threshold(t.act, t.sess, 2, 10, max_of_each=True), "threshold")


_ISL = "SELECT session_id, min(frame)::INT AS first, max(frame)::INT AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id ORDER BY frame) AS g FROM {}) GROUP BY session_id, g"


@query("g3_detect_events", f"WITH w AS (SELECT a.session_id, f, count(DISTINCT cell) AS n FROM act a, range(119) y(f) WHERE a.frame BETWEEN f AND f + 1 GROUP BY ALL), h AS (SELECT DISTINCT session_id, f + d AS frame FROM w, range(2) z(d) WHERE n >= 5), e AS ({_ISL.format('h')}) SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS event_id FROM e")
def g3(t):
    return G.detect_events(t.act, t.sess, t.sess.select("session_id", F.lit(5.0).alias("threshold")), 2)


@query("g3b_event_numbers", "SELECT s.session_id, s.frame, event_id FROM (SELECT DISTINCT session_id, frame FROM spine) s LEFT JOIN pop p ON p.session_id = s.session_id AND s.frame BETWEEN p.first AND p.last")
def g3b(t):
    return G.event_numbers(t.pop, t.sess)


_PEAKS = "n AS (SELECT session_id, frame, count(*) AS n FROM act GROUP BY ALL), al AS (SELECT s.session_id, s.frame, coalesce(n, 0) AS n FROM (SELECT DISTINCT session_id, frame FROM spine) s LEFT JOIN n USING (session_id, frame)), df AS (SELECT *, n - lag(n) OVER (PARTITION BY session_id ORDER BY frame) AS d FROM al), ch AS (SELECT *, lead(d) OVER (PARTITION BY session_id ORDER BY frame) AS nd FROM df WHERE d <> 0), pe AS (SELECT session_id, frame, n FROM ch WHERE d > 0 AND nd < 0 AND n >= 3 AND NOT EXISTS (SELECT 1 FROM mvt m WHERE m.session_id = ch.session_id AND m.label = 'twitch' AND ch.frame BETWEEN m.first - 2 AND m.last + 2))"


@query("g4_detect_peak_events", f"WITH RECURSIVE {_PEAKS}, {taken('session_id', 'pe', 'n', 5)}, wd AS (SELECT DISTINCT session_id, f::INT AS frame FROM tk, range(0, 120) x(f) WHERE f BETWEEN tk.frame - 2 AND tk.frame + 2), e AS ({_ISL.format('wd')}) SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS event_id FROM e")
def g4(t):
    return G.detect_peak_events(t.act, t.sess, 2, 5, 3, t.mvt.filter("label = 'twitch'"))


@query("g5_detect_block_events", "WITH RECURSIVE bs AS MATERIALIZED (SELECT session_id, f::INT AS frame FROM act, range(0, 117, 2) x(f) WHERE frame BETWEEN f AND f + 3 GROUP BY session_id, f HAVING count(*) > 0.6 * 10), nx AS MATERIALIZED (SELECT a.session_id, a.frame, min(b.frame) AS nxt FROM bs a LEFT JOIN bs b ON b.session_id = a.session_id AND b.frame >= a.frame + 4 GROUP BY ALL), r AS (SELECT session_id, min(frame) AS frame FROM bs GROUP BY session_id UNION ALL SELECT r.session_id, nxt FROM r JOIN nx USING (session_id, frame) WHERE nxt IS NOT NULL) SELECT session_id, frame AS first, frame + 3 AS last FROM r")
def g5(t):
    return G.detect_block_events(t.act, t.sess, 4, 2, 0.6)


@query("g6_event_cells", "SELECT DISTINCT p.session_id, event_id, cell FROM pop p JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first AND p.last")
def g6(t):
    return G.event_cells(t.act, t.pop)


@query("g7_events_vs_movement", "SELECT p.session_id, event_id, first, last, EXISTS (SELECT 1 FROM mvt m WHERE m.session_id = p.session_id AND m.label = 'twitch' AND m.first <= p.last AND p.first <= m.last + 2) AS linked FROM pop p")
def g7(t):
    return G.events_vs_movement(t.pop, t.mvt.filter("label = 'twitch'"), 2).select("session_id", "event_id", "first", "last", "linked")


_TW = "tw AS (SELECT session_id, transient_id AS twitch_id, first, last FROM tr WHERE cell = 0)"


def _twitches(t):
    return t.tr.filter("cell = 0").select("session_id", F.col("transient_id").alias("twitch_id"), "first", "last")


@query("g8_twitch_groups", f"WITH {_TW} SELECT *, CASE WHEN EXISTS (SELECT 1 FROM pop p WHERE p.session_id = tw.session_id AND p.first <= tw.last AND tw.first <= p.last) THEN 'in_event' WHEN EXISTS (SELECT 1 FROM pop p WHERE p.session_id = tw.session_id AND p.first <= tw.last + 3 AND tw.last + 1 <= p.last) THEN 'before_event' ELSE 'alone' END AS \"group\" FROM tw")
def g8(t):
    return G.twitch_groups(_twitches(t), t.pop, 3)


@query("g8b_post_twitch_bouts", f"WITH {_TW}, n AS (SELECT session_id, frame, count(*) AS n FROM act GROUP BY ALL), o AS (SELECT tw.session_id, twitch_id, tw.last, avg(coalesce(n, 0)) AS m FROM tw JOIN spine s ON s.session_id = tw.session_id AND s.cell = 0 AND s.frame BETWEEN tw.first AND tw.last LEFT JOIN n ON n.session_id = tw.session_id AND n.frame = s.frame GROUP BY tw.session_id, twitch_id, tw.last), l AS (SELECT o.session_id, twitch_id, frame FROM o JOIN n ON n.session_id = o.session_id AND frame BETWEEN o.last + 1 AND o.last + 20 WHERE n >= m) SELECT session_id, twitch_id, min(frame) AS first, max(frame) AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, twitch_id ORDER BY frame) AS g FROM l) GROUP BY session_id, twitch_id, g")
def g8b(t):
    return G.post_twitch_bouts(t.act, _twitches(t))


@query("g9_significant_periods", f"WITH {_SUR}, o AS (SELECT p.session_id, event_id AS period_id, count(cell) AS n FROM pop p LEFT JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first AND p.last GROUP BY p.session_id, event_id), c AS (SELECT p.session_id, event_id, k, count(cell) AS n FROM (SELECT pop.*, k::INT AS k FROM pop, range(10) x(k)) p LEFT JOIN (SELECT session_id, k AS sk, cell, frame FROM sur) s ON s.session_id = p.session_id AND sk = k AND frame BETWEEN p.first AND p.last GROUP BY p.session_id, event_id, k), l AS (SELECT session_id, quantile_cont(n, 0.9) AS threshold FROM c GROUP BY ALL) SELECT session_id, period_id, n, round(threshold, 6) AS threshold FROM o JOIN l USING (session_id) WHERE n >= threshold")
def g9(t):
    return rounded(G.significant_periods(t.act, t.pop.withColumnRenamed("event_id", "period_id"), t.sess, 10, 0.9), "threshold")


def _folded() -> str:
    """Distributions of the cells 0 to 9, folded one after the other."""
    steps = ["f0 AS (SELECT session_id, L, 0 AS n, 1.0::DOUBLE AS p FROM ln)"]
    for c in range(10):
        steps.append(f"q{c} AS (SELECT l.session_id, l.L, coalesce(d.n, 0) AS n, coalesce(d.p, 1.0) AS p FROM ln l LEFT JOIN (SELECT * FROM ds WHERE cell = {c}) d ON d.session_id = l.session_id AND d.L = l.L)")
        steps.append(f"f{c + 1} AS MATERIALIZED (SELECT f.session_id, f.L, f.n + q.n AS n, sum(f.p * q.p) AS p FROM f{c} f JOIN q{c} q ON q.session_id = f.session_id AND q.L = f.L GROUP BY f.session_id, f.L, f.n + q.n)")
    return ", ".join(steps)


@query("g9b_periods_of_all_rotations", f"WITH ln AS (SELECT session_id, (last - first + 1)::INT AS L, count(*) AS m FROM pop GROUP BY ALL), wc AS (SELECT ln.session_id, L, cell, u, count(*) FILTER ((frame - u + 120) % 120 < L) AS n FROM ln JOIN act USING (session_id), range(120) x(u) GROUP BY ALL), ds AS (SELECT session_id, L, cell, n, count(*) / 120.0::DOUBLE AS p FROM wc GROUP BY ALL), {_folded()}, al AS (SELECT session_id, n, sum(p * m) AS w FROM f10 JOIN ln USING (session_id, L) GROUP BY ALL), cu AS (SELECT *, sum(w) OVER (PARTITION BY session_id ORDER BY n) AS c, sum(w) OVER (PARTITION BY session_id) AS t FROM al), th AS (SELECT session_id, min(n)::DOUBLE AS threshold FROM cu WHERE c >= 0.9 * t - 1e-9 * t GROUP BY ALL), o AS (SELECT p.session_id, event_id AS period_id, count(cell) AS n FROM pop p LEFT JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first AND p.last GROUP BY p.session_id, event_id) SELECT session_id, period_id, n, threshold FROM o JOIN th USING (session_id) WHERE n >= threshold")
def g9b(t):
    return G.significant_periods(t.act, t.pop.withColumnRenamed("event_id", "period_id"), t.sess, pct=0.9)


@query("g10b_cells_of_all_rotations", "WITH mk AS (SELECT DISTINCT p.session_id, f::INT AS frame FROM pop p, range(120) y(f) WHERE f BETWEEN p.first AND p.last), o AS (SELECT session_id, cell, count(*) AS n FROM act JOIN mk USING (session_id, frame) GROUP BY ALL), c AS (SELECT a.session_id, a.cell, s, count(mk.frame) AS m FROM (SELECT act.*, s, ((frame + s) % 120)::INT AS g FROM act, range(120) x(s)) a LEFT JOIN mk ON mk.session_id = a.session_id AND mk.frame = a.g GROUP BY a.session_id, a.cell, s), k AS (SELECT session_id, cell, m, sum(count(*)) OVER (PARTITION BY session_id, cell ORDER BY m) AS c FROM c GROUP BY session_id, cell, m), th AS (SELECT session_id, cell, min(m)::DOUBLE AS threshold FROM k WHERE c >= 0.9 * 120 - 1e-6 GROUP BY ALL) SELECT session_id, cell, n, threshold FROM o JOIN th USING (session_id, cell) WHERE n >= threshold")
def g10b(t):
    mask = t.pop.withColumn("frame", F.explode(F.sequence("first", "last"))).select("session_id", "frame")
    return G.significant_cells(t.act, mask, t.sess, pct=0.9)


@query("g10_significant_cells", f"WITH {_SUR}, mk AS (SELECT DISTINCT p.session_id, f::INT AS frame FROM pop p, range(120) y(f) WHERE f BETWEEN p.first AND p.last), o AS (SELECT session_id, cell, count(*) AS n FROM act JOIN mk USING (session_id, frame) GROUP BY ALL), c AS (SELECT o.session_id, o.cell, x.k, count(s.frame) AS m FROM o CROSS JOIN range(10) x(k) LEFT JOIN (SELECT sur.* FROM sur JOIN mk USING (session_id, frame)) s ON s.session_id = o.session_id AND s.cell = o.cell AND s.k = x.k GROUP BY o.session_id, o.cell, x.k), l AS (SELECT session_id, cell, quantile_cont(m, 0.9) AS threshold FROM c GROUP BY ALL) SELECT session_id, cell, n, round(threshold, 6) AS threshold FROM o JOIN l USING (session_id, cell) WHERE n >= threshold")
def g10(t):
    mask = t.pop.withColumn("frame", F.explode(F.sequence("first", "last"))).select("session_id", "frame")
    return rounded(G.significant_cells(t.act, mask, t.sess, 10, 0.9), "threshold")


@query("g11_random_membership", "WITH z AS (SELECT session_id, event_id, count(DISTINCT cell) AS size FROM pop p JOIN act a USING (session_id) WHERE frame BETWEEN p.first AND p.last GROUP BY ALL), c AS (SELECT DISTINCT session_id, cell FROM act), d AS (SELECT z.*, cell, k::INT AS k, row_number() OVER (PARTITION BY z.session_id, event_id, k ORDER BY (cell * 2654435761 + event_id * 40503 + k * 104729) % 65521, cell) AS r FROM z JOIN c USING (session_id), range(3) x(k)) SELECT session_id, event_id, k, cell FROM d WHERE r <= size")
def g11(t):
    sizes = G.event_cells(t.act, t.pop).groupBy("session_id", "event_id").agg(F.count("cell").alias("size"))
    return G.random_membership(sizes, t.act.select(*CELL).distinct(), 3)


@query("g12_surrogate_dither", "SELECT DISTINCT session_id, cell, greatest(0, least(119, frame + (cell * 7919 + frame * 104729) % 7 - 3))::INT AS frame FROM act")
def g12(t):
    return G.surrogate_dither(t.act, t.sess, 3)
