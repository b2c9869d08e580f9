"""Queries of aggregations and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CELL
from ..operators import intervals as I
from ..operators import series as S
from ..operators import stats as A
from .registry import query
from .series import rounded

_OV = "a.session_id = b.session_id AND a.first <= b.last AND b.first <= a.last"
_POPN = "popn AS (SELECT session_id, frame, coalesce(n, 0) AS n, 100.0 * coalesce(n, 0) / 10 AS percent FROM (SELECT DISTINCT session_id, frame FROM spine) LEFT JOIN (SELECT session_id, frame, count(*) AS n FROM act GROUP BY ALL) USING (session_id, frame))"


@query("a1_transient_frequency", "SELECT s.session_id, s.cell, age, count(tr.first) AS n, count(tr.first) / 120.0 AS frequency FROM (SELECT DISTINCT session_id, cell FROM spine) s JOIN sess USING (session_id) LEFT JOIN tr USING (session_id, cell) GROUP BY ALL")
def a1(t):
    return A.transient_frequency(t.tr, t.sess)


@query("a2_transient_durations", "SELECT session_id, cell, age, round(avg(last - first + 1), 6) AS mean_s, count(*) AS n FROM tr JOIN sess USING (session_id) GROUP BY ALL")
def a2(t):
    return rounded(A.transient_durations(t.tr, t.sess), "mean_s")


_AMP = "amp AS (SELECT tr.session_id, tr.cell, transient_id, first, last, max(x) AS amplitude FROM tr JOIN (SELECT *, value / nullif(avg(value) OVER (PARTITION BY session_id, cell), 0) AS x FROM traces) v ON v.session_id = tr.session_id AND v.cell = tr.cell AND frame BETWEEN first AND last GROUP BY ALL)"


@query("a3_transient_amplitude", f"WITH {_AMP} SELECT session_id, cell, transient_id, first, last, round(amplitude, 6) AS amplitude FROM amp")
def a3(t):
    return rounded(A.transient_amplitude(t.tr, t.traces), "amplitude")


@query("a4_duration_per_amplitude", f"WITH {_AMP} SELECT session_id, cell, transient_id, round((last - first) / nullif(amplitude, 0), 6) AS duration_per_amplitude FROM amp")
def a4(t):
    return rounded(A.duration_per_amplitude(t.tr, t.traces, t.sess), "duration_per_amplitude")


@query("a5_population_activity", f"WITH {_POPN} SELECT * FROM popn")
def a5(t):
    return A.population_activity(t.act, t.sess)


@query("a6_activity_variance", f"WITH {_POPN} SELECT session_id, round(var_pop(percent), 6) AS variance FROM popn GROUP BY ALL")
def a6(t):
    return rounded(A.activity_variance(A.population_activity(t.act, t.sess)), "variance")


@query("a7_spike_rate", "SELECT session_id, cell, round(count(*) / 120.0, 9) AS rate FROM act GROUP BY ALL")
def a7(t):
    return rounded(A.spike_rate(t.act, t.sess), "rate", digits=9)


@query("a7b_isi", "SELECT * FROM (SELECT session_id, cell, frame, frame - lag(frame) OVER (PARTITION BY session_id, cell ORDER BY frame) AS isi FROM act) WHERE isi IS NOT NULL")
def a7b(t):
    return A.isi(t.act)


@query("a8_event_participation", f"WITH h AS (SELECT a.session_id, a.cell, count(DISTINCT event_id) AS e, count(DISTINCT transient_id) AS s FROM tr a JOIN pop b ON {_OV} GROUP BY ALL), n AS (SELECT session_id, count(*) AS ne FROM pop GROUP BY ALL) SELECT session_id, cell, round(least(100, 100.0 * coalesce(max(e), 0) / max(ne)), 6) AS pct_events, round(least(100, 100.0 * coalesce(max(s), 0) / count(*)), 6) AS pct_spikes FROM tr JOIN n USING (session_id) LEFT JOIN h USING (session_id, cell) GROUP BY ALL")
def a8(t):
    return rounded(A.event_participation(t.tr, t.pop), "pct_events", "pct_spikes")


@query("a9_share_in_movement", f"SELECT session_id, cell, count(*) AS n, round(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM mvt b WHERE {_OV})) / count(*), 6) AS pct_in_movement FROM tr a WHERE cell > 1 GROUP BY ALL".replace("count(*) FILTER (EXISTS (", "sum(CASE WHEN EXISTS (").replace(f"WHERE {_OV}))", f"WHERE {_OV}) THEN 1 ELSE 0 END)"))
def a9(t):
    return rounded(A.share_in_movement(t.tr.filter("cell > 1"), t.mvt), "pct_in_movement")


_MF = "mf AS (SELECT DISTINCT session_id, label, unnest(range(first, last + 1))::INT AS frame FROM mvt)"


@query("a10_movement_share", f"WITH {_MF} SELECT session_id, label, round(100.0 * count(*) / 120, 6) AS pct FROM mf GROUP BY ALL UNION ALL SELECT session_id, 'all', round(100.0 * count(DISTINCT frame) / 120, 6) FROM mf GROUP BY ALL UNION ALL SELECT session_id, 'still', round(100.0 * (120 - coalesce(max(n), 0)) / 120, 6) FROM sess LEFT JOIN (SELECT session_id, count(DISTINCT frame) AS n FROM mf GROUP BY ALL) USING (session_id) GROUP BY session_id")
def a10(t):
    return rounded(A.movement_share(t.mvt, t.sess), "pct")


@query("a11_movement_activity", "SELECT m.session_id, label, m.first, m.last, count(DISTINCT cell) AS n, round(count(DISTINCT cell) / 10.0 / (m.last - m.first + 1), 6) AS activity FROM mvt m LEFT JOIN act a ON a.session_id = m.session_id AND frame BETWEEN m.first AND m.last GROUP BY m.session_id, label, m.first, m.last")
def a11(t):
    return rounded(A.movement_activity(t.act, t.mvt, t.sess), "activity")


@query("a12_before_after_ratio", "SELECT p.session_id, event_id, count(*) FILTER (frame < p.first) AS before, count(*) FILTER (frame > p.first) AS after, round(100.0 * count(*) FILTER (frame > p.first) / nullif(count(*) FILTER (frame <> p.first), 0), 6) AS ratio FROM pop p LEFT JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first - 4 AND p.first + 4 GROUP BY p.session_id, event_id")
def a12(t):
    return rounded(A.before_after_ratio(t.act, t.pop, 4), "ratio")


@query("a13_event_stats", "WITH f AS (SELECT p.session_id, event_id, p.first, p.last, frame, count(*) AS n FROM pop p JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first AND p.last GROUP BY ALL), d AS (SELECT p.session_id, event_id, count(DISTINCT cell) AS c FROM pop p JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first AND p.last GROUP BY ALL) SELECT session_id, event_id, (max(last) - max(first) + 1)::DOUBLE AS duration_s, round(100.0 * max(n) / 10, 6) AS max_pct, round(100.0 * avg(n) / 10, 6) AS mean_pct, round(100.0 * max(c) / 10, 6) AS overall_pct FROM f JOIN d USING (session_id, event_id) GROUP BY session_id, event_id")
def a13(t):
    return rounded(A.event_stats(t.act, t.pop, t.sess), "max_pct", "mean_pct", "overall_pct")


@query("a14_group_summary", "SELECT age, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std, round(quantile_cont(f, 0.05), 6) AS p5, round(quantile_cont(f, 0.25), 6) AS p25, round(quantile_cont(f, 0.5), 6) AS median, round(quantile_cont(f, 0.75), 6) AS p75, round(quantile_cont(f, 0.95), 6) AS p95, count(*) AS n FROM (SELECT age, value::DOUBLE AS f FROM ev JOIN sess USING (session_id)) GROUP BY age")
def a14(t):
    return rounded(A.group_summary(t.ev.join(t.sess, "session_id"), ["age"], "value"), "mean", "std", "p5", "p25", "median", "p75", "p95")


@query("a15_histogram", "WITH h AS (SELECT session_id, least(floor(value * 20 / 400), 19)::INT AS bin, count(*) AS n FROM ev WHERE value BETWEEN 0 AND 400 GROUP BY ALL) SELECT session_id, bin, n, round(100.0 * n / sum(n) OVER (PARTITION BY session_id), 9) AS pct, round(n / sum(n) OVER (PARTITION BY session_id) / 20.0, 9) AS density FROM h")
def a15(t):
    return rounded(A.histogram(t.ev, "value", 0, 400, 20, ["session_id"]), "pct", "density", digits=9)


_CF = """WITH p AS (SELECT DISTINCT session_id, cell, frame, method FROM pred WHERE p >= 0.4), m AS (SELECT DISTINCT session_id, cell, method FROM p),
t AS (SELECT session_id, cell, frame, method FROM truth JOIN m USING (session_id, cell)),
n AS (SELECT session_id, cell, method, count(*) FILTER (t.frame IS NOT NULL AND p.frame IS NOT NULL) AS tp, count(*) FILTER (t.frame IS NULL) AS fp, count(*) FILTER (p.frame IS NULL) AS fn
      FROM t FULL JOIN p USING (session_id, cell, method, frame) GROUP BY ALL), c AS (SELECT *, 120 - tp - fp - fn AS tn FROM n),"""
_RAT = """ r AS (SELECT session_id, cell, method, tp, fp, fn, tn, {d}(tp / nullif(tp + fn, 0){e}) AS sensitivity, {d}(tn / nullif(tn + fp, 0){e}) AS specificity, {d}((tp + tn) / nullif(tp + tn + fp + fn, 0){e}) AS accuracy,
 {d}(tp / nullif(tp + fp, 0){e}) AS ppv, {d}(tn / nullif(tn + fn, 0){e}) AS npv, {d}(fn / nullif(fn + tp, 0){e}) AS fnr, {d}(fp / nullif(fp + tn, 0){e}) AS fpr, {d}(fp / nullif(fp + tp, 0){e}) AS fdr, {d}(fn / nullif(fn + tn, 0){e}) AS "for" FROM c)
SELECT session_id, cell, method, tp, fp, fn, tn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(accuracy, 6) AS accuracy, round(ppv, 6) AS ppv, round(npv, 6) AS npv, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr, round(fdr, 6) AS fdr, round("for", 6) AS "for",
 round({d}(sensitivity / nullif(fpr, 0){e}), 6) AS lr_plus, round({d}(fnr / nullif(specificity, 0){e}), 6) AS lr_minus FROM r"""
_ONE, _NULL = {"d": "coalesce", "e": ", 1"}, {"d": "", "e": ""}
_RATIO_COLS = ("sensitivity", "specificity", "accuracy", "ppv", "npv", "fnr", "fpr", "fdr", "for", "lr_plus", "lr_minus")


def _predicted(t):
    return t.pred.filter("p >= 0.4").select(*CELL, "frame", "method")


@query("a16_confusion_frames", _CF + _RAT.format(**_ONE))
def a16(t):
    return rounded(A.confusion_frames(t.truth, _predicted(t), t.sess), *_RATIO_COLS)


_FALSE = "cand AS (SELECT session_id, cell, min(frame) AS first, max(frame) AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, cell ORDER BY frame) AS g FROM act WHERE frame % 4 <> 3) GROUP BY session_id, cell, g), tru AS (SELECT session_id, cell, min(frame) AS first, max(frame) AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, cell ORDER BY frame) AS g FROM truth) GROUP BY session_id, cell, g), fal AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM tru b WHERE a.cell = b.cell AND " + _OV + "))"


@query("a17_confusion_transients", f"WITH {_FALSE}, p AS (SELECT DISTINCT session_id, cell, frame, method FROM pred WHERE p >= 0.4), m AS (SELECT DISTINCT session_id, cell, method FROM p), u AS (SELECT *, true AS rl FROM tru UNION ALL SELECT *, false FROM fal), h AS (SELECT u.*, method, EXISTS (SELECT 1 FROM p WHERE p.session_id = u.session_id AND p.cell = u.cell AND p.method = m.method AND p.frame BETWEEN u.first AND u.last) AS hit FROM u JOIN m ON u.session_id = m.session_id AND u.cell = m.cell), c AS (SELECT session_id, cell, method, count(*) FILTER (rl AND hit) AS tp, count(*) FILTER (NOT rl AND hit) AS fp, count(*) FILTER (rl AND NOT hit) AS fn, count(*) FILTER (NOT rl AND NOT hit) AS tn FROM h GROUP BY ALL)," + _RAT.format(**_ONE))
def a17(t):
    tru = I.runs(t.truth, CELL)
    fal = I.false_transients(I.runs(t.act.filter("frame % 4 <> 3"), CELL), tru)
    return rounded(A.confusion_transients(tru, fal, _predicted(t)), *_RATIO_COLS)


@query("a18_confusion_onsets", _CF.replace("FROM pred WHERE p >= 0.4)", "FROM pred WHERE p >= 0.4 AND frame % 2 = 0)").replace("FROM truth JOIN", "FROM (SELECT * FROM truth WHERE frame % 2 = 0) JOIN") + _RAT.format(**_NULL))
def a18(t):
    even = "frame % 2 = 0"
    return rounded(A.confusion_onsets(t.truth.filter(even), _predicted(t).filter(even), t.sess), *_RATIO_COLS)


@query("a19_coverage_of_found", f"WITH {_FALSE} SELECT b.session_id, b.cell, method, b.first, b.last, round(100.0 * count(DISTINCT frame) / (b.last - b.first + 1), 6) AS coverage FROM tru b JOIN pred p ON p.session_id = b.session_id AND p.cell = b.cell AND frame BETWEEN b.first AND b.last WHERE p >= 0.4 GROUP BY b.session_id, b.cell, method, b.first, b.last")
def a19(t):
    return rounded(A.coverage_of_found(I.runs(t.truth, CELL), _predicted(t)), "coverage")


@query("a20_prediction_by_outcome", "SELECT method, CASE WHEN p >= 0.4 AND t.frame IS NOT NULL THEN 'TP' WHEN p >= 0.4 THEN 'FP' WHEN t.frame IS NOT NULL THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n, round(avg(p), 6) AS mean_p, max(p) AS max_p FROM pred LEFT JOIN truth t USING (session_id, cell, frame) GROUP BY ALL")
def a20(t):
    return rounded(A.prediction_by_outcome(t.truth, t.pred, 0.4), "mean_p")


@query("a21_threshold_sweep", "WITH th AS (SELECT round(k * 0.05, 2)::DOUBLE AS threshold FROM range(21) r(k)), d AS (SELECT p.session_id, p.cell, method, threshold, count(*) AS pos, count(t.frame) AS tp FROM pred p JOIN th ON p >= threshold LEFT JOIN truth t ON t.session_id = p.session_id AND t.cell = p.cell AND t.frame = p.frame GROUP BY ALL), r AS (SELECT session_id, cell, count(*) AS k FROM truth GROUP BY ALL), x AS (SELECT d.*, coalesce(k, 0) AS k FROM d LEFT JOIN r USING (session_id, cell)) SELECT method, threshold, round(avg(coalesce(tp / nullif(k, 0), 1)), 6) AS sensitivity, round(avg(coalesce(tp / nullif(pos, 0), 1)), 6) AS ppv, round(avg(coalesce((pos - tp) / nullif(120 - k, 0), 1)), 6) AS fpr, count(*) AS n FROM x GROUP BY ALL")
def a21(t):
    return rounded(A.threshold_sweep(t.truth, t.pred, t.sess), "sensitivity", "ppv", "fpr")


@query("a22_f1", (_CF + _RAT.format(**_ONE)).replace("\nSELECT session_id, cell, method, tp", "\n, z AS (SELECT session_id, cell, method, tp") + ") SELECT session_id, cell, method, round(2 * ppv * sensitivity / nullif(ppv + sensitivity, 0), 4) AS f1 FROM z")
def a22(t):
    return rounded(A.f1(A.confusion_frames(t.truth, _predicted(t), t.sess)), "f1", digits=4).select(*CELL, "method", "f1")


@query("a23_pool_benchmarks", _CF + " z AS (SELECT * FROM c) SELECT method, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS n_cells FROM z GROUP BY method")
def a23(t):
    parts = [A.confusion_frames(t.truth.filter(c), _predicted(t).filter(c), t.sess) for c in ("cell < 5", "cell >= 5")]
    return A.pool_benchmarks(*parts).groupBy("method").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count("cell").alias("n_cells"))


@query("a24_interval_scores", "WITH p AS (SELECT session_id, CASE WHEN cell = 2 THEN 'twitch' ELSE 'long' END AS label, first, last FROM tr WHERE cell IN (2, 3)), e AS (SELECT session_id, label, max(last) AS e FROM mvt GROUP BY ALL), q AS (SELECT p.* FROM p JOIN e USING (session_id, label) WHERE first <= e), a AS (SELECT a.label, EXISTS (SELECT 1 FROM q b WHERE a.label = b.label AND " + _OV + ") AS hit FROM mvt a), f AS (SELECT a.label, EXISTS (SELECT 1 FROM mvt b WHERE a.label = b.label AND " + _OV + ") AS hit FROM q a), x AS (SELECT label, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn FROM a GROUP BY label), y AS (SELECT label, count(*) FILTER (NOT hit) AS fp FROM f GROUP BY label) SELECT label, tp, fn, coalesce(fp, 0) AS fp, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tp / nullif(tp + coalesce(fp, 0), 0), 6) AS ppv FROM x LEFT JOIN y USING (label)")
def a24(t):
    p = t.tr.filter("cell IN (2, 3)").select("session_id", F.when(F.col("cell") == 2, "twitch").otherwise("long").alias("label"), "first", "last")
    return rounded(A.interval_scores(t.mvt, p), "sensitivity", "ppv")


@query("a25_class_scores", "WITH d AS (SELECT quality AS t, (n_chars > 500)::INT AS p FROM labels JOIN documents USING (doc_id)) SELECT c AS class, count(*) FILTER (t = c) AS n_true, count(*) FILTER (p = c) AS n_predicted, round(count(*) FILTER (t = c AND p = c) / nullif(count(*) FILTER (p = c), 0), 6) AS precision, round(count(*) FILTER (t = c AND p = c) / nullif(count(*) FILTER (t = c), 0), 6) AS recall FROM d, (SELECT DISTINCT t AS c FROM d) GROUP BY c")
def a25(t):
    d = t.table("labels").join(t.table("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("predicted"))
    return rounded(A.class_scores(d), "precision", "recall")


@query("a26_sequence_table", "WITH g(age_group, low, high) AS (VALUES ('5', 5, 5), ('6-7', 6, 7), ('8', 8, 8)), q AS (SELECT session_id, event_id, count(DISTINCT cell) AS n_cells, count(DISTINCT frame) AS repetitions FROM pop p JOIN act a USING (session_id) WHERE frame BETWEEN p.first AND p.last GROUP BY ALL) SELECT age_group, n_cells, repetitions, count(*) AS n FROM q JOIN (SELECT session_id, age FROM sess) USING (session_id) JOIN g ON age BETWEEN low AND high GROUP BY ALL")
def a26(t):
    q = I.periods_to_frames(t.pop).join(t.act, ["session_id", "frame"]).groupBy("session_id", "event_id").agg(F.count_distinct("cell").alias("n_cells"), F.count_distinct("frame").alias("repetitions"))
    groups = t.spark.sql("SELECT * FROM VALUES ('5', 5, 5), ('6-7', 6, 7), ('8', 8, 8) AS g(age_group, low, high)")
    return A.sequence_table(q, t.sess, groups)


_NN = "nn AS (SELECT session_id, count(DISTINCT v) AS n FROM (SELECT session_id, src AS v FROM edges UNION ALL SELECT session_id, dst FROM edges) GROUP BY session_id)"


def nodes(edges):
    return edges.select("session_id", F.explode(F.array("src", "dst")).alias("v")).groupBy("session_id").agg(F.count_distinct("v").alias("n"))


@query("a27_connectivity_share", f"WITH {_NN} SELECT session_id, src AS node, 'out' AS side, round(100.0 * count(*) / max(n), 6) AS pct FROM edges JOIN nn USING (session_id) GROUP BY ALL UNION ALL SELECT session_id, dst, 'in', round(100.0 * count(*) / max(n), 6) FROM edges JOIN nn USING (session_id) GROUP BY ALL")
def a27(t):
    return rounded(A.connectivity_share(t.edges, nodes(t.edges)), "pct")


@query("a27b_network_density", f"WITH {_NN} SELECT session_id, round(100.0 * count(*) / (max(n) * (max(n) - 1)), 6) AS density FROM edges JOIN nn USING (session_id) GROUP BY session_id")
def a27b(t):
    return rounded(A.network_density(t.edges, nodes(t.edges)), "density")


@query("a28_assembly_by_state", f"WITH a0 AS (SELECT session_id, (event_id % 3)::INT AS assembly, first, last FROM pop), n AS (SELECT session_id, assembly, count(*) AS n FROM a0 GROUP BY ALL), h AS (SELECT DISTINCT a.session_id, assembly, a.first, a.last, label FROM a0 a JOIN mvt b ON {_OV}), k AS (SELECT session_id, assembly, label, count(*) AS k FROM h GROUP BY ALL UNION ALL SELECT session_id, assembly, 'all', count(*) FROM (SELECT DISTINCT session_id, assembly, first, last FROM h) GROUP BY ALL UNION ALL SELECT session_id, assembly, 'still', max(n) - count(DISTINCT (h.first, h.last)) FILTER (h.first IS NOT NULL) FROM n LEFT JOIN h USING (session_id, assembly) GROUP BY session_id, assembly) SELECT session_id, assembly, label, round(100.0 * k / n, 6) AS pct FROM k JOIN n USING (session_id, assembly)")
def a28(t):
    e = t.pop.select("session_id", (F.col("event_id") % 3).cast("int").alias("assembly"), "first", "last")
    return rounded(A.assembly_by_state(e, t.mvt), "pct")


def flagship(t):
    """How often each cell is active, by age: percentiles of the transient frequency."""
    active = I.transients(S.mask_boundaries(t.act, 30, 0))
    return A.group_summary(A.transient_frequency(active, t.sess), ["age"], "frequency").orderBy("age")
