"""Queries of series operators.  Values are rounded at the end: sums in another order differ in their last bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CELL
from ..operators import intervals as I
from ..operators import series as S
from .registry import query

_KEY = "session_id, cell, frame"
_PART = "PARTITION BY session_id, cell"


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("p1_zscore", f"SELECT {_KEY}, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS value FROM traces WINDOW w AS ({_PART})")
def p1(t):
    return rounded(S.zscore(t.traces), "value")


@query("p2_median_normalise", "SELECT session_id, cell, frame, round(value / nullif(m, 0), 6) AS value FROM ev2 JOIN (SELECT session_id, cell, quantile_cont(value, 0.5) AS m FROM ev2 GROUP BY ALL) USING (session_id, cell)".replace("ev2", "(SELECT session_id, cell, frame, value FROM ev)"))
def p2(t):
    return rounded(S.median_normalise(t.ev.select(*CELL, "frame", "value")), "value")


@query("p3_mean_normalise", f"SELECT {_KEY}, round(value / nullif(avg(value) OVER ({_PART}), 0), 6) AS value FROM traces")
def p3(t):
    return rounded(S.mean_normalise(t.traces), "value")


@query("p4_minmax01", f"SELECT {_KEY}, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE value - min(value) OVER w END, 6) AS value FROM traces WINDOW w AS ({_PART})")
def p4(t):
    return rounded(S.minmax01(t.traces), "value")


@query("p5_segment_zscore", f"WITH s AS (SELECT *, frame // 40 AS segment FROM traces), g AS (SELECT {_KEY}, segment, CASE WHEN frame % 40 < 3 AND segment > 0 THEN avg(value) OVER w ELSE value END AS value FROM s WINDOW w AS ({_PART}, segment)) SELECT {_KEY}, segment, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 5) AS value FROM g WINDOW w AS ({_PART}, segment)")
def p5(t):
    changes = t.traces.filter("frame > 0 AND frame % 40 = 0").select(*CELL, "frame")
    return rounded(S.segment_zscore(t.traces, changes, flatten=3), "value", digits=5).select(*CELL, "frame", F.col("segment").cast("long").alias("segment"), "value")


@query("p6_smooth", "WITH k AS (SELECT unnest([0.08, 0.16785218, 0.39785218, 0.68214782, 0.91214782, 1.0, 0.91214782, 0.68214782, 0.39785218, 0.16785218, 0.08]) AS w, unnest(range(-5, 6)) AS d) SELECT a.session_id, a.cell, a.frame, round(sum(b.value * w) / sum(w), 6) AS value FROM traces a, k JOIN traces b ON b.session_id = a.session_id AND b.cell = a.cell AND b.frame = a.frame + d GROUP BY ALL")
def p6(t):
    return rounded(S.smooth(t.traces), "value")


@query("p7_rolling_mean", f"SELECT {_KEY}, CASE WHEN count(*) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS value FROM traces WINDOW w AS ({_PART} ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def p7(t):
    return rounded(S.rolling_mean(t.traces, 5), "value")


@query("p8_bin_sum", "SELECT session_id, cell, (frame // 5)::INT AS bin, round(sum(value), 6) AS value, max(value) > 0 AS active FROM traces GROUP BY ALL")
def p8(t):
    any_ = S.bin_sum(t.traces, 5, how="max").select(*CELL, "bin", (F.col("value") > 0).alias("active"))
    return rounded(S.bin_sum(t.traces, 5), "value").join(any_, [*CELL, "bin"])


@query("p9_drop_reindex_cells", "SELECT session_id, cell, (row_number() OVER (PARTITION BY session_id ORDER BY cell) - 1)::INT AS new_cell FROM (SELECT DISTINCT session_id, cell FROM act WHERE cell % 4 <> 1)")
def p9(t):
    return S.reindex_cells(S.drop_cells(t.act, t.act.filter("cell % 4 = 1").select(*CELL).distinct()))


@query("p10_mask_boundaries", f"SELECT {_KEY} FROM act WHERE frame % 30 >= 3 OR frame < 30")
def p10(t):
    return S.mask_boundaries(t.act, 30, 3)


@query("p11_refractory", f"SELECT {_KEY} FROM (SELECT *, frame - lag(frame) OVER ({_PART} ORDER BY frame) AS d FROM act) WHERE d IS NULL OR d > 2")
def p11(t):
    return S.refractory(t.act, 2)


@query("p12_threshold_predictions", f"SELECT {_KEY}, method FROM pred WHERE p >= 0.4 AND (method = 'max' OR p >= 1 - p)")
def p12(t):
    probs = F.when(F.col("method") == "max", F.array("p")).otherwise(F.array(F.col("p"), 1 - F.col("p")))
    return S.threshold_predictions(t.pred.select(*CELL, "frame", "method", probs.alias("probs")), 0.4)


@query("p13_uncertain_periods", f"WITH a AS (SELECT {_KEY}, p FROM pred WHERE method = 'max' AND p >= 0.1), r AS (SELECT session_id, cell, min(frame) AS first, max(frame) AS last, max(p) AS top FROM (SELECT *, frame - row_number() OVER ({_PART} ORDER BY frame) AS g FROM a) GROUP BY session_id, cell, g) SELECT session_id, cell, first, last, top, greatest(0, first - 10) AS view_first, least(119, last + 10) AS view_last FROM r WHERE top <= 0.5")
def p13(t):
    return S.uncertain_periods(t.pred.filter("method = 'max'"), t.sess, 0.1, 0.5, 10)


@query("p14_mark_doubtful", "SELECT session_id, cell, frame, frame < 2 OR frame >= 118 OR (frame % 30 < 2 AND frame >= 30) OR frame % 30 >= 28 AS doubtful FROM act")
def p14(t):
    return S.mark_doubtful(t.act, t.sess, 30, 2)


_WIDE = "wide AS (SELECT session_id, unnest(range(greatest(0, first - 1), least(119, last + 2) + 1)) AS frame FROM mvt), wf AS (SELECT DISTINCT session_id, frame FROM wide)"
_RUNS = "SELECT session_id, min(frame)::INT AS first, max(frame)::INT AS last FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id ORDER BY frame) AS g FROM {}) GROUP BY session_id, g"


@query("p15_dilate", "WITH d AS (SELECT session_id, greatest(0, first - 1) AS first, least(119, last + 2) AS last FROM mvt) SELECT session_id, min(first) AS first, max(last) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY first, last) AS g FROM (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY session_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM d)) GROUP BY session_id, g")
def p15(t):
    return I.dilate(t.mvt, t.sess, 1, 2)


@query("p16_complement", f"WITH {_WIDE}, rest AS (SELECT DISTINCT session_id, frame FROM spine EXCEPT SELECT * FROM wf) {_RUNS.format('rest')}")
def p16(t):
    return S.still(t.mvt, t.sess, 1, 2)


@query("p16b_state_frames", "WITH f AS (SELECT DISTINCT session_id, label, unnest(range(first, last + 1))::INT AS frame FROM mvt) SELECT session_id, frame FROM f WHERE label = 'long' EXCEPT SELECT session_id, frame FROM f WHERE label = 'twitch'")
def p16b(t):
    return S.state_frames(t.mvt, ["long"], ["twitch"])


@query("p17_keep_frames", "WITH gone AS (SELECT DISTINCT session_id, unnest(range(first, last + 1))::INT AS frame FROM mvt WHERE label = 'twitch'), ok AS (SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.session_id = tr.session_id AND gone.frame BETWEEN tr.first AND tr.last)), f AS (SELECT session_id, cell, unnest(range(first, last + 1))::INT AS frame FROM ok), m AS (SELECT session_id, frame, (row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1)::INT AS new_frame FROM (SELECT DISTINCT session_id, frame FROM spine EXCEPT SELECT * FROM gone)) SELECT f.*, new_frame FROM f JOIN m USING (session_id, frame)")
def p17(t):
    return S.keep_frames(t.act, t.mvt.filter("label = 'twitch'").select("session_id", "first", "last"))
