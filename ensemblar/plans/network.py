"""Queries of pairs, networks and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CELL
from ..operators import intervals as I
from ..operators import network as N
from ..operators import stats as A
from ..sources import io as S
from .registry import query
from .series import rounded
from .stats import nodes

_PC = "nn AS (SELECT session_id, {k} AS k, count(*) AS n FROM {t} GROUP BY ALL), bb AS (SELECT a.session_id, a.{k} AS k, b.{k} AS k2, count(*) AS bo FROM {t} a JOIN {t} b ON a.session_id = b.session_id AND a.{j} = b.{j} AND a.{k} < b.{k} GROUP BY ALL), pc AS (SELECT a.session_id, a.k, b.k AS k2, a.n, b.n AS n2, coalesce(bo, 0) AS bo FROM nn a JOIN nn b ON a.session_id = b.session_id AND a.k < b.k LEFT JOIN bb ON bb.session_id = a.session_id AND bb.k = a.k AND bb.k2 = b.k)"
_CELLS = _PC.format(k="cell", t="act", j="frame")
_EV = _PC.format(k="event_id", t="ecells", j="cell")


@query("n1_pairwise_pearson", f"WITH {_CELLS} SELECT session_id, k AS cell, k2 AS cell2, round((120 * bo - n * n2) / nullif(sqrt((120 * n - n * n)::DOUBLE * (120 * n2 - n2 * n2)), 0), 6) AS r FROM pc")
def n1(t):
    return rounded(N.pairwise_pearson(t.act, t.sess), "r")


@query("n2_pairwise_hamming", f"WITH {_CELLS} SELECT session_id, k AS cell, k2 AS cell2, round((n + n2 - 2 * bo) / 120.0, 6) AS distance FROM pc")
def n2(t):
    return rounded(N.pairwise_hamming(t.act, t.sess), "distance")


_EMD = "SELECT {key}, round(sum(abs(c) * g), 6) AS distance FROM (SELECT *, sum(s) OVER (PARTITION BY {key} ORDER BY x ROWS UNBOUNDED PRECEDING) AS c, coalesce(lead(x) OVER (PARTITION BY {key} ORDER BY x) - x, 0) AS g FROM (SELECT {key}, x, sum(s) AS s FROM {of} GROUP BY {key}, x)) GROUP BY {key}"


@query("n3_pairwise_wasserstein", "WITH c AS (SELECT session_id, cell, count(*) AS n FROM act GROUP BY ALL), m AS (SELECT a.session_id, a.cell, b.cell AS cell2, frame AS x, 1.0 / a.n AS s FROM c a JOIN c b ON a.session_id = b.session_id AND a.cell < b.cell JOIN act ON act.session_id = a.session_id AND act.cell = a.cell UNION ALL SELECT a.session_id, a.cell, b.cell, frame, -1.0 / b.n FROM c a JOIN c b ON a.session_id = b.session_id AND a.cell < b.cell JOIN act ON act.session_id = b.session_id AND act.cell = b.cell) " + _EMD.format(key="session_id, cell, cell2", of="m"))
def n3(t):
    return rounded(N.pairwise_wasserstein(t.act), "distance")


@query("n4_event_jaccard", f"WITH {_EV} SELECT session_id, k AS event_id, k2 AS event_id2, round(100.0 * bo / (n + n2 - bo), 6) AS jaccard_pct FROM pc")
def n4(t):
    return rounded(N.event_jaccard(t.ecells), "jaccard_pct")


@query("n5_event_covariance", f"WITH {_EV} SELECT session_id, k AS event_id, k2 AS event_id2, round(CASE WHEN bo = 0 THEN 0 ELSE coalesce((20 * bo - n * n2) / nullif(sqrt((n * (20 - n))::DOUBLE * (n2 * (20 - n2))), 0), 0) END, 6) AS covariance FROM pc")
def n5(t):
    m = t.ecells.select("session_id").distinct().withColumn("m", F.lit(20))
    return rounded(N.event_covariance(t.ecells, m), "covariance")


@query("n6_common_core_course", "WITH e AS (SELECT DISTINCT p.session_id, event_id, cell FROM pop p JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first AND p.last), i AS (SELECT *, event_id - row_number() OVER (PARTITION BY session_id, cell ORDER BY event_id) AS g FROM e), l AS (SELECT *, max(event_id) OVER (PARTITION BY session_id, cell, g) AS z FROM i), s AS (SELECT session_id, event_id, unnest(range(0, z - event_id + 1))::INT AS step FROM l), n AS (SELECT session_id, event_id, step, count(*) AS n FROM s GROUP BY ALL) SELECT n.session_id, n.event_id, step, n, b.first - a.first AS delay FROM n JOIN pop a ON a.session_id = n.session_id AND a.event_id = n.event_id JOIN pop b ON b.session_id = n.session_id AND b.event_id = n.event_id + step")
def n6(t):
    members = I.periods_to_frames(t.pop).join(t.act, ["session_id", "frame"]).select("session_id", "event_id", "cell").distinct()
    return N.common_core_course(members, t.pop)


@query("n7_event_delays", "SELECT a.session_id, a.event_id, b.event_id AS event_id2, b.first - a.first AS delay, b.event_id - a.event_id AS steps FROM pop a JOIN pop b ON a.session_id = b.session_id AND a.event_id < b.event_id")
def n7(t):
    return N.event_delays(t.pop)


@query("n8_template_similarity", "WITH e AS (SELECT DISTINCT p.session_id, event_id, cell FROM pop p JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first AND p.last), z AS (SELECT session_id, event_id, count(*) AS z FROM e GROUP BY ALL), w AS (SELECT DISTINCT session_id, cell, s::INT AS start FROM act, range(118) x(s) WHERE frame BETWEEN s AND s + 2) SELECT e.session_id, e.event_id, start, round(count(*) / max(z), 6) AS share FROM e JOIN w ON w.session_id = e.session_id AND w.cell = e.cell JOIN z ON z.session_id = e.session_id AND z.event_id = e.event_id GROUP BY e.session_id, e.event_id, start")
def n8(t):
    members = I.periods_to_frames(t.pop).join(t.act, ["session_id", "frame"]).select("session_id", "event_id", "cell").distinct()
    return rounded(N.template_similarity(members, t.act, t.sess, 3), "share")


@query("n9_epoch_lag_distance", "WITH e AS (SELECT *, (frame // 40)::INT AS epoch FROM act), l AS (SELECT a.session_id, a.cell, b.cell AS cell2, a.epoch, b.frame - a.frame AS x, count(*) AS w FROM e a JOIN e b ON a.session_id = b.session_id AND a.epoch = b.epoch AND a.cell < b.cell GROUP BY ALL), q AS (SELECT session_id, cell, cell2, epoch, x, w / sum(w) OVER (PARTITION BY session_id, cell, cell2, epoch) AS s FROM l), h AS (SELECT DISTINCT session_id, cell, cell2, epoch FROM q), pr AS (SELECT a.*, b.epoch AS epoch2 FROM h a JOIN h b ON a.session_id = b.session_id AND a.cell = b.cell AND a.cell2 = b.cell2 AND a.epoch < b.epoch), m AS (SELECT pr.*, x, s FROM pr JOIN q USING (session_id, cell, cell2, epoch) UNION ALL SELECT pr.*, x, -s FROM pr JOIN q ON q.session_id = pr.session_id AND q.cell = pr.cell AND q.cell2 = pr.cell2 AND q.epoch = pr.epoch2), d AS (" + _EMD.format(key="session_id, cell, cell2, epoch, epoch2", of="m").replace("round(sum(abs(c) * g), 6)", "sum(abs(c) * g)") + "), ep AS (SELECT DISTINCT session_id, epoch FROM e) SELECT a.session_id, a.epoch, b.epoch AS epoch2, round(avg(distance), 6) AS distance, count(distance) AS n_pairs FROM ep a JOIN ep b ON a.session_id = b.session_id AND a.epoch < b.epoch LEFT JOIN d ON d.session_id = a.session_id AND d.epoch = a.epoch AND d.epoch2 = b.epoch GROUP BY a.session_id, a.epoch, b.epoch")
def n9(t):
    return rounded(N.epoch_lag_distance(t.act, 40), "distance")


@query("n10_lag_samples", "SELECT a.session_id, a.cell, b.cell AS cell2, (b.frame - a.frame)::INT AS lag FROM act a JOIN act b ON a.session_id = b.session_id AND a.cell <> b.cell AND b.frame BETWEEN a.frame - 5 AND a.frame + 5")
def n10(t):
    return N.lag_samples(t.act, 5)


#: Moments, D'Agostino's K2 and the Kolmogorov tail, step by step as published.
_LINKS = """WITH lg AS (SELECT a.session_id, a.cell, b.cell AS cell2, (b.frame - a.frame)::DOUBLE AS lag FROM act a JOIN act b ON a.session_id = b.session_id AND a.cell < b.cell AND b.frame BETWEEN a.frame - 10 AND a.frame + 10),
mu AS (SELECT *, avg(lag) OVER (PARTITION BY session_id, cell, cell2) AS m FROM lg),
mo AS (SELECT session_id, cell, cell2, count(*)::DOUBLE AS n, avg((lag - m) ** 2) AS m2, avg((lag - m) ** 3) AS m3, avg((lag - m) ** 4) AS m4, sum(sign(lag)) AS side FROM mu GROUP BY ALL HAVING count(*) >= 20),
k0 AS (SELECT *, m3 / m2 ** 1.5 AS skew, m4 / m2 ** 2 AS kurt, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, 3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM mo),
k1 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, (kurt - e) / sqrt(v) AS x, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM k0),
k2 AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS s, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS t FROM k1),
k3 AS (SELECT *, ln(s + sqrt(s * s + 1)) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / (9 * a) - sign(t) * abs(t) ** (1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM k2),
hs AS (SELECT session_id, cell, cell2, lag, count(*) AS c FROM lg GROUP BY ALL),
cu AS (SELECT *, sum(c) OVER (PARTITION BY session_id, cell, cell2 ORDER BY lag) AS f, sum(c) OVER (PARTITION BY session_id, cell, cell2) AS al FROM hs),
ks AS (SELECT session_id, cell, cell2, max(greatest(abs(f / al - (lag + 11) / 21), abs((f - c) / al - (lag + 10) / 21))) AS d FROM cu GROUP BY ALL),
pv AS (SELECT k3.*, exp(-(z1 * z1 + z2 * z2) / 2) AS p_normal, greatest((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d, 1e-3) AS u FROM k3 JOIN ks USING (session_id, cell, cell2)),
pu AS (SELECT session_id, cell, cell2, n, side, p_normal, CASE WHEN u < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum((CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2 * (j * u) ** 2)) FROM range(1, 101) q(j)))) END AS p_uniform FROM pv)
SELECT session_id, CASE WHEN side > 0 THEN cell ELSE cell2 END AS src, CASE WHEN side > 0 THEN cell2 ELSE cell END AS dst, n::BIGINT AS n, round(p_normal, 9) AS p_normal, round(p_uniform, 9) AS p_uniform FROM pu WHERE p_normal < 0.3 AND p_uniform < 0.3 AND side <> 0"""


@query("n10b_functional_links", _LINKS)
def n10b(t):
    return rounded(N.functional_links(t.act, 10, 20, 0.3), "p_normal", "p_uniform", digits=9)


def _sparse(t):
    """The edges that weigh most, so that shortest paths are longer than one step."""
    w = t.edges.groupBy("session_id").agg(F.percentile("weight", F.lit(0.93)).alias("lim"))
    return t.edges.join(w, "session_id").filter("weight >= lim").select("session_id", "src", "dst")


_BET = """WITH RECURSIVE lim AS (SELECT session_id, quantile_cont(weight, 0.93) AS l FROM edges GROUP BY ALL), sp AS MATERIALIZED (SELECT session_id, src, dst FROM edges JOIN lim USING (session_id) WHERE weight >= l),
nd AS MATERIALIZED (SELECT session_id, src AS node FROM sp UNION SELECT session_id, dst FROM sp),
w AS (SELECT session_id, node AS s, node, 0 AS d FROM nd UNION SELECT w.session_id, s, dst, d + 1 FROM w JOIN sp ON sp.session_id = w.session_id AND sp.src = w.node WHERE d < 40),
ds AS MATERIALIZED (SELECT session_id, s, node, min(d) AS d FROM w GROUP BY ALL),
sh AS (SELECT session_id, s, s AS node, 0 AS d FROM (SELECT session_id, node AS s FROM nd) UNION ALL SELECT sh.session_id, sh.s, sp.dst, sh.d + 1 FROM sh JOIN sp ON sp.session_id = sh.session_id AND sp.src = sh.node JOIN ds ON ds.session_id = sh.session_id AND ds.s = sh.s AND ds.node = sp.dst AND ds.d = sh.d + 1),
pt AS MATERIALIZED (SELECT session_id, s, node, d, count(*) AS n FROM sh GROUP BY ALL),
th AS (SELECT a.session_id, a.node, sum(a.n * b.n / c.n::DOUBLE) AS b FROM pt a JOIN pt b ON b.session_id = a.session_id AND b.s = a.node AND b.d > 0 JOIN pt c ON c.session_id = a.session_id AND c.s = a.s AND c.node = b.node AND c.d = a.d + b.d WHERE a.d > 0 GROUP BY ALL),
m AS (SELECT session_id, count(*) AS m FROM nd GROUP BY ALL),
bw AS (SELECT nd.session_id, nd.node, coalesce(b / nullif((m - 1) * (m - 2), 0), 0.0) AS betweenness FROM nd JOIN m USING (session_id) LEFT JOIN th ON th.session_id = nd.session_id AND th.node = nd.node)"""


@query("n11_hubs", _BET + """, dg AS (SELECT bw.*, (SELECT count(*) FROM sp WHERE sp.session_id = bw.session_id AND sp.src = bw.node) AS o, (SELECT count(*) FROM sp WHERE sp.session_id = bw.session_id AND sp.dst = bw.node) AS i FROM bw),
lm AS (SELECT session_id, quantile_cont(o + i, 0.8) AS d, quantile_cont(betweenness, 0.8) AS b FROM dg GROUP BY ALL)
SELECT session_id, node, o + i AS degree, round(betweenness, 6) AS betweenness FROM dg JOIN lm USING (session_id) JOIN m USING (session_id) WHERE o > 0 AND 100 * o >= 2.0 * m AND o + i >= d AND betweenness >= b - 1e-12""")
def n11(t):
    e = _sparse(t)
    return rounded(N.hubs(e, nodes(e), 2.0, 0.8), "betweenness")


@query("n12_betweenness", _BET + " SELECT session_id, node, round(betweenness, 6) AS betweenness FROM bw")
def n12(t):
    return rounded(N.betweenness(_sparse(t)), "betweenness")


@query("n13_lag_coactivity", "WITH nr AS (SELECT p.session_id, event_id, cell, frame FROM pop p JOIN act a ON a.session_id = p.session_id AND frame BETWEEN p.first - 2 AND p.last + 2), l AS (SELECT a.session_id, a.cell, avg(a.frame - b.frame) AS m FROM nr a JOIN nr b ON a.session_id = b.session_id AND a.event_id = b.event_id AND a.cell <> b.cell GROUP BY ALL), n AS (SELECT session_id, count(*) AS n FROM pop GROUP BY ALL), h AS (SELECT session_id, cell, count(DISTINCT event_id) AS h FROM nr GROUP BY ALL) SELECT h.session_id, h.cell, round(m, 6) AS mean_lag, round(h / n, 6) AS share FROM h JOIN n USING (session_id) LEFT JOIN l ON l.session_id = h.session_id AND l.cell = h.cell")
def n13(t):
    return rounded(N.lag_coactivity(t.act, t.pop, 2), "mean_lag", "share")


_GRID = "ga AS (SELECT session_id, cell, (frame // 3)::INT AS frame FROM act), cl AS (SELECT DISTINCT session_id, cell, (cell * 37 % 100)::INT AS cx, (cell * 53 % 100)::INT AS cy FROM act), gc AS (SELECT session_id, frame, floor(cx / 25)::INT AS gx, floor(cy / 25)::INT AS gy, count(*) AS n FROM act JOIN cl USING (session_id, cell) GROUP BY ALL)"


def _grid(t):
    c = t.act.select(*CELL).distinct().select(*CELL, (F.col("cell") * 37 % 100).alias("cx"), (F.col("cell") * 53 % 100).alias("cy"))
    return N.grid_counts(c, t.act, 25)


@query("n14_grid_counts", f"WITH {_GRID} SELECT * FROM gc")
def n14(t):
    return _grid(t)


_PATH = _GRID + ", pa AS (SELECT session_id, frame, arg_max((gx, gy), (n, -gx, -gy)) AS b FROM gc GROUP BY ALL), pth AS (SELECT session_id, frame, b[1] AS gx, b[2] AS gy FROM pa)"


@query("n15_dominant_square_path", f"WITH {_PATH} SELECT * FROM pth")
def n15(t):
    return N.dominant_square_path(_grid(t))


@query("n16_transition_edges", f"WITH {_PATH}, m AS (SELECT session_id, gx, gy, lead(gx) OVER w AS gx2, lead(gy) OVER w AS gy2 FROM pth WINDOW w AS (PARTITION BY session_id ORDER BY frame)) SELECT *, count(*) AS weight FROM m WHERE gx2 IS NOT NULL AND (gx <> gx2 OR gy <> gy2) GROUP BY ALL")
def n16(t):
    return N.transition_edges(N.dominant_square_path(_grid(t)))


@query("n17_pixel_links", "WITH b AS (SELECT session_id, x, y, frame // 20 AS bin, avg(v) AS v FROM pixels GROUP BY ALL) SELECT a.session_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, round(corr(a.v, b.v), 6) AS r FROM b a JOIN b ON a.session_id = b.session_id AND a.bin = b.bin AND (b.x > a.x OR (b.x = a.x AND b.y > a.y)) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 GROUP BY ALL HAVING corr(a.v, b.v) >= 0.4")
def n17(t):
    return rounded(N.pixel_links(t.pixels, 20, 3, 0.4), "r")


_PROFILE = "pr AS (SELECT session_id, cell, x, y, sum(v * w) / sum(w) AS profile FROM pixels JOIN rises USING (session_id, frame) JOIN masks USING (session_id, cell, x, y) GROUP BY ALL), im AS (SELECT session_id, cell, frame // 100 AS transient_id, x, y, sum(v * w) / sum(w) AS image FROM pixels JOIN rises USING (session_id, frame) JOIN masks USING (session_id, cell, x, y) GROUP BY ALL)"


def _images(t):
    r = t.rises.withColumn("transient_id", F.floor(F.col("frame") / 100))
    return N.source_profile(t.pixels, t.masks, t.rises), N.transient_profile(t.pixels, t.masks, r)


@query("n18_source_profile", f"WITH {_PROFILE} SELECT session_id, cell, x, y, round(profile, 6) AS profile FROM pr")
def n18(t):
    return rounded(N.source_profile(t.pixels, t.masks, t.rises), "profile")


@query("n19_profile_correlation", f"WITH {_PROFILE} SELECT session_id, cell, transient_id, round(corr(image, profile), 6) AS r FROM im JOIN pr USING (session_id, cell, x, y) GROUP BY ALL")
def n19(t):
    return rounded(N.profile_correlation(*_images(t)), "r")


_R20 = "rr AS (SELECT session_id, cell, transient_id, (cell * 31 + transient_id * 17) % 100 / 100.0 AS r FROM tr)"


@query("n20_filter_overlap_transients", f"WITH {_R20}, x AS (SELECT tr.*, r FROM tr JOIN rr USING (session_id, cell, transient_id)), co AS (SELECT a.session_id, a.cell, b.cell AS cell2, a.frame FROM act a JOIN act b ON a.session_id = b.session_id AND a.frame = b.frame AND abs(a.cell - b.cell) = 1), g AS (SELECT DISTINCT x.session_id, x.cell, x.transient_id FROM x JOIN co ON co.session_id = x.session_id AND co.cell = x.cell AND co.frame BETWEEN x.first AND x.last JOIN x y ON y.session_id = x.session_id AND y.cell = co.cell2 AND co.frame BETWEEN y.first AND y.last WHERE x.r < 0.4 AND y.r > 0.6) SELECT session_id, cell, transient_id, first, last FROM tr WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.session_id = tr.session_id AND g.cell = tr.cell AND g.transient_id = tr.transient_id)")
def n20(t):
    r = t.tr.select(*CELL, "transient_id", (((F.col("cell") * 31 + F.col("transient_id") * 17) % 100) / 100).alias("r"))
    pairs = t.act.select(*CELL).distinct().withColumn("cell2", F.col("cell") + 1)
    return N.filter_overlap_transients(t.tr, t.act, pairs, r).select(*CELL, "transient_id", "first", "last")


@query("n21_mask_overlaps", "WITH n AS (SELECT session_id, cell, count(*) AS n FROM masks GROUP BY ALL), b AS (SELECT a.session_id, a.cell, b.cell AS cell2, count(*) AS bo FROM masks a JOIN masks b ON a.session_id = b.session_id AND a.x = b.x AND a.y = b.y AND a.cell < b.cell GROUP BY ALL) SELECT b.session_id, b.cell, b.cell2, bo AS \"both\" FROM b JOIN n n1 ON n1.session_id = b.session_id AND n1.cell = b.cell JOIN n n2 ON n2.session_id = b.session_id AND n2.cell = b.cell2 WHERE bo > 0.3 * greatest(n1.n, n2.n)")
def n21(t):
    return N.mask_overlaps(t.masks, 0.3)


@query("n21b_overlap_error_rate", "WITH rr AS (SELECT session_id, cell, transient_id, (cell + 1)::INT AS cell2, (cell * 31 + transient_id * 17) % 100 / 100.0 AS r, (cell * 7 + transient_id * 29) % 100 / 100.0 AS r2 FROM tr), w AS (SELECT tr.* FROM tr JOIN rr USING (session_id, cell, transient_id) WHERE r < 0.2 AND r2 > 0.7 AND cell % 2 = 0), p AS (SELECT * FROM pred WHERE p >= 0.4), m AS (SELECT DISTINCT session_id, method FROM p), h AS (SELECT w.session_id, w.cell, w.transient_id, method, EXISTS (SELECT 1 FROM p WHERE p.session_id = w.session_id AND p.cell = w.cell AND p.method = m.method AND frame BETWEEN w.first AND w.last) AS k FROM w JOIN m ON m.session_id = w.session_id) SELECT method, count(*) AS n, round(avg(k::INT), 6) AS error_rate FROM h GROUP BY method")
def n21b(t):
    key = F.col("cell"), F.col("transient_id")
    r = t.tr.select(*CELL, "transient_id", (key[0] + 1).alias("cell2"), (((key[0] * 31 + key[1] * 17) % 100) / 100).alias("r"), (((key[0] * 7 + key[1] * 29) % 100) / 100).alias("r2"))
    overlaps = t.act.select(*CELL).distinct().filter("cell % 2 = 0").withColumn("cell2", F.col("cell") + 1)
    return rounded(N.overlap_error_rate(t.tr, r, overlaps, t.pred.filter("p >= 0.4").select(*CELL, "frame", "method")), "error_rate")


@query("s10_frame_means", "SELECT session_id, frame, cell, round(avg(v), 6) AS value FROM pixels JOIN masks USING (session_id, x, y) GROUP BY ALL UNION ALL SELECT session_id, frame, -1, round(avg(v), 6) FROM pixels GROUP BY ALL")
def s10(t):
    return rounded(S.frame_means(t.pixels, t.masks), "value")


@query("k1_top_k_by", "SELECT session_id, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY session_id, src ORDER BY weight DESC, dst) AS r FROM edges) WHERE r <= 3")
def k1(t):
    return A.top_k_by(t.edges, ["session_id", "src"], [F.col("weight").desc(), "dst"], 3)


@query("k2_set_ops", "WITH a AS (SELECT session_id, src AS x, dst AS y FROM edges WHERE weight > 12), b AS (SELECT session_id, dst AS x, src AS y FROM edges WHERE weight > 12) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def k2(t):
    e = t.edges.filter("weight > 12")
    a, b = e.select("session_id", F.col("src").alias("x"), F.col("dst").alias("y")), e.select("session_id", F.col("dst").alias("x"), F.col("src").alias("y"))
    sets = A.set_ops(a, b)
    out = None
    for name, d in sets.items():
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out
