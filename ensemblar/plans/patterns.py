"""Queries of transition matrices, sequences and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import CELL, over
from ..operators import events as G
from ..operators import patterns as Q
from ..operators import stats as A
from .registry import query
from .series import rounded

_FOL = "fl AS (SELECT a.session_id, a.cell AS src, b.cell AS dst, a.frame, b.frame AS frame2 FROM act a JOIN act b ON a.session_id = b.session_id AND b.frame BETWEEN a.frame + 1 AND a.frame + 3 WHERE a.cell <> b.cell)"
_MAT = _FOL + ", tm AS (SELECT session_id, src, dst, w / sum(w) OVER (PARTITION BY session_id, src) AS p FROM (SELECT session_id, src, dst, count(*) AS w FROM fl GROUP BY ALL))"


def _matrix(t):
    return Q.transition_matrix(t.act, 1, 3)


def _n(t):
    return t.sess.select("session_id", F.col("n_cells").alias("n"))


@query("q1_transition_matrix", f"WITH {_MAT} SELECT session_id, src, dst, round(p, 6) AS p FROM tm")
def q1(t):
    return rounded(_matrix(t), "p")


@query("q1b_weighted_transition_matrix", f"WITH {_FOL}, r AS (SELECT session_id, cell AS dst, count(*) / 120.0 AS rate FROM act GROUP BY ALL), n AS (SELECT session_id, src, dst, n * (1 - rate) AS w FROM (SELECT session_id, src, dst, count(*) AS n FROM fl GROUP BY ALL) JOIN r USING (session_id, dst)), s AS (SELECT n.session_id, n.src, n.dst, greatest(0, n.w - 0.2 * coalesce(b.w, 0)) AS w FROM n LEFT JOIN n b ON b.session_id = n.session_id AND b.src = n.dst AND b.dst = n.src), z AS (SELECT *, w / nullif(sum(w) OVER (PARTITION BY session_id, src), 0) AS p FROM s) SELECT session_id, src, dst, round(p, 6) AS p FROM z WHERE w > 0")
def q1b(t):
    return rounded(Q.transition_matrix(t.act, 1, 3, A.spike_rate(t.act, t.sess), 0.2), "p")


@query("q2_transition_matrix_adaptive", f"WITH {_FOL}, ld AS (SELECT session_id, f AS frame, count(*) AS n FROM act, range(-3, 120) x(f) WHERE frame BETWEEN f + 1 AND f + 3 GROUP BY ALL), bz AS (SELECT session_id, frame FROM ld WHERE n > 0.3 * 10 * 3), k AS (SELECT session_id, cell AS dst, count(*) AS n FROM act GROUP BY ALL), x AS (SELECT session_id, src, dst, sum(1.0 / n) AS x FROM fl JOIN k USING (session_id, dst) WHERE NOT EXISTS (SELECT 1 FROM bz WHERE bz.session_id = fl.session_id AND bz.frame = fl.frame) GROUP BY ALL), c AS (SELECT DISTINCT session_id, cell FROM act), al AS (SELECT a.session_id, a.cell AS src, b.cell AS dst, 1 / 10.0 + coalesce(x, 0) AS w FROM c a JOIN c b ON a.session_id = b.session_id AND a.cell <> b.cell LEFT JOIN x ON x.session_id = a.session_id AND x.src = a.cell AND x.dst = b.cell) SELECT session_id, src, dst, round(w / sum(w) OVER (PARTITION BY session_id, src), 6) AS p FROM al")
def q2(t):
    return rounded(Q.transition_matrix_adaptive(t.act, t.sess, 1, 3, 0.3), "p")


@query("q3_transition_matrix_order2", f"WITH {_FOL}, r AS (SELECT session_id, cell, count(*) / 120.0 AS rate FROM act GROUP BY ALL), n AS (SELECT x.session_id, x.src AS a, x.dst AS b, y.dst AS c, sum(rb.rate + rc.rate) AS w FROM fl x JOIN fl y ON x.session_id = y.session_id AND x.dst = y.src AND x.frame2 = y.frame AND x.src <> y.dst JOIN r rb ON rb.session_id = x.session_id AND rb.cell = x.dst JOIN r rc ON rc.session_id = x.session_id AND rc.cell = y.dst GROUP BY ALL) SELECT session_id, a, b, c, round(w / sum(w) OVER (PARTITION BY session_id, a), 9) AS p FROM n")
def q3(t):
    return rounded(Q.transition_matrix_order2(t.act, A.spike_rate(t.act, t.sess), 1, 3), "p", digits=9)


@query("q4_next_candidates", f"WITH {_MAT} SELECT session_id, src, dst, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY session_id, src ORDER BY p DESC, dst) AS r FROM tm WHERE p > 1.0 / 9) WHERE r <= 3")
def q4(t):
    return rounded(Q.next_candidates(_matrix(t), _n(t), 1.0, 3), "p")


def _beam(depth: int, branches: int) -> str:
    """Fronts f0, f1, ... of the search, and the paths that cannot go on."""
    out = ["nx AS MATERIALIZED (SELECT session_id, src, dst, p FROM (SELECT *, row_number() OVER (PARTITION BY session_id, src ORDER BY p DESC, dst) AS r FROM tm WHERE p > 1.0 / 9) WHERE r <= 3)", "f0 AS (SELECT DISTINCT session_id, src AS start, [src] AS cells, 1.0::DOUBLE AS p FROM tm)"]
    for k in range(depth - 1):
        out.append(f"g{k} AS MATERIALIZED (SELECT f.session_id, f.start, f.cells AS was, list_append(f.cells, n.dst) AS cells, f.p * n.p AS p FROM f{k} f JOIN nx n ON n.session_id = f.session_id AND n.src = f.cells[-1] WHERE NOT list_contains(f.cells, n.dst))")
        out.append(f"e{k} AS (SELECT f.* FROM f{k} f ANTI JOIN g{k} g ON g.session_id = f.session_id AND g.was = f.cells)")
        out.append(f"f{k + 1} AS MATERIALIZED (SELECT session_id, start, cells, p FROM (SELECT *, row_number() OVER (PARTITION BY session_id, start ORDER BY p DESC, cells) AS r FROM g{k}) WHERE r <= {branches})")
    ended = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(depth - 1))
    return ", ".join(out) + f", sq AS ({ended} UNION ALL SELECT * FROM f{depth - 1})"


@query("q5_likely_sequences", f"WITH {_MAT}, {_beam(4, 5)} SELECT session_id, start, cells, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY session_id, start ORDER BY len(cells) DESC, p DESC, cells) AS r FROM sq) WHERE r <= 5")
def q5(t):
    return rounded(Q.likely_sequences(_matrix(t), _n(t), 4, 5), "p", digits=9)


def _chains(t):
    """The best successor of each cell and that one's, as sequences of three."""
    best = Q.next_candidates(_matrix(t), _n(t), 1.0, 1)
    b = best.select("session_id", F.col("src").alias("dst"), F.col("dst").alias("third"))
    return best.join(b, ["session_id", "dst"]).filter("third <> src").select("session_id", F.array("src", "dst", "third").alias("cells"))


_CHAIN = _MAT + ", bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, src ORDER BY p DESC, dst) AS r FROM tm WHERE p > 1.0 / 9) WHERE r = 1), ch AS (SELECT x.session_id, [x.src, x.dst, y.dst] AS cells FROM bs x JOIN bs y ON x.session_id = y.session_id AND x.dst = y.src WHERE y.dst <> x.src), o1 AS (SELECT ch.session_id, cells, a.frame AS t1, min(b.frame) AS t2 FROM ch JOIN act a ON a.session_id = ch.session_id AND a.cell = cells[1] JOIN act b ON b.session_id = ch.session_id AND b.cell = cells[2] AND b.frame BETWEEN a.frame + 1 AND a.frame + 5 GROUP BY ALL), o2 AS (SELECT o1.session_id, cells, t1, t2, min(c.frame) AS t3 FROM o1 JOIN act c ON c.session_id = o1.session_id AND c.cell = cells[3] AND c.frame BETWEEN t2 + 1 AND t2 + 5 GROUP BY ALL), oc AS (SELECT session_id, cells, [t1, t2, t3] AS times, count(*) OVER (PARTITION BY session_id, cells) AS n FROM o2)"


@query("q6_sequence_occurrences", f"WITH {_CHAIN} SELECT session_id, cells, times FROM oc WHERE n >= 2")
def q6(t):
    return Q.sequence_occurrences(t.act, _chains(t), 1, 5, 2)


@query("q7_group_by_time_profile", f"WITH {_CHAIN} SELECT session_id, cells, [((times[2] - times[1]) // 3)::INT, ((times[3] - times[2]) // 3)::INT] AS profile, count(*) AS n, min(times[1]) AS first_time FROM oc WHERE n >= 2 GROUP BY ALL")
def q7(t):
    return Q.group_by_time_profile(Q.sequence_occurrences(t.act, _chains(t), 1, 5, 2), 1)


@query("q8_prune_prefixes", f"WITH {_CHAIN}, o12 AS (SELECT session_id, cells[1:2] AS cells, t1, count(*) OVER (PARTITION BY session_id, cells) AS n FROM o1), s AS (SELECT session_id, cells, list(DISTINCT t1 ORDER BY t1) AS starts FROM (SELECT session_id, cells, times[1] AS t1 FROM oc WHERE n >= 2 UNION ALL SELECT session_id, cells, t1 FROM o12 WHERE n >= 2) GROUP BY session_id, cells HAVING count(DISTINCT t1) >= 2) SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.session_id = a.session_id AND len(b.cells) > len(a.cells) AND b.cells[1:len(a.cells)] = a.cells AND b.starts = a.starts)")
def q8(t):
    seqs = _chains(t)
    pairs = seqs.select("session_id", F.slice("cells", 1, 2).alias("cells")).distinct()
    return Q.prune_prefixes(Q.sequence_occurrences(t.act, seqs.unionByName(pairs), 1, 5, 2), 2)


_ORD = "od AS (SELECT session_id, cell, (row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, cell))::INT AS rank FROM act GROUP BY session_id, cell)"


@query("q9_order_score", f"WITH {_ORD}, pr AS (SELECT a.session_id, a.cell AS src, b.cell AS dst FROM od a JOIN od b ON a.session_id = b.session_id AND b.rank > a.rank AND b.rank - a.rank <= 3), d AS (SELECT pr.*, a.frame, arg_min(b.frame - a.frame, (abs(b.frame - a.frame), a.frame - b.frame)) FILTER (b.frame IS NOT NULL) AS d FROM pr JOIN act a ON a.session_id = pr.session_id AND a.cell = src LEFT JOIN act b ON b.session_id = pr.session_id AND b.cell = dst AND b.frame BETWEEN a.frame - 5 AND a.frame + 5 GROUP BY pr.session_id, src, dst, a.frame) SELECT session_id, round(sum(CASE WHEN d IS NULL THEN 5 WHEN d < 0 THEN -d ELSE 0 END) / (count(*) * 5), 6) AS loss FROM d GROUP BY session_id")
def q9(t):
    return rounded(Q.order_score(t.act, _order(t)), "loss")


def _order(t):
    n = t.act.groupBy(*CELL).agg(F.count("frame").alias("n"))
    return n.select(*CELL, F.row_number().over(over("session_id", F.col("n").desc(), "cell")).alias("rank"))


@query("q18_order_cells", f"WITH {_CHAIN}, cd AS (SELECT DISTINCT session_id, cells, array_to_string(cells, '-') AS candidate FROM ch), ac AS (SELECT DISTINCT session_id, cell FROM act), od AS (SELECT cd.session_id, candidate, cell, row_number() OVER (PARTITION BY cd.session_id, candidate ORDER BY list_position(cells, cell) NULLS LAST, cell) AS rank FROM cd JOIN ac USING (session_id)), pr AS (SELECT a.session_id, a.candidate, a.cell AS src, b.cell AS dst FROM od a JOIN od b ON a.session_id = b.session_id AND a.candidate = b.candidate AND b.rank > a.rank AND b.rank - a.rank <= 3), d AS (SELECT pr.*, a.frame, arg_min(b.frame - a.frame, (abs(b.frame - a.frame), a.frame - b.frame)) FILTER (b.frame IS NOT NULL) AS d FROM pr JOIN act a ON a.session_id = pr.session_id AND a.cell = src LEFT JOIN act b ON b.session_id = pr.session_id AND b.cell = dst AND b.frame BETWEEN a.frame - 5 AND a.frame + 5 GROUP BY pr.session_id, pr.candidate, src, dst, a.frame), ls AS (SELECT session_id, candidate, sum(CASE WHEN d IS NULL THEN 5 WHEN d < 0 THEN -d ELSE 0 END) / (count(*) * 5) AS loss FROM d GROUP BY ALL) SELECT session_id, candidate, round(loss, 6) AS loss FROM ls QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loss, candidate) = 1")
def q18(t):
    c = _chains(t).withColumn("candidate", F.array_join(F.col("cells").cast("array<string>"), "-"))
    return rounded(Q.order_cells(t.act, c), "loss")


_TX = "bn AS (SELECT DISTINCT session_id, cell, (frame // 2)::INT AS b FROM act), hd AS (SELECT DISTINCT session_id, b AS w FROM bn), tx AS (SELECT bn.session_id, w AS \"window\", list(DISTINCT cell * 3 + b - w ORDER BY cell * 3 + b - w) AS items FROM bn JOIN hd ON hd.session_id = bn.session_id AND b BETWEEN w AND w + 2 GROUP BY ALL)"


def _tx(t):
    return Q.spike_windows(t.act, 2, 3)


def _patterns(t, least, most, **more):
    return Q.frequent_patterns(_tx(t), least, 2, most, sizes=Q.spike_sizes(t.act, 2, 3), **more)


def _baskets(t):
    return t.baskets.groupBy("session_id", F.col("basket").alias("window")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _basket_patterns(t, least):
    # a session has no more baskets, nor items in them, than line items
    n = t.table("lineitem").groupBy(F.col("l_returnflag").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
    return Q.frequent_patterns(_baskets(t), least, 2, 2, closed=False, sizes=n.select("session_id", (F.col("n") <= Q.TRANSACTIONS).alias("short")))


@query("q10_spike_windows", f'WITH {_TX} SELECT session_id, "window", items FROM tx')
def q10(t):
    return _tx(t)


_PAIRS = "sz AS (SELECT session_id, a.item AS i, b.item AS j, count(*) AS cnt FROM baskets a JOIN baskets b USING (session_id, basket) WHERE a.item < b.item GROUP BY ALL), k AS (SELECT session_id, [i, j] AS items, 2 AS size, cnt FROM sz WHERE cnt >= {n})"


@query("q11_frequent_patterns", "WITH " + _PAIRS.format(n=20) + " SELECT * FROM k")
def q11(t):
    return _basket_patterns(t, 20)


def _mined(p: str, tx: str, key: str, least: int, most: int) -> str:
    """Common tables, named with a prefix: all frequent sets up to a size (sc), and the closed ones of less than it (cl)."""
    k = key.split(", ")
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    of = lambda a: ", ".join(f"{a}.{x}" for x in k)
    return f"""{p}fi AS MATERIALIZED (SELECT {key}, item, list("window") AS ws FROM (SELECT {key}, "window", unnest(items) AS item FROM {tx}) GROUP BY {key}, item HAVING count(*) >= {least}),
{p}st AS (SELECT {key}, [item] AS items, ws FROM {p}fi UNION ALL SELECT {of("s")}, list_append(s.items, i.item), list_intersect(s.ws, i.ws) FROM {p}st s JOIN {p}fi i ON {same("s", "i")} AND i.item > s.items[-1] WHERE len(s.items) < {most} AND len(list_intersect(s.ws, i.ws)) >= {least}),
{p}sc AS MATERIALIZED (SELECT {key}, items, len(items)::INT AS size, len(ws) AS cnt FROM {p}st),
{p}sub AS (SELECT DISTINCT {key}, cnt, list_filter(items, lambda x: x <> d) AS items FROM (SELECT *, unnest(items) AS d FROM {p}sc)),
{p}cl AS MATERIALIZED (SELECT a.* FROM {p}sc a LEFT JOIN {p}sub b ON {same("a", "b")} AND b.items = a.items AND b.cnt = a.cnt WHERE b.cnt IS NULL AND a.size < {most})"""


def _closed(least: int, most: int) -> str:
    return "WITH RECURSIVE " + _TX + ", " + _mined("", "tx", "session_id", least, most + 1)


@query("q11b_closed_patterns", _closed(5, 5) + " SELECT session_id, items, size, cnt FROM cl WHERE size >= 2 AND len(list_filter(items, lambda i: i % 3 = 0)) > 0 AND len(list_distinct(list_transform(items, lambda i: i // 3))) >= 2")
def q11b(t):
    return _patterns(t, 5, 5, length=3, min_cells=2)


@query("q12_pattern_spectrum", "WITH " + _PAIRS.format(n=20) + " SELECT session_id, size, cnt, count(*) AS n FROM k GROUP BY ALL")
def q12(t):
    return Q.pattern_spectrum(_basket_patterns(t, 20))


#: Signatures of a closed pattern and, for each dithered copy, the largest count of every size.
_SP = _closed(5, 3) + ", sg AS (SELECT DISTINCT session_id, size, cnt FROM cl WHERE size >= 2), kd AS (SELECT DISTINCT session_id, k, cell, greatest(0, least(119, frame + (cell * 7919 + frame * 104729 + k * 15485863) % 7 - 3))::INT AS frame FROM act, range(3) x(k)), kb AS (SELECT DISTINCT session_id, k, cell, (frame // 2)::INT AS b FROM kd), kx AS (SELECT kb.session_id, kb.k, w AS \"window\", list(DISTINCT cell * 3 + b - w ORDER BY cell * 3 + b - w) AS items FROM kb JOIN (SELECT DISTINCT session_id, k, b AS w FROM kb) h ON h.session_id = kb.session_id AND h.k = kb.k AND b BETWEEN w AND w + 2 GROUP BY kb.session_id, kb.k, w), " + _mined("k", "kx", "session_id, k", 5, 3) + ", kt AS (SELECT session_id, k, size, max(cnt) AS m FROM ksc GROUP BY ALL), pv AS (SELECT session_id, size, cnt, (SELECT count(DISTINCT k) FROM kt WHERE kt.session_id = sg.session_id AND kt.size >= sg.size AND kt.m >= sg.cnt) / 3.0 AS p FROM sg)"


def _spectrum(t, n=3):
    """Closed patterns, and the p-values of their signatures from dithered copies."""
    p = _patterns(t, 5, 3)
    return p, Q.surrogate_spectrum(t.act, t.sess, p, n, 3, 2, 3)


@query("q12b_pvalue_spectrum", _SP + " SELECT session_id, size, cnt, round(p, 6) AS p FROM pv")
def q12b(t):
    return rounded(_spectrum(t)[1], "p")


_PV = "pv AS (SELECT session_id, src, dst, round(1.0 / (1 + weight * weight), 6) AS p FROM edges)"


def _pvalues(t):
    return t.edges.select("session_id", "src", "dst", F.round(1 / (1 + F.col("weight") * F.col("weight")), 6).alias("p"))


@query("q13_correct_pvalues", f"WITH {_PV}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY p, src, dst) AS r, count(*) OVER (PARTITION BY session_id) AS m FROM pv), a AS (SELECT *, max(r) FILTER (p <= 0.05 * r / m) OVER (PARTITION BY session_id) AS l, min(r) FILTER (p > 0.05 / (m - r + 1)) OVER (PARTITION BY session_id) AS f FROM r) SELECT session_id, src, dst, p, r <= coalesce(l, 0) AS fdr, f IS NULL OR r < f AS holm, p <= 0.05 / m AS bonferroni FROM a")
def q13(t):
    p, key = _pvalues(t), ["session_id", "src", "dst"]
    out = p
    for m in ("fdr", "holm", "bonferroni"):
        out = out.join(Q.correct_pvalues(p, 0.05, m).select(*key, F.col("significant").alias(m)), key)
    return out


@query("q14_filter_patterns", "WITH " + _PAIRS.format(n=10) + " SELECT * FROM k WHERE cnt >= 14")
def q14(t):
    p = _basket_patterns(t, 10)
    return Q.filter_patterns(p, Q.pattern_spectrum(p).withColumn("significant", F.col("cnt") >= 14))


#: Which windows of a pattern a random subset holds, as the operator draws it.
_DRAW = "((list_reduce(list_prepend(0::BIGINT, items::BIGINT[]), lambda a, i: (a * 31 + i) % 65521) * 7919 + w * 40503 + k * 104729) % 999983 * 48271 % 65521) % 2 = 0"


@query("q15_pattern_stability", _closed(6, 4) + f", p AS (SELECT session_id, items, size, cnt FROM cl WHERE size >= 2), oc AS (SELECT p.session_id, p.items, size, tx.\"window\" AS w, tx.items AS ti FROM p JOIN tx ON tx.session_id = p.session_id AND list_has_all(tx.items, p.items)), kp AS MATERIALIZED (SELECT oc.*, k::INT AS k FROM oc, range(8) x(k) WHERE {_DRAW}), sz AS (SELECT session_id, items, k, count(*) AS m FROM kp GROUP BY ALL), it AS (SELECT session_id, items, size, k, i, count(*) AS c FROM (SELECT *, unnest(ti) AS i FROM kp) GROUP BY ALL), cm AS (SELECT it.session_id, it.items, size, it.k, count(*) AS common FROM it JOIN sz ON sz.session_id = it.session_id AND sz.items = it.items AND sz.k = it.k AND c = m GROUP BY ALL), h AS (SELECT session_id, items, count(*) FILTER (common = size) / 8.0 AS s FROM cm GROUP BY ALL) SELECT p.session_id, p.items, p.size, p.cnt, round(coalesce(s, 0), 6) AS stability FROM p LEFT JOIN h ON h.session_id = p.session_id AND h.items = p.items")
def q15(t):
    p = _patterns(t, 6, 4)
    return rounded(Q.pattern_stability(p, _tx(t), 8, sizes=Q.spike_sizes(t.act, 2, 3)), "stability")


@query("q16_reduce_patterns", _closed(5, 4) + ", p AS MATERIALIZED (SELECT session_id, items, size, cnt FROM cl WHERE size >= 2), ns AS (SELECT DISTINCT session_id, size, cnt FROM p WHERE cnt < 6), d AS (SELECT a.session_id, a.items AS a, a.size AS za, a.cnt AS ca, b.items AS b, b.size AS zb, b.cnt AS cb, EXISTS (SELECT 1 FROM ns WHERE ns.session_id = a.session_id AND ns.size = b.size AND ns.cnt = b.cnt - a.cnt) AS bo, EXISTS (SELECT 1 FROM ns WHERE ns.session_id = a.session_id AND ns.size = a.size - b.size AND ns.cnt = a.cnt) AS ao FROM p a JOIN p b ON b.session_id = a.session_id AND b.size < a.size AND list_has_all(a.items, b.items)), g AS (SELECT session_id, CASE WHEN ao AND bo THEN CASE WHEN (za - 2) * ca >= (zb - 2) * cb THEN b ELSE a END WHEN bo THEN b WHEN ao THEN a END AS items FROM d) SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.session_id = p.session_id AND g.items = p.items)")
def q16(t):
    p = _patterns(t, 5, 4)
    return Q.reduce_patterns(p, Q.pattern_spectrum(p).filter("cnt < 6").select("session_id", "size", "cnt"))


@query("q17_pattern_occurrences", "WITH " + _PAIRS.format(n=24) + " SELECT k.session_id, k.items, [(i // 3)::INT, (j // 3)::INT] AS cells, [i % 3 - least(i % 3, j % 3), j % 3 - least(i % 3, j % 3)] AS lags, list(basket ORDER BY basket) AS times, 2 AS size, max(cnt) AS cnt FROM (SELECT *, items[1] AS i, items[2] AS j FROM k) k JOIN baskets a ON a.session_id = k.session_id AND a.item = i JOIN baskets b ON b.session_id = k.session_id AND b.item = j AND b.basket = a.basket USING_ GROUP BY k.session_id, k.items, i, j".replace("b.basket = a.basket USING_", "b.basket = a.basket").replace("a.basket GROUP", "a.basket GROUP").replace("list(basket ORDER BY basket)", "list(a.basket ORDER BY a.basket)"))
def q17(t):
    p = _basket_patterns(t, 24)
    return Q.pattern_occurrences(p, _baskets(t), 3)
