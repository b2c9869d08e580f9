"""Overlaps of short and long intervals against all pairs, and the plan they take."""

import io
import random
from contextlib import redirect_stdout

from ensemblar.operators import intervals as I
from ensemblar.operators import prep


def sides(spark, seed, span, longest, n=120):
    r = random.Random(seed)

    def make(name):
        rows = []
        for k in range(n):
            f = r.randint(-50, span)
            rows.append((r.choice("st"), k, f, f + r.choice([0, r.randint(0, 5), r.randint(0, longest)])))
        rows += [("s", n, -50, span + longest), ("t", n + 1, 0, span)]
        return rows, spark.createDataFrame(rows, f"session_id string, {name} int, first int, last int")

    return make("x"), make("y")


def test_all_overlaps_once(spark):
    for seed, (span, longest, bucket) in enumerate([(60, 10, 4), (5000, 5000, 16), (1 << 14, 1 << 13, 1), (1 << 22, 1 << 21, 16), (300, 40, 16)]):
        (a, da), (b, db) = sides(spark, seed, span, longest)
        want = sorted((x, y) for s, x, f, l in a for t, y, g, m in b if s == t and f <= m and g <= l)
        assert sorted((r.x, r.y) for r in I.interval_overlap_join(da, db, bucket=bucket).collect()) == want
        hit = {x for x, _ in want}
        assert sorted(r.x for r in I.interval_overlap_join(da, db, bucket=bucket, how="semi").collect()) == sorted(x for _, x, _, _ in a if x in hit)
        assert sorted(r.x for r in I.interval_overlap_join(da, db, bucket=bucket, how="anti").collect()) == sorted(x for _, x, _, _ in a if x not in hit)


def test_repeated_and_missing_rows(spark):
    d = spark.createDataFrame([("s", 1, 3), ("s", 1, 3), (None, 1, 3)], "session_id string, first int, last int")
    assert I.interval_overlap_join(d, d).count() == 4
    assert I.interval_overlap_join(d, d.filter("false")).count() == 0
    assert I.interval_overlap_join(d, d.filter("false"), how="anti").count() == 3


def test_no_join_by_the_part_alone(spark):
    (_, a), (_, b) = sides(spark, 1, 5000, 5000)
    out = io.StringIO()
    with redirect_stdout(out):
        I.interval_overlap_join(a, b).explain("formatted")
    plan = out.getvalue()
    keys = [x for x in plan.splitlines() if x.startswith(("Left keys", "Right keys"))]
    assert keys and all("_level" in k and "_node" in k for k in keys)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exploded_rows_are_not_broadcast(spark):
    (_, a), (_, b) = sides(spark, 1, 5000, 5000)
    windows = a.withColumnRenamed("x", "cell")
    runs = b.selectExpr("session_id", "y as cell", "first", "last", "y % 2 = 0 as real", "y as amplitude")
    for d in (I.interval_overlap_join(a, b), prep.strata(windows, runs)):
        out = io.StringIO()
        with redirect_stdout(out):
            d.explain()
        assert "SortMergeJoin" in out.getvalue() and "Broadcast" not in out.getvalue()
