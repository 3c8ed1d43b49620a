"""Frames, designs, planes, rings, chi-square tails, cell pyramids and resampling against plain versions on small tables."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import rings as RG
from tidewright.operators import cells as C
from tidewright.operators import frame as FR
from tidewright.operators import interp as I
from tidewright.operators import resample as RS
from tidewright.operators import spatial as P
from tidewright.operators import stats as ST


def test_degrees_and_mixed_frames_are_refused(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "aid int, ax double, ay double")
    b = spark.createDataFrame([(1, 3.0, 4.0)], "bid int, bx double, by double")
    metric_a, metric_b = FR.in_frame(a, FR.METRIC, "ax", "ay"), FR.in_frame(b, FR.METRIC, "bx", "by")
    assert P.radius_pairs(metric_a, metric_b, 10.0).count() == 1
    assert FR.frame_of(metric_a.select(F.col("ax").alias("x")).where("x > -1").join(b).withColumnRenamed("x", "z"), "z") == FR.METRIC
    with pytest.raises(ValueError, match="degrees"):
        P.knn(FR.in_frame(a, "EPSG:4326", "ax", "ay"), metric_b, 1, "aid", "bid")
    with pytest.raises(ValueError, match="different frames"):
        P.radius_pairs(metric_a, FR.in_frame(b, "EPSG:32637", "bx", "by"), 10.0)
    spark.conf.set(FR.FRAME_REQUIRED_KEY, "true")
    try:
        with pytest.raises(ValueError, match="no frame"):
            P.nearest_within(a, metric_b, 10.0, "aid", "bid")
        assert P.nearest_within(metric_a, metric_b, 10.0, "aid", "bid").first().dist == 5.0
    finally:
        spark.conf.unset(FR.FRAME_REQUIRED_KEY)


def tail(x, k):
    """Upper tail by closed forms: sums for even degrees, the error function and a sum for odd ones."""
    z = x / 2
    if k % 2 == 0:
        return math.exp(-z) * sum(z**i / math.factorial(i) for i in range(k // 2))
    return math.erfc(math.sqrt(z)) + math.exp(-z) * sum(z ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (k + 1) // 2))


def test_chi_square_tail(spark):
    rows = [(x, k) for k in (1, 2, 3, 4, 5, 8, 11, 24, 61) for x in (0.0, 1e-6, 0.3, 2.0, 7.5, 20.0, 45.0, 90.0)]
    got = spark.createDataFrame(rows, "x double, k int").withColumn("p", ST.chi2_tail(F.col("x"), F.col("k"))).collect()
    for r in got:
        assert r.p == pytest.approx(tail(r.x, r.k), rel=1e-9, abs=1e-13)
    assert spark.createDataFrame([(None, 2)], "x double, k int").select(ST.chi2_tail(F.col("x"), F.col("k"))).first()[0] is None


@pytest.mark.parametrize("shift, spread, want", [(9.0, 1.0, "PER_GROUP"), (0.0, 100.0, "CONSTANT"), (0.0, 0.1, "NO_CONSTANT")])
def test_offset_stability_verdicts(spark, shift, spread, want):
    rng = random.Random(3)
    rows = [(f"g{i % 4}", i % 3, rng.random() * 5 + shift * (i % 4), spread) for i in range(60)] + [("alone", 9, 2.0, spread)]
    got = ST.offset_stability(spark.createDataFrame(rows, "target string, orbit int, md double, nm double"), ["target", "orbit"], "md", "nm").collect()
    assert {r.verdict for r in got} == {want} and {r.n for r in got} == {60}


def test_design_with_interaction_and_dummies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("a", "b", "flat"):
        for i in range(60):
            x, w, kind = rng.normal(), rng.normal(), "pqr"[i % 3]
            x = 1.0 if key == "flat" else x  # a constant column beside the intercept
            rows.append((key, x, w, kind, 2 + x - 0.5 * w + 0.7 * x * w + (kind == "q") - 2 * (kind == "r") + rng.normal() * (0.1 + abs(x))))
    rows.append(("a", None, 1.0, "p", 99.0))
    df = spark.createDataFrame([(k, *[None if v is None else float(v) if not isinstance(v, str) else v for v in r]) for k, *r in rows], "key string, x double, w double, kind string, y double")
    got = ST.ols_design(df, ["key"], "y", ["x", "w"], [("x", "w")], ["kind"]).collect()
    for key in ("a", "b"):
        d = [r for r in rows if r[0] == key and r[1] is not None]
        m = np.array([[1, x, w, k == "q", k == "r", x * w] for _, x, w, k, _ in d], float)
        y = np.array([r[4] for r in d])
        inv = np.linalg.inv(m.T @ m)
        beta = inv @ m.T @ y
        e = (y - m @ beta) / (1 - np.einsum("ij,jk,ik->i", m, inv, m))
        se = np.sqrt(np.diag(inv @ (m * e[:, None] ** 2).T @ m @ inv))
        mine = {r.term: r for r in got if r.key == key}
        assert list(mine) == ["intercept", "x", "w", "kind=q", "kind=r", "x:w"] and {r.n for r in mine.values()} == {60}
        assert [r.beta for r in mine.values()] == pytest.approx(beta) and [r.se for r in mine.values()] == pytest.approx(se)
    assert {(r.rank, r.beta, r.se) for r in got if r.key == "flat"} == {(4, None, None)}


def test_plane_left_out_equals_refitting(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 300, (120, 2))
    z = 3 + 0.02 * xy[:, 0] - 0.01 * xy[:, 1] + rng.normal(0, 0.3, 120)
    line = [(1000 + i, 5000.0 + 10 * i, 5000.0 + 10 * i, float(i % 3)) for i in range(12)]  # on one line: no plane
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, z))] + line
    got = {r.pid: r for r in I.plane_left_out(spark.createDataFrame(rows, "pid int, x double, y double, z double"), "pid", "z", 90.0).collect()}
    assert all(got[p].error is None for p, *_ in line)
    for i in range(120):
        near = np.hypot(*(xy - xy[i]).T) <= 90.0
        assert got[i].n == near.sum()
        if got[i].error is None:
            continue
        m = np.c_[np.ones(120), xy - xy[i]]
        full = np.linalg.lstsq(m[near], z[near], rcond=None)[0]
        near[i] = False
        rest = np.linalg.lstsq(m[near], z[near], rcond=None)[0]
        assert got[i].slope == pytest.approx(math.hypot(full[1], full[2])) and got[i].error == pytest.approx(z[i] - rest[0])
    assert sum(got[i].error is not None for i in range(120)) > 100


def test_rings(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    cases = [([(2, 2), (4, 2), (4, 5), (2, 5)], 6.0), ([(-5, -5), (5, -5), (5, 5), (-5, 5)], 25.0), ([(20, 20), (30, 20), (25, 30)], 0.0), ([(-10, 5), (5, -10), (20, 5), (5, 20)], 100.0),
             ([(5, 5), (15, 5), (5, 15)], 25.0), (list(reversed([(2, 2), (4, 2), (4, 5), (2, 5)])), 6.0), ([], 0.0), ([(1, 1), (2, 2)], 0.0), (square, 100.0)]
    pts = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, [(float(a), float(b)) for a, b in r], [(float(a), float(b)) for a, b in square]) for i, (r, _) in enumerate(cases)], f"i int, ring {pts}, domain {pts}")
    got = {r.i: r.a for r in df.select("i", RG.area(RG.clip(F.col("ring"), F.col("domain"))).alias("a")).collect()}
    assert got == {i: pytest.approx(a) for i, (_, a) in enumerate(cases)}


def test_pyramid_and_convergence(spark):
    rng = random.Random(1)
    base = [(m, r, c, n, rng.randint(0, n)) for m in (0, 1) for r in range(13) for c in range(6) for n in [rng.randint(1, 4)]]
    levels = C.pyramid(spark.createDataFrame(base, "m int, row long, col long, n long, d long"), ["m"], ["n", "d"], 3)
    for size, df in levels:
        want = {}
        for m, r, c, n, d in base:
            k = (m, r // size, c // size)
            want[k] = (want.get(k, (0, 0))[0] + n, want.get(k, (0, 0))[1] + d)
        assert {(r.m, r.row, r.col): (r.n, r.d) for r in df.collect()} == want
    shares = spark.createDataFrame([("s", size, m, 10, float(v + m)) for size, v in ((1, 40.2), (2, 40.0), (4, 35.0)) for m in (0, 1, 2)] + [("t", 1, 0, 1, 3.0)],
                                   "scope string, size long, method int, cells long, pct double")
    got = {(r.scope, r.size): r for r in C.convergence(shares, ["scope"]).collect()}
    assert got["s", 1].pct == pytest.approx(41.2) and (got["s", 4].lo, got["s", 4].hi, got["s", 4].step) == (35.0, 37.0, None)
    assert got["s", 2].step == pytest.approx(5.0) and got["s", 1].step == pytest.approx(0.2) and {got["s", s].converged for s in (1, 2, 4)} == {True}
    assert got["s", 4].drift == pytest.approx(5.2) and got["t", 1].converged is None


def test_both_ways_of_drawing_agree(spark):
    """Packed groups and multiplicities of units give the same replicates, whatever the group's size."""
    rng = random.Random(8)
    rows = [(k, i, i % 2, f"c{i % 5}", rng.randint(0, 50) / 2, rng.randint(0, 9) / 1.0) for k, n in (("a", 9), ("b", 24), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, side int, cl string, v double, w double")
    close = lambda a, b: [(x[0], *[pytest.approx(y) if isinstance(y, float) else y for y in x[1:]]) for x in sorted(map(tuple, a.collect()))] == sorted(map(tuple, b.collect()))
    for limit in (0, 10):  # all large; one large
        assert close(RS.boot_medians(df, ["k"], "v", ["i"], 40, 3), RS.boot_medians(df, ["k"], "v", ["i"], 40, 3, limit))
        assert close(RS.boot_corr(df.where("k <> 'c'"), ["k"], "v", "w", ["i"], 40, 4), RS.boot_corr(df.where("k <> 'c'"), ["k"], "v", "w", ["i"], 40, 4, limit))
        assert close(RS.permutation(df, "v", "side", "i", 60, 5, ["k"]), RS.permutation(df, "v", "side", "i", 60, 5, ["k"], limit))
    for limit in (0, 12):
        assert close(RS.cluster_stats(df, "cl", ["side"], "v", 30, 6), RS.cluster_stats(df, "cl", ["side"], "v", 30, 6, limit))
    assert RS.permutation(df.limit(0), "v", "side", "i", 10, 5).collect()[0].p is None
    assert RS.boot_median(df.limit(0), ["k"], "v", ["i"], 10, 1).count() == 0


def test_kriging_in_cells_equals_neighbour_table(spark):
    """Same neighbours, ties by id, repeated places, far targets and sparse corners as the table of k nearest rows."""
    rng = np.random.default_rng(9)
    xy = np.r_[rng.integers(0, 60, (400, 2)) * 10.0, rng.uniform(5000, 5200, (30, 2)), np.repeat([[100.0, 100.0]], 40, 0)]
    train = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, rng.normal(size=len(xy))))], "bid long, bx double, by double, z double")
    at = np.r_[rng.uniform(0, 600, (150, 2)), [[100.0, 100.0], [2500.0, 2500.0], [-3000.0, 9000.0]]]
    query = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "aid long, ax double, ay double")
    vg = (900.0, 1.2, 0.1)
    for k in (1, 12, 600):
        one = {r.aid: r for r in I.krige(query, train, "aid", "bid", vg, "z", k=k).collect()}
        two = {r.aid: r for r in I.kriging(P.knn(query, train, k, "aid", "bid", ["bx", "by", "z"]), "aid", vg).collect()}
        assert one.keys() == two.keys() == set(range(len(at)))
        for i in one:
            assert one[i].fallback == two[i].fallback and one[i].pred == pytest.approx(two[i].pred, nan_ok=True)
            assert (one[i].variance or 0) == pytest.approx(two[i].variance or 0, nan_ok=True)
