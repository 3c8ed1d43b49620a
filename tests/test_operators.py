"""Tiny hand tables with known answers, and brute-force checks of what SQL cannot say."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import geodesy as G
from tidewright.functions import rules as R
from tidewright.functions import text as X
from tidewright.operators import cells as C
from tidewright.operators import interp as I
from tidewright.operators import labels as LB
from tidewright.operators import select as L
from tidewright.operators import temporal as TM
from tidewright.sources import readers as RD
from tidewright.sources import sinks as K
from tidewright.streaming import jobs as J


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_mode_ignores_unobserved_and_breaks_ties_low(spark):
    d = rows(spark, [(0, 0, 6), (0, 0, 6), (0, 0, None), (0, 0, 0), (0, 0, 0), (1, 0, 3), (1, 0, 5), (2, 0, None)], "row int, col int, c int")
    got = {r.row: (r.mode, r.n_valid) for r in C.class_mode(d, "c").collect()}
    assert got == {0: (6, 2), 1: (3, 2), 2: (0, 0)}


def test_water_share_over_observed_only(spark):
    d = rows(spark, [(0, 0, 0), (0, 0, 1), (0, 0, None), (0, 0, None), (1, 0, None)], "row int, col int, w int")
    assert {r.row: r.water_share for r in C.water_share(d, "w").collect()} == {0: 50.0, 1: None}


def test_nan_is_missing(spark):
    from tidewright.schema import clean_doubles
    d = clean_doubles(rows(spark, [(1.0,), (float("nan"),), (3.0,)], "x double"))
    assert d.agg(F.avg("x")).first()[0] == 2.0


def test_best_link(spark):
    sch = T.StructType([T.StructField("id", T.IntegerType()), RD.ENTRY_SCHEMA["links"]])
    d = spark.createDataFrame([(1, [("https://h/a.log", "data#"), ("https://h/a.nc", "x/data#"), ("https://h/a.zip", "x/data#")]), (2, [("http://h/a.nc", "data#")]), (3, None)], sch)
    assert {r.id: r.download_url for r in RD.best_link(d, "id", ("opendap",)).collect()} == {1: "https://h/a.nc", 2: None, 3: None}


@pytest.mark.parametrize("start,title,want", [("2023-04-01T00:00", "x", ("2023", "04")), (None, "a_20230615T1_b", ("2023", "06")), (None, "a_20231799_20240102", ("2024", "01")), (None, "none", ("unknown", "unknown"))])
def test_year_month(spark, start, title, want):
    y, m = X.year_month(F.col("s"), F.col("t"))
    assert tuple(rows(spark, [(start, title)], "s string, t string").select(y, m).first()) == want


def test_empty_area_is_an_error(spark):
    d = rows(spark, [("z", '{"features": []}')], "d string, j string")
    with pytest.raises(Exception, match="no feature"):
        RD.rings(d, "j", "d").collect()


def test_civil_time(spark):
    d = rows(spark, [(dt.datetime(2021, 7, 1, 8),), (dt.datetime(2021, 1, 1, 8),)], "t timestamp_ntz")
    got = [r[0].hour for r in d.select(F.convert_timezone(F.lit("Europe/Kyiv"), F.lit("UTC"), "t")).collect()]
    assert got == [5, 6]


def test_projection_round_trip_below_a_millimetre(spark):
    d = rows(spark, [(32.6, 46.6), (35.3, 47.6), (33.0, 46.0)], "lon double, lat double")
    x, y = G.to_metric(F.col("lon"), F.col("lat"))
    d = d.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = G.to_degrees(F.col("x"), F.col("y"))
    for r in d.select("lon", "lat", "x", lon.alias("lo"), lat.alias("la")).collect():
        assert abs(r.lon - r.lo) < 1e-9 and abs(r.lat - r.la) < 1e-9
        if r.lon == 33.0:
            assert r.x == pytest.approx(500000.0, abs=1e-6)


def test_gap_stays_unresolved(spark):
    ev = rows(spark, [(1, 2.0), (2, 5.0), (3, 11.0), (4, 99.0)], "id int, t double")
    se = rows(spark, [(0.0, 10.0), (4.0, 14.0), (10.0, 20.0), (12.0, 24.0)], "t double, v double")
    j = TM.linear(TM.bracket(ev, se, [], "t", "t", "v", "id"), "t", "h", 4.0)
    assert {r.id: r.h for r in j.collect()} == {1: 12.0, 2: None, 3: 22.0, 4: None}


def test_older_clear_scene_beats_nearer_cloud(spark):
    d = rows(spark, [(0, 0, 1, None, "near_cloud"), (0, 0, 5, 1, "older_clear")], "row int, col int, lag int, w int, s string")
    r = C.first_valid(d, "w", ["lag"], "s").first()
    assert (r.w, r.source) == (1, "older_clear")


def test_reasons_are_null_safe(spark):
    r = R.reasons({"a": F.col("x") > 1, "b": F.col("x").isNull()})
    assert [x[0] for x in rows(spark, [(2.0,), (None,)], "x double").select(r).collect()] == [["a"], ["b"]]


@pytest.mark.parametrize("s2", [0.0, 1.0, 5.0, 10.0])
def test_soft_kriging_equals_covariance_form(s2):
    rng, sill = 100.0, 10.0
    nug, reg = I.NUGGET_FLOOR * sill, I.DIAGONAL * sill
    xy, z, q = np.array([[0.0, 0.0], [50.0, 0.0]]), np.array([1.0, 10.0]), np.array([20.0, 30.0])
    cov = lambda h: sill - I.spherical(h, rng, sill, nug)
    k = np.ones((3, 3))
    k[2, 2] = 0
    k[:2, :2] = cov(np.array([[0.0, 50.0], [50.0, 0.0]])) + np.diag([-reg, s2 - reg])
    want = np.linalg.solve(k, np.append(cov(q), 1.0))[:2] @ z
    pred, _, bad = I.solve_kriging(q[None], xy[None], z[None], np.array([[0.0, s2]]), (rng, sill, 0.0))
    assert not bad[0] and pred[0] == pytest.approx(want, abs=1e-9)


def test_kriging_is_exact_at_a_point(spark):
    nn = rows(spark, [(1, i, float(d), float(x), 0.0, z) for i, (d, x, z) in enumerate([(0, 0, 3.0), (10, 10, 5.0), (20, 20, 4.0)], 1)], "q int, nn int, dist double, bx double, by double, z double")
    assert I.kriging(nn, "q", (50.0, 1.0, 0.0)).first().pred == pytest.approx(3.0, abs=1e-6)


def brute_labels(cells, conn):
    left, out = set(cells), {}
    while left:
        todo = [min(left)]
        comp = set(todo)
        while todo:
            r, c = todo.pop()
            for dr, dc in C.shifts(conn):
                n = (r + dr, c + dc)
                if n in left and n not in comp:
                    comp.add(n)
                    todo.append(n)
        left -= comp
        out |= {x: min(a * 64 + b for a, b in comp) for x in comp}
    return out


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_across_tiles(spark, conn):
    r = np.random.default_rng(3)
    m = [(int(a), int(b)) for a, b in np.argwhere(r.random((40, 40)) < 0.5)] + [(50, c) for c in range(60)]
    got = LB.label_cells(rows(spark, m, "row long, col long"), 64, conn, tile=7)
    assert {(x.row, x.col): x.label for x in got.collect()} == brute_labels(m, conn)


def test_holes_are_filled_but_bays_are_not(spark):
    ring = [(r, c) for r in range(1, 6) for c in range(1, 6) if r in (1, 5) or c in (1, 5)]
    open_ring = [(r, c) for r in range(1, 6) for c in range(8, 13) if (r in (1, 5) or c in (8, 12)) and (r, c) != (3, 12)]
    frame = rows(spark, [(r, c) for r in range(8) for c in range(15)], "row long, col long")
    got = LB.fill_holes(rows(spark, ring + open_ring, "row long, col long"), frame, (0, 7, 0, 14), 16)
    assert got.count() == len(ring) + 9 + len(open_ring)


def test_known_displacement_is_recovered(spark):
    f = lambda s: rows(spark, [(r, c, float(c - s)) for r in range(6) for c in range(12)], "row long, col long, z double")
    a, b = C.crossings(f(4.25), "z", 0.0), C.crossings(f(6.75), "z", 0.0)
    mid = lambda d: d.agg(F.avg((F.col("x1") + F.col("x2")) / 2)).first()[0]
    assert mid(b) - mid(a) == pytest.approx(2.5)


def test_distance_is_exact(spark):
    r = np.random.default_rng(5)
    hit = r.random((20, 17)) < 0.03
    hit[3, 4] = True
    d = rows(spark, [(i, j, bool(hit[i, j])) for i in range(20) for j in range(17)], "row long, col long, h boolean")
    at = np.argwhere(hit)
    for x in C.distance(d, "h").collect():
        assert x.dist == pytest.approx(np.sqrt(((at - [x.row, x.col]) ** 2).sum(1)).min())


def test_upsert_replaces_only_its_slice(spark):
    s = "p string, a string, t int"
    old = rows(spark, [("n", "x", 1), ("n", "x", 2), ("l", "x", 3)], s)
    out = K.replace_slice(old, rows(spark, [("n", "x", 9)], s), ["p", "a"])
    assert sorted(map(tuple, out.collect())) == [("l", "x", 3), ("n", "x", 9)]


def test_frames_equal_as_bags(spark):
    a = rows(spark, [(1, None), (1, None), (2, "b")], "x int, y string")
    assert L.frame_difference(a, a.orderBy("x")).isEmpty()
    d = L.frame_difference(a, rows(spark, [(1, None), (2, "b")], "x int, y string")).collect()
    assert [(r.x, r.surplus, r.side) for r in d] == [(1, 1, "left")]


def test_table_hash_ignores_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") * 3)
    h = lambda d: K.table_hash(d).first().sha
    assert h(a) == h(a.repartition(7).orderBy(F.col("id").desc())) and h(a) != h(a.where("id > 0"))


def _stream(spark, path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    return J.file_stream(spark, path, "*.parquet", spark.createDataFrame(batches[0], schema).schema, files_per_batch=1)


def test_late_rows_are_kept_with_a_reason(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 2)
    b = [[(1, t0)], [(2, t0 - dt.timedelta(hours=5)), (3, t0 + dt.timedelta(hours=1))]]
    got = J.late_split(_stream(spark, str(tmp_path / "s"), b, "id int, ts timestamp"), "ts", 3600)
    assert {r.id: r.status for r in got.collect()} == {1: "accepted", 2: "rejected", 3: "accepted"}


def test_runs_span_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    mk = lambda k, v: (k % 1, t0 + dt.timedelta(hours=k), k, float(v))
    b = [[mk(i, 7) for i in range(3)], [mk(3, 7), mk(4, 7), mk(5, 1)], [mk(6, 2)]]
    got = J.fill_runs(_stream(spark, str(tmp_path / "r"), b, "st int, ts timestamp, id long, v double"), "st", "ts", "id", "v", 5)
    assert [(r.run_start, r.n, r.value) for r in got.collect()] == [(0, 5, 7.0)]


def test_index_replay_is_safe(spark, tmp_path):
    p = str(tmp_path / "i")
    d = rows(spark, [("a", 1), ("b", 2)], "area string, k int")
    for _ in range(2):
        K.write_slices(d, p, ["area"])
    K.write_slices(d.where("area = 'a'").withColumn("k", F.lit(5)), p, ["area"])
    assert {r.area: r.k for r in spark.read.parquet(p).collect()} == {"a": 5, "b": 2}


