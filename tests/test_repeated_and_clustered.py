"""Tables with repeated keys and places, sparse groups and crowded ones, against twins or brute force."""
import os

import numpy as np
import pandas as pd
import pytest
import twin

from tidewright import plans
from tidewright.operators import interp as I
from tidewright.operators import pairs as PR
from tidewright.operators import spatial as P

SOURCE = "/root/testdata/sf0.001"


def folder_with(con, path, **tables):
    """The small tables, some of them replaced by the result of a query."""
    for t in twin.TABLES:
        if t in tables:
            con.execute(f"COPY ({tables[t]}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SOURCE}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


def same_as_twin(spark, name, folder):
    q = plans.registered()[name]
    return twin.compare(plans.runner(q)(spark, folder), twin.duck(folder).execute(q.sql))


def test_plane_left_out_with_repeated_soundings(spark, tmp_path):
    lines = "SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet'"  # order and line number repeat, with another survey each
    assert same_as_twin(spark, "int_plane_left_out", folder_with(twin.duck(SOURCE), tmp_path, lineitem=lines)) == ""


def test_plane_left_out_makes_no_pairs(spark):
    """Crowded and sparse tiles, some rows at one place and one beyond the others, by sums of cells; the pairs of a plan would be a join on cells."""
    r = np.random.default_rng(12)
    p = pd.DataFrame({"x": np.r_[r.uniform(-300, 900, 6000), r.uniform(0, 20000, 300).round()], "y": np.r_[r.uniform(0, 500, 6000), r.uniform(-9000, 9000, 300).round()]})
    p.loc[100:140, ["x", "y"]] = (600.0, 100.0)
    p = p.assign(pid=np.arange(len(p)), z=r.normal(size=len(p)))
    df = spark.createDataFrame(p)
    got = I.plane_left_out(df, "pid", "z", 100.0)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    sums = P.near_moments(df.selectExpr("pid", "x AS ax", "y AS ay"), df.selectExpr("x AS bx", "y AS by", "z"), 100.0, "z", ["pid"]).toPandas().set_index("pid")
    assert len(sums) == len(p)
    for i in [*range(0, len(p), 97), 110]:
        u, v = (p.x - p.x[i]) / 100, (p.y - p.y[i]) / 100
        near = np.hypot(p.x - p.x[i], p.y - p.y[i]) <= 100
        for c, e in zip(P.MOMENTS, (near, u, v, u * u, u * v, v * v, p.z, u * p.z, v * p.z)):
            assert sums.loc[i, c] == pytest.approx(e[near].sum(), abs=1e-8)


def test_moments_of_a_hot_tile_come_in_pieces_that_add_up(spark, large_path):
    r = np.random.default_rng(13)
    p = pd.DataFrame({"pid": np.arange(1000), "x": r.uniform(0, 300, 1000), "y": r.uniform(0, 300, 1000), "z": r.normal(size=1000)})
    df = spark.createDataFrame(p)
    sums = P.near_moments(df.selectExpr("pid", "x AS ax", "y AS ay"), df.selectExpr("x AS bx", "y AS by", "z"), 100.0, "z", ["pid"]).toPandas()
    assert len(sums) > 1000
    sums = sums.groupby("pid").sum()
    for i in range(0, 1000, 50):
        near = np.hypot(p.x - p.x[i], p.y - p.y[i]) <= 100
        assert sums.loc[i, "n"] == near.sum() and sums.loc[i, "sw"] == pytest.approx(p.z[near].sum(), abs=1e-8)


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_of_few_large_groups(spark, large_path, keys):
    """Only rows about the wanted rank are brought into order; ties and small groups included."""
    from tidewright.operators import blocks as B
    r = np.random.default_rng(14)
    p = pd.DataFrame({"k": np.r_[np.zeros(20_000), np.ones(9_001), np.full(6, 2)].astype(int), "v": np.r_[r.normal(size=20_000), r.integers(0, 4, 9_001), np.arange(6)]})
    df = spark.createDataFrame(p)
    few = B._few_groups(df.selectExpr("k", "v AS __v", "1L AS __m"), keys, {"a": 0.5, "b": 0.9}).toPandas()
    for k, g in (p.groupby("k") if keys else [(None, p)]):
        row = few.set_index("k").loc[k] if keys else few.iloc[0]
        assert row["a"] == np.quantile(g["v"], 0.5) and row["b"] == pytest.approx(np.quantile(g["v"], 0.9))
    assert len(few) == (3 if keys else 1)
    assert B._few_groups(df.selectExpr("k", "v AS __v", "2L AS __m"), keys, {"a": 0.5}) is None


def test_passing_bablok_without_an_inner_median(spark):
    r = np.random.default_rng(1)
    x = r.uniform(0, 10, 30)
    p = pd.DataFrame({"k": np.repeat([0, 1], 30), "x": np.r_[x, x], "y": np.r_[-3 * x, 2 * x + r.normal(0, 0.1, 30)]})
    got = PR.passing_bablok(spark.createDataFrame(p), ["k"], "x", "y").toPandas().set_index("k")
    assert np.isnan(got.loc[0, "slope"]) and np.isnan(got.loc[0, "intercept"]) and got.loc[0, "n_slopes"] == 435
    assert got.loc[1, "slope"] == pytest.approx(2, abs=0.1)


def test_archive_clip_east_of_all_zones(spark, tmp_path):
    east = "SELECT * REPLACE (event_id * 20 AS event_id) FROM events"  # one view a granule
    assert same_as_twin(spark, "jon_archive_clip", folder_with(twin.duck(SOURCE), tmp_path, events=east)) == ""


@pytest.mark.parametrize("whole", [100, 2_000_000])
def test_slopes_and_shifts_by_date(spark, monkeypatch, whole):
    """A date as the key, and units that hold no value of a wanted prefix."""
    monkeypatch.setattr(PR, "WHOLE", whole)
    r = np.random.default_rng(4)
    p = pd.DataFrame({"k": np.repeat(pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"]).date, [300, 25, 4]),
                      "x": np.r_[r.integers(0, 240, 325) / 10, np.ones(4)], "y": np.round(r.normal(2, 1, 329), 2)})
    df = spark.createDataFrame(p, "k date, x double, y double")
    ts = PR.theil_sen(df, ["k"], "x", "y", chunk=40).toPandas().set_index("k")
    hl = PR.hodges_lehmann(df.selectExpr("k", "y", "int(x > 12) AS b"), ["k"], "y", "b", chunk=40).toPandas().set_index("k")
    assert len(ts) == 2 and len(hl) == 2            # one place has no slope and no second sample
    for k, g in p[:325].groupby("k"):
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        i, j = np.triu_indices(len(x), 1)
        ok = x[i] != x[j]
        s = np.sort((y[j] - y[i])[ok] / (x[j] - x[i])[ok])
        assert ts.loc[k, "slope"] == np.median(s) and ts.loc[k, "slope_lo"] in s and ts.loc[k, "slope_hi"] in s
        assert hl.loc[k, "shift"] == pytest.approx(np.median(y[x > 12][None, :] - y[x <= 12][:, None]), abs=1e-12)


@pytest.mark.parametrize("few", [5, 500_000])
def test_slope_ranks_are_exact(monkeypatch, few):
    monkeypatch.setattr(PR, "FEW", few)
    r = np.random.default_rng(3)
    for x, y in ((r.integers(0, 40, 400) / 10, r.integers(0, 500, 400) / 10000), (r.normal(size=400), r.normal(size=400)), (np.arange(400.0), np.arange(400) * 0.3 + 1e6), (np.arange(400.0), np.zeros(400))):
        i, j = np.triu_indices(400, 1)
        ok = x[i] != x[j]
        s = np.sort((y[j] - y[i])[ok] / (x[j] - x[i])[ok])
        ranks = [0, len(s) // 7, len(s) // 2, len(s) - 1]
        assert PR._slope_ranks(x, y, ranks) == s[ranks].tolist()


@pytest.mark.parametrize("sent", [0, 10_000])
def test_nearest_of_repeated_and_crowded_nodes(spark, monkeypatch, sent):
    monkeypatch.setattr(P, "NODES_SENT", sent)
    r = np.random.default_rng(6)
    a = pd.DataFrame({"aid": np.arange(300), "ax": r.uniform(0, 1000, 300).round(), "ay": r.uniform(0, 1000, 300).round()})
    a.loc[200:, ["ax", "ay"]] = (400.0, 90.0)
    b = pd.DataFrame({"bid": np.arange(400)[::-1], "bx": r.uniform(0, 1000, 400).round(), "by": r.uniform(0, 100, 400).round()})
    b.loc[300:, ["bx", "by"]] = (500.0, 50.0)                      # copies: the lowest id counts
    b["tag"] = b["bid"] * 2.0
    got = P.nearest_within(spark.createDataFrame(a), spark.createDataFrame(b), 120.0, "aid", "bid", ["bx", "tag"]).toPandas().set_index("aid")
    assert len(got) == 300
    d = np.hypot(a["ax"].to_numpy()[:, None] - b["bx"].to_numpy(), a["ay"].to_numpy()[:, None] - b["by"].to_numpy())
    for i in range(300):
        want = min(zip(d[i], b["bid"], b["bx"]))
        if want[0] > 120:
            assert np.isnan(got.loc[i, "dist"]) and np.isnan(got.loc[i, "tag"])
        else:
            assert got.loc[i, "bid"] == want[1] and got.loc[i, "dist"] == pytest.approx(want[0]) and got.loc[i, "bx"] == want[2] and got.loc[i, "tag"] == 2 * want[1]


def test_nearest_sends_no_large_side_to_every_task(spark, tmp_path):
    """Sequential keys are packed so well that estimates take a million nodes for a small table."""
    spark.range(400_000).selectExpr("id AS bid", "double(id % 1000) * 100 AS bx", "double(id * 37 % 20000) AS by").write.parquet(str(tmp_path / "n"))
    points = spark.range(50).selectExpr("id AS aid", "id * 1500.0D AS ax", "id * 300.0D AS ay")
    plan = P.nearest_within(points, spark.read.parquet(str(tmp_path / "n")), 5000.0, "aid", "bid")
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.where("dist is not null").count() > 0


def test_near_folds_in_hot_cells(spark, large_path):
    from pyspark.sql.types import DoubleType, LongType, StructField

    r = np.random.default_rng(8)
    a = pd.DataFrame({"aid": np.arange(900), "ax": r.uniform(0, 500, 900), "ay": r.uniform(-200, 200, 900), "t": r.integers(0, 100, 900)})
    a.loc[:699, ["ax", "ay"]] = (250.0, 10.0)          # one cell with more rows than a block
    b = pd.DataFrame({"bx": r.uniform(0, 500, 300), "by": r.uniform(-200, 200, 300), "u": r.integers(0, 100, 300), "v": r.normal(size=300).round(1)})

    def fold(left, right, keep, dist):
        row, col = np.nonzero(keep)
        g, n, m = P.run_medians(row, right["v"].to_numpy()[col])
        return left.loc[g, ["aid"]].assign(n=n, m=m)

    columns = [StructField("aid", LongType()), StructField("n", LongType()), StructField("m", DoubleType())]
    got = P.near_folds(spark.createDataFrame(a), spark.createDataFrame(b), 60.0, fold, columns, ["aid"], ["v"], window=("t", "u", 20.0)).toPandas().set_index("aid")
    want = {}
    for i in range(900):
        near = (np.hypot(a.ax[i] - b.bx, a.ay[i] - b.by) <= 60) & ((a.t[i] - b.u).abs() <= 20)
        if near.any():
            want[i] = (near.sum(), b.v[near].median())
    assert set(got.index) == set(want) and len(got) == len(want)
    assert all(got.loc[i, "n"] == n and got.loc[i, "m"] == pytest.approx(m) for i, (n, m) in want.items())


@pytest.mark.parametrize("name", ["jon_space_time_pairs", "jon_colocated_same_day"])
def test_pairs_are_folded_where_they_are_made(spark, name):
    plan = plans.runner(plans.registered()[name])(spark, SOURCE)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "percentile" not in plan


def test_local_plane_sums_repeated_places(spark):
    r = np.random.default_rng(9)
    at = r.uniform(0, 100, (60, 2)).round()
    b = pd.DataFrame(np.r_[at, at, at], columns=["bx", "by"])
    b["z"] = 3 + 0.02 * b.bx - 0.01 * b.by + r.normal(0, 0.3, 180)
    a = pd.DataFrame({"aid": np.arange(20), "ax": np.repeat(r.uniform(20, 80, 10), 2), "ay": 50.0})
    got = I.local_plane(spark.createDataFrame(a), spark.createDataFrame(b), 40.0, "aid", "z")
    # repeated places meet once: the joined sides are sums by place and distinct points
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [ax") >= 2
    got = got.toPandas().set_index("aid")
    assert len(got) == 20
    for i in range(20):
        near = np.hypot(b.bx - a.ax[i], b.by - a.ay[i]) <= 40
        m = np.c_[np.ones(near.sum()), b.bx[near] - a.ax[i], b.by[near] - a.ay[i]]
        fit = np.linalg.lstsq(m, b.z[near], rcond=None)[0]
        assert got.loc[i, "n"] == near.sum() and got.loc[i, "fit"] == pytest.approx(fit[0]) and got.loc[i, "slope"] == pytest.approx(np.hypot(fit[1], fit[2]))


REPEATED = "SELECT * REPLACE (event_id + 100000 * c AS event_id, value + c * 3 AS value) FROM events, range(3) r(c)"


@pytest.mark.parametrize("name", ["agg_variogram", "agg_moran"])
def test_pair_sums_over_repeated_places(spark, tmp_path, name):
    assert same_as_twin(spark, name, folder_with(twin.duck(SOURCE), tmp_path, events=REPEATED.replace("SELECT * REPLACE", "SELECT * EXCLUDE (c) REPLACE"))) == ""


def test_repeated_places_meet_once(spark, tmp_path):
    from tidewright.plans import q_surfaces
    from tidewright.plans.registry import Tables

    folder = folder_with(twin.duck(SOURCE), tmp_path, events=REPEATED.replace("SELECT * REPLACE", "SELECT * EXCLUDE (c) REPLACE"))
    once, thrice = (q_surfaces._place_pairs(Tables(spark, d), 8000.0) for d in (SOURCE, folder))
    assert thrice.where("dist > 0").count() == once.where("dist > 0").count()


REPEATED = f"SELECT * REPLACE (event_id + i * 100000 AS event_id) FROM '{SOURCE}/events.parquet', range(5) r(i)"


@pytest.mark.parametrize("name", ["q_crossings", "q_crossing_rule_sweep", "q_crossings_by_zone"])
def test_crossings_of_repeated_readings(spark, tmp_path, monkeypatch, name):
    """Five equal readings meet the others once, with their number."""
    met = []
    near = P.near_folds
    monkeypatch.setattr(P, "near_folds", lambda rows, others, *a, **k: met.append((rows.count(), others.count())) or near(rows, others, *a, **k))
    folder = folder_with(twin.duck(SOURCE), tmp_path, events=REPEATED)
    assert same_as_twin(spark, name, folder) == ""
    con = twin.duck(SOURCE)
    assert met == [tuple(con.execute(f"SELECT count(DISTINCT event_id) FROM events WHERE event_type = '{k}'").fetchone()[0] for k in ("click", "view"))]


def test_crossings_send_no_modules_to_tasks(spark, monkeypatch):
    """What a task is sent holds no module: one that something cannot be pickled from (as after other tests of a session) does no harm."""
    import threading

    from tidewright.plans import q_joins
    monkeypatch.setattr(q_joins, "lock", threading.RLock(), raising=False)
    monkeypatch.setattr(P, "lock", threading.RLock(), raising=False)
    assert same_as_twin(spark, "q_crossing_rule_sweep", SOURCE) == ""


def test_crossings_keep_one_number_a_node(spark, monkeypatch):
    """The sweep needs no time difference and no place of a node; columns are those of the written table."""
    from tidewright.plans import q_answers
    from tidewright.plans.registry import Tables
    assert set(q_answers._nodes(Tables(spark, SOURCE), [3000], whole=False).columns) == {"radius", "aday", "bday", "d", "m"}


@pytest.mark.parametrize("times", [None, [1, 1, 3, 1, 2, 1, 5]])
def test_line_middles(times):
    near = np.array([[1, 1, 0, 1, 0, 0, 1], [0, 0, 0, 1, 1, 1, 1], [0] * 7], bool)
    h = np.array([1.0, 2, 4, 0, 3, 7, 9])
    line, run, lo, hi = P.line_middles(near, np.array([0, 3]), None if times is None else np.array(times))
    got = {(a, b): (h[c] + h[d]) / 2 for a, b, c, d in zip(line, run, lo, hi)}
    n = np.ones(7, int) if times is None else np.array(times)
    want = {(i, k): np.median(np.repeat(h[s][near[i, s]], n[s][near[i, s]])) for i in range(3) for k, s in enumerate((slice(0, 3), slice(3, 7))) if near[i, s].any()}
    assert got == want


def test_quantiles_of_rows_that_count_often(spark, large_path):
    r = np.random.default_rng(3)
    p = pd.DataFrame({"k": np.repeat([0, 1], 400), "v": r.integers(0, 90, 800).astype(float), "m": r.integers(1, 6, 800)})
    from tidewright.operators import blocks as B
    q = {"a": ("v", 0.5), "b": ("v", 0.9)}
    got = B.summarise(spark.createDataFrame(p), ["k"], {}, q, "m").toPandas().set_index("k")
    for k, g in p.groupby("k"):
        all_rows = np.repeat(g["v"], g["m"])
        assert got.loc[k, "a"] == np.quantile(all_rows, 0.5) and got.loc[k, "b"] == pytest.approx(np.quantile(all_rows, 0.9))


@pytest.mark.parametrize("name", ["q_transition_slopes", "q_slope_spans"])
def test_slopes_of_repeated_points(spark, tmp_path, name):
    assert same_as_twin(spark, name, folder_with(twin.duck(SOURCE), tmp_path, events=REPEATED)) == ""


def test_a_key_of_many_rows_is_cut_though_its_table_looks_small(spark, tmp_path, monkeypatch):
    """Equal values take almost no bytes in a file, but a window holds their rows."""
    from pyspark.sql import functions as F

    from tidewright.operators import blocks as B
    spark.range(30_000).select((F.col("id") % 2).alias("k"), "id", F.lit(1).alias("v")).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set(B.BLOCK_ROWS_KEY, "5000")
    try:
        assert B.plan_bytes(d) <= 256 * 1024 * 1024
        assert B.with_blocks(d, ["id"])[1] and B.with_blocks(d, ["id"], ["k"])[1] and not B.with_blocks(d, ["id"], ["id"])[1]
        got = B.running_sum(d, [], ["id"], F.col("v"), "s")
        assert got.where("s <> id + 1").count() == 0 and got.count() == 30_000
    finally:
        spark.conf.unset(B.BLOCK_ROWS_KEY)



def test_tail_clusters_of_repeated_places(spark, tmp_path, monkeypatch):
    met = []
    pairs = P.radius_pairs
    monkeypatch.setattr(P, "radius_pairs", lambda a, b, *r, **k: met.append(b.count()) or pairs(a, b, *r, **k))
    assert same_as_twin(spark, "cv_tail_clusters", folder_with(twin.duck(SOURCE), tmp_path, events=REPEATED)) == ""
    con = twin.duck(SOURCE)
    assert met == [con.execute("SELECT count(DISTINCT event_id) FROM events WHERE event_type = 'click' AND value / 100 > 0.8").fetchone()[0]]


def test_station_alignment_of_repeated_readings(spark, tmp_path, monkeypatch):
    met = []
    pairs = P.radius_pairs
    monkeypatch.setattr(P, "radius_pairs", lambda a, b, *r, **k: met.append(a.count()) or pairs(a, b, *r, **k))
    assert same_as_twin(spark, "q_station_alignment", folder_with(twin.duck(SOURCE), tmp_path, events=REPEATED)) == ""
    assert met[0] <= twin.duck(SOURCE).execute("SELECT count(*) FROM events WHERE event_type = 'view'").fetchone()[0]


def test_planes_of_few_groups_are_sent_to_the_rows(spark, large_path):
    """The rows of a group are not brought together to meet the group's plane."""
    from tidewright.operators import stats as ST
    from tidewright.session import BROADCAST_BYTES_KEY
    spark.conf.set(BROADCAST_BYTES_KEY, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = np.random.default_rng(5)
        p = pd.DataFrame({"k": np.repeat([0, 1, 2], 50), "x": r.uniform(0, 9, 150), "w": r.uniform(0, 9, 150)})
        got = ST.planar_residual(spark.createDataFrame(p.assign(y=3 + 2 * p.x - p.w * p.k)), ["k"], "x", "w", "y", "e")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert abs(got.toPandas()["e"]).max() < 1e-9
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_matches_of_repeated_readings(spark, tmp_path, monkeypatch):
    """The streamed join holds each place and time once, however often it repeats."""
    from tidewright.streaming import jobs as J
    tables = {}
    run, packs = J.run_append, J._packs
    monkeypatch.setattr(J, "run_append", lambda s, name: tables.setdefault(name, run(s, name)) if name == "pairs" else run(s, name))
    monkeypatch.setattr(J, "_packs", lambda rows, keys, name: packs(rows, keys, name, 2))
    assert same_as_twin(spark, "str_space_time_matches", folder_with(twin.duck(SOURCE), tmp_path, events=REPEATED)) == ""
    sql = plans.registered()["str_space_time_matches"].sql
    assert tables["pairs"].count() == len(twin.duck(SOURCE).execute(sql).fetchall())


def test_stream_matches_are_not_joined_again(spark, tmp_path):
    """Where no place repeats, what the stream has written is the result."""
    plan = plans.runner(plans.registered()["str_space_time_matches"])(spark, SOURCE)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_stream_matches_of_ids_at_several_times(spark, tmp_path):
    """Some rows repeat, some ids come back hours or days later (in another batch) and some of those repeat as well."""
    again = """SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0
     UNION ALL SELECT * REPLACE (ts + INTERVAL 5 HOUR AS ts) FROM events WHERE event_id % 2 = 0
     UNION ALL SELECT * REPLACE (ts + INTERVAL 5 HOUR AS ts) FROM events WHERE event_id % 4 = 0
     UNION ALL SELECT * REPLACE (ts + INTERVAL 12 DAY AS ts) FROM events WHERE event_id % 5 < 2
     UNION ALL SELECT * REPLACE (event_id + 100000 AS event_id) FROM events WHERE event_id % 7 = 0"""
    assert same_as_twin(spark, "str_space_time_matches", folder_with(twin.duck(SOURCE), tmp_path, events=again)) == ""


def test_persistence_counts_years_as_bits(spark, tmp_path):
    """A cell is one row whatever its years; years 64 apart and rows without a date are told apart."""
    dates = "CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN l_shipdate - INTERVAL 64 YEAR ELSE l_shipdate END"
    lines = f"SELECT * REPLACE ({dates} AS l_shipdate) FROM lineitem"
    folder = folder_with(twin.duck(SOURCE), tmp_path, lineitem=lines)
    assert same_as_twin(spark, "ras_persistence_prior", folder) == ""
    plan = plans.runner(plans.registered()["ras_persistence_prior"])(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not any("year" in line for line in plan.split("\n") if "hashpartitioning(" in line)


def test_island_mask_joins_rows_of_the_strip(spark):
    """The last joins hold one row a row of the strip, not one a cell."""
    plan = plans.runner(plans.registered()["ras_island_mask"])(spark, SOURCE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter") and "distinct" not in plan
