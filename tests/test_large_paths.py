"""The large-data paths on small tables: one key holds most rows, one value repeats thousands of times."""
import numpy as np
import pandas as pd
import pytest

from tidewright.operators import blocks as B
from tidewright.operators import pairs as PR
from tidewright.operators import spatial as P
from tidewright.operators import stats as ST
from tidewright.operators import temporal as T


def frame(spark, n=4000, seed=0):
    r = np.random.default_rng(seed)
    p = pd.DataFrame({"id": np.arange(n), "k": np.where(r.random(n) < 0.7, 0, r.integers(1, 9, n)),
                      "t": np.where(r.random(n) < 0.4, 500.0, r.integers(0, 1000, n)), "v": np.round(r.normal(size=n), 2)})
    p["g"] = np.where(r.random(n) < 0.3, np.nan, p["v"])
    df = spark.createDataFrame(p)
    from tidewright.schema import clean_doubles
    return p, clean_doubles(df)


def test_blocks_are_used(spark, large_path):
    _, df = frame(spark)
    got, many = B.with_blocks(df, ["t", "id"])
    assert many
    assert got.groupBy(B.BLK).count().agg({"count": "max"}).first()[0] <= 600  # twice the limit


def test_blocks_of_one_instant_and_of_strings(spark, large_path):
    df = spark.range(3000).selectExpr("id", "1.0 AS t", "concat('s', id % 997) AS name", "id % 3 AS k")
    for order in (["t", "id"], ["name", "id"]):
        got, many = B.with_blocks(df, order)
        assert many and got.groupBy(B.BLK).count().agg({"count": "max"}).first()[0] <= 600
    pos = B.row_position(df, ["k"], ["name", "id"], "pos").toPandas()
    want = pos.sort_values(["k", "name", "id"]).groupby("k").cumcount() + 1
    assert (pos["pos"] == want).all()


def test_position_sum_neighbour(spark, large_path):
    p, df = frame(spark)
    from pyspark.sql import functions as F
    out = B.row_position(df, ["k"], ["t", "id"], "pos", "n")
    out = B.running_sum(out, ["k"], ["t", "id"], F.lit(1), "cum")
    out = B.running_sum(out, ["k"], ["t", "id"], F.lit(1), "rev", reverse=True)
    out = B.neighbour(out, ["k"], ["t", "id"], {"prev": "id"})
    out = B.neighbour(out, ["k"], ["t", "id"], {"next": "id"}, step=1)
    got = out.toPandas().sort_values("id").reset_index(drop=True)
    s = p.sort_values(["k", "t", "id"])
    want = s.assign(pos=s.groupby("k").cumcount() + 1, n=s.groupby("k")["id"].transform("size"), prev=s.groupby("k")["id"].shift(),
                    next=s.groupby("k")["id"].shift(-1)).sort_values("id").reset_index(drop=True)
    assert (got["pos"] == want["pos"]).all() and (got["cum"] == want["pos"]).all() and (got["n"] == want["n"]).all()
    assert (got["rev"] == want["n"] - want["pos"] + 1).all()
    for c in ("prev", "next"):
        assert got[c].fillna(-1).astype(int).equals(want[c].fillna(-1).astype(int))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_known(spark, large_path, forward, inclusive):
    p, df = frame(spark)
    got = B.known(df, ["k"], ["t", "id"], "g", "out", forward=forward, inclusive=inclusive).toPandas().sort_values("id")["out"].to_numpy(float)
    s = p.sort_values(["k", "t", "id"])
    g = s.groupby("k")["g"]
    f = g.bfill() if forward else g.ffill()
    if not inclusive:
        f = f.groupby(s["k"]).shift(-1 if forward else 1)
    want = s.assign(f=f).sort_values("id")["f"].to_numpy(float)
    assert np.array_equal(got, want, equal_nan=True)


def test_quantiles_and_ranks(spark, large_path):
    p, df = frame(spark)
    q = B.quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).toPandas().set_index("k").sort_index()
    for name, x in (("a", 0.05), ("b", 0.5), ("c", 0.95)):
        assert np.allclose(q[name], p.groupby("k")["v"].quantile(x), atol=1e-12)
    r = B.tied_rank(df, ["k"], "v", "r").toPandas().sort_values("id")["r"]
    assert np.allclose(r, p.groupby("k")["v"].rank().sort_index())
    n = ST.nmad(df, ["k"], "v").toPandas().set_index("k").sort_index()["nmad"]
    want = p.groupby("k")["v"].apply(lambda v: 1.4826 * np.median(np.abs(v - np.median(v))))
    assert np.allclose(n, want)


def test_summary_agrees_with_small_path(spark, large_path):
    from pyspark.sql import functions as F
    p, df = frame(spark)
    g = B.summarise(df, ["k"], {"n": F.count(F.lit(1))}, {"m": ("v", 0.5), "h": ("t", 0.9)}).toPandas().set_index("k").sort_index()
    assert np.allclose(g["m"], p.groupby("k")["v"].median()) and np.allclose(g["h"], p.groupby("k")["t"].quantile(0.9))


def test_asof_on_hot_station(spark, large_path):
    p, df = frame(spark)
    right = df.where("id % 3 = 0").groupBy("k", "t").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    got = T.asof_nearest(df.select("id", "k", "t"), right, ["k"], "t", "t", "v", "id").toPandas().sort_values("id")
    rp = right.toPandas()
    for k, part in p.groupby("k"):
        rk = rp[rp["k"] == k]["t"].to_numpy()
        want = np.abs(part["t"].to_numpy()[:, None] - rk[None, :]).min(1)
        assert np.array_equal(got[got["k"] == k]["gap"].to_numpy(), want)


def brute_slopes(x, y):
    i, j = np.triu_indices(len(x), 1)
    ok = x[i] != x[j]
    return np.sort((y[j] - y[i])[ok] / (x[j] - x[i])[ok])


@pytest.mark.parametrize("chunk", [40, 4096])
def test_pair_statistics(spark, chunk):
    r = np.random.default_rng(4)
    p = pd.DataFrame({"k": np.repeat([0, 1], [180, 25]), "x": r.integers(0, 50, 205).astype(float), "y": np.round(r.normal(size=205), 1)})
    df = spark.createDataFrame(p)
    ts = PR.theil_sen(df, ["k"], "x", "y", chunk=chunk).toPandas().set_index("k")
    pb = PR.passing_bablok(df, ["k"], "x", "y", chunk=chunk).toPandas().set_index("k")
    hl = PR.hodges_lehmann(df.withColumn("b", (df.x > 20).cast("int")), ["k"], "y", "b", chunk=chunk).toPandas().set_index("k")
    for k, g in p.groupby("k"):
        s = brute_slopes(g["x"].to_numpy(), g["y"].to_numpy())
        assert ts.loc[k, "slope"] == pytest.approx(np.median(s), abs=1e-12)
        assert ts.loc[k, "slope_lo"] in s and ts.loc[k, "slope_hi"] in s and ts.loc[k, "slope_lo"] <= np.median(s) <= ts.loc[k, "slope_hi"]
        z = s[s != -1]
        m, off = len(z), int((z < -1).sum())
        assert pb.loc[k, "slope"] == pytest.approx((z[(m - 1) // 2 + off] + z[m // 2 + off]) / 2, abs=1e-12)
        a, b = g["y"][g["x"] <= 20].to_numpy(), g["y"][g["x"] > 20].to_numpy()
        assert hl.loc[k, "shift"] == pytest.approx(np.median(b[None, :] - a[:, None]), abs=1e-12)


def cloud(spark, n=600, seed=2):
    """A third of the points at one place, a third in one tight patch."""
    r = np.random.default_rng(seed)
    xy = r.uniform(0, 1000, (n, 2))
    xy[: n // 3] = (500, 500)
    xy[n // 3: 2 * n // 3] = 200 + r.uniform(0, 2, (n // 3, 2))
    a = pd.DataFrame({"aid": np.arange(n), "ax": xy[:, 0], "ay": xy[:, 1]})
    b = pd.DataFrame({"bid": np.arange(n), "bx": xy[::-1, 0] + 0.5, "by": xy[::-1, 1]})
    return a, b, spark.createDataFrame(a), spark.createDataFrame(b)


@pytest.mark.parametrize("k", [1, 7])
def test_knn_is_exact_on_hot_cells(spark, large_path, k):
    a, b, da, db = cloud(spark)
    got = P.knn(da, db, k, "aid", "bid").toPandas().sort_values(["aid", "nn"])
    d = np.sqrt((a["ax"].to_numpy()[:, None] - b["bx"].to_numpy()[None]) ** 2 + (a["ay"].to_numpy()[:, None] - b["by"].to_numpy()[None]) ** 2)
    want = np.sort(d, 1)[:, :k]
    assert len(got) == len(a) * k
    assert np.allclose(got["dist"].to_numpy().reshape(len(a), k), want)


def test_radius_pairs_salted(spark, large_path):
    a, b, da, db = cloud(spark)
    got = set(map(tuple, P.radius_pairs(da, db, 30.0).select("aid", "bid").toPandas().to_numpy()))
    d = np.sqrt((a["ax"].to_numpy()[:, None] - b["bx"].to_numpy()[None]) ** 2 + (a["ay"].to_numpy()[:, None] - b["by"].to_numpy()[None]) ** 2)
    assert got == set(zip(*np.nonzero(d <= 30.0)))


def test_point_in_polygon_with_hole(spark, large_path):
    a, _, da, _ = cloud(spark)
    th = np.linspace(0, 2 * np.pi, 41)[:-1]
    ring = lambda c, rad, no: pd.DataFrame({"domain": 1, "part": 0, "ring": no, "seq": range(40), "x": c + rad * np.cos(th), "y": c + rad * np.sin(th)})
    rings = spark.createDataFrame(pd.concat([ring(500, 400, 0), ring(500, 100, 1)]))
    got = set(P.in_domain(da, rings, "aid", 10.0).toPandas()["aid"])
    d = np.hypot(a["ax"] - 500, a["ay"] - 500)
    sure = set(a["aid"][(d < 395) & (d > 101)])
    never = set(a["aid"][(d > 401) | (d < 98)])
    assert sure <= got and not (never & got)


def test_diameter(spark):
    a, _, da, _ = cloud(spark)
    got = P.diameter(da.selectExpr("aid % 2 AS k", "ax", "ay"), ["k"], "ax", "ay").toPandas().set_index("k")["diameter"]
    for k, g in a.groupby(a["aid"] % 2):
        d = np.hypot(g["ax"].to_numpy()[:, None] - g["ax"].to_numpy(), g["ay"].to_numpy()[:, None] - g["ay"].to_numpy())
        assert got[k] == pytest.approx(d.max())
