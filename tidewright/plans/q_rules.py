"""Scalar rules, names and flags over the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as K
from ..functions import geodesy as G
from ..functions import rules as R
from ..functions import text as X
from ..functions import vertical as V
from ..functions.rng import mix_sql
from . import standins as S
from .registry import Tables, query
from .standins import r6

LON, LAT = "32 + (event_id % 400) / 100", "46 + (event_id % 277) / 100"


def _lonlat(df):
    return df.withColumn("lon", 32 + (F.col("event_id") % 400) / 100).withColumn("lat", 46 + (F.col("event_id") % 277) / 100)


@query("prj_pixel_height", "PRJ-01 M6", f"""WITH {S.LEVELS} SELECT event_id,
 round(m - (coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE hr / 100.0 END, 0) + (event_id % 7) / 100.0 + coalesce(CASE WHEN event_id % 3 > 0 THEN 0.01 END, 0)), 6) AS h FROM lv""")
def _(t: Tables):
    e = F.col("event_id")
    nan = F.lit(float("nan"))
    h = V.pixel_ellipsoidal(F.col("m"), F.when(e % 5 == 0, nan).otherwise(F.col("hr") / 100), (e % 7) / 100, F.when(e % 3 > 0, 0.01))
    return S.levels(t).select("event_id", r6(h).alias("h"))


@query("prj_tide_and_chains", "PRJ-02 PRJ-03 PRJ-04 PRJ-42 M1 UDF-01", f"""WITH {S.LEVELS}, q AS (SELECT event_id, m, {LAT} AS lat, hr / 10.0 AS zeta FROM lv)
 SELECT event_id, round(0.06029 - 0.180873 * power(sin(radians(lat)), 2), 6) AS f2m,
 round(m + 0.06029 - 0.180873 * power(sin(radians(lat)), 2), 6) AS mean_tide, round(m - zeta, 6) AS normal,
 round(m + 0.5 - zeta, 6) AS node, round(m + 12.0 + 0.25, 6) AS gauge, round(m + 1.5 - zeta + 0.02, 6) AS moved FROM q""")
def _(t: Tables):
    d = _lonlat(S.levels(t)).withColumn("zeta", F.col("hr") / 10)
    m, lat, z = F.col("m"), F.col("lat"), F.col("zeta")
    return d.select("event_id", r6(V.free_to_mean(lat)).alias("f2m"), r6(V.tide_free_to_mean(m, lat)).alias("mean_tide"),
                    r6(V.normal_height(m, z)).alias("normal"), r6(V.node_height(m, F.lit(0.5), z)).alias("node"),
                    r6(V.gauge_height(m, F.lit(12.0), F.lit(0.25))).alias("gauge"),
                    r6(V.reframe(m, F.lit(1.5), z, F.lit(0.02))).alias("moved"))


@query("prj_chain_variants", "PRJ-05 AGG-01", f"""WITH {S.LEVELS}, v AS (SELECT station, 'raw' AS variant, m AS h FROM lv UNION ALL
 SELECT station, 'normal', m - hr / 10.0 FROM lv UNION ALL SELECT station, 'gauge', m + 12.25 FROM lv)
 SELECT variant, station, count(*) AS n, round(avg(h), 6) AS mean_h, round(max(h) - min(h), 6) AS range_h, round(median(h), 6) AS med FROM v GROUP BY 1, 2""")
def _(t: Tables):
    from ..operators import blocks as B
    d = S.levels(t)
    opts = {"raw": F.col("m"), "normal": F.col("m") - F.col("hr") / 10, "gauge": F.col("m") + 12.25}
    arr = F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("h")) for k, c in opts.items()])
    long = d.select("station", F.explode(arr).alias("v")).select("station", "v.variant", "v.h")
    g = B.summarise(long, ["variant", "station"], {"n": F.count(F.lit(1)), "mean_h": F.avg("h"), "range_h": F.max("h") - F.min("h")},
                    {"med": ("h", 0.5)})
    return g.select("variant", "station", "n", *[r6(F.col(c)).alias(c) for c in ("mean_h", "range_h", "med")])


@query("prj_distances", "PRJ-06 PRJ-07", f"""WITH {S.LEVELS}, q AS (SELECT event_id, {LON} AS lon, {LAT} AS lat FROM lv)
 SELECT event_id, round(2 * 6371.0088 * asin(sqrt(power(sin(radians(46.6 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(46.6)) * power(sin(radians(33.4 - lon) / 2), 2))), 6) AS km,
 round(lon * 111.32 * cos(radians(47.0)), 6) AS fx, round(lat * 110.57, 6) AS fy FROM q""")
def _(t: Tables):
    d = _lonlat(S.levels(t))
    fx, fy = G.flat_xy(F.col("lon"), F.col("lat"), F.lit(47.0))
    return d.select("event_id", r6(G.haversine_km(F.col("lon"), F.col("lat"), F.lit(33.4), F.lit(46.6))).alias("km"), r6(fx).alias("fx"), r6(fy).alias("fy"))


def _proj_sql() -> str:
    n, a, e = G._N, G._ALPHA, G._ECC
    k = G.UTM_K0 * G._RECT
    sx = " + ".join(f"{c!r} * cos({2*j} * xi) * sinh({2*j} * eta)" for j, c in enumerate(a, 1))
    sy = " + ".join(f"{c!r} * sin({2*j} * xi) * cosh({2*j} * eta)" for j, c in enumerate(a, 1))
    return f"""WITH {S.LEVELS}, q AS (SELECT event_id, radians({LON} - 33.0) AS lam, sin(radians({LAT})) AS s FROM lv),
 u AS (SELECT *, sinh(ln((1 + s) / (1 - s)) / 2 - {e!r} * ln((1 + {e!r} * s) / (1 - {e!r} * s)) / 2) AS tt FROM q),
 w AS (SELECT event_id, atan2(tt, cos(lam)) AS xi, ln((1 + sin(lam) / sqrt(1 + tt * tt)) / (1 - sin(lam) / sqrt(1 + tt * tt))) / 2 AS eta FROM u)
 SELECT event_id, round({k!r} * (eta + {sx}) + 500000, 3) AS x, round({k!r} * (xi + {sy}), 3) AS y FROM w"""


@query("prj_projection", "PRJ-08", _proj_sql())
def _(t: Tables):
    x, y = G.to_metric(F.col("lon"), F.col("lat"))
    return _lonlat(S.levels(t)).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("prj_projection_round_trip", "PRJ-08", f"WITH {S.LEVELS} SELECT event_id, round({LON}, 6) AS lon, round({LAT}, 6) AS lat FROM lv")
def _(t: Tables):
    d = _lonlat(S.levels(t))
    x, y = G.to_metric(F.col("lon"), F.col("lat"))
    d = d.select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = G.to_degrees(F.col("x"), F.col("y"))
    return d.select("event_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("prj_cell_index", "PRJ-09", f"""WITH {S.LEVELS}, {S.SENSORS} SELECT aid, CAST(floor((ax - 500) / 250) AS BIGINT) AS col, CAST(floor((ay - 500) / 250) AS BIGINT) AS row,
 CASE WHEN ax >= 500 AND ax < 80500 AND ay >= 500 AND ay < 80500 THEN 1 ELSE 0 END AS ok FROM sa""")
def _(t: Tables):
    a = S.sensor(t, "view", "a")
    c, r = G.cell_of(F.col("ax"), 500, 250), G.cell_of(F.col("ay"), 500, 250)
    return a.select("aid", c.alias("col"), r.alias("row"), (c.between(0, 319) & r.between(0, 319)).cast("int").alias("ok"))


@query("prj_period_label", "PRJ-10", """SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'before' WHEN ts < TIMESTAMP '2024-01-20' THEN 'drawdown' ELSE 'after' END AS period,
 event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t: Tables):
    p = R.period(F.col("ts").cast("timestamp"), [("2024-01-10", "before"), ("2024-01-20", "drawdown")], "after")
    return t.events.groupBy(p.alias("period"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_IDX = """(b08-b04)/nullif(b08+b04,0) AS ndvi, (b03-b08)/nullif(b03+b08,0) AS ndwi, (b03-b11)/nullif(b03+b11,0) AS mndwi,
 (b08-b11)/nullif(b08+b11,0) AS ndmi, ((b11+b04)-(b08+b02))/nullif((b11+b04)+(b08+b02),0) AS bsi,
 b02+2.5*b03-1.5*(b08+b11)-0.25*b12 AS aweish, (b04-b03)/nullif(b04+b03,0) AS ndti"""
_VALID = "(scl NOT IN (0,1,3,8,9,10,11) AND b03 > 0)"
_WATER = f"""({_VALID} AND ((coalesce(ndwi,-9) > 0 AND coalesce(mndwi,-9) > 0) OR (scl = 6 AND coalesce(ndwi,-9) > 0 - 0.15)))"""


def _indexed(t: Tables):
    b = S.bands(t)
    ix = R.indices(*[F.col(c) for c in ("b02", "b03", "b04", "b08", "b11", "b12")])
    d = b.select("*", *[c.alias(n) for n, c in ix.items()]).withColumn("valid", R.observed(F.col("scl"), F.col("b03")))
    return d.withColumn("is_water", R.water(F.col("ndwi"), F.col("mndwi"), F.col("scl"), F.col("valid")))


@query("prj_spectral_indices", "PRJ-11 UDF-01", f"WITH {S.BANDS}, ix AS (SELECT *, {_IDX} FROM bd) SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("ndvi", "ndwi", "mndwi", "ndmi", "bsi", "aweish", "ndti")) + " FROM ix")
def _(t: Tables):
    return _indexed(t).select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in ("ndvi", "ndwi", "mndwi", "ndmi", "bsi", "aweish", "ndti")])


@query("prj_reflectance", "PRJ-12", """SELECT l_orderkey, l_linenumber, round((CAST(l_quantity * 100 AS BIGINT) + CASE WHEN o_orderstatus = 'F' THEN -1000 WHEN o_orderstatus = 'O' THEN 0 ELSE 0 END) / 10000.0::DOUBLE, 6) AS rho
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t: Tables):
    scene = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", -1000).when(
        F.col("o_orderstatus") == "O", 0).alias("off"))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").join(scene, "l_orderkey")
    return d.select("l_orderkey", "l_linenumber", r6(R.reflectance(F.col("l_quantity") * 100, F.col("off"), F.lit(10000.0))).alias("rho"))


@query("prj_water_rule", "PRJ-13 PRJ-14 PRJ-15", f"""WITH {S.BANDS}, ix AS (SELECT *, {_IDX} FROM bd), w AS (SELECT year, scl, CASE WHEN {_VALID} THEN CASE WHEN {_WATER} THEN 1 ELSE 0 END END AS w3 FROM ix)
 SELECT year, scl, count(*) AS n, count(w3) AS n_seen, CAST(coalesce(sum(w3), 0) AS BIGINT) AS n_water FROM w GROUP BY 1, 2""")
def _(t: Tables):
    w = _indexed(t).withColumn("w3", R.three_valued(F.col("is_water"), F.col("valid")))
    return w.groupBy("year", "scl").agg(F.count(F.lit(1)).alias("n"), F.count("w3").alias("n_seen"), F.coalesce(F.sum("w3"), F.lit(0)).alias("n_water"))


_CLASS = f"""CASE WHEN NOT {_VALID} THEN 0 WHEN NOT {_WATER} AND coalesce(ndvi,-9) >= 0.30 AND coalesce(ndmi,-9) >= 0.10 THEN 7
 WHEN NOT {_WATER} AND coalesce(ndvi,-9) >= 0.30 AND coalesce(ndmi,-9) < 0.10 THEN 6
 WHEN NOT {_WATER} AND coalesce(ndvi,-9) >= 0.15 AND coalesce(ndvi,-9) < 0.30 AND coalesce(ndmi,-9) < 0.10 THEN 5
 WHEN NOT {_WATER} AND coalesce(ndmi,-9) >= 0.10 AND coalesce(ndvi,-9) < 0.30 AND coalesce(bsi,-9) < 0.10 THEN 3
 WHEN NOT {_WATER} AND coalesce(bsi,-9) >= 0.10 AND coalesce(ndvi,-9) < 0.15 AND coalesce(ndmi,-9) < 0.10 THEN 4
 WHEN NOT {_WATER} AND scl = 5 AND coalesce(ndvi,-9) < 0.15 AND coalesce(ndmi,-9) < 0.10 THEN 4
 WHEN l_linenumber = 7 THEN 2 WHEN {_WATER} THEN 1 ELSE 9 END"""
_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in R.SURFACE.items())


@query("prj_surface_class", "PRJ-16 PRJ-34", f"""WITH {S.BANDS}, ix AS (SELECT *, {_IDX} FROM bd), c AS (SELECT l_orderkey, l_linenumber, {_CLASS} AS code FROM ix)
 SELECT l_orderkey, l_linenumber, code, CASE code {_NAMES} ELSE 'UNATTRIBUTED' END AS name FROM c""")
def _(t: Tables):
    d = _indexed(t)
    code = R.surface_class(F.col("ndvi"), F.col("ndmi"), F.col("bsi"), F.col("scl"), F.col("is_water"), F.col("valid"), F.col("l_linenumber") == 7)
    d = d.withColumn("code", code)
    return d.select("l_orderkey", "l_linenumber", "code", R.decode(F.col("code"), R.SURFACE, R.UNKNOWN_SURFACE).alias("name"))


_ROUGH_SQL = """CASE WHEN mode = 0 THEN 0 WHEN built AND NOT mode IN (1,2) THEN 11 WHEN crops AND mode IN (5,6) AND NOT pool THEN 12
 WHEN mode IN (5,6,7) AND legacy THEN 10 WHEN mode IN (5,6,7) AND NOT legacy AND wl THEN 9 WHEN mode IN (5,6,7) AND NOT legacy AND wood >= 0.30 THEN 8
 WHEN mode IN (1,2) AND share >= 80 THEN 1 WHEN mode IN (1,2) THEN 2 WHEN mode BETWEEN 3 AND 7 THEN mode ELSE 0 END"""
_MANNING = "(VALUES " + ", ".join(f"({c}, {a}, {b}, {h})" for c, a, b, h in R.ROUGHNESS.values()) + ") AS mn(code, n_low, n_base, n_high)"


def _rough(t: Tables):
    k = F.col("l_orderkey")
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("mode"), (F.col("l_quantity") * 2).alias("share"),
                          ((k % 10) / 10).alias("wood"), (k % 11 == 0).alias("wl"), (k % 17 == 0).alias("built"), (k % 5 == 0).alias("crops"),
                          (k % 13 == 0).alias("legacy"), (k % 3 == 0).alias("pool"))
    code = R.roughness_code(*[F.col(c) for c in ("mode", "share", "wood", "wl", "built", "crops", "legacy", "pool")])
    return d.withColumn("code", code)


_ROUGH_CTE = f"""rg AS (SELECT l_orderkey, l_linenumber, {_ROUGH_SQL} AS code FROM (SELECT *, l_linenumber AS mode, l_quantity * 2 AS share, (l_orderkey % 10) / 10 AS wood,
 l_orderkey % 11 = 0 AS wl, l_orderkey % 17 = 0 AS built, l_orderkey % 5 = 0 AS crops, l_orderkey % 13 = 0 AS legacy, l_orderkey % 3 = 0 AS pool FROM lineitem))"""


@query("prj_roughness_and_manning", "PRJ-17 PRJ-18", f"""WITH {_ROUGH_CTE} SELECT l_orderkey, l_linenumber, code, n_low::DOUBLE AS n_low, n_base::DOUBLE AS n_base, n_high::DOUBLE AS n_high,
 round((n_high - n_low)::DOUBLE / n_base::DOUBLE, 6) AS spread, round(n_base::DOUBLE * CASE WHEN code IN (7,8,9,10) THEN 0.7 ELSE 1.0 END, 6) AS n_winter FROM rg JOIN {_MANNING} USING (code)""")
def _(t: Tables):
    rows = [F.struct(F.lit(c).alias("code"), F.lit(a).alias("n_low"), F.lit(b).alias("n_base"), F.lit(h).alias("n_high"))
            for c, a, b, h in R.ROUGHNESS.values()]
    table = t.spark.range(1).select(F.explode(F.array(*rows)).alias("m")).select("m.*")      # 15 rows
    j = _rough(t).join(F.broadcast(table), "code")
    return j.select("l_orderkey", "l_linenumber", "code", "n_low", "n_base", "n_high", r6((F.col("n_high") - F.col("n_low")) / F.col("n_base")).alias("spread"),
                    r6(F.col("n_base") * F.when(F.col("code").isin(*R.WOODY_CODES), R.LEAF_OFF_FACTOR).otherwise(1.0)).alias("n_winter"))


@query("prj_decibel_and_risk", "PRJ-19 PRJ-20", f"""WITH {S.BANDS}, ix AS (SELECT *, {_IDX} FROM bd), k AS (SELECT l_orderkey, l_linenumber, b12, ndvi, ndmi, qty / 100.0 AS sd, qty / 10.0 AS hc, (cents % 50) / 100.0 AS fr FROM ix)
 SELECT l_orderkey, l_linenumber, round(10 * log10(greatest(b12, 1e-6)), 6) AS db, round(greatest(least(coalesce((ndvi - 0.10) / 0.40, 0), 1), 0), 6) AS vegetation_risk,
 round(greatest(least(coalesce(CASE WHEN ndvi IS NULL THEN ndmi / 0.30 WHEN ndmi IS NULL THEN (ndvi - 0.15) / 0.35 ELSE least((ndvi - 0.15) / 0.35, ndmi / 0.30) END, 0), 1), 0), 6) AS reed_risk,
 round(greatest(least(0.6 * greatest(least(hc / 3.0, 1), 0) + 0.4 * greatest(least(fr / 0.3, 1), 0), 1), 0), 6) AS woody_risk,
 round(greatest(least(greatest(greatest(least(sd / 0.20, 1), 0), CASE WHEN l_linenumber = 2 THEN 1.0 ELSE 0.0 END), 1), 0), 6) AS mixed_risk FROM k""")
def _(t: Tables):
    d = _indexed(t)
    risk = R.canopy_risks(F.col("ndvi"), F.col("ndmi"), F.col("qty") / 100, F.col("qty") / 10, F.col("cents") % 50 / 100, F.col("l_linenumber") == 2)
    return d.select("l_orderkey", "l_linenumber", r6(R.decibel(F.col("b12"))).alias("db"), *[r6(c).alias(n) for n, c in risk.items()])


@query("prj_quality_flags", "PRJ-21 PRJ-22 M7 M4", f"""WITH {S.LEVELS} SELECT event_id, CASE WHEN cm < 100 AND hr < 20 THEN 1 ELSE 0 END AS terrain_ok, CASE WHEN cm >= 20 AND cm < 80 THEN 1 ELSE 0 END AS canopy_ok,
 CASE WHEN hr < 6 OR hr >= 20 THEN 1 ELSE 0 END AS night, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS strong,
 CASE WHEN event_id % 4 <= 1 AND event_id % 10 / 10 < 0.5 THEN 1 ELSE 0 END AS q_standard, CASE WHEN event_id % 4 <= 0 AND event_id % 10 / 10 < 0.5 THEN 1 ELSE 0 END AS q_strict,
 CASE WHEN event_id % 4 <= 2 THEN 1 ELSE 0 END AS q_loose FROM lv""")
def _(t: Tables):
    e, cm, hr = F.col("event_id"), F.col("cm"), F.col("hr")
    q, dark = e % 4, e % 10 / 10
    flags = {"terrain_ok": (cm < 100) & (hr < 20), "canopy_ok": (cm >= 20) & (cm < 80), "night": (hr < 6) | (hr >= 20), "strong": e % 2 == 0,
             "q_standard": (q <= 1) & (dark < 0.5), "q_strict": (q <= 0) & (dark < 0.5), "q_loose": q <= 2}
    return S.levels(t).select("event_id", *[c.cast("int").alias(n) for n, c in flags.items()])


@query("prj_qc_ledger", "PRJ-23", f"""WITH {S.LEVELS}, s AS (SELECT count(*) AS n0, count(*) FILTER (cm > 5) AS n1, count(*) FILTER (cm > 5 AND hr < 20) AS n2, count(*) FILTER (cm > 5 AND hr < 20 AND event_type <> 'error') AS n3 FROM lv)
 SELECT 1 AS step, 'not_tiny' AS rule, n0 AS before, n1 AS after, n0 - n1 AS removed FROM s UNION ALL SELECT 2, 'daytime', n1, n2, n1 - n2 FROM s UNION ALL SELECT 3, 'no_error', n2, n3, n2 - n3 FROM s""")
def _(t: Tables):
    steps = [("not_tiny", F.col("cm") > 5), ("daytime", F.col("hr") < 20), ("no_error", F.col("event_type") != "error")]
    aggs, acc = [F.count(F.lit(1)).alias("n0")], F.lit(True)
    for i, (_, c) in enumerate(steps, 1):
        acc = acc & c
        aggs.append(F.count_if(acc).alias(f"n{i}"))
    g = S.levels(t).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.col(f"n{i-1}").alias("before"), F.col(f"n{i}").alias("after"),
                              (F.col(f"n{i-1}") - F.col(f"n{i}")).alias("removed")) for i, (n, _) in enumerate(steps, 1)])
    return g.select(F.explode(rows).alias("r")).select("r.*")


@query("prj_subset_ladder", "PRJ-24", f"""WITH {S.LEVELS}, r AS (SELECT cm, CASE WHEN hr >= 20 THEN 0 WHEN cm <= 5 THEN 1 WHEN event_type = 'error' THEN 2 WHEN event_id % 2 = 0 THEN 3 ELSE 4 END AS passed FROM lv)
 SELECT rung, count(*) AS n, round(avg(cm), 6) AS mean_cm, round(median(cm), 6) AS med_cm FROM r JOIN (VALUES (0),(1),(2),(3),(4)) AS g(rung) ON rung <= passed GROUP BY 1""")
def _(t: Tables):
    from ..operators import blocks as B
    tests = [F.col("hr") < 20, F.col("cm") > 5, F.col("event_type") != "error", F.col("event_id") % 2 == 1]
    passed = F.lit(len(tests))
    for i in reversed(range(len(tests))):
        passed = F.when(~tests[i], i).otherwise(passed)
    d = S.levels(t).select("cm", F.explode(F.sequence(F.lit(0), passed)).alias("rung"))
    g = B.summarise(d, ["rung"], {"n": F.count(F.lit(1)), "mean_cm": F.avg("cm")}, {"med_cm": ("cm", 0.5)})
    return g.select("rung", "n", r6(F.col("mean_cm")).alias("mean_cm"), r6(F.col("med_cm")).alias("med_cm"))


@query("prj_grades", "PRJ-25", f"""WITH {S.LEVELS} SELECT event_id, CASE WHEN cm / 100 >= 0.80 THEN 'HIGH' WHEN cm / 100 >= 0.50 THEN 'ACCEPTABLE' ELSE 'PARTIAL' END AS coverage,
 CASE WHEN event_id % 9 = 0 THEN 'D' WHEN hr <= 2 THEN 'A' WHEN hr <= 5 THEN 'B' WHEN hr <= 10 THEN 'C' ELSE 'D' END AS lag,
 CASE WHEN event_id % 40 < 10 OR event_id % 4 < 1 THEN 'UNSUPPORTED' WHEN event_id % 4 >= 3 AND hr >= 5 THEN 'ROBUST_MULTI_TRACK' WHEN event_id % 4 >= 2 THEN 'LIMITED_MULTI_TRACK' ELSE 'EXPLORATORY_SINGLE_TRACK' END AS support FROM lv""")
def _(t: Tables):
    e, hr = F.col("event_id"), F.col("hr")
    cov = F.when(F.col("m") >= 0.80, "HIGH").when(F.col("m") >= 0.50, "ACCEPTABLE").otherwise("PARTIAL")
    lag = R.ladder(F.when(e % 9 != 0, hr), [(2, "A"), (5, "B"), (10, "C")], "D", missing="D")
    sup = (F.when((e % 40 < 10) | (e % 4 < 1), "UNSUPPORTED").when((e % 4 >= 3) & (hr >= 5), "ROBUST_MULTI_TRACK")
           .when(e % 4 >= 2, "LIMITED_MULTI_TRACK").otherwise("EXPLORATORY_SINGLE_TRACK"))
    return S.levels(t).select("event_id", cov.alias("coverage"), lag.alias("lag"), sup.alias("support"))


def _reasons_sql(names: list[tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in names) + ")"


_RS = [("far_from_channel", "cm > 40"), ("tiny_component", "event_id % 16 < 8"), ("single_beam", "event_id % 3 = 0"), ("not_persistent", "event_id % 5 < 2"),
       ("edge_sliver", "hr < 2"), ("wse_gate_fail", "event_id % 7 = 0"), ("stale_imagery", "hr > 18")]


@query("prj_reason_list", "PRJ-26", f"""WITH {S.LEVELS}, r AS (SELECT event_id, {_reasons_sql(_RS)} AS reasons, ({' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for _, c in _RS)}) AS n_reasons,
 cm > 40 AS far, event_id % 7 = 0 AS gate, event_id % 3 = 0 AS single, event_id % 16 < 8 AS tiny, event_id % 5 < 2 AS np FROM lv)
 SELECT event_id, reasons, n_reasons, CASE WHEN (far AND gate) OR (far AND (single OR tiny) AND np) OR n_reasons >= 4 THEN 1 ELSE 0 END AS suspect FROM r""")
def _(t: Tables):
    tests = {n: F.expr(c) for n, c in _RS}
    d = S.levels(t).withColumn("rs", R.reasons(tests))
    far = tests["far_from_channel"]
    bad = (far & tests["wse_gate_fail"]) | (far & (tests["single_beam"] | tests["tiny_component"]) & tests["not_persistent"]) | (F.size("rs") >= 4)
    return d.select("event_id", F.array_join("rs", "|").alias("reasons"), F.size("rs").alias("n_reasons"), bad.cast("int").alias("suspect"))


@query("prj_event_quality", "PRJ-27", """WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'x' WHEN o_orderkey % 29 = 0 THEN '' END AS rej, CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey % 101 / 100 END AS cov,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 / 100 END AS bn, o_orderkey % 2 = 0 AS app, o_orderkey % 7 / 2 AS sm, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 9) - 4.5 END AS zv, (o_orderkey % 11) - 5.5 AS zh FROM orders),
 f AS (SELECT *, concat_ws('|', CASE WHEN bn > 0.05 THEN 'border_noise_high' END, CASE WHEN app AND sm > 1.5 THEN 'mosaic_seam' END, CASE WHEN abs(zv) > 3 THEN 'stable_ref_VV' END, CASE WHEN abs(zh) > 3 THEN 'stable_ref_VH' END) AS fl,
 (CASE WHEN bn > 0.05 THEN 1 ELSE 0 END + CASE WHEN app AND sm > 1.5 THEN 1 ELSE 0 END + CASE WHEN abs(zv) > 3 THEN 1 ELSE 0 END + CASE WHEN abs(zh) > 3 THEN 1 ELSE 0 END) AS nf,
 (coalesce(trim(rej), '') <> '' OR cov IS NULL OR cov <= 0.001) AS outside FROM q)
 SELECT o_orderkey, CASE WHEN outside THEN 'NO_OVERLAP' WHEN cov >= 0.95 THEN 'VALID_OVERLAP' ELSE 'PARTIAL_OVERLAP' END AS spatial,
 CASE WHEN outside THEN 'NOT_EVALUATED' WHEN nf >= 2 THEN 'DEGRADED' WHEN nf = 1 THEN 'USABLE' WHEN cov < 0.5 THEN 'USABLE' ELSE 'GOOD' END AS quality,
 CASE WHEN outside THEN '' WHEN nf > 0 THEN fl WHEN cov < 0.5 THEN 'partial_coverage' ELSE '' END AS flags FROM f""")
def _(t: Tables):
    k = F.col("o_orderkey")
    d = t.orders.select("o_orderkey", F.when(k % 23 == 0, "x").when(k % 29 == 0, "").alias("rej"), F.when(k % 31 != 0, F.col("o_custkey") % 101 / 100).alias("cov"),
                        F.when(k % 3 == 0, k % 10 / 100).alias("bn"), (k % 2 == 0).alias("app"), (k % 7 / 2).alias("sm"),
                        F.when(k % 5 > 0, k % 9 - 4.5).alias("zv"), (k % 11 - 5.5).alias("zh"))
    rs = R.reasons({"border_noise_high": F.col("bn") > 0.05, "mosaic_seam": F.col("app") & (F.col("sm") > 1.5),
                    "stable_ref_VV": F.abs("zv") > 3, "stable_ref_VH": F.abs("zh") > 3})
    has_text = F.coalesce(F.trim("rej") != "", F.lit(False))
    out = has_text | F.col("cov").isNull() | (F.col("cov") <= 0.001)
    d = d.withColumn("rs", rs).withColumn("out", out)
    n = F.size("rs")
    return d.select(
        "o_orderkey", F.when(F.col("out"), "NO_OVERLAP").when(F.col("cov") >= 0.95, "VALID_OVERLAP").otherwise("PARTIAL_OVERLAP").alias("spatial"),
        F.when(F.col("out"), "NOT_EVALUATED").when(n >= 2, "DEGRADED").when((n == 1) | (F.col("cov") < 0.5), "USABLE").otherwise("GOOD").alias("quality"),
        F.when(F.col("out"), "").when(n > 0, F.array_join("rs", "|")).when(F.col("cov") < 0.5, "partial_coverage").otherwise("").alias("flags"))


ROLES = {   # fixed values: roles of an observation by regime
    "PREBREACH_IMPOUNDED": ["PREBREACH_REFERENCE", "RADIOMETRIC_CALIBRATION"],
    "BREACH_ONSET": ["BREACH_ONSET_OBSERVATION", "HYDRAULIC_TRANSITION", "TEMPORAL_CHANGE_REFERENCE"],
    "ACTIVE_DRAWDOWN": ["POSTBREACH_DRAWDOWN", "HYDRAULIC_TRANSITION", "LOWER_STAGE_GEOMETRY", "CHANNEL_EXPOSURE_REFERENCE",
                        "TEMPORAL_CHANGE_REFERENCE", "FLOODED_VEGETATION_DIAGNOSTIC", "FUTURE_HYDRAULIC_MODEL_VALIDATION"],
    "POSTBREACH_TRANSITION": ["POSTBREACH_TRANSITION_OBSERVATION", "LOWER_STAGE_GEOMETRY", "CHANNEL_EXPOSURE_REFERENCE", "TEMPORAL_CHANGE_REFERENCE"],
    "REGIME_UNRESOLVED": ["REGIME_UNRESOLVED", "TEMPORAL_CHANGE_REFERENCE"],
}
TARGETS = {"T_LOW": 0.2, "T_MID": 0.6, "T_HIGH": 1.2}
_REG = "CASE event_id % 5 WHEN 0 THEN 'PREBREACH_IMPOUNDED' WHEN 1 THEN 'BREACH_ONSET' WHEN 2 THEN 'ACTIVE_DRAWDOWN' WHEN 3 THEN 'POSTBREACH_TRANSITION' ELSE 'REGIME_UNRESOLVED' END"


@query("prj_roles_and_targets", "PRJ-28 PRJ-29", f"""WITH {S.LEVELS}, h AS (SELECT event_id, {_REG} AS reg, CASE WHEN event_id % 11 > 0 THEN m END AS h FROM lv),
 d AS (SELECT event_id, reg, h, arg_min(tid, (abs(h - lev), ord)) AS target, arg_min(h - lev, (abs(h - lev), ord)) AS dh FROM h, (VALUES (0, 'T_LOW', 0.2::DOUBLE), (1, 'T_MID', 0.6::DOUBLE), (2, 'T_HIGH', 1.2::DOUBLE)) AS g(ord, tid, lev) GROUP BY 1, 2, 3)
 SELECT event_id, CASE WHEN h IS NULL THEN '' ELSE target END AS target, coalesce(round(dh, 6), -9999.0) AS dh, concat_ws('|', CASE reg {' '.join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in ROLES.items())} END,
 CASE WHEN h IS NULL THEN 'WSE_UNRESOLVED' END, CASE WHEN h IS NOT NULL AND reg = 'PREBREACH_IMPOUNDED' THEN CASE WHEN abs(dh) <= 0.10 THEN target || '_TARGET_STAGE_GEOMETRY' WHEN abs(dh) <= 0.30 THEN target || '_NEAR_TARGET_STAGE_GEOMETRY'
 WHEN dh > 0 THEN 'HIGHER_STAGE_GEOMETRY' ELSE 'LOWER_STAGE_GEOMETRY' END END, CASE WHEN h IS NOT NULL THEN 'STAGE_RESPONSE_OBSERVATION|CLASSIFIER_DIAGNOSTIC' END) AS roles FROM d""")
def _(t: Tables):
    d = S.levels(t).select("event_id", F.expr(_REG).alias("reg"), F.when(F.col("event_id") % 11 > 0, F.col("m")).alias("h"))
    cand = F.array(*[F.struct(F.abs(F.col("h") - v).alias("a"), F.lit(i).alias("i"), F.lit(n).alias("id"), (F.col("h") - v).alias("dh"))
                     for i, (n, v) in enumerate(TARGETS.items())])
    d = d.withColumn("b", F.when(F.col("h").isNotNull(), F.array_min(cand)))
    base = None
    for k, v in ROLES.items():
        a = F.array(*[F.lit(x) for x in v])
        base = F.when(F.col("reg") == k, a) if base is None else base.when(F.col("reg") == k, a)
    dh, tid = F.col("b.dh"), F.col("b.id")
    stage = (F.when(F.abs(dh) <= 0.10, F.concat(tid, F.lit("_TARGET_STAGE_GEOMETRY")))
             .when(F.abs(dh) <= 0.30, F.concat(tid, F.lit("_NEAR_TARGET_STAGE_GEOMETRY")))
             .when(dh > 0, "HIGHER_STAGE_GEOMETRY").otherwise("LOWER_STAGE_GEOMETRY"))
    tail = F.when(F.col("h").isNull(), F.array(F.lit("WSE_UNRESOLVED"))).when(
        F.col("reg") == "PREBREACH_IMPOUNDED", F.array(stage, F.lit("STAGE_RESPONSE_OBSERVATION"), F.lit("CLASSIFIER_DIAGNOSTIC"))).otherwise(
        F.array(F.lit("STAGE_RESPONSE_OBSERVATION"), F.lit("CLASSIFIER_DIAGNOSTIC")))
    return d.select("event_id", F.coalesce(tid, F.lit("")).alias("target"), F.coalesce(r6(dh), F.lit(-9999.0)).alias("dh"), F.array_join(F.concat(base, tail), "|").alias("roles"))


@query("prj_uncertainty", "PRJ-30 FN-16", f"""WITH {S.LEVELS} SELECT event_id, round(sqrt(power(m, 2) + power(hr / 100.0, 2) + power(coalesce(CASE WHEN event_id % 4 > 0 THEN 0.05 END, 0), 2)), 6) AS sigma FROM lv""")
def _(t: Tables):
    s = V.quadrature(F.col("m"), F.col("hr") / 100, F.when(F.col("event_id") % 4 > 0, F.lit(0.05)).otherwise(F.lit(float("nan"))))
    return S.levels(t).select("event_id", r6(s).alias("sigma"))


_AX = "sin(radians(65.0))", "cos(radians(65.0))"
_SET = "(100 * 1.2 * 1.5e-3 * 60e3 / (1000.0 * 9.81 * 5.0))"


@query("prj_wind", "PRJ-31 PRJ-33 FN-15 M15", f"""WITH {S.LEVELS}, w AS (SELECT event_id, station, hr, -(cm / 10) * sin(radians(event_id % 360)) AS u, -(cm / 10) * cos(radians(event_id % 360)) AS v FROM lv),
 f AS (SELECT station, hr, avg(u) AS u, avg(v) AS v, count(*) AS n FROM w GROUP BY 1, 2), g AS (SELECT *, u * {_AX[0]} + v * {_AX[1]} AS al, v * {_AX[0]} - u * {_AX[1]} AS cr FROM f)
 SELECT station, hr, n, round(al, 6) AS along_ms, round(cr, 6) AS cross_ms, round(sqrt(u*u+v*v), 6) AS speed, round({_SET} * al * abs(al), 6) AS setup,
 round(CASE WHEN degrees(atan2(-u, -v)) < 0 THEN degrees(atan2(-u, -v)) + 360 ELSE degrees(atan2(-u, -v)) END, 6) AS from_deg FROM g""")
def _(t: Tables):
    d = S.levels(t)
    u, v = G.wind_vector(F.col("cm") / 10, (F.col("event_id") % 360).cast("double"))
    f = d.select("station", "hr", u.alias("u"), v.alias("v")).groupBy("station", "hr").agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    al, cr = G.along_cross(F.col("u"), F.col("v"), 65.0)
    return f.select("station", "hr", "n", r6(al).alias("along_ms"), r6(cr).alias("cross_ms"), r6(F.hypot("u", "v")).alias("speed"),
                    r6(G.setup_cm(al)).alias("setup"), r6(G.wind_from(F.col("u"), F.col("v"))).alias("from_deg"))


@query("prj_wind_class_season", "PRJ-32 FN-10", """SELECT CASE WHEN o_custkey % 10 <= 3 THEN 'CALM' WHEN o_custkey % 10 <= 5 THEN 'LOW' WHEN o_custkey % 10 <= 8 THEN 'MODERATE' ELSE 'HIGH' END AS wind,
 CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'DJF' WHEN month(o_orderdate) IN (3,4,5) THEN 'MAM' WHEN month(o_orderdate) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def _(t: Tables):
    ts = F.col("o_orderdate").cast("timestamp")
    w = R.ladder(F.col("o_custkey") % 10, [(3.0, "CALM"), (5.0, "LOW"), (8.0, "MODERATE")], "HIGH")
    return t.orders.groupBy(w.alias("wind"), R.season(ts).alias("season"), F.year(ts).alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_bounds_and_pull", "PRJ-35 PRJ-36 JON-30", f"""WITH {S.CELLS}, b AS (SELECT row, col, min(CASE WHEN water = 1 THEN qty END) AS up, max(CASE WHEN water = 0 THEN qty END) AS lo FROM cl GROUP BY 1, 2),
 j AS (SELECT l_orderkey, l_linenumber, CAST(qty AS DOUBLE) AS h, CAST(lo AS DOUBLE) AS lo, CAST(up AS DOUBLE) AS up FROM cl JOIN b USING (row, col)),
 p AS (SELECT *, CASE WHEN up IS NOT NULL AND h > up THEN h + 0.5 * (up - h) ELSE h END AS p1 FROM j)
 SELECT l_orderkey, l_linenumber, CASE WHEN greatest(coalesce(greatest(h - up, 0), 0), coalesce(greatest(lo - h, 0), 0)) > 0 THEN 1 ELSE 0 END AS violated,
 round(greatest(CASE WHEN up IS NULL THEN 0 ELSE greatest(h - up, 0) END, CASE WHEN lo IS NULL THEN 0 ELSE greatest(lo - h, 0) END), 6) AS size_m, round(CASE WHEN lo IS NOT NULL AND h < lo THEN p1 + 0.5 * (lo - p1) ELSE p1 END, 6) AS pulled FROM p""")
def _(t: Tables):
    c = S.cells(t)
    b = c.groupBy("row", "col").agg(F.min(F.when(F.col("water") == 1, F.col("qty"))).cast("double").alias("up"),
                                    F.max(F.when(F.col("water") == 0, F.col("qty"))).cast("double").alias("lo"))
    j = c.join(b, ["row", "col"]).withColumn("h", F.col("qty").cast("double"))
    bad, size = R.bound_violation(F.col("h"), F.col("lo"), F.col("up"))
    return j.select("l_orderkey", "l_linenumber", bad.cast("int").alias("violated"), r6(size).alias("size_m"),
                    r6(R.soft_pull(F.col("h"), F.col("lo"), F.col("up"), 0.5)).alias("pulled"))


@query("prj_width_anomaly", "PRJ-37", f"""WITH {S.LEVELS}, b AS (SELECT station, greatest(avg(cm), 1) AS base FROM lv WHERE day < DATE '2024-01-11' GROUP BY 1)
 SELECT event_id, round(cm - base, 6) AS d, round(100 * (cm - base) / base, 6) AS pct FROM lv JOIN b USING (station)""")
def _(t: Tables):
    from ..session import broadcast_if_small
    d = S.levels(t)
    b = d.where(F.col("day") < F.to_date(F.lit("2024-01-11"))).groupBy("station").agg(F.greatest(F.avg("cm"), F.lit(1.0)).alias("base"))
    j = d.join(broadcast_if_small(b), "station")
    return j.select("event_id", r6(F.col("cm") - F.col("base")).alias("d"), r6(100 * (F.col("cm") - F.col("base")) / F.col("base")).alias("pct"))


@query("prj_grid_covers", "PRJ-38 SRC-07 M10 M11", """SELECT domain, CAST(w AS DOUBLE) AS w, 0.0::DOUBLE AS s, CAST(w + 15000 AS DOUBLE) AS e, 60000.0::DOUBLE AS n, 1 AS covered FROM (SELECT r_regionkey AS domain, r_regionkey * 20000 AS w FROM region)""")
def _(t: Tables):
    from ..sources.readers import bbox
    b = bbox(S.zone_rings(t))
    side = (F.when(F.col("w") < 0, "west").when(F.col("e") > 100000, "east").when(F.col("s") < 0, "south").when(F.col("n") > 100000, "north"))
    bad = F.raise_error(F.concat(F.lit("grid does not reach the domain on its side "), side)).cast("int")
    return b.select("domain", "w", "s", "e", "n", F.when(side.isNull(), F.lit(1)).otherwise(bad).alias("covered"))


@query("prj_admission", "PRJ-40", f"""WITH {S.LEVELS}, r AS (SELECT event_id, {_reasons_sql([('coverage', 'NOT coalesce(CASE WHEN event_id % 8 > 0 THEN cm END > 10, FALSE)'), ('night', 'NOT coalesce(hr >= 5, FALSE)'), ('kind', "NOT coalesce(event_type <> 'error', FALSE)")])} AS failed, cm, event_id % 8 AS k FROM lv)
 SELECT event_id, failed, CASE WHEN failed = '' THEN 1 ELSE 0 END AS admitted, CASE WHEN failed = '' AND cm > 60 THEN 1 ELSE 0 END AS strict FROM r""")
def _(t: Tables):
    cuts = {"coverage": F.when(F.col("event_id") % 8 > 0, F.col("cm")) > 10, "night": F.col("hr") >= 5, "kind": F.col("event_type") != "error"}
    d = S.levels(t).withColumn("f", R.reasons({n: ~F.coalesce(c, F.lit(False)) for n, c in cuts.items()}))
    ok = F.size("f") == 0
    return d.select("event_id", F.array_join("f", "|").alias("failed"), ok.cast("int").alias("admitted"), (ok & (F.col("cm") > 60)).cast("int").alias("strict"))


@query("prj_mask_recheck", "PRJ-41", f"""WITH {S.CELLS}, a AS (SELECT year, avg(CASE WHEN water IS NOT NULL THEN 1.0 ELSE 0 END) AS now FROM cl GROUP BY 1), b AS (SELECT year, round(avg(CASE WHEN cls > 0 THEN 1.0 ELSE 0 END), 2) AS rec FROM cl WHERE year % 2 = 0 GROUP BY 1)
 SELECT year, round(now, 6) AS now, coalesce(round(abs(now - rec), 6), -1.0) AS diff FROM a LEFT JOIN b USING (year)""")
def _(t: Tables):
    c = S.cells(t)
    a = c.groupBy("year").agg(F.avg(F.col("water").isNotNull().cast("double")).alias("now"))
    b = c.where(F.col("year") % 2 == 0).groupBy("year").agg(F.round(F.avg(F.coalesce(F.col("cls") > 0, F.lit(False)).cast("double")), 2).alias("rec"))
    return a.join(b, "year", "left").select("year", r6(F.col("now")).alias("now"), F.coalesce(r6(F.abs(F.col("now") - F.col("rec"))), F.lit(-1.0)).alias("diff"))


@query("fn_keys_and_dates", "FN-03 FN-04 FN-05 FN-08 FN-09 M13", f"""WITH {S.LEVELS} SELECT event_id, lpad(CAST(station AS VARCHAR), 3, '0') || '_' || lpad(CAST(hr AS VARCHAR), 3, '0') || '_' || strftime(day, '%Y%m%d') AS pass_id,
 strftime(day, '%Y-%m-%d') || '_orb' || station || '_' || upper(substr(event_type, 1, 3)) AS event_key, strftime(date_trunc('month', day), '%Y-%m-%d') AS month0,
 round((us - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 6) AS hours, split_part('a_Node_' || station || '_' || hr, '_', 3) AS part3, strftime(make_timestamp(us // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS back FROM lv""")
def _(t: Tables):
    d = S.levels(t)
    return d.select(
        "event_id", K.pass_key(F.col("station"), F.col("hr"), F.col("day")).alias("pass_id"), K.event_key(F.col("day"), F.col("station"), F.col("event_type")).alias("event_key"),
        F.date_format(F.trunc("day", "month"), "yyyy-MM-dd").alias("month0"), r6((F.col("us") - F.unix_micros(F.to_timestamp(F.lit("2024-01-01")))) / 3.6e9).alias("hours"),
        F.element_at(F.split(F.concat(F.lit("a_Node_"), F.col("station").cast("string"), F.lit("_"), F.col("hr").cast("string")), "_"), 3).alias("part3"),
        F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("back"))


@query("fn_civil_time", "FN-07 M2", """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 8 HOUR AS loc FROM orders) SELECT o_orderkey, strftime(loc, '%Y-%m-%d %H:%M:%S') AS local_term,
 strftime(loc - INTERVAL 1 HOUR * CASE WHEN loc >= dst0 AND loc < dst1 THEN 3 ELSE 2 END, '%Y-%m-%d %H:%M:%S') AS utc_term FROM (SELECT o_orderkey, loc,
 CAST(last_day(make_date(year(loc), 3, 1)) - CAST(dayofweek(last_day(make_date(year(loc), 3, 1))) AS INTEGER) AS DATE) + INTERVAL 3 HOUR AS dst0,
 CAST(last_day(make_date(year(loc), CASE WHEN year(loc) < 1996 THEN 9 ELSE 10 END, 1)) - CAST(dayofweek(last_day(make_date(year(loc), CASE WHEN year(loc) < 1996 THEN 9 ELSE 10 END, 1))) AS INTEGER) AS DATE) + INTERVAL 4 HOUR AS dst1 FROM d)""")
def _(t: Tables):
    loc = F.expr("cast(cast(o_orderdate as date) as timestamp_ntz) + interval 8 hours")
    d = t.orders.select("o_orderkey", loc.alias("loc"))
    return d.select("o_orderkey", F.date_format("loc", "yyyy-MM-dd HH:mm:ss").alias("local_term"),
                    F.date_format(F.convert_timezone(F.lit("Europe/Kyiv"), F.lit("UTC"), F.col("loc")), "yyyy-MM-dd HH:mm:ss").alias("utc_term"))


@query("fn_stamps_and_search", "FN-01 FN-02 FN-06", """SELECT event_id, coalesce(strftime(try_strptime(CASE WHEN event_id % 6 = 0 THEN '20241399' ELSE strftime(ts, '%Y%m%d') END, '%Y%m%d'), '%Y-%m-%d'), 'none') AS stamp,
 regexp_extract(props, '"k": *([0-9]+)', 1) AS k, CASE WHEN lower(trim(upper(event_type))) IN ('view', 'click') THEN 1 ELSE 0 END AS listed, CASE WHEN regexp_matches(upper(event_type), '(?i)^er|up$') THEN 1 ELSE 0 END AS hit FROM events""")
def _(t: Tables):
    e = t.events
    raw = F.when(F.col("event_id") % 6 == 0, "20241399").otherwise(F.date_format("ts", "yyyyMMdd"))
    return e.select("event_id", F.coalesce(F.date_format(F.try_to_timestamp(raw, F.lit("yyyyMMdd")), "yyyy-MM-dd"), F.lit("none")).alias("stamp"),
                    F.regexp_extract("props", '"k": *([0-9]+)', 1).alias("k"), F.lower(F.trim(F.upper("event_type"))).isin("view", "click").cast("int").alias("listed"),
                    F.upper("event_type").rlike("(?i)^er|up$").cast("int").alias("hit"))


@query("fn_rounding_and_bins", "FN-11 FN-12 FN-13 SRC-11", """WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity / 2 AS h, l_quantity AS q, replace(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',' || l_linenumber, ' ', '') AS raw FROM lineitem)
 SELECT l_orderkey, l_linenumber, round_even(h, 0) AS even, floor(q / 7) * 7 AS bin, coalesce(CASE WHEN q > 0 AND q <= 10 THEN 'low' WHEN q > 10 AND q <= 25 THEN 'mid' WHEN q > 25 AND q <= 45 THEN 'high' END, 'out') AS cut,
 CASE WHEN l_linenumber = 1 THEN -1.0 ELSE CAST(replace(raw, ',', '.') AS DOUBLE) END AS num, CASE WHEN l_linenumber = 3 THEN 'i' ELSE '' END AS flag FROM q""")
def _(t: Tables):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    raw = F.concat(q.cast("int").cast("string"), F.lit(","), n.cast("string"))
    raw = F.when(n == 1, "-").when(n == 3, F.concat(raw, F.lit(" i"))).otherwise(raw)
    num, flag = X.locale_number(raw)
    cut = R.interval_bin(q, [0, 10, 25, 45], ["low", "mid", "high"])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(q / 2).alias("even"), (F.floor(q / 7) * 7).cast("double").alias("bin"), F.coalesce(cut, F.lit("out")).alias("cut"),
                             F.coalesce(num, F.lit(-1.0)).alias("num"), flag.alias("flag"))


@query("fn_lists_json_hash", "FN-17 FN-18 FN-19", """WITH g AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1)
 SELECT user_id, array_to_string(kinds, '|') AS kinds, array_to_string(list_sort(list_intersect(kinds, ['view', 'error'])), '|') AS both, CASE WHEN list_contains(kinds, 'signup') THEN 1 ELSE 0 END AS has, k, sha256(array_to_string(kinds, '|')) AS sha FROM g""")
def _(t: Tables):
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    j = F.array_join("kinds", "|")
    return g.select("user_id", j.alias("kinds"), F.array_join(F.array_sort(F.array_intersect("kinds", F.array(F.lit("view"), F.lit("error")))), "|").alias("both"),
                    F.array_contains("kinds", "signup").cast("int").alias("has"), "k", F.sha2(j, 256).alias("sha"))


@query("fn_quantile_bins", "FN-14", f"""WITH {S.LEVELS}, e AS (SELECT station, quantile_cont(cm, 0.25) AS q1, quantile_cont(cm, 0.5) AS q2, quantile_cont(cm, 0.75) AS q3 FROM lv GROUP BY 1)
 SELECT event_id, CASE WHEN cm <= q1 THEN 'q1' WHEN cm <= q2 THEN 'q2' WHEN cm <= q3 THEN 'q3' ELSE 'q4' END AS bin FROM lv JOIN e USING (station)""")
def _(t: Tables):
    from ..operators import blocks as B
    from ..session import broadcast_if_small
    d = S.levels(t)
    e = B.quantiles(d, ["station"], "cm", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    j = d.join(broadcast_if_small(e), "station")
    c = F.col("cm")
    return j.select("event_id", F.when(c <= F.col("q1"), "q1").when(c <= F.col("q2"), "q2").when(c <= F.col("q3"), "q3").otherwise("q4").alias("bin"))


@query("fn_portable_draws", "FN-20", f"SELECT event_id, {mix_sql(7, 'event_id', 'user_id')} AS draw FROM events")
def _(t: Tables):
    from ..functions.rng import mix
    return t.events.select("event_id", mix(7, F.col("event_id"), F.col("user_id")).alias("draw"))


@query("udf_grid_and_spacing", "UDF-05 M11", """WITH b AS (SELECT s_suppkey AS id, s_suppkey * 37.0::DOUBLE AS w, s_nationkey * 11.0::DOUBLE AS s FROM supplier), g AS (SELECT id, CAST(unnest(range(CAST(ceil(s / 10) AS BIGINT), CAST(floor((s + 45) / 10) AS BIGINT) + 1)) AS BIGINT) AS row, w FROM b), c AS (SELECT id, row, CAST(unnest(range(CAST(ceil(w / 10) AS BIGINT), CAST(floor((w + 35) / 10) AS BIGINT) + 1)) AS BIGINT) AS col FROM g)
 SELECT id, count(*) AS n_cells, CAST(sum(row * 1000 + col) AS BIGINT) AS cells, CAST(max(n_pts) AS BIGINT) AS n_pts FROM c JOIN (SELECT id, floor(sqrt(35.0 * 35 + 45 * 45) / 4) + 1 AS n_pts FROM b) USING (id) GROUP BY 1""")
def _(t: Tables):
    b = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37.0).alias("w"), (F.col("s_nationkey") * 11.0).alias("s"))
    b = b.withColumn("e", F.col("w") + 35).withColumn("n", F.col("s") + 45)
    cells = G.grid_cells(b, 10.0, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("row") * 1000 + F.col("col")).alias("cells"))
    pts = G.points_along(b.select("id", F.col("w").alias("x1"), F.col("s").alias("y1"), F.col("e").alias("x2"), F.col("n").alias("y2")), 4.0, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n_pts"))
    return cells.join(pts, "id")
