"""Frames, models and the answers built on them: frame report, convergence over cell sizes, offset stability, designs with interactions,
local planes, lake areas before and after, wind at scene times."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import rings as RG
from ..functions import rules as R
from ..functions.rng import mix_sql
from ..operators import blocks as B
from ..operators import cells as C
from ..operators import frame as FR
from ..operators import interp as I
from ..operators import resample as RS
from ..operators import select as L
from ..operators import stats as ST
from ..operators import temporal as T
from ..session import broadcast_if_small, cut_lineage
from . import standins as S
from .q_answers import slopes
from .q_stats import _AB, _NM, _TS, REPS, _ab
from .registry import Tables, query
from .standins import r6

CUT = "2024-01-16"


@query("prj_metric_frame", "PRJ-39", f"""WITH {S.LEVELS}, {S.SENSORS}, {S.AXIS}, {S.SOUNDINGS}, al AS (SELECT 'axis' AS input, 'EPSG:32636' AS frame, 'OK' AS status, bx AS x FROM ax UNION ALL SELECT 'sensor', 'EPSG:32636', 'OK', ax FROM sa UNION ALL SELECT 'soundings', 'EPSG:32636', 'OK', x FROM sd
 UNION ALL SELECT 'degrees', 'EPSG:4326', 'GEOGRAPHIC', 30 + ax / 100000 FROM sa UNION ALL SELECT 'chainage', 'none', 'MISSING', chain FROM ax) SELECT input, frame, status, count(*) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max FROM al GROUP BY 1, 2, 3""")
def _(t: Tables):
    """What every input states about its coordinates, read from the plan; the extent from the rows."""
    a = S.sensor(t, "view", "a")
    degrees = FR.in_frame(a.select((30 + F.col("ax") / 100000).alias("x")), "EPSG:4326", "x")
    inputs = {"axis": S.axis(t).select(F.col("bx").alias("x")), "sensor": a.select(F.col("ax").alias("x")), "soundings": S.soundings(t).select("x"),
              "degrees": degrees, "chainage": S.axis(t).select(F.col("chain").alias("x"))}
    out = None
    for name, df in inputs.items():
        frame = FR.frame_of(df, "x")
        g = df.groupBy().agg(F.count(F.lit(1)).alias("n"), r6(F.min("x")).alias("x_min"), r6(F.max("x")).alias("x_max"))
        g = g.select(F.lit(name).alias("input"), F.lit(frame or "none").alias("frame"), F.lit(FR.fault(frame) or "OK").alias("status"), "n", "x_min", "x_max")
        out = g if out is None else out.unionByName(g)
    return out


_LEVELS = 4


@query("agg_convergence", "AGG-60 AGG-47", f"""WITH {S.CELLS}, ob AS (SELECT scl % 4 AS method, row, col, water FROM cl WHERE water IS NOT NULL), ce AS ({" UNION ALL ".join(f"SELECT {2**k} AS size, method, row // {2**k} AS row, col // {2**k} AS col, count(*) AS n, count(*) FILTER (water = 0) AS d FROM ob GROUP BY 2, 3, 4" for k in range(_LEVELS))}),
 sc AS (SELECT *, unnest(['whole', 'reach ' || (row * size * 4 // (SELECT max(p_partkey) + 1 FROM part))]) AS scope FROM ce), sh AS (SELECT scope, size, method, count(*) AS cells, 100 * avg(CASE WHEN 2 * d >= n THEN 1.0 ELSE 0.0 END) AS pct FROM sc GROUP BY 1, 2, 3),
 g AS (SELECT scope, size, max(cells) AS cells, median(pct) AS pct, min(pct) AS lo, max(pct) AS hi FROM sh GROUP BY 1, 2), w AS (SELECT *, pct - lag(pct) OVER (PARTITION BY scope ORDER BY size DESC) AS step, first_value(pct) OVER (PARTITION BY scope ORDER BY size) - first_value(pct) OVER (PARTITION BY scope ORDER BY size DESC) AS drift FROM g)
 SELECT scope, CAST(size AS BIGINT) AS size, cells, round(pct, 6)::DOUBLE AS pct, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi, coalesce(round(step, 6), 0)::DOUBLE AS step, round(drift, 6)::DOUBLE AS drift, CASE WHEN abs(first_value(step) OVER (PARTITION BY scope ORDER BY size)) < 0.3 THEN 1 ELSE 0 END AS converged FROM w""")
def _(t: Tables):
    last = t.part.agg(F.max("p_partkey").alias("m")).first().m + 1
    base = S.cells(t).where("water is not null").groupBy((F.col("scl") % 4).alias("method"), "row", "col").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("water") == 0).alias("d"))
    shares = None
    for size, level in C.pyramid(cut_lineage(base), ["method"], ["n", "d"], _LEVELS):
        scope = F.explode(F.array(F.lit("whole"), F.concat(F.lit("reach "), F.floor(F.col("row") * size * 4 / last).cast("string"))))
        s = level.withColumn("scope", scope).groupBy("scope", "method").agg(F.count(F.lit(1)).alias("cells"), (100 * F.avg((2 * F.col("d") >= F.col("n")).cast("double"))).alias("pct"))
        s = s.withColumn("size", F.lit(size).cast("long"))
        shares = s if shares is None else shares.unionByName(s)
    g = C.convergence(shares, ["scope"])
    return g.select("scope", "size", "cells", *[r6(F.col(c)).alias(c) for c in ("pct", "lo", "hi")], F.coalesce(r6(F.col("step")), F.lit(0.0)).alias("step"), r6(F.col("drift")).alias("drift"), F.col("converged").cast("int").alias("converged"))


def _kw(g: str) -> str:
    return f"""rk_{g} AS (SELECT {g} AS grp, md, rank() OVER (ORDER BY md) + (count(*) OVER (PARTITION BY md) - 1) / 2.0 AS r FROM sc WHERE {g} IN (SELECT {g} FROM sc GROUP BY 1 HAVING count(*) > 1)),
 h_{g} AS (SELECT '{g}' AS grouping, n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM (SELECT sum(c) AS n, count(*) AS k, sum(s * s / c)::DOUBLE AS q FROM (SELECT sum(r)::DOUBLE AS s, count(*)::DOUBLE AS c FROM rk_{g} GROUP BY grp)), (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*)::DOUBLE AS c FROM rk_{g} GROUP BY md)))"""


@query("agg_offset_stability", "AGG-56", f"""WITH {S.LEVELS}, m0 AS (SELECT station, day, median(cm) AS md FROM lv GROUP BY 1, 2), sc AS (SELECT station AS orbit, station % 5 AS target, md, nm FROM (SELECT station, day, md, 1.4826::DOUBLE * median(abs(cm - md)) AS nm FROM lv JOIN m0 USING (station, day) GROUP BY 1, 2, 3)), {_kw('target')}, {_kw('orbit')},
 h AS (SELECT * FROM h_target UNION ALL SELECT * FROM h_orbit), p AS (SELECT *, 1 - list_sum(list_transform(range(0, 500), lambda i: exp(((k - 1) / 2.0 + i) * ln(h / 2) - h / 2 - lgamma((k - 1) / 2.0 + i + 1)))) AS p FROM h), s AS (SELECT max(md) - min(md) AS b, median(nm) AS w FROM sc), v AS (SELECT max(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) AS a FROM p)
 SELECT grouping, CAST(n AS BIGINT) AS n, k, round(h, 6) AS h, round(p, 9) AS p, CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS structured, round(b, 6) AS between_spread, round(w, 6) AS within_spread, round(b / w, 6) AS ratio, CASE WHEN a = 1 THEN 'PER_GROUP' WHEN b / w < 1.5 THEN 'CONSTANT' ELSE 'NO_CONSTANT' END AS verdict FROM p, s, v""")
def _(t: Tables):
    d = S.levels(t).select("station", "day", "cm")
    md = B.quantiles(d, ["station", "day"], "cm", {"md": 0.5})
    nm = B.quantiles(d.join(md, ["station", "day"]).withColumn("a", F.abs(F.col("cm") - F.col("md"))), ["station", "day"], "a", {"nm": 0.5})
    scenes = cut_lineage(md.join(nm, ["station", "day"]).select(F.col("station").alias("orbit"), (F.col("station") % 5).alias("target"), "md", (1.4826 * F.col("nm")).alias("nm")))
    g = ST.offset_stability(scenes, ["target", "orbit"], "md", "nm")
    return g.select("grouping", "n", "k", r6(F.col("h")).alias("h"), F.round("p", 9).alias("p"), F.col("structured").cast("int").alias("structured"), r6(F.col("between")).alias("between_spread"),
                    r6(F.col("within")).alias("within_spread"), r6(F.col("ratio")).alias("ratio"), "verdict")


_TYPES = ("(SELECT list_sort(list_distinct(list(event_type))) FROM events)", 5)


def _orthogonal(columns: list[str]) -> str:
    """Gram-Schmidt within stations: q0, q1, ... from the design columns, the last being the term of interest."""
    out, last = ["g0 AS (SELECT *, 1.0::DOUBLE AS q0 FROM dz)"], "g0"
    for j in range(1, len(columns)):
        expr = columns[j]
        for i in range(j):
            step = f"g{j}_{i}"
            value = expr if i == 0 else "x_"
            out.append(f"{step} AS (SELECT * {'EXCLUDE (x_)' if i else ''}, {value} - q{i} * (sum(q{i} * {value}) OVER w / nullif(sum(q{i} * q{i}) OVER w, 0)) AS x_ FROM {last} WINDOW w AS (PARTITION BY station))")
            last = step
        out.append(f"g{j} AS (SELECT * RENAME (x_ AS q{j}) FROM {last})")
        last = f"g{j}"
    return ", ".join(out)


_COLS = ["1.0", "x", "w", *[f"(CASE WHEN event_type = ({_TYPES[0]})[{k}] THEN 1.0::DOUBLE ELSE 0.0 END)" for k in range(2, _TYPES[1] + 1)], "x * w"]
_NQ = len(_COLS)


@query("agg_design_ols", "AGG-23", f"""WITH {S.LEVELS}, dz AS (SELECT station, event_type, CAST(hr AS DOUBLE) AS x, CAST(dayofmonth(day) AS DOUBLE) AS w, cm AS y FROM lv), {_orthogonal(_COLS)},
 b AS (SELECT *, {", ".join(f"sum(q{j} * y) OVER w / sum(q{j} * q{j}) OVER w AS b{j}, sum(q{j} * q{j}) OVER w AS s{j}" for j in range(_NQ))} FROM g{_NQ - 1} WINDOW w AS (PARTITION BY station)),
 e AS (SELECT station, q{_NQ - 1} AS q, b{_NQ - 1} AS beta, s{_NQ - 1} AS s, y - ({" + ".join(f"b{j} * q{j}" for j in range(_NQ))}) AS e, {" + ".join(f"q{j} * q{j} / s{j}" for j in range(_NQ))} AS lev FROM b)
 SELECT station, count(*) AS n, CAST({_NQ} AS BIGINT) AS rank, round(max(beta), 6) AS beta, round(sqrt(sum(power(q * e / (1 - lev), 2))) / max(s), 6) AS se FROM e GROUP BY 1""")
def _(t: Tables):
    """Level on hour, day, their interaction and the event type: the interaction and its HC3 error by station."""
    q = S.levels(t).select("station", F.col("hr").cast("double").alias("x"), F.dayofmonth("day").cast("double").alias("w"), "event_type", F.col("cm").alias("y"))
    g = ST.ols_design(q, ["station"], "y", ["x", "w"], [("x", "w")], ["event_type"])
    return g.where("term = 'x:w'").select("station", "n", "rank", r6(F.col("beta")).alias("beta"), r6(F.col("se")).alias("se"))


_RAD = 600.0


@query("int_plane_left_out", "INT-05", f"""WITH {S.SOUNDINGS}, a AS (SELECT *, floor(x / {_RAD}) AS cx, floor(y / {_RAD}) AS cy FROM sd), c AS (SELECT x, y, z, cx + dx AS cx, cy + dy AS cy FROM a, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
 p AS (SELECT a.sid, a.src, a.z AS z0, (c.x - a.x) / {_RAD} AS u, (c.y - a.y) / {_RAD} AS v, c.z AS w FROM a JOIN c USING (cx, cy) WHERE sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) <= {_RAD}),
 g AS (SELECT sid, max(src) AS src, max(z0) AS z0, count(*) AS n, sum(u) AS su, sum(v) AS sv, sum(u * u) AS suu, sum(u * v) AS suv, sum(v * v) AS svv, sum(w) AS sw, sum(u * w) AS suw, sum(v * w) AS svw FROM p GROUP BY 1),
 d AS (SELECT *, suu * svv - suv * suv AS co, n * (suu * svv - suv * suv) + su * (suv * sv - su * svv) + sv * (su * suv - suu * sv) AS de FROM g),
 f AS (SELECT src, sid, n, (z0 - (co * sw + (suv * sv - su * svv) * suw + (su * suv - suu * sv) * svw) / de) / (1 - co / de) AS er,
  sqrt(power(((suv * sv - su * svv) * sw + (n * svv - sv * sv) * suw + (su * sv - n * suv) * svw) / de, 2) + power(((su * suv - suu * sv) * sw + (su * sv - n * suv) * suw + (n * suu - su * su) * svw) / de, 2)) / {_RAD} AS sl FROM d WHERE n >= 8 AND de > 1e-3 * n * suu * svv),
 md AS (SELECT src, median(er) AS m FROM f GROUP BY 1) SELECT src, count(*) AS n, round(median(sl), 6) AS slope_p50, round(max(m), 6) AS bias, round(1.4826::DOUBLE * median(abs(er - m)), 6) AS sigma, round(sqrt(avg(er * er)), 6) AS rmse FROM f JOIN md USING (src) GROUP BY 1""")
def _(t: Tables):
    """Slope and leave-one-out error of the plane around every sounding, by the survey it belongs to."""
    s = S.soundings(t)
    f = cut_lineage(I.plane_left_out(s, "sid", "z", _RAD, carry=["src"]).where("error is not null").select("src", "slope", "error"))
    g = B.summarise(f, ["src"], {"n": F.count(F.lit(1)), "rmse": F.sqrt(F.avg(F.col("error") * F.col("error")))}, {"slope_p50": ("slope", 0.5), "bias": ("error", 0.5)})
    d = B.quantiles(f.join(broadcast_if_small(g.select("src", "bias")), "src").withColumn("a", F.abs(F.col("error") - F.col("bias"))), ["src"], "a", {"mad": 0.5})
    return g.join(d, "src").select("src", "n", r6(F.col("slope_p50")).alias("slope_p50"), r6(F.col("bias")).alias("bias"), r6(1.4826 * F.col("mad")).alias("sigma"), r6(F.col("rmse")).alias("rmse"))


_RECT = "200 + bid % 7 * 90"


@query("q_lake_area", "Q-24 JON-18 AGG-29 AGG-27", f"""WITH {S.LEVELS}, {S.SENSORS}, lk AS (SELECT bday, bx, by_, {_RECT} AS w, CAST(round(bh * 1000) AS BIGINT) AS mm FROM sb), zn AS (SELECT DISTINCT r_regionkey AS zone FROM region),
 cp AS (SELECT zone, bday, mm, greatest(0, least(bx + w, zone * 20000 + 15000) - greatest(bx - w, zone * 20000)) * greatest(0, least(by_ + w, 60000) - greatest(by_ - w, 0)) AS a FROM lk, zn),
 dt AS (SELECT zone, bday, count(*) AS n, sum(a)::DOUBLE AS area, median(mm)::DOUBLE AS level FROM cp WHERE a > 0 GROUP BY 1, 2), lg AS (SELECT zone, metric, value, epoch(CAST(bday AS TIMESTAMP))::BIGINT // 86400 AS uid, CASE WHEN bday < DATE '{CUT}' THEN 0 ELSE 1 END AS post FROM dt UNPIVOT (value FOR metric IN (area, level))),
 na AS (SELECT zone, metric, count(*) FILTER (post = 0) AS na, median(CASE WHEN post = 1 THEN value END) - median(CASE WHEN post = 0 THEN value END) AS obs FROM lg GROUP BY 1, 2),
 pr AS (SELECT zone, metric, rep, value, row_number() OVER (PARTITION BY zone, metric, rep ORDER BY {mix_sql(41, 'rep', 'uid')}, uid) AS pos FROM lg, (SELECT unnest(range(1, {REPS + 1})) AS rep)), pd AS (SELECT zone, metric, rep, median(CASE WHEN pos > na THEN value END) - median(CASE WHEN pos <= na THEN value END) AS d FROM pr JOIN na USING (zone, metric) GROUP BY 1, 2, 3),
 pp AS (SELECT zone, metric, (count(*) FILTER (abs(d) >= abs(obs)) + 1) / {REPS + 1}.0 AS p FROM pd JOIN na USING (zone, metric) GROUP BY 1, 2),
 u AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY zone, metric, post) AS k FROM lg WINDOW w AS (PARTITION BY zone, metric, post ORDER BY uid)), dr AS (SELECT zone, metric, post, rep, 1 + {mix_sql(42, 'rep', 'pos')} % k AS pos FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
 bm AS (SELECT zone, metric, rep, median(CASE WHEN post = 1 THEN value END) - median(CASE WHEN post = 0 THEN value END) AS d FROM dr JOIN u USING (zone, metric, post, pos) GROUP BY 1, 2, 3), ci AS (SELECT zone, metric, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM bm GROUP BY 1, 2)
 SELECT zone, metric, count(*) FILTER (post = 0) AS n_pre, count(*) FILTER (post = 1) AS n_post, round(max(obs), 6) AS diff, round(max(p), 6)::DOUBLE AS p, round(max(lo), 6) AS ci_lo, round(max(hi), 6) AS ci_hi FROM lg JOIN na USING (zone, metric) JOIN pp USING (zone, metric) JOIN ci USING (zone, metric) GROUP BY 1, 2 HAVING n_pre > 0 AND n_post > 0""")
def _(t: Tables):
    """Lake area (rings clipped to their zone) and level by date, before against after the cut."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    b = S.sensor(t, "click", "b")
    w = 200 + F.col("bid") % 7 * 90
    x0, x1, y0, y1 = F.col("bx") - w, F.col("bx") + w, F.col("by") - w, F.col("by") + w
    lakes = b.select("bday", F.round(F.col("bh") * 1000).cast("long").alias("mm"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"),
                     F.explode(F.array_distinct(F.array(F.floor(x0 / 20000), F.floor(x1 / 20000)))).alias("zone"))
    lo, hi = F.col("r_regionkey") * 20000, F.col("r_regionkey") * 20000 + 15000
    zones = t.region.select(F.col("r_regionkey").cast("long").alias("zone"), F.array(corner(lo, F.lit(0)), corner(hi, F.lit(0)), corner(hi, F.lit(60000)), corner(lo, F.lit(60000))).alias("domain"))
    cut = lakes.join(broadcast_if_small(zones), "zone").withColumn("area", RG.area(RG.clip(F.col("ring"), F.col("domain")))).where("area > 0")
    d = B.summarise(cut, ["zone", "bday"], {"area": F.sum("area")}, {"level": ("mm", 0.5)})
    m = d.select("zone", F.unix_date("bday").cast("long").alias("uid"), (F.col("bday") >= F.to_date(F.lit(CUT))).cast("int").alias("post"), F.explode(F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("area", "level")])).alias("m")).select("zone", "uid", "post", "m.*")
    m, k = cut_lineage(m), ["zone", "metric"]
    n = m.groupBy(*k).agg(F.count_if(F.col("post") == 0).alias("n_pre"), F.count_if(F.col("post") == 1).alias("n_post")).where("n_pre > 0 and n_post > 0")
    p = RS.permutation(m, "value", "post", "uid", REPS, 41, k)
    ci = RS.boot_diff(m, k, "value", "post", ["uid"], REPS, 42)
    return n.join(p, k).join(ci, k).select(*k, "n_pre", "n_post", r6(F.col("obs")).alias("diff"), *[r6(F.col(c)).alias(c) for c in ("p", "ci_lo", "ci_hi")])


_AXIS_DEG = 65.0
_E = (math.sin(math.radians(_AXIS_DEG)), math.cos(math.radians(_AXIS_DEG)))


@query("q_wind_catalogue", "Q-19 PRJ-31 JON-08 WIN-04", f"""WITH {S.LEVELS}, {S.ASSETS}, ph AS (SELECT station % 5 AS gx, station // 5 AS gy, us // 3600000000 AS t, -(cm / 10) * sin(radians((event_id * 37 % 360)::DOUBLE)) AS u, -(cm / 10) * cos(radians((event_id * 37 % 360)::DOUBLE)) AS v FROM lv),
 se AS (SELECT gx, gy, t, avg(u) AS u, avg(v) AS v FROM ph GROUP BY 1, 2, 3), sn AS (SELECT o_orderkey, orbit, cents, day, o_orderkey * 31 % 500 // 100 AS gx, o_orderkey * 17 % 500 // 100 AS gy, 473352 + (o_orderkey * 7919 % 43200) / 60 AS t FROM ast),
 b AS (SELECT sn.*, s.t AS bt, s.u AS bu, s.v AS bv FROM sn ASOF LEFT JOIN se s ON sn.gx = s.gx AND sn.gy = s.gy AND sn.t >= s.t), a AS (SELECT b.*, s.t AS at_, s.u AS au, s.v AS av FROM b ASOF LEFT JOIN se s ON b.gx = s.gx AND b.gy = s.gy AND b.t <= s.t),
 w AS (SELECT *, CASE WHEN at_ - bt <= 6 THEN CASE WHEN at_ = bt THEN bu ELSE bu + (au - bu) * (t - bt) / (at_ - bt) END END AS u, CASE WHEN at_ - bt <= 6 THEN CASE WHEN at_ = bt THEN bv ELSE bv + (av - bv) * (t - bt) / (at_ - bt) END END AS v FROM a),
 k AS (SELECT *, sqrt(u * u + v * v) AS sp, CASE WHEN u IS NULL THEN 'UNKNOWN' WHEN sqrt(u * u + v * v) <= 3 THEN 'CALM' WHEN sqrt(u * u + v * v) <= 5 THEN 'LOW' WHEN sqrt(u * u + v * v) <= 8 THEN 'MODERATE' ELSE 'HIGH' END AS wind, CASE WHEN month(day) IN (12,1,2) THEN 'DJF' WHEN month(day) IN (3,4,5) THEN 'MAM' WHEN month(day) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season FROM w),
 r AS (SELECT *, row_number() OVER (PARTITION BY wind, season, orbit ORDER BY cents DESC, o_orderkey) AS rk, count(*) OVER (PARTITION BY wind, season, orbit) AS n FROM k)
 SELECT wind, season, orbit, CAST(rk AS INTEGER) AS rk, n, o_orderkey, coalesce(round(sp, 5), -1.0) AS speed, coalesce(round(CASE WHEN degrees(atan2(-u, -v)) < 0 THEN degrees(atan2(-u, -v)) + 360 ELSE degrees(atan2(-u, -v)) END, 4), -1.0) AS from_deg, coalesce(round(u * {_E[0]} + v * {_E[1]}, 5), -99.0) AS along, coalesce(round(v * {_E[0]} - u * {_E[1]}, 5), -99.0) AS cross_ FROM r WHERE rk <= 2""")
def _(t: Tables):
    """Scenes with the wind of their place and instant (nearest cell of an hourly series, both sides of the instant, as vectors), and two
    scenes of every wind class, season and orbit."""
    u, v = G.wind_vector(F.col("cm") / 10, (F.col("event_id") * 37 % 360).cast("double"))
    hour = F.floor(F.col("us") / 3600000000)
    se = S.levels(t).select((F.col("station") % 5).alias("gx"), F.floor(F.col("station") / 5).alias("gy"), hour.cast("double").alias("t"), u.alias("u"), v.alias("v"))
    se = cut_lineage(se.groupBy("gx", "gy", "t").agg(F.avg("u").alias("u"), F.avg("v").alias("v")))
    k = F.col("o_orderkey")
    place = lambda m: F.floor(k * m % 500 / 100)  # the cell that holds the scene's centre is the nearest one
    sn = S.assets(t).select("o_orderkey", "orbit", "cents", "day", place(31).alias("gx"), place(17).alias("gy"), (473352 + k * 7919 % 43200 / 60).alias("t"))
    wind = T.linear(T.bracket(sn, se, ["gx", "gy"], "t", "t", "u", "o_orderkey"), "t", "u", 6).drop("before_t", "before_v", "after_t", "after_v")
    wind = T.linear(T.bracket(wind, se, ["gx", "gy"], "t", "t", "v", "o_orderkey"), "t", "v", 6)
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    wind = cut_lineage(wind.withColumn("speed", speed).withColumn("season", R.season(F.col("day"))).withColumn(
        "wind", R.ladder(F.col("speed"), [(3, "CALM"), (5, "LOW"), (8, "MODERATE")], "HIGH", "UNKNOWN")))
    strata = ["wind", "season", "orbit"]
    top = L.first_n(wind, strata, [F.col("cents").desc(), k], 2, "rk").join(broadcast_if_small(wind.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))), strata)
    al, cr = G.along_cross(F.col("u"), F.col("v"), _AXIS_DEG)
    return top.select(*strata, "rk", "n", "o_orderkey", F.coalesce(F.round("speed", 5), F.lit(-1.0)).alias("speed"), F.coalesce(F.round(G.wind_from(F.col("u"), F.col("v")), 4), F.lit(-1.0)).alias("from_deg"),
                      F.coalesce(F.round(al, 5), F.lit(-99.0)).alias("along"), F.coalesce(F.round(cr, 5), F.lit(-99.0)).alias("cross_"))


@query("agg_decision_quality", "AGG-37", f"""WITH {S.LEVELS}, {_AB}, {_NM}, p9 AS (SELECT station, b, quantile_cont(cm, 0.95) AS p95 FROM ab GROUP BY 1, 2), w AS (SELECT x.station, x.md AS m0, y.md AS m1, 0.5 * (x.nm + y.nm) AS sc, 0.5 * (x.md + y.md) AS at_, CASE WHEN y.md > x.md THEN px.p95 - y.p05 ELSE py.p95 - x.p05 END AS ov
  FROM nm x JOIN nm y ON x.station = y.station AND x.b = 0 AND y.b = 1 JOIN p9 px ON px.station = x.station AND px.b = 0 JOIN p9 py ON py.station = x.station AND py.b = 1)
 SELECT station, round(max(abs(m1 - m0) / sc), 6) AS effect_size, round(max(ov / sc), 6) AS overlap_norm, round(avg(CASE WHEN abs(cm - at_) < sc THEN 1.0 ELSE 0 END), 6)::DOUBLE AS near_decision,
  round(avg(CASE WHEN b = 0 THEN CASE WHEN cm <> at_ AND (cm > at_) = (m1 > m0) THEN 1.0 ELSE 0 END END), 6)::DOUBLE AS wrong_a, round(avg(CASE WHEN b = 1 THEN CASE WHEN cm <> at_ AND (cm < at_) = (m1 > m0) THEN 1.0 ELSE 0 END END), 6)::DOUBLE AS wrong_b FROM ab JOIN w USING (station) GROUP BY 1""")
def _(t: Tables):
    g = ST.decision_quality(_ab(t), ["station"], "cm", "b")
    return g.select("station", *[r6(F.col(c)).alias(c) for c in ("effect_size", "overlap_norm", "near_decision", "wrong_a", "wrong_b")])


@query("agg_otsu_log", "AGG-38", f"""WITH {S.CELLS}, d AS (SELECT scl, log10(cents) AS x FROM cl WHERE cents > 0), lim AS (SELECT scl, min(x) AS lo, max(x) AS hi, count(*) AS total FROM d GROUP BY 1 HAVING max(x) > min(x)), hc AS (SELECT scl, least(CAST(floor((x - lo) / (hi - lo) * 256) AS INTEGER), 255) AS bin, count(*) AS n FROM d JOIN lim USING (scl) GROUP BY 1, 2),
 e AS (SELECT l.scl, bin, lo + (hi - lo) * bin / 256 AS edge, coalesce(n, 0)::DOUBLE / total AS p, total FROM lim l CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) g LEFT JOIN hc USING (scl, bin)), c AS (SELECT *, sum(p) OVER w AS om, sum(p * edge) OVER w AS mu, sum(p * edge) OVER (PARTITION BY scl) AS mt FROM e WINDOW w AS (PARTITION BY scl ORDER BY bin ROWS UNBOUNDED PRECEDING))
 SELECT scl, max(total) AS n, round(log10(pow(10, arg_max(edge, (round(power(mt*om - mu, 2) / (om*(1-om) + 1e-10), 9), -bin)))), 6) AS log_threshold FROM c GROUP BY 1""")
def _(t: Tables):
    g = ST.otsu_log(S.cells(t), ["scl"], "cents", 10)
    return g.select("scl", "n", r6(F.log10("threshold")).alias("log_threshold"))


@query("agg_area_by_class", "AGG-44", f"""WITH {S.CELLS}, c AS (SELECT coalesce(cls, 0) AS class, CASE WHEN scl > 2 THEN qty END AS v, (1 + row % 3) * 100 AS a FROM cl) SELECT class, count(*) AS n, CAST(sum(a) AS BIGINT) AS area, round(sum(a)::DOUBLE / (SELECT sum(a) FROM c)::DOUBLE, 6) AS share, round(sum(v * a)::DOUBLE / sum(CASE WHEN v IS NOT NULL THEN a END)::DOUBLE, 6) AS weighted_mean FROM c GROUP BY 1""")
def _(t: Tables):
    c = S.cells(t).select(F.coalesce("cls", F.lit(0)).alias("class"), F.when(F.col("scl") > 2, F.col("qty")).alias("v"), ((1 + F.col("row") % 3) * 100).alias("a"))
    g = C.area_by_class(c, ["class"], "v", "a")
    return g.select("class", "n", "area", r6(F.col("share")).alias("share"), r6(F.col("weighted_mean")).alias("weighted_mean"))


_EDGES = {"hour": ("hr", (3, 6, 12, 18)), "day": ("dom", (7, 14, 21)), "station": ("station", (5, 12, 20))}


@query("agg_root_cause", "AGG-58 AGG-42", f"""WITH {S.LEVELS}, ax AS ({" UNION ALL ".join(f"SELECT cm - 40 AS r, '{n}' AS axis, ({'dayofmonth(day)' if c == 'dom' else c})::DOUBLE AS v, CAST({' + '.join(f"CASE WHEN {'dayofmonth(day)' if c == 'dom' else c} > {e} THEN 1 ELSE 0 END" for e in edges)} AS INTEGER) AS bin FROM lv" for n, (c, edges) in _EDGES.items())}),
 rk AS (SELECT axis, rank() OVER (PARTITION BY axis ORDER BY r) + (count(*) OVER (PARTITION BY axis, r) - 1) / 2.0 AS a, rank() OVER (PARTITION BY axis ORDER BY v) + (count(*) OVER (PARTITION BY axis, v) - 1) / 2.0 AS b FROM ax), rh AS (SELECT axis, corr(a, b) AS rho FROM rk GROUP BY 1), md AS (SELECT axis, bin, median(r) AS m FROM ax GROUP BY 1, 2)
 SELECT axis, bin, count(*) AS n, round(max(m), 6) AS median, round(1.4826::DOUBLE * median(abs(r - m)), 6) AS nmad, round(max(rho), 6) AS rho FROM ax JOIN md USING (axis, bin) JOIN rh USING (axis) GROUP BY 1, 2""")
def _(t: Tables):
    d = S.levels(t).select((F.col("cm") - 40).alias("r"), "hr", F.dayofmonth("day").alias("dom"), "station")
    g = ST.decompose(d, "r", _EDGES)
    return g.select("axis", "bin", "n", *[r6(F.col(c)).alias(c) for c in ("median", "nmad", "rho")])


_SPANS = (20, 150, 230)


@query("q_slope_spans", "Q-07 AGG-19 AGG-29 AGG-32", f"""WITH {S.LEVELS}, {S.POINTS}, {_TS}, o AS (SELECT day, max(post) AS post, count(*) AS k, max(chain) - min(chain) AS span FROM pt GROUP BY 1), q AS (SELECT epoch(CAST(o.day AS TIMESTAMP))::BIGINT // 86400 AS uid, post, span, round(slope * 1e8)::DOUBLE AS v FROM o JOIN ts USING (day) WHERE span >= 20 AND k >= 3),
 x AS (SELECT min_span, uid, post, v FROM q, (SELECT unnest([{', '.join(map(str, _SPANS))}]) AS min_span) WHERE span >= min_span), na AS (SELECT min_span, count(*) FILTER (post = 0) AS na, count(*) FILTER (post = 1) AS nb, median(CASE WHEN post = 0 THEN v END) AS ma, median(CASE WHEN post = 1 THEN v END) AS mb FROM x GROUP BY 1),
 pr AS (SELECT min_span, rep, v, row_number() OVER (PARTITION BY min_span, rep ORDER BY {mix_sql(43, 'rep', 'uid')}, uid) AS pos FROM x, (SELECT unnest(range(1, {REPS + 1})) AS rep)), pd AS (SELECT min_span, rep, median(CASE WHEN pos > na THEN v END) - median(CASE WHEN pos <= na THEN v END) AS d FROM pr JOIN na USING (min_span) GROUP BY 1, 2),
 pp AS (SELECT min_span, (count(*) FILTER (abs(d) >= abs(mb - ma)) + 1) / {REPS + 1}.0 AS p FROM pd JOIN na USING (min_span) GROUP BY 1), su AS (SELECT min_span, post, count(*) FILTER (v > 0) AS up FROM x GROUP BY 1, 2)
 SELECT CAST(min_span AS BIGINT) AS min_span, na AS n_before, nb AS n_after, round(ma / 1e6, 4) AS before_cm_km, round(mb / 1e6, 4) AS after_cm_km, round((mb - ma) / 1e6, 4) AS diff_cm_km, round(p, 6)::DOUBLE AS p, (SELECT up FROM su WHERE su.min_span = na.min_span AND post = 0) AS up_before, (SELECT up FROM su WHERE su.min_span = na.min_span AND post = 1) AS up_after FROM na JOIN pp USING (min_span) WHERE na > 0 AND nb > 0""")
def _(t: Tables):
    """Slopes before against after the cut, tested by permutation, for overpasses of at least several spans."""
    s = slopes(t).select(F.unix_date("day").cast("long").alias("uid"), "post", "span", F.round(F.col("slope") * 1e8).cast("double").alias("v"))
    x = cut_lineage(s.withColumn("min_span", F.explode(F.array(*[F.lit(k).cast("long") for k in _SPANS]))).where("span >= min_span"))
    g = B.summarise(x, ["min_span", "post"], {"n": F.count(F.lit(1)), "up": F.count_if(F.col("v") > 0)}, {"m": ("v", 0.5)})
    side = lambda k, c: F.max(F.when(F.col("post") == k, F.col(c)))
    w = g.groupBy("min_span").agg(side(0, "n").alias("n_before"), side(1, "n").alias("n_after"), side(0, "m").alias("ma"), side(1, "m").alias("mb"), side(0, "up").alias("up_before"), side(1, "up").alias("up_after"))
    p = RS.permutation(x, "v", "post", "uid", REPS, 43, ["min_span"])
    j = w.where("n_before is not null and n_after is not null").join(p, "min_span")
    cm = lambda c: F.round(c / 1e6, 4)
    return j.select("min_span", "n_before", "n_after", cm(F.col("ma")).alias("before_cm_km"), cm(F.col("mb")).alias("after_cm_km"), cm(F.col("mb") - F.col("ma")).alias("diff_cm_km"), r6(F.col("p")).alias("p"), "up_before", "up_after")
