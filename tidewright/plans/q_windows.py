"""Ordered passes, picks and set comparisons."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.rng import mix_sql
from ..operators import blocks as B
from ..operators import select as L
from ..operators import temporal as T
from ..operators.holdout import greedy_tracks
from ..session import broadcast_if_small
from . import standins as S
from .registry import Tables, query
from .standins import r6

D = lambda c="day": F.date_format(c, "yyyy-MM-dd")


@query("win_consecutive_change", "WIN-01", f"""WITH {S.LEVELS}, {S.OBSERVER_DAILY}, l AS (SELECT station, day, cm, lag(cm) OVER w AS p, lag(day) OVER w AS pd FROM dl WINDOW w AS (PARTITION BY station ORDER BY day)) SELECT station, strftime(day, '%Y-%m-%d') AS d, round(cm - p, 6) AS step FROM l WHERE day - pd = 1""")
def _(t: Tables):
    d = S.daily(t, "user_id")
    l = B.neighbour(d, ["station"], ["day"], {"p": "cm", "pd": "day"})
    return l.where(F.datediff("day", "pd") == 1).select("station", D().alias("d"), r6(F.col("cm") - F.col("p")).alias("step"))


@query("win_anomaly", "WIN-02", f"""WITH {S.LEVELS}, g AS (SELECT station, avg(cm) AS a, median(cm) AS mm FROM lv GROUP BY 1) SELECT event_id, round(cm - a, 6) AS from_mean, round(cm - mm, 6) AS from_median FROM lv JOIN g USING (station)""")
def _(t: Tables):
    d = S.levels(t)
    g = B.summarise(d, ["station"], {"avg_cm": F.avg("cm")}, {"med_cm": ("cm", 0.5)})
    return d.join(broadcast_if_small(g), "station").select("event_id", r6(F.col("cm") - F.col("avg_cm")).alias("from_mean"), r6(F.col("cm") - F.col("med_cm")).alias("from_median"))


_RUNS = """rn AS (SELECT *, floor(cm / 50) AS v, CASE WHEN floor(cm / 50) IS NOT DISTINCT FROM lag(floor(cm / 50)) OVER (PARTITION BY user_id ORDER BY us, event_id) AND lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) IS NOT NULL THEN 0 ELSE 1 END AS st FROM lv),
 rr AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM rn)"""


@query("win_fill_runs", "WIN-03", f"WITH {S.LEVELS}, {_RUNS} SELECT event_id, run, CASE WHEN count(*) OVER (PARTITION BY user_id, run) >= 5 THEN 1 ELSE 0 END AS fill_suspect FROM rr")
def _(t: Tables):
    d = S.levels(t).withColumn("v", F.floor(F.col("cm") / 50).cast("double"))
    return T.flag_runs(d, ["user_id"], ["us", "event_id"], "v", 5, "fill").select("event_id", "run", F.col("fill").cast("int").alias("fill_suspect"))


@query("win_top_and_extremes", "WIN-04 WIN-05", f"""WITH {S.LEVELS}, r AS (SELECT station, event_id, cm, row_number() OVER (PARTITION BY station ORDER BY cm DESC, event_id) AS rk FROM lv), b AS (SELECT station, arg_min(event_id, (cm, event_id)) AS low_id, arg_max(event_id, (cm, event_id)) AS high_id FROM lv GROUP BY 1) SELECT station, event_id, cm, CAST(rk AS INTEGER) AS rk, low_id, high_id FROM r JOIN b USING (station) WHERE rk <= 3""")
def _(t: Tables):
    d = S.levels(t)
    top = L.first_n(d.select("station", "event_id", "cm"), ["station"], [F.col("cm").desc(), F.col("event_id")], 3, "rk")
    b = d.groupBy("station").agg(F.min_by("event_id", F.struct("cm", "event_id")).alias("low_id"), F.max_by("event_id", F.struct("cm", "event_id")).alias("high_id"))
    return top.join(broadcast_if_small(b), "station")


@query("win_percentile_rank", "WIN-06", f"""WITH {S.LEVELS} SELECT event_id, round((rank() OVER (PARTITION BY station ORDER BY cm) + (count(*) OVER (PARTITION BY station, cm) - 1) / 2.0) / count(*) OVER (PARTITION BY station), 6) AS pct FROM lv""")
def _(t: Tables):
    d = B.tied_rank(S.levels(t).select("event_id", "station", "cm"), ["station"], "cm", "r", "n")
    return d.select("event_id", r6(F.col("r") / F.col("n")).alias("pct"))


@query("win_rolling_median", "WIN-07", f"""WITH {S.LEVELS} SELECT event_id, round(median(cm) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS med7 FROM lv""")
def _(t: Tables):
    # a fixed frame: three neighbours each way, chained so the pass stays block-safe
    d = S.levels(t).select("event_id", "user_id", "us", F.col("cm").alias("x0"))
    for side, step in (("p", -1), ("n", 1)):
        src = "x0"
        for i in (1, 2, 3):
            d = B.neighbour(d, ["user_id"], ["us", "event_id"], {f"{side}{i}": src}, step)
            src = f"{side}{i}"
    a = F.array_sort(F.array_compact(F.array("p3", "p2", "p1", "x0", "n1", "n2", "n3")))
    n = F.size("a")
    mid = (F.element_at("a", F.floor((n + 1) / 2).cast("int")) + F.element_at("a", F.floor((n + 2) / 2).cast("int"))) / 2
    return d.withColumn("a", a).select("event_id", r6(mid).alias("med7"))


@query("win_drawdown", "WIN-08", f"""WITH {S.LEVELS}, {S.OBSERVER_DAILY}, d AS (SELECT * FROM dl), s AS (SELECT station, day, cm, cm - lag(cm) OVER w AS st, coalesce(day - lag(day) OVER w, 1) AS gap FROM d WINDOW w AS (PARTITION BY station ORDER BY day)),
 b AS (SELECT *, sum(CASE WHEN gap > 3 AND day > DATE '2024-01-03' THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING) AS br FROM s) SELECT station, strftime(day, '%Y-%m-%d') AS d, round(sum(CASE WHEN br = 0 AND day > DATE '2024-01-03' AND st < -0.2 THEN -st ELSE 0 END) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING), 5) AS lost FROM b""")
def _(t: Tables):
    d = S.daily(t, "user_id")
    r = T.regimes(d, ["station"], "day", "cm", "2024-01-03")
    return r.select("station", D().alias("d"), F.round("lost", 5).alias("lost"))


def regime_sql(source: str, onset: str) -> str:
    """CTEs that end in rg(station, day, cm, gap, regime) from a series (station, day, cm)."""
    return f"""s AS (SELECT station, day, cm, cm - lag(cm) OVER w AS st, coalesce(day - lag(day) OVER w, 1) AS gap, lead(cm, 1) OVER w AS n1, lead(cm, 2) OVER w AS n2, lead(cm, 3) OVER w AS n3 FROM {source} WINDOW w AS (PARTITION BY station ORDER BY day)),
 b AS (SELECT *, lead(gap, 1) OVER w AS g1, lead(gap, 2) OVER w AS g2, lead(gap, 3) OVER w AS g3, sum(CASE WHEN gap > 3 AND day > DATE '{onset}' THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING) AS br FROM s WINDOW w AS (PARTITION BY station ORDER BY day)),
 f AS (SELECT *, (br = 0 AND day > DATE '{onset}' AND coalesce(st < -0.2, FALSE)) AS fall FROM b), l AS (SELECT *, sum(CASE WHEN fall THEN -st ELSE 0 END) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING) AS lost, CASE WHEN coalesce(st = 0, FALSE) THEN 1 ELSE 0 END AS flat FROM f),
 r AS (SELECT *, CASE WHEN day < DATE '{onset}' THEN 'PREBREACH_IMPOUNDED' WHEN day = DATE '{onset}' THEN 'BREACH_ONSET' WHEN gap > 3 THEN 'REGIME_UNRESOLVED' WHEN fall THEN 'ACTIVE_DRAWDOWN' WHEN br = 0 AND lost >= 0.5 THEN CASE WHEN n2 IS NOT NULL AND abs(n1 - cm) < 0.2 AND g1 <= 3 AND abs(n2 - cm) < 0.2 AND g2 <= 3 AND (n3 IS NULL OR (abs(n3 - cm) < 0.2 AND g3 <= 3)) THEN 'POSTBREACH_TRANSITION' ELSE 'REGIME_UNRESOLVED' END
 WHEN lost >= 0.5 THEN 'POSTBREACH_TRANSITION' ELSE 'REGIME_UNRESOLVED' END AS reg, CASE WHEN flat IS DISTINCT FROM lag(flat) OVER (PARTITION BY station ORDER BY day) THEN 1 ELSE 0 END AS chg FROM l),
 z AS (SELECT *, sum(chg) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM r),
 rg AS (SELECT station, day, cm, gap, CASE WHEN flat = 1 AND count(*) OVER (PARTITION BY station, run) >= 4 THEN 'REGIME_UNRESOLVED' ELSE reg END AS regime FROM z)"""


@query("win_regimes", "WIN-09", f"""WITH {S.LEVELS}, {S.OBSERVER_DAILY}, d AS (SELECT station, day, round(cm / 10, 1) AS cm FROM dl), {regime_sql('d', '2024-01-08')} SELECT station, strftime(day, '%Y-%m-%d') AS d, regime FROM rg""")
def _(t: Tables):
    d = S.daily(t, "user_id").select("station", "day", F.round(F.col("cm") / 10, 1).alias("cm"))
    return T.regimes(d, ["station"], "day", "cm", "2024-01-08").select("station", D().alias("d"), "regime")


@query("win_rate_flags", "WIN-10", f"""WITH {S.LEVELS}, {S.DAILY}, s AS (SELECT station, day, round(cm - lag(cm) OVER w, 1) AS st, round(lead(cm) OVER w - lag(cm) OVER w, 1) / 2 AS rate, lead(day) OVER w - lag(day) OVER w AS span FROM dl WINDOW w AS (PARTITION BY station ORDER BY day)), q AS (SELECT quantile_cont(abs(st), 0.5) AS q50, quantile_cont(abs(st), 0.85) AS q85 FROM s)
 SELECT station, strftime(day, '%Y-%m-%d') AS d, CASE WHEN rate IS NULL OR span <> 2 THEN 'UNKNOWN' WHEN abs(rate) <= q50 THEN 'STABLE' WHEN abs(rate) <= q85 THEN 'SLOW_CHANGE' WHEN abs(rate) > q85 * 2 THEN 'RAPID_CHANGE' WHEN rate > 0 THEN 'RISING' ELSE 'FALLING' END AS flag FROM s, q""")
def _(t: Tables):
    return rate_flags(t).select("station", D().alias("d"), "flag")


def rate_flags(t: Tables):
    d = B.neighbour(S.daily(t), ["station"], ["day"], {"p": "cm", "pd": "day"})
    d = B.neighbour(d, ["station"], ["day"], {"n": "cm", "nd": "day"}, step=1)
    d = d.withColumn("step", F.abs(F.round(F.col("cm") - F.col("p"), 1)))
    d = d.withColumn("rate", F.when(F.datediff("nd", "pd") == 2, F.round(F.col("n") - F.col("p"), 1) / 2))
    q = B.quantiles(d, [], "step", {"q50": 0.5, "q85": 0.85}).withColumn("one", F.lit(1))
    d = d.withColumn("one", F.lit(1)).join(F.broadcast(q), "one")
    a = F.abs("rate")
    flag = (F.when(a.isNull(), "UNKNOWN").when(a <= F.col("q50"), "STABLE").when(a <= F.col("q85"), "SLOW_CHANGE")
            .when(a > F.col("q85") * 2, "RAPID_CHANGE").when(F.col("rate") > 0, "RISING").otherwise("FALLING"))
    return d.withColumn("flag", flag)


@query("win_year_change", "WIN-11", f"""WITH {S.ASSETS}, y AS (SELECT orbit, CAST(year(day) AS INTEGER) AS yr, CAST(sum(cents) AS BIGINT) AS s FROM ast GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER w AS p, lag(yr) OVER w AS py FROM y WINDOW w AS (PARTITION BY orbit ORDER BY yr)) SELECT orbit, yr, coalesce(round(100.0 * (s - p) / p, 6), 0.0) AS pct, CASE WHEN py IS NULL OR yr - py > 1 THEN 1 ELSE 0 END AS boundary FROM l""")
def _(t: Tables):
    y = S.assets(t).groupBy("orbit", F.year("day").alias("yr")).agg(F.sum("cents").alias("s"))
    y = B.neighbour(y, ["orbit"], ["yr"], {"p": "s", "py": "yr"})
    return y.select("orbit", "yr", F.coalesce(r6(100.0 * (F.col("s") - F.col("p")) / F.col("p")), F.lit(0.0)).alias("pct"), (F.col("py").isNull() | (F.col("yr") - F.col("py") > 1)).cast("int").alias("boundary"))


@query("win_separated_count", "WIN-12", f"""WITH RECURSIVE {S.LEVELS}, {S.POINTS}, dc AS (SELECT DISTINCT day, chain FROM pt), g AS (SELECT day, min(chain) AS k, 1 AS n FROM dc GROUP BY 1 UNION ALL SELECT g.day, (SELECT min(chain) FROM dc WHERE dc.day = g.day AND dc.chain > g.k + 5), n + 1 FROM g WHERE EXISTS (SELECT 1 FROM dc WHERE dc.day = g.day AND dc.chain > g.k + 5)) SELECT strftime(day, '%Y-%m-%d') AS d, max(n) AS n_sep FROM g GROUP BY 1""")
def _(t: Tables):
    return separated(S.points(t), ["day"]).select(D().alias("d"), "n_sep")


def separated(points, keys):
    """Greedy count of chainages more than 5 km apart.  Chainage is on a 0.1 km grid of fixed length, so the distinct list
    that a group carries is bounded by the axis and not by its rows."""
    a = points.groupBy(*keys).agg(F.array_sort(F.collect_set("chain")).alias("c"))
    start = F.struct(F.lit(-1e9).alias("k"), F.lit(0).alias("n"))
    step = lambda acc, x: F.when(x > acc["k"] + 5, F.struct(x.alias("k"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return a.select(*keys, F.aggregate("c", start, step)["n"].alias("n_sep"))


_BIN = "bn AS (SELECT user_id, CAST(floor((event_id * 7 % 2400) / 10 / 5) * 5 AS BIGINT) AS s, avg(cm / 100) AS h FROM lv GROUP BY 1, 2)"


def _grad(source: str, value: str, out: str) -> str:
    return f"""(SELECT *, CASE WHEN ps IS NULL AND ns IS NULL THEN NULL WHEN ps IS NULL THEN (nv - {value}) / (ns - s) WHEN ns IS NULL THEN ({value} - pv) / (s - ps)
 ELSE ((s - ps) * (s - ps) * nv + ((ns - s) * (ns - s) - (s - ps) * (s - ps)) * {value} - (ns - s) * (ns - s) * pv) / ((s - ps) * (ns - s) * (ns - ps)) END AS {out} FROM (SELECT * EXCLUDE (ps, pv, ns, nv), lag(s) OVER w AS ps, lag({value}) OVER w AS pv, lead(s) OVER w AS ns, lead({value}) OVER w AS nv FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY s)))"""


@query("win_profile_gradient", "WIN-13 FN-12", f"""WITH {S.LEVELS}, {_BIN}, b0 AS (SELECT *, 0 AS ps, 0 AS pv, 0 AS ns, 0 AS nv FROM bn), g1 AS {_grad('b0', 'h', 'slope')}, g2 AS {_grad('g1', 'slope', 'bend')} SELECT user_id, s, round(slope, 9) AS slope, round(bend, 9) AS bend FROM g2 WHERE slope IS NOT NULL""")
def _(t: Tables):
    """First and second derivative along the unevenly filled bins of every observer's profile."""
    b = S.levels(t).groupBy("user_id", (F.floor((F.col("event_id") * 7 % 2400) / 10 / 5) * 5).alias("s")).agg(F.avg(F.col("cm") / 100).alias("h"))
    g = gradient(gradient(b, ["user_id"], "s", "h", "slope"), ["user_id"], "s", "slope", "bend")
    return g.where("slope is not null").select("user_id", "s", F.round("slope", 9).alias("slope"), F.round("bend", 9).alias("bend"))


def gradient(df, keys, at: str, value: str, out: str):
    """Derivative on an uneven grid: second-order in the middle, one-sided at the ends; NULL for a lone point."""
    b = B.neighbour(B.neighbour(df, keys, [at], {"__ps": at, "__pv": value}), keys, [at], {"__ns": at, "__nv": value}, step=1)
    a, c = F.col(at) - F.col("__ps"), F.col("__ns") - F.col(at)
    mid = (a * a * F.col("__nv") + (c * c - a * a) * F.col(value) - c * c * F.col("__pv")) / (a * c * (a + c))
    g = F.when(F.col("__ps").isNull(), (F.col("__nv") - F.col(value)) / c).when(F.col("__ns").isNull(), (F.col(value) - F.col("__pv")) / a).otherwise(mid)
    return b.withColumn(out, g).drop("__ps", "__pv", "__ns", "__nv")


@query("win_split_tracks", "WIN-14", f"""WITH {S.LEVELS}, q AS (SELECT station, us, event_id, us / 6e7 AS x FROM lv), s AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY station ORDER BY us, event_id), 0) AS st FROM q), p AS (SELECT *, CAST(sum(CASE WHEN st > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece FROM s)
 SELECT station, piece, count(*) AS n, round(sum(CASE WHEN st > 180 THEN 0 ELSE st END), 5) AS length FROM p GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t: Tables):
    q = S.levels(t).select("station", "us", "event_id", (F.col("us") / 6e7).alias("x"))
    p = T.split_at_gaps(q, ["station"], ["us", "event_id"], "x", 180.0)
    return p.groupBy("station", "piece").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("step"), 5).alias("length")).where("n >= 2")


@query("win_reach_with_gaps", "WIN-15", f"""WITH {S.LEVELS}, {S.POINTS}, b AS (SELECT day, k, max(CASE WHEN h > 0.9 AND CAST(floor(chain / 10) AS BIGINT) = k THEN 1 ELSE 0 END) AS c FROM pt, (SELECT unnest(range(24)) AS k) GROUP BY 1, 2), g AS (SELECT *, sum(c) OVER (PARTITION BY day ORDER BY k ROWS UNBOUNDED PRECEDING) AS grp FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY day, grp ORDER BY k) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS gap FROM g), s AS (SELECT *, max(CASE WHEN gap * 10 > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop, CASE WHEN gap * 10 > 20 THEN 1 ELSE 0 END AS hit FROM r),
 u AS (SELECT *, sum(hit) OVER (PARTITION BY day ORDER BY k ROWS UNBOUNDED PRECEDING) AS hits FROM s) SELECT strftime(day, '%Y-%m-%d') AS d, CAST(coalesce(max(CASE WHEN c = 1 AND stop = 0 THEN (k + 1) * 10 END), 0) AS BIGINT) AS reach_km, CAST(coalesce(max(CASE WHEN stop = 0 OR hits = 1 AND hit = 1 THEN gap * 10 END), 0) AS BIGINT) AS max_gap FROM u GROUP BY 1""")
def _(t: Tables):
    p = S.points(t).withColumn("k", F.floor(F.col("chain") / 10))
    hit = p.where("h > 0.9").select("day", "k").distinct().withColumn("c", F.lit(1))
    full = p.select("day").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    b = full.join(hit, ["day", "k"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return reach(b, ["day"], 10, 20).select(D().alias("d"), "reach_km", "max_gap")


def reach(bins, keys, width: int, tolerance: int):
    """Contiguous reach from bin 0 over (k, c) tolerating gaps; windows run over the fixed bins of the axis."""
    w = W.partitionBy(*keys).orderBy("k")
    b = bins.withColumn("grp", F.sum("c").over(w)).withColumn("gap", F.row_number().over(W.partitionBy(*keys, "grp").orderBy("k")) - (F.col("grp") > 0).cast("int"))
    b = b.withColumn("hit", (F.col("gap") * width > tolerance).cast("int")).withColumn("hits", F.sum("hit").over(w))
    live = F.col("hits") == 0
    return b.groupBy(*keys).agg(F.coalesce(F.max(F.when((F.col("c") == 1) & live, (F.col("k") + 1) * width)), F.lit(0)).cast("long").alias("reach_km"),
                                F.coalesce(F.max(F.when(live | ((F.col("hits") == 1) & (F.col("hit") == 1)), F.col("gap") * width)), F.lit(0)).cast("long").alias("max_gap"))


@query("win_temporal_residual", "WIN-16", f"""WITH {S.LEVELS}, {S.DAILY}, n AS (SELECT a.station, a.day, a.cm, b.cm AS nb, row_number() OVER (PARTITION BY a.station, a.day ORDER BY abs(a.day - b.day), b.day) AS rk FROM dl a JOIN dl b ON a.station = b.station AND a.day <> b.day) SELECT station, strftime(day, '%Y-%m-%d') AS d, round(abs(max(cm) - median(nb)), 6) AS resid FROM n WHERE rk <= 4 GROUP BY 1, day HAVING count(*) >= 2""")
def _(t: Tables):
    # the k nearest in time lie among k rows before and k rows after, so neighbours come from ordered passes
    d = S.daily(t)
    for side, step in (("p", -1), ("n", 1)):
        src = {f"{side}1c": "cm", f"{side}1d": "day"}
        for i in range(1, 5):
            if i > 1:
                src = {f"{side}{i}c": f"{side}{i-1}c", f"{side}{i}d": f"{side}{i-1}d"}
            d = B.neighbour(d, ["station"], ["day"], src, step)
    cand = F.array(*[F.when(F.col(f"{s}{i}d").isNotNull(), F.struct(F.abs(F.datediff(f"{s}{i}d", "day")).alias("a"), F.col(f"{s}{i}d").alias("dd"), F.col(f"{s}{i}c").alias("c"))) for s in "pn" for i in range(1, 5)])
    near = F.slice(F.array_sort(F.array_compact(cand)), 1, 4)
    d = d.withColumn("v", F.array_sort(F.transform(near, lambda x: x["c"]))).where(F.size("v") >= 2)
    n = F.size("v")
    med = (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor((n + 2) / 2).cast("int"))) / 2
    return d.select("station", D().alias("d"), r6(F.abs(F.col("cm") - med)).alias("resid"))


@query("win_lag_correlation", "WIN-17 SET-04", f"""WITH {S.LEVELS}, {S.DAILY}, sp AS (SELECT station, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dl GROUP BY station), f AS (SELECT sp.station, sp.day, cm - lag(cm) OVER w AS dh, n - lag(n) OVER w AS dg FROM sp LEFT JOIN dl USING (station, day) WINDOW w AS (PARTITION BY sp.station ORDER BY sp.day))
 SELECT a.station, l, count(*) AS n, round(corr(a.dh, b.dg), 6) AS r FROM f a, (VALUES (-1), (0), (1)) AS g(l) JOIN f b ON b.station = a.station AND b.day = a.day - l WHERE a.dh IS NOT NULL AND b.dg IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables):
    d = S.daily(t)
    f = T.daily_spine(d, ["station"], "day").join(d, ["station", "day"], "left")
    f = B.neighbour(f, ["station"], ["day"], {"p": "cm", "q": "n"}).select("station", "day", (F.col("cm") - F.col("p")).alias("dh"), (F.col("n") - F.col("q")).alias("dg"))
    a = f.select("station", "day", "dh", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("l")).withColumn("src", F.expr("date_sub(day, l)"))
    j = a.join(f.select("station", F.col("day").alias("src"), "dg"), ["station", "src"]).where("dh is not null and dg is not null")
    return j.groupBy("station", "l").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("dh", "dg")).alias("r"))


@query("win_first_exposure", "WIN-18 RAS-20", f"""WITH {S.CELLS}, g AS (SELECT row, col, min(CASE WHEN cls IN (1, 2) THEN day END) AS fw, max(CASE WHEN cls IN (1, 2) THEN day END) AS lw, min(CASE WHEN cls > 2 THEN day END) AS fd, arg_min(cls, (day, cls)) FILTER (cls > 2) AS dc, count(cls) AS n FROM cl GROUP BY 1, 2)
 SELECT row, col, coalesce(strftime(fw, '%Y-%m-%d'), '') AS first_wet, coalesce(strftime(lw, '%Y-%m-%d'), '') AS last_wet, coalesce(strftime(fd, '%Y-%m-%d'), '') AS first_dry, coalesce(dc, 0) AS dry_class, CASE WHEN n = 0 THEN 0 WHEN fd IS NULL THEN 4 WHEN fd <= DATE '1995-06-30' THEN 1 WHEN fd <= DATE '1998-08-06' THEN 2 ELSE 3 END AS zoning FROM g""")
def _(t: Tables):
    from ..operators.cells import first_last
    g = first_last(S.cells(t), "day", "cls", (1, 2))
    s = lambda c: F.coalesce(D(c), F.lit(""))
    z = F.when(F.col("n_seen") == 0, 0).when(F.col("first_dry").isNull(), 4).when(F.col("first_dry") <= F.to_date(F.lit("1995-06-30")), 1).when(F.col("first_dry") <= F.to_date(F.lit("1998-08-06")), 2).otherwise(3)
    return g.select("row", "col", s("first_wet").alias("first_wet"), s("last_wet").alias("last_wet"), s("first_dry").alias("first_dry"), F.coalesce("dry_class", F.lit(0)).alias("dry_class"), z.alias("zoning"))


@query("win_error_concentration", "WIN-19", f"""WITH {S.LEVELS}, e AS (SELECT event_id, station, CAST(round(cm) AS BIGINT) * CAST(round(cm) AS BIGINT) AS se FROM lv) SELECT event_id, row_number() OVER (PARTITION BY station ORDER BY se DESC, event_id) AS rk, round((sum(se) OVER (PARTITION BY station ORDER BY se DESC, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(se) OVER (PARTITION BY station))::DOUBLE, 6) AS share FROM e""")
def _(t: Tables):
    c = F.round("cm").cast("long")
    e = S.levels(t).select("event_id", "station", (c * c).alias("se"), (-c * c).alias("neg"))
    e = B.row_position(B.running_sum(e, ["station"], ["neg", "event_id"], F.col("se"), "cum"), ["station"], ["neg", "event_id"], "rk")
    tot = e.groupBy("station").agg(F.sum("se").alias("tot"))
    return e.join(broadcast_if_small(tot), "station").select("event_id", "rk", r6(F.col("cum") / F.col("tot")).alias("share"))


@query("win_hydrological_context", "WIN-20", f"""WITH {S.LEVELS}, {S.DAILY}, s AS (SELECT a.station, a.day, a.cm, """ + ", ".join(f"CASE WHEN count(CASE WHEN abs(b.day - a.day) <= {k} THEN 1 END) >= 3 THEN regr_slope(CASE WHEN abs(b.day - a.day) <= {k} THEN b.cm END, b.day - a.day) END AS s{2*k+1}" for k in (1, 2, 3)) + """, max(CASE WHEN b.day = a.day - 1 THEN b.cm END) AS p, max(CASE WHEN b.day = a.day + 1 THEN b.cm END) AS n FROM dl a JOIN dl b ON a.station = b.station AND abs(b.day - a.day) <= 3 GROUP BY 1, 2, 3)
 SELECT station, strftime(day, '%Y-%m-%d') AS d, coalesce(round(s3, 5), -999.0) AS s3, coalesce(round(s5, 5), -999.0) AS s5, coalesce(round(s7, 5), -999.0) AS s7, CASE WHEN round(n - p, 1) IS NULL THEN 'UNCERTAIN' WHEN abs(round(n - p, 1)) / 2 < 2 THEN 'STABLE' WHEN n > p THEN 'RISING' ELSE 'FALLING' END AS state, coalesce(round((n - p) / 2 * 0.25, 5), -999.0) AS expected FROM s""")
def _(t: Tables):
    # slopes over +-1..3 days from seven day-offset copies of the daily series: a fixed fan-out and one aggregate
    d = S.daily(t)
    o = d.select("station", "cm", F.col("day").alias("src"), F.explode(F.array(*[F.lit(k) for k in range(-3, 4)])).alias("k")).withColumn("day", F.expr("date_sub(src, k)"))
    inside = lambda k: F.abs("k") <= k
    g = o.groupBy("station", "day").agg(
        *[F.when(F.count_if(inside(k)) >= 3, F.regr_slope(F.when(inside(k), F.col("cm")), F.col("k"))).alias(f"s{2*k+1}") for k in (1, 2, 3)],
        F.max(F.when(F.col("k") == -1, F.col("cm"))).alias("p"), F.max(F.when(F.col("k") == 1, F.col("cm"))).alias("n"))
    j = d.select("station", "day").join(g, ["station", "day"])
    c = F.round(F.col("n") - F.col("p"), 1)
    st = F.when(c.isNull(), "UNCERTAIN").when(F.abs(c) / 2 < 2, "STABLE").when(c > 0, "RISING").otherwise("FALLING")
    nz = lambda x: F.coalesce(F.round(x, 5), F.lit(-999.0))
    return j.select("station", D().alias("d"), *[nz(F.col(f"s{k}")).alias(f"s{k}") for k in (3, 5, 7)], st.alias("state"), nz((F.col("n") - F.col("p")) / 2 * 0.25).alias("expected"))


# ------------------------------------------------------------------ picks
@query("top_smallest_and_scored", "TOP-01 TOP-02", """SELECT o_orderkey, 2 * (o_custkey % 100) + (o_orderkey % 10) * 5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS score FROM orders ORDER BY score DESC, o_orderkey LIMIT 25""")
def _(t: Tables):
    s = 2 * (F.col("o_custkey") % 100) + (F.col("o_orderkey") % 10) * 5 - F.substring("o_orderpriority", 1, 1).cast("int")
    return t.orders.select("o_orderkey", s.alias("score")).orderBy(F.col("score").desc(), "o_orderkey").limit(25)


@query("top_nearest_in_time_first", "TOP-03", f"""WITH {S.ASSETS}, r AS (SELECT orbit, o_orderkey, row_number() OVER (PARTITION BY orbit, prio ORDER BY abs(day - DATE '1997-06-01'), cents DESC, o_orderkey) AS rk, prio FROM ast) SELECT orbit, prio, o_orderkey FROM r WHERE rk = 1""")
def _(t: Tables):
    a = S.assets(t).withColumn("lag", F.abs(F.datediff("day", F.to_date(F.lit("1997-06-01"))))).withColumn("worse", -F.col("cents"))
    return L.best(a, ["orbit", "prio"], [F.col("lag"), F.col("worse"), F.col("o_orderkey")], ["o_orderkey"])


@query("top_per_year_and_season", "TOP-04", f"""WITH {S.ASSETS}, y AS (SELECT *, CAST(year(day) AS INTEGER) AS yr, CAST(month(day) AS INTEGER) AS mo FROM ast), f AS (SELECT yr, arg_min(o_orderkey, (cents, o_orderkey)) AS k, arg_min(mo, (cents, o_orderkey)) AS m0 FROM y GROUP BY 1), s AS (SELECT y.yr, arg_max(o_orderkey, (abs(mo - m0), -cents, -o_orderkey)) AS k, max(abs(mo - m0)) AS far FROM y JOIN f ON y.yr = f.yr WHERE o_orderkey <> f.k GROUP BY 1)
 SELECT yr, k AS o_orderkey FROM f UNION SELECT yr, k FROM s WHERE far >= 2""")
def _(t: Tables):
    y = S.assets(t).withColumn("yr", F.year("day")).withColumn("mo", F.month("day"))
    f = L.best(y, ["yr"], [F.col("cents"), F.col("o_orderkey")], ["o_orderkey", "mo"])
    other = y.join(broadcast_if_small(f.select("yr", F.col("o_orderkey").alias("k"), F.col("mo").alias("m0"))), "yr").where("o_orderkey <> k").withColumn("far", F.abs(F.col("mo") - F.col("m0")))
    s = L.best(other, ["yr"], [-F.col("far"), F.col("cents"), F.col("o_orderkey")], ["o_orderkey", "far"]).where("far >= 2")
    return f.select("yr", "o_orderkey").union(s.select("yr", "o_orderkey")).distinct()


@query("top_level_classes", "TOP-05", f"""WITH {S.ASSETS}, e AS (SELECT quantile_cont(cents, 0.2) AS q1, quantile_cont(cents, 0.4) AS q2, quantile_cont(cents, 0.6) AS q3, quantile_cont(cents, 0.8) AS q4 FROM ast), c AS (SELECT ast.*, CASE WHEN cents <= q1 THEN 'LOW' WHEN cents <= q2 THEN 'LOW-MEDIUM' WHEN cents <= q3 THEN 'MEDIUM' WHEN cents <= q4 THEN 'HIGH-MEDIUM' ELSE 'HIGH' END AS cls FROM ast, e),
 r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY CASE prio WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, orbit, o_orderkey) AS rk FROM c) SELECT o_orderkey, cls FROM r WHERE rk <= 4 UNION SELECT arg_min(o_orderkey, (cents, o_orderkey)), 'LOW' FROM ast UNION SELECT arg_max(o_orderkey, (cents, o_orderkey)), 'HIGH' FROM ast""")
def _(t: Tables):
    a = S.assets(t)
    q = B.quantiles(a, [], "cents", {f"q{i}": i / 5 for i in range(1, 5)}).withColumn("one", F.lit(1))
    c = a.withColumn("one", F.lit(1)).join(F.broadcast(q), "one")
    names = ["LOW", "LOW-MEDIUM", "MEDIUM", "HIGH-MEDIUM"]
    lab = None
    for i, n in enumerate(names, 1):
        lab = F.when(F.col("cents") <= F.col(f"q{i}"), n) if lab is None else lab.when(F.col("cents") <= F.col(f"q{i}"), n)
    c = c.withColumn("cls", lab.otherwise("HIGH"))
    stable = F.when(F.col("prio") == 1, 0).when(F.col("prio") == 2, 1).otherwise(2)
    top = L.first_n(c, ["cls"], [stable, F.col("orbit"), F.col("o_orderkey")], 4).select("o_orderkey", "cls")
    ends = a.agg(F.min_by("o_orderkey", F.struct("cents", "o_orderkey")).alias("lo"), F.max_by("o_orderkey", F.struct("cents", "o_orderkey")).alias("hi"))
    ends = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("o_orderkey"), F.lit("LOW").alias("cls")), F.struct(F.col("hi").alias("o_orderkey"), F.lit("HIGH").alias("cls")))).alias("e")).select("e.*")
    return top.union(ends).distinct()


@query("top_fill_cells", "TOP-06", f"""WITH {S.ASSETS}, r AS (SELECT *, row_number() OVER (PARTITION BY orbit, state ORDER BY cents DESC, o_orderkey) AS rk FROM ast), c AS (SELECT o_orderkey FROM r WHERE rk <= 2), n AS (SELECT greatest(0, 60 - count(*)) AS need FROM c), f AS (SELECT o_orderkey, row_number() OVER (ORDER BY cents DESC, o_orderkey) AS rk FROM ast WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)) SELECT o_orderkey, 'cell' AS how FROM c UNION ALL SELECT o_orderkey, 'fill' FROM f, n WHERE rk <= need""")
def _(t: Tables):
    return L.fill(S.assets(t), ["orbit", "state"], [F.col("cents").desc(), F.col("o_orderkey")], 2, 60, "o_orderkey").select("o_orderkey", "how")


@query("top_seeded_strata", "TOP-07", f"""WITH {S.ASSETS}, r AS (SELECT orbit, o_orderkey, row_number() OVER (PARTITION BY orbit ORDER BY {mix_sql(5, 'o_orderkey')}, o_orderkey) AS rk FROM ast) SELECT orbit, o_orderkey FROM r WHERE rk <= 10""")
def _(t: Tables):
    return L.sample_strata(S.assets(t), ["orbit"], "o_orderkey", 10, 5).select("orbit", "o_orderkey")


@query("top_track_holdout", "TOP-08", f"""WITH k AS (SELECT o_custkey AS track, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT track, n, sum(n) OVER (ORDER BY {mix_sql(6, 'track')}, track ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM k) SELECT track, n, CASE WHEN cum - n < 0.2 * total THEN 1 ELSE 0 END AS held_out FROM c""")
def _(t: Tables):
    k = t.orders.groupBy(F.col("o_custkey").alias("track")).agg(F.count(F.lit(1)).alias("n"))
    return greedy_tracks(k, "track", "n", 0.2, 6).select("track", "n", F.col("held_out").cast("int").alias("held_out"))


@query("top_random_points", "TOP-09", f"""WITH {S.LEVELS}, p AS (SELECT event_id, {mix_sql(8, 'event_id')} / 2147483647.0::DOUBLE * 100000 AS x, {mix_sql(9, 'event_id')} / 2147483647.0::DOUBLE * 100000 AS y FROM lv) SELECT event_id, {S.ZONE_OF.format(x='floor(x)', y='y')} AS zone FROM p WHERE {S.ZONE_OF.format(x='floor(x)', y='y')} IS NOT NULL""")
def _(t: Tables):
    from ..functions.rng import uniform
    from ..operators.spatial import in_domain
    p = t.events.select("event_id", (uniform(8, F.col("event_id")) * 100000).alias("ax"), (uniform(9, F.col("event_id")) * 100000).alias("ay"))
    return in_domain(p, S.zone_rings(t), "event_id", 5000.0).select("event_id", F.col("domain").cast("long").alias("zone"))


@query("top_extreme_strata", "TOP-10", f"""WITH {S.LEVELS}, a AS (SELECT event_id, 'highest' AS why FROM (SELECT event_id FROM lv ORDER BY cm DESC, event_id LIMIT 10) UNION ALL SELECT event_id, 'latest' FROM (SELECT event_id FROM lv ORDER BY us DESC, event_id LIMIT 10) UNION ALL SELECT event_id, 'error_high' FROM (SELECT event_id FROM lv WHERE event_type = 'error' ORDER BY cm DESC, event_id LIMIT 10)) SELECT event_id, min(why) AS why FROM a GROUP BY 1""")
def _(t: Tables):
    d = S.levels(t)
    pick = lambda df, col, why: df.orderBy(F.col(col).desc(), "event_id").limit(10).select("event_id", F.lit(why).alias("why"))
    u = pick(d, "cm", "highest").union(pick(d, "us", "latest")).union(pick(d.where("event_type = 'error'"), "cm", "error_high"))
    return u.groupBy("event_id").agg(F.min("why").alias("why"))


# ------------------------------------------------------------------ sets
@query("set_union_and_dedup", "SET-01 SET-02 SRC-15", f"""WITH {S.LEVELS}, u AS (SELECT station, day, cm, 2 AS rk, 'term' AS src, event_id FROM lv WHERE event_type = 'view' UNION ALL SELECT station, day, cm, 1, 'daily', event_id FROM lv WHERE event_type = 'click') SELECT station, strftime(day, '%Y-%m-%d') AS d, arg_max(src, (rk, -event_id)) AS src, arg_max(cm, (rk, -event_id)) AS cm FROM u GROUP BY 1, day""")
def _(t: Tables):
    d = S.levels(t)
    a = d.where("event_type = 'view'").select("station", "day", "cm", "event_id", F.lit(2).alias("rk"), F.lit("term").alias("src"))
    b = d.where("event_type = 'click'").select("station", "day", "cm", "event_id", F.lit("daily").alias("src"))
    u = a.unionByName(b, allowMissingColumns=True).withColumn("rk", -F.coalesce("rk", F.lit(1)))
    return L.best(u, ["station", "day"], [F.col("rk"), F.col("event_id")], ["src", "cm"]).select("station", D().alias("d"), "src", "cm")


@query("set_missing_days", "SET-03 SET-04", f"""WITH {S.LEVELS}, v AS (SELECT DISTINCT user_id AS station, day FROM lv), sp AS (SELECT station, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM v GROUP BY station) SELECT station, strftime(day, '%Y-%m-%d') AS d FROM (SELECT * FROM sp EXCEPT SELECT * FROM v)""")
def _(t: Tables):
    v = S.levels(t).select(F.col("user_id").alias("station"), "day").distinct()
    return T.daily_spine(v, ["station"], "day").join(v, ["station", "day"], "left_anti").select("station", D().alias("d"))


@query("set_frame_difference", "SET-06", """WITH a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1), g AS (SELECT l_suppkey, l_linenumber, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2) SELECT l_suppkey, l_linenumber, surplus, CASE WHEN surplus > 0 THEN 'left' ELSE 'right' END AS side FROM g WHERE surplus <> 0""")
def _(t: Tables):
    l = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber")
    return L.frame_difference(l.where("l_orderkey % 2 = 0").drop("l_orderkey"), l.where("l_orderkey % 2 = 1").drop("l_orderkey"))


@query("set_clip_verification", "SET-07", f"""WITH {S.LEVELS}, m AS (SELECT station, count(*) AS want FROM lv GROUP BY 1), k AS (SELECT station, event_id, cm FROM lv WHERE event_id % 50 > 0), g AS (SELECT station, count(*) AS have, count(DISTINCT event_id) AS ids FROM k GROUP BY 1), s AS (SELECT station, event_id, cm, row_number() OVER (PARTITION BY station ORDER BY {mix_sql(17, 'event_id')}, event_id) AS rk FROM lv),
 f AS (SELECT s.station, count(*) FILTER (k.event_id IS NULL) AS lost, count(*) FILTER (k.cm <> s.cm) AS changed FROM s LEFT JOIN k USING (event_id) WHERE rk <= 20 GROUP BY 1) SELECT station, want, have, want - have AS missing, have - ids AS repeated, lost, changed FROM m JOIN g USING (station) JOIN f USING (station)""")
def _(t: Tables):
    d = S.levels(t).select("station", "event_id", "cm")
    k = d.where("event_id % 50 > 0")
    m = d.groupBy("station").agg(F.count(F.lit(1)).alias("want"))
    g = k.groupBy("station").agg(F.count(F.lit(1)).alias("have"), F.count_distinct("event_id").alias("ids"))
    s = L.sample_strata(d, ["station"], "event_id", 20, 17).join(k.select("event_id", F.col("cm").alias("kc")), "event_id", "left")
    f = s.groupBy("station").agg(F.count_if(F.col("kc").isNull()).alias("lost"), F.count_if(F.col("kc") != F.col("cm")).alias("changed"))
    j = m.join(g, "station").join(f, "station")
    return j.select("station", "want", "have", (F.col("want") - F.col("have")).alias("missing"), (F.col("have") - F.col("ids")).alias("repeated"), "lost", "changed")


@query("set_key_audit", "SET-08 M18", """WITH m AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 > 0), c AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 5 > 0) SELECT coalesce(m.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'MISSING' WHEN m.doc_id IS NULL THEN 'ORPHAN' WHEN m.n_chars <> c.n_chars THEN 'STALE' ELSE 'OK' END AS status FROM m FULL JOIN c ON m.doc_id = c.doc_id""")
def _(t: Tables):
    d = t.documents.select("doc_id", "n_chars")
    c = d.where("doc_id % 5 > 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("shape"))
    return L.key_audit(d.where("doc_id % 7 > 0"), c, "doc_id", "n_chars", "shape")
