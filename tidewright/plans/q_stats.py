"""Grouped statistics, tests and resampling."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.rng import mix_sql
from ..operators import blocks as B
from ..operators import pairs as PR
from ..operators import resample as RS
from ..operators import select as L
from ..operators import spatial as P
from ..operators import stats as ST
from ..session import broadcast_if_small
from . import standins as S
from .registry import Tables, query
from .standins import r6

REPS = 10_000


@query("agg_named_outputs", "AGG-01 AGG-02 AGG-06 AGG-10", f"""WITH {S.LEVELS} SELECT station, event_type, count(*) AS n, round(avg(cm), 6) AS mean_cm, min(cm) AS min_cm, max(cm) AS max_cm, count(DISTINCT day) AS n_days,
 count(DISTINCT (day, hr)) AS n_slots, arg_min(cm, (us, event_id)) AS first_cm, round(quantile_cont(cm, 0.05), 6) AS p05, round(median(cm), 6) AS p50, round(quantile_cont(cm, 0.95), 6) AS p95,
 round(quantile_cont(cm, 0.95) - quantile_cont(cm, 0.05), 6) AS range95, round(quantile_cont(cm, 0.75) - quantile_cont(cm, 0.25), 6) AS iqr FROM lv GROUP BY 1, 2""")
def _(t: Tables):
    k = ["station", "event_type"]
    # distinct counts beside quantiles would copy every row per distinct list; distinct slots are few, so they go first
    slots = S.levels(t).select(*k, "day", "hr").distinct().groupBy(*k, "day").agg(F.count(F.lit(1)).alias("s"))
    slots = slots.groupBy(*k).agg(F.count(F.lit(1)).alias("n_days"), F.sum("s").alias("n_slots"))
    g = B.summarise(S.levels(t), k, {
        "n": F.count(F.lit(1)), "mean_cm": r6(F.avg("cm")), "min_cm": F.min("cm"), "max_cm": F.max("cm"), "first_cm": F.min_by("cm", F.struct("us", "event_id"))},
        {"p05": ("cm", 0.05), "p25": ("cm", 0.25), "p50": ("cm", 0.5), "p75": ("cm", 0.75), "p95": ("cm", 0.95)}).join(broadcast_if_small(slots), k)
    return g.select("station", "event_type", "n", "mean_cm", "min_cm", "max_cm", "n_days", "n_slots", "first_cm", *[r6(F.col(c)).alias(c) for c in ("p05", "p50", "p95")],
                    r6(F.col("p95") - F.col("p05")).alias("range95"), r6(F.col("p75") - F.col("p25")).alias("iqr"))


@query("agg_residual_block", "AGG-03 AGG-04 UDF-02", f"""WITH {S.LEVELS}, d AS (SELECT station, m - 0.5 AS d FROM lv), md AS (SELECT station, median(d) AS md FROM d GROUP BY 1), nm AS (SELECT station, 1.4826::DOUBLE * median(abs(d - md)) AS nm FROM d JOIN md USING (station) GROUP BY 1),
 w AS (SELECT station, count(*)::DOUBLE AS n, median(d) AS median, avg(abs(d)) AS mae, sqrt(avg(d*d)) AS rmse, 100 * avg(CASE WHEN abs(d) <= 0.10 THEN 1.0 ELSE 0 END) AS within_pct FROM d GROUP BY 1)
 SELECT station, statistic, round(value, 6) AS value FROM (SELECT w.*, nm AS nmad FROM w JOIN nm USING (station)) UNPIVOT (value FOR statistic IN (n, median, nmad, mae, rmse, within_pct))""")
def _(t: Tables):
    d = S.levels(t).select("station", (F.col("m") - 0.5).alias("d"))
    w = ST.residual_stats(d, ["station"], "d")
    names = ["n", "median", "nmad", "mae", "rmse", "within_pct"]
    w = w.select("station", *[F.col(c).cast("double").alias(c) for c in names])
    return w.unpivot("station", names, "statistic", "value").withColumn("value", r6(F.col("value")))


@query("agg_accuracy", "AGG-05", f"""WITH {S.LEVELS}, d AS (SELECT station, event_type, cm - 40 AS d FROM lv), g AS (SELECT station, event_type, count(*) AS n, quantile_cont(abs(d), 0.9) AS a, quantile_cont(abs(d), 0.95) AS b, max(abs(d)) AS c, avg(CASE WHEN d < -5 THEN 1.0 ELSE 0 END) AS e FROM d GROUP BY 1, 2)
 SELECT station, event_type, n, coalesce(round(CASE WHEN n >= 70 THEN a END, 6), -1.0) AS le90, coalesce(round(CASE WHEN n >= 70 THEN b END, 6), -1.0) AS le95, coalesce(round(CASE WHEN n >= 70 THEN c END, 6), -1.0) AS worst, coalesce(round(CASE WHEN n >= 70 THEN e END, 6), -1.0) AS tail_share FROM g""")
def _(t: Tables):
    g = ST.accuracy(S.levels(t).select("station", "event_type", (F.col("cm") - 40).alias("d")), ["station", "event_type"], "d", 70)
    return g.select("station", "event_type", "n", *[F.coalesce(r6(F.col(c)), F.lit(-1.0)).alias(c) for c in ("le90", "le95", "worst", "tail_share")])


@query("agg_shares_and_groupings", "AGG-07 AGG-08 AGG-09", f"""WITH {S.CELLS} SELECT coalesce(CAST(year AS VARCHAR), 'ALL') AS year, coalesce(CAST(scl AS VARCHAR), 'ALL') AS stratum, CAST(grouping_id(year, scl) AS BIGINT) AS gid, count(*) AS n, count(*) FILTER (water = 1) AS n_wet, coalesce(round(avg(water), 6), -1.0) AS wet_share, round(avg(CASE WHEN cls IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unseen
 FROM cl GROUP BY GROUPING SETS ((year, scl), (year), (scl), ())""")
def _(t: Tables):
    g = S.cells(t).groupingSets([("year", "scl"), ("year",), ("scl",), ()], "year", "scl").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("water") == 1).alias("n_wet"),
        F.coalesce(r6(F.avg("water")), F.lit(-1.0)).alias("wet_share"), r6(F.avg(F.col("cls").isNull().cast("double"))).alias("unseen"))
    return g.select(F.coalesce(F.col("year").cast("string"), F.lit("ALL")).alias("year"), F.coalesce(F.col("scl").cast("string"), F.lit("ALL")).alias("stratum"), "gid", "n", "n_wet", "wet_share", "unseen")


@query("agg_distinct_lists", "AGG-11", """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS kinds, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1""")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("kinds"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("states"))


@query("agg_weighted_and_yearly", "AGG-12 AGG-13", f"""WITH {S.CELLS}, y AS (SELECT col, year, avg(qty) AS m FROM cl GROUP BY 1, 2), a AS (SELECT col, round(avg(m), 6) AS mean_of_means, round(stddev_pop(m), 6) AS spread, count(*) AS n_years FROM y GROUP BY 1), w AS (SELECT col, round(sum(qty * greatest(scl, 0.01)) / sum(greatest(scl, 0.01)), 6) AS wmean FROM cl GROUP BY 1) SELECT * FROM a JOIN w USING (col)""")
def _(t: Tables):
    c = S.cells(t)
    y = c.groupBy("col", "year").agg(F.avg("qty").alias("m")).groupBy("col").agg(r6(F.avg("m")).alias("mean_of_means"), r6(F.stddev_pop("m")).alias("spread"), F.count(F.lit(1)).alias("n_years"))
    wt = F.greatest(F.col("scl").cast("double"), F.lit(0.01))
    return y.join(c.groupBy("col").agg(r6(F.sum(F.col("qty") * wt) / F.sum(wt)).alias("wmean")), "col")


@query("agg_pivots", "AGG-14 AGG-15", f"""WITH {S.ASSETS} SELECT orbit, CAST(year(day) AS INTEGER) AS yr, """ + ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s}, coalesce(round(median(CASE WHEN state = '{s}' THEN cents END), 6), 0.0) AS med_{s}" for s in "FOP") + " FROM ast GROUP BY 1, 2")
def _(t: Tables):
    a = S.assets(t).withColumn("yr", F.year("day"))
    cols = a.select("orbit", "yr", *[F.when(F.col("state") == s, F.col("cents")).alias(f"c{s}") for s in "FOP"])
    g = B.summarise(cols, ["orbit", "yr"], {f"n_{s}": F.count(f"c{s}") for s in "FOP"}, {f"med_{s}": (f"c{s}", 0.5) for s in "FOP"})
    return g.select("orbit", "yr", *[f"n_{s}" for s in "FOP"], *[F.coalesce(r6(F.col(f"med_{s}")), F.lit(0.0)).alias(f"med_{s}") for s in "FOP"])


@query("agg_coverage_cube", "AGG-15", f"""WITH {S.ASSETS} SELECT coalesce(CAST(prio AS VARCHAR), 'ALL') AS wind, coalesce(CASE WHEN grouping(quarter) = 1 THEN 'ALL' ELSE CAST(quarter AS VARCHAR) END, 'ALL') AS season, coalesce(CAST(orbit AS VARCHAR), 'ALL') AS orbit, count(*) AS n
 FROM (SELECT prio, quarter(day) AS quarter, orbit FROM ast) GROUP BY CUBE (prio, quarter, orbit)""")
def _(t: Tables):
    a = S.assets(t).select("prio", F.quarter("day").alias("season"), "orbit")
    g = a.cube("prio", "season", "orbit").agg(F.count(F.lit(1)).alias("n"))
    lab = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("ALL"))
    return g.select(lab("prio").alias("wind"), lab("season").alias("season"), lab("orbit").alias("orbit"), "n")


@query("agg_assets_to_events", "AGG-16 M13", f"""WITH {S.ASSETS} SELECT strftime(day, '%Y-%m-%d') || '_orb' || orbit || '_' || upper(substr(state, 1, 3)) AS event_id, count(*) AS n_assets, max(prio) - min(prio) AS span, CASE WHEN max(prio) - min(prio) <= 3 THEN 1 ELSE 0 END AS span_ok FROM ast GROUP BY day, orbit, state""")
def _(t: Tables):
    from ..schema import event_key
    g = S.assets(t).groupBy("day", "orbit", "state").agg(F.count(F.lit(1)).alias("n_assets"), (F.max("prio") - F.min("prio")).alias("span"))
    return g.select(event_key(F.col("day"), F.col("orbit"), F.col("state")).alias("event_id"), "n_assets", "span", (F.col("span") <= 3).cast("int").alias("span_ok"))


@query("agg_dedup_coordinates", "AGG-17 M8", f"""WITH {S.SOUNDINGS} SELECT round_even(x / 100, 0) AS gx, round_even(y / 100, 0) AS gy, count(*) AS n, round(avg(z), 6) AS z, round(avg(x), 6) AS x FROM sd GROUP BY 1, 2""")
def _(t: Tables):
    s = S.soundings(t)
    return s.groupBy(F.bround(F.col("x") / 100).alias("gx"), F.bround(F.col("y") / 100).alias("gy")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("z")).alias("z"), r6(F.avg("x")).alias("x"))


@query("agg_ols", "AGG-18", f"""WITH {S.LEVELS}, {S.POINTS}, f AS (SELECT day, count(*) AS n, regr_slope(h, chain) AS s, regr_intercept(h, chain) AS i, regr_r2(h, chain) AS r2 FROM pt GROUP BY 1), r AS (SELECT day, h - s * chain - i AS r FROM pt JOIN f USING (day)), md AS (SELECT day, median(r) AS md FROM r GROUP BY 1), nm AS (SELECT day, 1.4826::DOUBLE * median(abs(r - md)) AS nm FROM r JOIN md USING (day) GROUP BY 1)
 SELECT strftime(day, '%Y-%m-%d') AS d, n, round(s, 6) AS slope, round(i, 6) AS intercept, round(r2, 6) AS r2, round(nm, 6) AS resid_nmad FROM f JOIN nm USING (day)""")
def _(t: Tables):
    g = ST.ols(S.points(t), ["day"], "chain", "h")
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("d"), "n", *[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "r2", "resid_nmad")])


_TS = """sl AS (SELECT a.day, (b.h - a.h) / (b.chain - a.chain) AS s FROM pt a JOIN pt b ON a.day = b.day AND a.event_id < b.event_id AND a.chain <> b.chain), ns AS (SELECT day, count(*) AS ns, median(s) AS slope, list_sort(list(s)) AS ls FROM sl GROUP BY 1),
 b0 AS (SELECT day, count(*) AS n, median(chain) AS mx, median(h) AS my FROM pt GROUP BY 1), kx AS (SELECT day, sum(m*(m-1)*(2*m+5)) AS k FROM (SELECT day, chain, count(*) AS m FROM pt GROUP BY 1, 2) GROUP BY 1), ky AS (SELECT day, sum(m*(m-1)*(2*m+5)) AS k FROM (SELECT day, h, count(*) AS m FROM pt GROUP BY 1, 2) GROUP BY 1),
 sg AS (SELECT day, n, ns, slope, ls, my - slope * mx AS icpt, sqrt((n*(n-1)*(2*n+5) - kx.k - ky.k)::DOUBLE / 18) AS sigma FROM ns JOIN b0 USING (day) JOIN kx USING (day) JOIN ky USING (day)),
 ts AS (SELECT day, n, slope, icpt, ls[1 + greatest(CAST(round_even((ns - 1.959963984540054::DOUBLE * sigma) / 2, 0) AS BIGINT) - 1, 0)] AS lo, ls[1 + least(CAST(round_even((ns + 1.959963984540054::DOUBLE * sigma) / 2, 0) AS BIGINT), ns - 1)] AS hi FROM sg)"""


@query("agg_theil_sen", "AGG-19 UDF-03", f"WITH {S.LEVELS}, {S.POINTS}, {_TS} SELECT strftime(day, '%Y-%m-%d') AS d, n, round(slope, 6) AS slope, round(icpt, 6) AS intercept, round(lo, 6) AS slope_lo, round(hi, 6) AS slope_hi FROM ts")
def _(t: Tables):
    g = PR.theil_sen(S.points(t), ["day"], "chain", "h")
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("d"), "n", *[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "slope_lo", "slope_hi")])


_XY = "xy AS (SELECT station, day, cm AS x, cm * 0.5::DOUBLE + n AS y FROM dl)"


def _xy(t: Tables):
    return S.daily(t).select("station", "day", F.col("cm").alias("x"), (F.col("cm") * 0.5 + F.col("n")).alias("y"))


@query("agg_deming", "AGG-20", f"""WITH {S.LEVELS}, {S.DAILY}, {_XY}, g AS (SELECT station, avg(x) AS mx, avg(y) AS my, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy FROM xy GROUP BY 1), s AS (SELECT *, (syy - sxx + sqrt((syy - sxx)*(syy - sxx) + 4*sxy*sxy)) / (2*sxy) AS b FROM g) SELECT station, round(b, 6) AS slope, round(my - b * mx, 5) AS intercept FROM s""")
def _(t: Tables):
    return ST.deming(_xy(t), ["station"], "x", "y").select("station", r6(F.col("slope")).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("agg_passing_bablok", "AGG-21", f"""WITH {S.LEVELS}, {S.DAILY}, {_XY}, sl AS (SELECT a.station, (b.y - a.y) / (b.x - a.x) AS s FROM xy a JOIN xy b ON a.station = b.station AND a.day < b.day AND a.x <> b.x), k AS (SELECT station, count(*) FILTER (s < -1) AS k, count(*) FILTER (s <> -1) AS m, list_sort(list(s) FILTER (s <> -1)) AS ls FROM sl GROUP BY 1),
 f AS (SELECT station, m, (ls[1 + (m - 1) // 2 + k] + ls[1 + m // 2 + k]) / 2 AS b FROM k) SELECT station, max(m) AS n_slopes, round(max(b), 6) AS slope, round(median(y - b * x), 6) AS intercept FROM xy JOIN f USING (station) GROUP BY 1""")
def _(t: Tables):
    return PR.passing_bablok(_xy(t), ["station"], "x", "y").select("station", "n_slopes", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"))


@query("agg_correlations", "AGG-22", f"""WITH {S.LEVELS}, {S.DAILY}, {_XY}, r AS (SELECT station, x, y, rank() OVER (PARTITION BY station ORDER BY x) + (count(*) OVER (PARTITION BY station, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY station ORDER BY y) + (count(*) OVER (PARTITION BY station, y) - 1) / 2.0 AS ry FROM xy)
 SELECT station, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def _(t: Tables):
    d = _xy(t)
    g = d.groupBy("station").agg(r6(F.corr("x", "y")).alias("pearson")).join(ST.spearman(d, ["station"], "x", "y"), "station")
    return g.select("station", "pearson", r6(F.col("rho")).alias("rho"))


_G2 = """gs AS (SELECT station, count(*) AS n, avg(x) AS mx, avg(w) AS mw, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(w, w) AS ww, covar_pop(x, w) AS xw, covar_pop(x, y) AS xy_, covar_pop(w, y) AS wy FROM q GROUP BY 1),
 fit AS (SELECT *, (ww*xy_ - xw*wy)/(xx*ww - xw*xw) AS b1, (xx*wy - xw*xy_)/(xx*ww - xw*xw) AS b2 FROM gs)"""


@query("agg_multiple_ols", "AGG-23", f"""WITH {S.LEVELS}, q AS (SELECT station, CAST(hr AS DOUBLE) AS x, CAST(dayofmonth(day) AS DOUBLE) AS w, cm AS y FROM lv), {_G2},
 r AS (SELECT q.station, n, xx, ww, xw, x - mx AS dx, w - mw AS dw, y - my - b1*(x - mx) - b2*(w - mw) AS e, b1, b2, my - b1*mx - b2*mw AS b0 FROM q JOIN fit USING (station)),
 l AS (SELECT *, 1.0/n + (ww*dx*dx - 2*xw*dx*dw + xx*dw*dw)/(n*(xx*ww - xw*xw)) AS lev, (ww*dx - xw*dw)/(n*(xx*ww - xw*xw)) AS z1, (xx*dw - xw*dx)/(n*(xx*ww - xw*xw)) AS z2 FROM r)
 SELECT station, max(n) AS n, round(max(b0), 5) AS beta0, round(max(b1), 6) AS beta1, round(max(b2), 6) AS beta2, round(sqrt(sum(power(z1*e/(1-lev), 2))), 6) AS se1, round(sqrt(sum(power(z2*e/(1-lev), 2))), 6) AS se2 FROM l GROUP BY 1""")
def _(t: Tables):
    q = S.levels(t).select("station", F.col("hr").cast("double").alias("x"), F.dayofmonth("day").cast("double").alias("w"), F.col("cm").alias("y"))
    g = ST.ols_multi(q, ["station"], ["x", "w"], "y", robust=True)
    return g.select("station", "n", F.round("beta0", 5).alias("beta0"), *[r6(F.col(c)).alias(c) for c in ("beta1", "beta2", "se1", "se2")])


@query("agg_effective_n", "AGG-24", f"""WITH {S.LEVELS}, {S.DAILY}, {_XY}, l AS (SELECT *, lag(x) OVER (PARTITION BY station ORDER BY day) AS px, lag(y) OVER (PARTITION BY station ORDER BY day) AS py FROM xy), g AS (SELECT station, count(*) AS n, corr(x, y) AS r, corr(x, px) AS r1, corr(y, py) AS r2 FROM l GROUP BY 1) SELECT station, n, round(r, 6) AS r, round(n * (1 - r1*r2) / (1 + r1*r2), 5) AS n_eff FROM g""")
def _(t: Tables):
    return ST.n_eff(_xy(t), ["station"], ["day"], "x", "y").select("station", "n", r6(F.col("r")).alias("r"), F.round("n_eff", 5).alias("n_eff"))


@query("agg_detrended_range", "AGG-25 Q-12", f"""WITH {S.LEVELS}, q AS (SELECT day, station, (event_id * 7919 % 1000)::DOUBLE AS x, (event_id * 104729 % 1000)::DOUBLE AS w, cm AS y FROM lv), gs AS (SELECT day, count(*) AS n, avg(x) AS mx, avg(w) AS mw, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(w, w) AS ww, covar_pop(x, w) AS xw, covar_pop(x, y) AS xy_, covar_pop(w, y) AS wy FROM q GROUP BY 1),
 fit AS (SELECT *, (ww*xy_ - xw*wy)/(xx*ww - xw*xw) AS b1, (xx*wy - xw*xy_)/(xx*ww - xw*xw) AS b2 FROM gs), r AS (SELECT day, y, y - my - b1*(x - mx) - b2*(w - mw) AS e FROM q JOIN fit USING (day))
 SELECT strftime(day, '%Y-%m-%d') AS d, count(*) AS n, round(quantile_cont(y, 0.95) - quantile_cont(y, 0.05), 5) AS range_cm, round(quantile_cont(e, 0.95) - quantile_cont(e, 0.05), 5) AS range_detrended FROM r GROUP BY 1""")
def _(t: Tables):
    e = F.col("event_id")
    q = S.levels(t).select("day", (e * 7919 % 1000).cast("double").alias("x"), (e * 104729 % 1000).cast("double").alias("w"), F.col("cm").alias("y"))
    r = ST.planar_residual(q, ["day"], "x", "w", "y", "e")
    g = B.summarise(r, ["day"], {"n": F.count(F.lit(1))}, {"a": ("y", 0.05), "b": ("y", 0.95), "c": ("e", 0.05), "d": ("e", 0.95)})
    return g.select(F.date_format("day", "yyyy-MM-dd").alias("d"), "n", F.round(F.col("b") - F.col("a"), 5).alias("range_cm"), F.round(F.col("d") - F.col("c"), 5).alias("range_detrended"))


@query("agg_soft_plane", "AGG-25", None)
def _(t: Tables):
    e = F.col("event_id")
    q = S.levels(t).select("day", (e * 7919 % 1000).cast("double").alias("x"), (e * 104729 % 1000).cast("double").alias("w"), F.col("cm").alias("y"))
    r = ST.planar_residual(q, ["day"], "x", "w", "y", "e", soft_scale=10.0)
    return B.summarise(r, ["day"], {"n": F.count(F.lit(1))}, {"p05": ("e", 0.05), "p95": ("e", 0.95)})


def _boot_sql(seed: int, src: str, keys: str, order: str, val: str) -> str:
    """Units, draws and per-replicate medians of the twin."""
    return f"""u AS (SELECT {keys}, {val} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
 dr AS (SELECT {keys}, rep, 1 + {mix_sql(seed, 'rep', 'pos')} % n AS pos FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)), md AS (SELECT {keys}, rep, median(v) AS med FROM dr JOIN u USING ({keys}, pos) GROUP BY {keys}, rep)"""


@query("agg_boot_median", "AGG-26 FN-20", f"WITH {S.LEVELS}, {S.DAILY}, {_boot_sql(11, 'dl', 'station', 'day', 'cm')} SELECT station, round(quantile_cont(med, 0.025), 6) AS ci_lo, round(quantile_cont(med, 0.975), 6) AS ci_hi FROM md GROUP BY 1")
def _(t: Tables):
    return RS.boot_median(S.daily(t), ["station"], "cm", ["day"], REPS, 11).select("station", r6(F.col("ci_lo")).alias("ci_lo"), r6(F.col("ci_hi")).alias("ci_hi"))


@query("agg_boot_corr", "AGG-27", f"""WITH {S.LEVELS}, {S.DAILY}, {_XY}, u AS (SELECT station, x, y, row_number() OVER (PARTITION BY station ORDER BY day) AS pos, count(*) OVER (PARTITION BY station) AS n FROM xy), dr AS (SELECT station, rep, 1 + {mix_sql(12, 'rep', 'pos')} % n AS pos FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
 c AS (SELECT station, rep, corr(x, y) AS r FROM dr JOIN u USING (station, pos) GROUP BY 1, 2) SELECT station, round(quantile_cont(r, 0.025), 6) AS ci_lo, round(quantile_cont(r, 0.975), 6) AS ci_hi FROM c GROUP BY 1""")
def _(t: Tables):
    return RS.boot_corr(_xy(t), ["station"], "x", "y", ["day"], REPS, 12).select("station", r6(F.col("ci_lo")).alias("ci_lo"), r6(F.col("ci_hi")).alias("ci_hi"))


@query("agg_boot_difference", "AGG-27", f"WITH {S.LEVELS}, {S.DAILY}, q AS (SELECT *, CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END AS post FROM dl), {_boot_sql(13, 'q', 'station, post', 'day', 'cm')}, d AS (SELECT station, rep, max(CASE WHEN post = 1 THEN med END) - max(CASE WHEN post = 0 THEN med END) AS d FROM md GROUP BY 1, 2) SELECT station, round(quantile_cont(d, 0.025), 6) AS ci_lo, round(quantile_cont(d, 0.975), 6) AS ci_hi FROM d GROUP BY 1")
def _(t: Tables):
    d = S.daily(t).withColumn("post", (F.col("day") >= F.to_date(F.lit("2024-01-16"))).cast("int"))
    return RS.boot_diff(d, ["station"], "cm", "post", ["day"], REPS, 13).select("station", r6(F.col("ci_lo")).alias("ci_lo"), r6(F.col("ci_hi")).alias("ci_hi"))


@query("agg_cluster_bootstrap", "AGG-28", f"""WITH {S.LEVELS}, {S.DAILY}, k AS (SELECT station, row_number() OVER (ORDER BY station) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT station FROM dl)), dr AS (SELECT rep, 1 + {mix_sql(14, 'rep', 'pos')} % n AS pos FROM k, (SELECT unnest(range(1, {REPS + 1})) AS rep)),
 s AS (SELECT rep, sum(cm) / count(*) AS m, median(cm) AS md FROM dr JOIN k USING (pos) JOIN dl USING (station) GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 6) AS mean_lo, round(quantile_cont(m, 0.975), 6) AS mean_hi, round(quantile_cont(md, 0.025), 6) AS med_lo, round(quantile_cont(md, 0.975), 6) AS med_hi FROM s""")
def _(t: Tables):
    s = RS.cluster_stats(S.daily(t), "station", [], "cm", REPS, 14)
    g = B.summarise(s, [], {}, {"mean_lo": ("mean", 0.025), "mean_hi": ("mean", 0.975), "med_lo": ("median", 0.025), "med_hi": ("median", 0.975)})
    return g.select(*[r6(F.col(c)).alias(c) for c in g.columns])


@query("agg_permutation_test", "AGG-29", f"""WITH {S.LEVELS}, d AS (SELECT epoch(CAST(day AS TIMESTAMP))::BIGINT // 86400 AS uid, CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END AS post, CAST(sum(CAST(round(cm * 100) AS BIGINT)) AS DOUBLE) AS v FROM lv GROUP BY 1, 2), na AS (SELECT count(*) AS n FROM d WHERE post = 0),
 p AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {mix_sql(15, 'rep', 'uid')}, uid) AS pos FROM d, (SELECT unnest(range(1, {REPS + 1})) AS rep)), m AS (SELECT rep, median(CASE WHEN pos > n THEN v END) - median(CASE WHEN pos <= n THEN v END) AS df FROM p, na GROUP BY 1),
 o AS (SELECT median(CASE WHEN post = 1 THEN v END) - median(CASE WHEN post = 0 THEN v END) AS obs FROM d) SELECT round(max(obs), 6) AS obs, round((count(*) FILTER (abs(df) >= abs(obs)) + 1) / {REPS + 1}.0, 6)::DOUBLE AS p FROM m, o""")
def _(t: Tables):
    d = S.levels(t).groupBy(F.unix_date("day").cast("long").alias("uid"), (F.col("day") >= F.to_date(F.lit("2024-01-16"))).cast("int").alias("post")).agg(
        F.sum(F.round(F.col("cm") * 100).cast("long")).cast("double").alias("v"))
    return RS.permutation(d, "v", "post", "uid", REPS, 15).select(r6(F.col("obs")).alias("obs"), r6(F.col("p")).alias("p"))


_AB = "ab AS (SELECT station, cm, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS b FROM lv)"


def _ab(t: Tables):
    return S.levels(t).select("station", "cm", F.col("event_type").isin("view", "click").cast("int").alias("b"))


@query("agg_rank_sum", "AGG-30", f"""WITH {S.LEVELS}, {_AB}, r AS (SELECT station, b, rank() OVER (PARTITION BY station ORDER BY cm) + (count(*) OVER (PARTITION BY station, cm) - 1) / 2.0 AS r FROM ab), g AS (SELECT station, sum(b) AS nb, count(*) - sum(b) AS na, sum(CASE WHEN b = 1 THEN r END) AS rb FROM r GROUP BY 1), tt AS (SELECT station, sum(c*c*c - c) AS tie FROM (SELECT station, cm, count(*) AS c FROM ab GROUP BY 1, 2) GROUP BY 1),
 u AS (SELECT station, na::DOUBLE AS na, nb::DOUBLE AS nb, (rb - nb * (nb + 1) / 2)::DOUBLE AS u, tie::DOUBLE AS tie FROM g JOIN tt USING (station)) SELECT station, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, u, round(u / (na*nb), 6) AS auc, round(2 * u / (na*nb) - 1, 6) AS cliff, round((u - na*nb/2) / sqrt(na*nb/12 * (na + nb + 1 - tie / ((na+nb)*(na+nb-1)))), 6) AS z FROM u""")
def _(t: Tables):
    g = ST.rank_sum(_ab(t), ["station"], "cm", "b")
    return g.select("station", "na", "nb", "u", *[r6(F.col(c)).alias(c) for c in ("auc", "cliff", "z")])


@query("agg_rank_sum_p", "AGG-30", None)
def _(t: Tables):
    g = ST.rank_sum(_ab(t), ["station"], "cm", "b")
    return g.select("station", "u", ST.two_sided_normal(F.col("z")).alias("p"))


@query("agg_hodges_lehmann", "AGG-31", f"""WITH {S.LEVELS}, {_AB} SELECT x.station, count(*) AS n_pairs, round(median(y.cm - x.cm), 6) AS shift FROM ab x JOIN ab y ON x.station = y.station AND x.b = 0 AND y.b = 1 GROUP BY 1""")
def _(t: Tables):
    return PR.hodges_lehmann(_ab(t), ["station"], "cm", "b").select("station", "n_pairs", r6(F.col("shift")).alias("shift"))


@query("agg_sign_and_wilcoxon", "AGG-32", f"""WITH {S.LEVELS}, {S.DAILY}, d AS (SELECT station, d FROM (SELECT station, cm - lag(cm) OVER (PARTITION BY station ORDER BY day) AS d FROM dl) WHERE d <> 0), e AS (SELECT station, round(d, 1) AS d FROM d), r AS (SELECT station, d, rank() OVER (PARTITION BY station ORDER BY abs(d)) + (count(*) OVER (PARTITION BY station, abs(d)) - 1) / 2.0 AS r FROM e)
 SELECT station, count(*) AS n, count(*) FILTER (d > 0) AS n_pos, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_pos, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_neg FROM r GROUP BY 1""")
def _(t: Tables):
    d = B.neighbour(S.daily(t), ["station"], ["day"], {"p": "cm"}).select("station", F.round(F.col("cm") - F.col("p"), 1).alias("d")).where("d is not null")
    return ST.signed_rank(d, ["station"], "d")


@query("agg_two_sample_ks", "AGG-33", f"""WITH {S.LEVELS}, {_AB}, c AS (SELECT station, cm, sum(1 - b) AS a, sum(b) AS b FROM ab GROUP BY 1, 2), f AS (SELECT station, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY station) AS na, sum(b) OVER (PARTITION BY station) AS nb FROM c WINDOW w AS (PARTITION BY station ORDER BY cm))
 SELECT station, round(max(abs(ca::DOUBLE / na::DOUBLE - cb::DOUBLE / nb::DOUBLE)), 6) AS d, CAST(max(na) AS BIGINT) AS na, CAST(max(nb) AS BIGINT) AS nb FROM f GROUP BY 1""")
def _(t: Tables):
    return ST.ks(_ab(t), ["station"], "cm", "b").select("station", r6(F.col("d")).alias("d"), "na", "nb")


@query("agg_confusion", "AGG-34", """WITH c AS (SELECT l_suppkey % 10 AS zone, count(*) FILTER (l_quantity > 20 AND l_discount > 0.04) AS tp, count(*) FILTER (l_quantity > 20 AND NOT l_discount > 0.04) AS fp, count(*) FILTER (NOT l_quantity > 20 AND l_discount > 0.04) AS fn, count(*) FILTER (NOT l_quantity > 20 AND NOT l_discount > 0.04) AS tn, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
 k AS (SELECT *, ((tp+fp)/n)*((tp+fn)/n)+((fn+tn)/n)*((fp+tn)/n) AS pe FROM c) SELECT zone, tp, fp, fn, tn, round(tp/(tp+fp), 6) AS precision, round(tp/(tp+fn), 6) AS recall, round(2*tp/(2*tp+fp+fn), 6) AS f1, round(tp/(tp+fp+fn), 6) AS iou, round(((tp+tn)/n - pe)/(1-pe), 6) AS kappa FROM k""")
def _(t: Tables):
    m = ST.confusion(F.col("l_quantity") > 20, F.col("l_discount") > 0.04)
    g = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("zone")).agg(*[c.alias(n) for n, c in m.items()])
    return g.select("zone", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "iou", "kappa")])


@query("agg_mask_overlap", "AGG-35", f"""WITH {S.CELLS}, a AS (SELECT row, col FROM cl WHERE year <= 1997 GROUP BY 1, 2 HAVING max(water) = 1), b AS (SELECT row, col FROM cl WHERE year > 1997 GROUP BY 1, 2 HAVING max(water) = 1),
 j AS (SELECT a.row IS NOT NULL AS ia, b.row IS NOT NULL AS ib FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col) SELECT count(*) FILTER (ia AND ib) AS n_both, count(*) FILTER (ia) AS n_a, count(*) FILTER (ib) AS n_b, round(count(*) FILTER (ia AND ib)::DOUBLE / count(*), 6) AS iou,
 round(count(*) FILTER (ib AND NOT ia)::DOUBLE / count(*) FILTER (ib), 6) AS omission, round(count(*) FILTER (ia AND NOT ib)::DOUBLE / count(*) FILTER (ia), 6) AS commission, round(100 * count(*) FILTER (ia AND ib)::DOUBLE / count(*) FILTER (ia), 6) AS nesting_pct FROM j""")
def _(t: Tables):
    c = S.cells(t)
    side = lambda cond, n: c.where(cond).groupBy("row", "col").agg(F.max("water").alias("w")).where("w = 1").select("row", "col", F.lit(True).alias(n))
    j = side(F.col("year") <= 1997, "a").join(side(F.col("year") > 1997, "b"), ["row", "col"], "full")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    n, na, nb, nab = F.count(F.lit(1)), F.count_if(a), F.count_if(b), F.count_if(a & b)
    return j.agg(nab.alias("n_both"), na.alias("n_a"), nb.alias("n_b"), r6(nab / n).alias("iou"), r6((nb - nab) / nb).alias("omission"), r6((na - nab) / na).alias("commission"), r6(100 * nab / na).alias("nesting_pct"))


@query("agg_discriminant", "AGG-36", """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, CASE WHEN label < 5 THEN 0 ELSE 1 END AS c FROM embeddings), m AS (SELECT c, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cv FROM e WHERE vec_id % 2 = 0 GROUP BY 1),
 j AS (SELECT x.ma AS a0, y.ma AS a1, x.mb AS b0, y.mb AS b1, (x.va+y.va)/2 AS saa, (x.vb+y.vb)/2 AS sbb, (x.cv+y.cv)/2 AS sab FROM m x, m y WHERE x.c = 0 AND y.c = 1), w AS (SELECT *, (sbb*(a1-a0)-sab*(b1-b0))/(saa*sbb-sab*sab) AS wa, (saa*(b1-b0)-sab*(a1-a0))/(saa*sbb-sab*sab) AS wb FROM j),
 k AS (SELECT wa, wb, (wa*(a0+a1)+wb*(b0+b1))/2 AS cut FROM w) SELECT round(max(wa), 5) AS wa, round(max(wb), 5) AS wb, round(max(cut), 6) AS cut, count(*) AS n_test, count(*) FILTER ((wa*a + wb*b > cut) = (c = 1)) AS n_right FROM e, k WHERE vec_id % 2 = 1""")
def _(t: Tables):
    e = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), (F.col("label") >= 5).cast("int").alias("c"))
    fit = ST.lda_fit(e.where("vec_id % 2 = 0"), [], "a", "b", "c").withColumn("one", F.lit(1))
    test = e.where("vec_id % 2 = 1").withColumn("one", F.lit(1)).join(F.broadcast(fit), "one")
    right = ((F.col("wa") * F.col("a") + F.col("wb") * F.col("b")) > F.col("cut")) == (F.col("c") == 1)
    return test.agg(F.round(F.max("wa"), 5).alias("wa"), F.round(F.max("wb"), 5).alias("wb"), r6(F.max("cut")).alias("cut"), F.count(F.lit(1)).alias("n_test"), F.count_if(right).alias("n_right"))


_NM = """md AS (SELECT station, b, median(cm) AS md, quantile_cont(cm, 0.05) AS p05 FROM ab GROUP BY 1, 2), nm AS (SELECT station, b, max(md) AS md, max(p05) AS p05, 1.4826::DOUBLE * median(abs(cm - md)) AS nm FROM ab JOIN md USING (station, b) GROUP BY 1, 2)"""


@query("agg_separation", "AGG-03", f"""WITH {S.LEVELS}, {_AB}, {_NM}, w AS (SELECT x.station, abs(y.md - x.md) / sqrt(0.5 * (x.nm*x.nm + y.nm*y.nm)) AS s, y.p05 FROM nm x JOIN nm y ON x.station = y.station AND x.b = 0 AND y.b = 1) SELECT ab.station, round(max(s), 6) AS separation, round(avg(CASE WHEN cm > p05 THEN 1.0 ELSE 0 END), 6) AS overlap FROM ab JOIN w USING (station) WHERE b = 0 GROUP BY 1""")
def _(t: Tables):
    return ST.separation(_ab(t), ["station"], "cm", "b").select("station", r6(F.col("separation")).alias("separation"), r6(F.col("overlap")).alias("overlap"))


_HIST = """lim AS (SELECT station, min(cm) AS lo, max(cm) AS hi, count(*) AS total FROM lv GROUP BY 1), hc AS (SELECT station, least(CAST(floor((cm - lo) / (hi - lo) * 256) AS INTEGER), 255) AS bin, count(*) AS n FROM lv JOIN lim USING (station) GROUP BY 1, 2),
 hh AS (SELECT l.station, lo, hi, total, g.bin, coalesce(n, 0) AS n FROM lim l CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) g LEFT JOIN hc ON hc.station = l.station AND hc.bin = g.bin)"""


@query("agg_otsu", "AGG-39", f"""WITH {S.LEVELS}, {_HIST}, e AS (SELECT station, bin, lo + (hi - lo) * bin / 256 AS edge, n::DOUBLE / total AS p FROM hh), c AS (SELECT station, bin, edge, sum(p) OVER w AS om, sum(p * edge) OVER w AS mu, sum(p * edge) OVER (PARTITION BY station) AS mt FROM e WINDOW w AS (PARTITION BY station ORDER BY bin ROWS UNBOUNDED PRECEDING))
 SELECT station, round(arg_max(edge, (round(power(mt*om - mu, 2) / (om*(1-om) + 1e-10), 9), -bin)), 6) AS threshold FROM c GROUP BY 1""")
def _(t: Tables):
    return ST.otsu(S.levels(t), ["station"], "cm").select("station", r6(F.col("threshold")).alias("threshold"))


@query("agg_modality", "AGG-39", f"""WITH {S.LEVELS}, {_HIST}, s AS (SELECT station, bin, sum(n) OVER (PARTITION BY station ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0::DOUBLE AS sm FROM hh), z AS (SELECT station, bin, sm / max(sm) OVER (PARTITION BY station) AS sm FROM s),
 p AS (SELECT *, sm > coalesce(lag(sm) OVER w, -1) AND sm > coalesce(lead(sm) OVER w, -1) AND sm > 0.02 AS pk FROM z WINDOW w AS (PARTITION BY station ORDER BY bin)), k AS (SELECT station, bin, sm, row_number() OVER (PARTITION BY station ORDER BY sm DESC, bin) AS rk FROM p WHERE pk),
 tp AS (SELECT station, count(*) AS n_modes, min(CASE WHEN rk <= 2 THEN bin END) AS b0, max(CASE WHEN rk <= 2 THEN bin END) AS b1, min(CASE WHEN rk <= 2 THEN sm END) AS lp FROM k GROUP BY 1) SELECT tp.station, max(n_modes) AS n_modes, round(CASE WHEN max(n_modes) >= 2 THEN max(lp) - min(sm) ELSE 0 END, 6) AS valley_depth FROM tp JOIN z ON z.station = tp.station AND bin BETWEEN b0 AND b1 GROUP BY 1""")
def _(t: Tables):
    return ST.modality(S.levels(t), ["station"], "cm").select("station", "n_modes", r6(F.col("valley_depth")).alias("valley_depth"))


@query("agg_robust_z", "AGG-40", f"""WITH {S.LEVELS}, md AS (SELECT station, median(cm) AS md, quantile_cont(cm, 0.25) AS q1, quantile_cont(cm, 0.75) AS q3 FROM lv GROUP BY 1), nm AS (SELECT station, 1.4826::DOUBLE * median(abs(cm - md)) AS nm FROM lv JOIN md USING (station) GROUP BY 1)
 SELECT event_id, round((md - cm) / nm, 6) AS z_below, CASE WHEN abs(cm - md) / nm > 6 THEN 1 ELSE 0 END AS anomaly, CASE WHEN cm > q3 + 3 * (q3 - q1) OR cm < q1 - 3 * (q3 - q1) THEN 1 ELSE 0 END AS spike FROM lv JOIN md USING (station) JOIN nm USING (station)""")
def _(t: Tables):
    d = ST.robust_z(S.levels(t), ["station"], "cm", "z")
    q = B.quantiles(S.levels(t), ["station"], "cm", {"q1": 0.25, "q3": 0.75})
    d = d.join(broadcast_if_small(q), "station")
    iqr = 3 * (F.col("q3") - F.col("q1"))
    return d.select("event_id", r6(F.col("z")).alias("z_below"), (F.abs("z") > 6).cast("int").alias("anomaly"), ((F.col("cm") > F.col("q3") + iqr) | (F.col("cm") < F.col("q1") - iqr)).cast("int").alias("spike"))


@query("agg_zone_classes", "AGG-41", f"""WITH {S.LEVELS}, q AS (SELECT event_id, station, CASE WHEN event_id % 13 > 0 THEN cm END AS v, hr FROM lv), c AS (SELECT station, quantile_cont(v, 0.25) AS qm, quantile_cont(v, 0.10) AS qp, quantile_cont(CASE WHEN v IS NOT NULL THEN hr END, 0.25) AS hm FROM q GROUP BY 1)
 SELECT event_id, CASE WHEN v IS NULL THEN 'NOT_ASSESSED' WHEN v <= qp THEN CASE WHEN hr > hm THEN 'MARGINAL' ELSE 'POOR' END WHEN v <= qm THEN 'MARGINAL' ELSE 'GOOD' END AS class FROM q JOIN c USING (station)""")
def _(t: Tables):
    q = S.levels(t).select("event_id", "station", F.when(F.col("event_id") % 13 > 0, F.col("cm")).alias("v"), "hr")
    c = B.quantiles(q, ["station"], "v", {"qm": 0.25, "qp": 0.10}).join(B.quantiles(q.where("v is not null"), ["station"], "hr", {"hm": 0.25}), "station")
    v = F.col("v")
    cls = (F.when(v.isNull(), "NOT_ASSESSED").when((v <= F.col("qp")) & (F.col("hr") > F.col("hm")), "MARGINAL").when(v <= F.col("qp"), "POOR").when(v <= F.col("qm"), "MARGINAL").otherwise("GOOD"))
    return q.join(broadcast_if_small(c), "station").select("event_id", cls.alias("class"))


@query("agg_axis_screen", "AGG-42", f"""WITH {S.LEVELS}, ax AS (SELECT cm, 'hour' AS axis, hr::DOUBLE AS v FROM lv UNION ALL SELECT cm, 'id', (event_id % 97)::DOUBLE FROM lv UNION ALL SELECT cm, 'self', floor(cm / 10) FROM lv), r AS (SELECT axis, cm, v, rank() OVER (PARTITION BY axis ORDER BY cm) + (count(*) OVER (PARTITION BY axis, cm) - 1) / 2.0 AS a, rank() OVER (PARTITION BY axis ORDER BY v) + (count(*) OVER (PARTITION BY axis, v) - 1) / 2.0 AS b FROM ax)
 SELECT axis, round(corr(a, b), 6) AS rho, CASE WHEN abs(corr(a, b)) < 0.5 THEN 1 ELSE 0 END AS kept FROM r GROUP BY 1""")
def _(t: Tables):
    arr = F.array(*[F.struct(F.lit(n).alias("axis"), c.cast("double").alias("v")) for n, c in (("hour", F.col("hr")), ("id", F.col("event_id") % 97), ("self", F.floor(F.col("cm") / 10)))])
    d = S.levels(t).select("cm", F.explode(arr).alias("a")).select("cm", "a.axis", "a.v")
    return ST.spearman(d, ["axis"], "cm", "v").select("axis", r6(F.col("rho")).alias("rho"), (F.abs("rho") < 0.5).cast("int").alias("kept"))


@query("agg_transition_matrix", "AGG-43", f"""WITH {S.CELLS}, a AS (SELECT row, col, max(cls) AS c FROM cl WHERE year <= 1997 GROUP BY 1, 2), b AS (SELECT row, col, max(cls) AS c FROM cl WHERE year > 1997 GROUP BY 1, 2) SELECT coalesce(a.c, 0) AS from_class, coalesce(b.c, 0) AS to_class, round(count(*) * 0.0004, 6)::DOUBLE AS area FROM a JOIN b USING (row, col) GROUP BY 1, 2""")
def _(t: Tables):
    from ..operators.cells import transitions
    c = S.cells(t)
    side = lambda cond: c.where(cond).groupBy("row", "col").agg(F.coalesce(F.max("cls"), F.lit(0)).alias("cls"))
    return transitions(side(F.col("year") <= 1997), side(F.col("year") > 1997), "cls", 0.0004).withColumn("area", r6(F.col("area")))


@query("agg_hypsometry", "AGG-45", f"""WITH {S.SOUNDINGS}, lv AS (SELECT unnest(range(0, 51, 5))::DOUBLE AS h) SELECT h, round(avg(CASE WHEN z < h THEN 1.0 ELSE 0 END), 6) AS area_share, round(avg(greatest(h - z, 0)), 6) AS volume FROM sd, lv GROUP BY 1""")
def _(t: Tables):
    # bed values are pre-counted, so the level grid multiplies distinct depths and not cells
    z = S.soundings(t).groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    g = z.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(5)))).withColumn("h", F.col("h").cast("double"))
    return g.groupBy("h").agg(r6(F.sum(F.when(F.col("z") < F.col("h"), F.col("n")).otherwise(0)) / F.sum("n")).alias("area_share"), r6(F.sum(F.col("n") * F.greatest(F.col("h") - F.col("z"), F.lit(0.0))) / F.sum("n")).alias("volume"))


@query("agg_datum_grid_fit", "AGG-46 M17", f"""WITH {S.SOUNDINGS}, z AS (SELECT z, count(*) AS n FROM sd GROUP BY 1), g AS (SELECT d::DOUBLE AS d, h::DOUBLE AS h FROM (SELECT unnest(range(-5, 6)) AS d), (SELECT unnest(range(0, 51, 5)) AS h)), v AS (SELECT d, h, sum(n * greatest(h + d - z, 0)) / sum(n) AS v FROM g, z GROUP BY 1, 2),
 e AS (SELECT d, sqrt(avg(power(v - h * h / 100, 2))) AS rms FROM v GROUP BY 1) SELECT d, round(rms, 6) AS rms, CASE WHEN d = (SELECT arg_min(d, (rms, d)) FROM e) THEN 1 ELSE 0 END AS best, CASE WHEN rms <= (SELECT min(rms) FROM e) * 1.1 THEN 1 ELSE 0 END AS in_band FROM e""")
def _(t: Tables):
    z = S.soundings(t).groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    g = z.withColumn("d", F.explode(F.sequence(F.lit(-5), F.lit(5)))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(5))))
    v = g.groupBy("d", "h").agg((F.sum(F.col("n") * F.greatest(F.col("h") + F.col("d") - F.col("z"), F.lit(0.0))) / F.sum("n")).alias("v"))
    e = v.groupBy("d").agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("h") * F.col("h") / 100, 2))).alias("rms"))
    best = e.agg(F.min("rms").alias("lo"), F.min_by("d", F.struct("rms", "d")).alias("bd")).withColumn("one", F.lit(1))
    j = e.withColumn("one", F.lit(1)).join(F.broadcast(best), "one")
    return j.select(F.col("d").cast("double").alias("d"), r6(F.col("rms")).alias("rms"), (F.col("d") == F.col("bd")).cast("int").alias("best"), (F.col("rms") <= F.col("lo") * 1.1).cast("int").alias("in_band"))


@query("agg_exposure_by_method", "AGG-47", f"""WITH {S.CELLS}, f AS (SELECT row % 5 AS reach, scl % 4 AS method, avg(CASE WHEN water = 0 THEN 1.0 ELSE 0 END) AS f FROM cl WHERE water IS NOT NULL GROUP BY 1, 2), g AS (SELECT reach, round(median(f), 6) AS med, round(min(f), 6) AS lo, round(max(f), 6) AS hi FROM f GROUP BY 1) SELECT reach, med, lo, hi, coalesce(round(med - lag(med) OVER (ORDER BY reach), 6), 0.0) AS step FROM g""")
def _(t: Tables):
    c = S.cells(t).where("water is not null")
    f = c.groupBy((F.col("row") % 5).alias("reach"), (F.col("scl") % 4).alias("method")).agg(F.avg((F.col("water") == 0).cast("double")).alias("f"))
    g = B.summarise(f, ["reach"], {"lo": r6(F.min("f")), "hi": r6(F.max("f"))}, {"med": ("f", 0.5)}).withColumn("med", r6(F.col("med")))
    g = B.neighbour(g, [], ["reach"], {"p": "med"})
    return g.select("reach", "med", "lo", "hi", F.coalesce(r6(F.col("med") - F.col("p")), F.lit(0.0)).alias("step"))


@query("agg_series_audit", "AGG-50 WIN-11", f"""WITH {S.ASSETS}, y AS (SELECT CAST(year(day) AS INTEGER) AS yr, count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS dup, count(*) FILTER (cents < 0) AS neg, count(*) FILTER (prio IS NULL) AS miss, CAST(sum(cents) AS BIGINT) AS total FROM ast GROUP BY 1) SELECT yr, n, dup, neg, miss, total, coalesce(round(100.0 * (total - lag(total) OVER (ORDER BY yr)) / lag(total) OVER (ORDER BY yr), 6), 0.0) AS pct FROM y""")
def _(t: Tables):
    y = S.assets(t).groupBy(F.year("day").alias("yr")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("dup"), F.count_if(F.col("cents") < 0).alias("neg"), F.count_if(F.col("prio").isNull()).alias("miss"), F.sum("cents").alias("total"))
    y = B.neighbour(y, [], ["yr"], {"p": "total"})
    return y.select("yr", "n", "dup", "neg", "miss", "total", F.coalesce(r6(100.0 * (F.col("total") - F.col("p")) / F.col("p")), F.lit(0.0)).alias("pct"))


@query("agg_duplicate_files", "AGG-51 SNK-04", """WITH f AS (SELECT doc_id, substr(sha256(text), 1, 16) AS sha16 FROM documents), g AS (SELECT sha16, count(*) AS copies, min(doc_id) AS first_id FROM f GROUP BY 1) SELECT doc_id, sha16, copies, first_id FROM f JOIN g USING (sha16)""")
def _(t: Tables):
    f = t.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("sha16"))
    g = f.groupBy("sha16").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return f.join(broadcast_if_small(g), "sha16").select("doc_id", "sha16", "copies", "first_id")


@query("agg_lattice_and_repetition", "AGG-52 AGG-53", f"""WITH {S.SOUNDINGS}, o AS (SELECT median(x) AS mx FROM sd), l AS (SELECT c, round(avg(CASE WHEN least(pmod, c - pmod) <= 1 THEN 1.0 ELSE 0 END), 6) AS share FROM (SELECT c, (((x - mx) % c) + c) % c AS pmod FROM sd, o, (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (100.0::DOUBLE)) AS g(c)) GROUP BY 1),
 v AS (SELECT z, count(*) AS n FROM sd GROUP BY 1), t20 AS (SELECT sum(n) AS s FROM (SELECT n FROM v ORDER BY n DESC, z LIMIT 20)) SELECT c, share, (SELECT count(*) FROM v) AS n_unique, round((SELECT s FROM t20)::DOUBLE / (SELECT sum(n) FROM v)::DOUBLE, 6) AS top20 FROM l""")
def _(t: Tables):
    s = S.soundings(t)
    o = B.quantiles(s, [], "x", {"mx": 0.5}).withColumn("one", F.lit(1))
    d = s.withColumn("one", F.lit(1)).join(F.broadcast(o), "one").withColumn("c", F.explode(F.array(F.lit(10.0), F.lit(25.0), F.lit(100.0))))
    m = F.pmod(F.col("x") - F.col("mx"), F.col("c"))
    l = d.groupBy("c").agg(r6(F.avg((F.least(m, F.col("c") - m) <= 1).cast("double"))).alias("share")).withColumn("one", F.lit(1))
    v = s.groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    top = v.orderBy(F.col("n").desc(), "z").limit(20).agg(F.sum("n").alias("s")).withColumn("one", F.lit(1))
    tot = v.agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("a")).withColumn("one", F.lit(1))
    return l.join(F.broadcast(top), "one").join(F.broadcast(tot), "one").select("c", "share", "n_unique", r6(F.col("s") / F.col("a")).alias("top20"))


@query("agg_station_leave_one_out", "AGG-54 CV-04", f"""WITH {S.LEVELS}, m AS (SELECT station, median(cm) AS c FROM lv GROUP BY 1), p AS (SELECT a.station, a.c, avg(b.c) AS by_mean, arg_min(b.c, (abs(b.station - a.station), b.station)) AS by_near FROM m a JOIN m b ON a.station <> b.station GROUP BY 1, 2) SELECT station, round(c - by_mean, 6) AS e_mean, round(c - by_near, 6) AS e_near FROM p""")
def _(t: Tables):
    from ..operators.holdout import leave_one_out_mean
    m = B.quantiles(S.levels(t), ["station"], "cm", {"c": 0.5})
    p = leave_one_out_mean(m, "station", "c")
    p = B.neighbour(B.neighbour(p, [], ["station"], {"ps": "station", "pc": "c"}), [], ["station"], {"ns": "station", "nc": "c"}, step=1)
    back = F.col("ps").isNotNull() & (F.col("ns").isNull() | (F.col("station") - F.col("ps") <= F.col("ns") - F.col("station")))
    return p.select("station", r6(F.col("c") - F.col("pred")).alias("e_mean"), r6(F.col("c") - F.when(back, F.col("pc")).otherwise(F.col("nc"))).alias("e_near"))


@query("agg_aspect_shift", "AGG-55", f"""WITH {S.SOUNDINGS}, q AS (SELECT src AS station, sin(radians(sid % 360)) AS x, cos(radians(sid % 360)) AS w, z / (1 + sid % 5) AS y FROM sd), {_G2} SELECT station, n, round(sqrt(b1*b1 + b2*b2), 6) AS shift, round(my - b1*mx - b2*mw, 6) AS bias FROM fit""")
def _(t: Tables):
    th = F.radians((F.col("sid") % 360).cast("double"))
    q = S.soundings(t).select(F.col("src").alias("station"), F.sin(th).alias("x"), F.cos(th).alias("w"), (F.col("z") / (1 + F.col("sid") % 5)).alias("y"))
    g = ST.ols_multi(q, ["station"], ["x", "w"], "y")
    return g.select("station", "n", r6(F.hypot("beta1", "beta2")).alias("shift"), r6(F.col("beta0")).alias("bias"))


@query("agg_kruskal", "AGG-30", f"""WITH {S.LEVELS}, r AS (SELECT station, event_type, rank() OVER (PARTITION BY station ORDER BY cm) + (count(*) OVER (PARTITION BY station, cm) - 1) / 2.0 AS r FROM lv), g AS (SELECT station, sum(s*s/k)::DOUBLE AS q, sum(k)::DOUBLE AS n, count(*) AS kk FROM (SELECT station, event_type, sum(r)::DOUBLE AS s, count(*) AS k FROM r GROUP BY 1, 2) GROUP BY 1),
 tt AS (SELECT station, sum(c*c*c - c)::DOUBLE AS tie FROM (SELECT station, cm, count(*) AS c FROM lv GROUP BY 1, 2) GROUP BY 1) SELECT station, CAST(n AS BIGINT) AS n, kk AS k, round((12/(n*(n+1))*q - 3*(n+1)) / (1 - tie/(n*n*n - n)), 6) AS h FROM g JOIN tt USING (station)""")
def _(t: Tables):
    return ST.kruskal(S.levels(t), ["station"], "event_type", "cm").select("station", "n", "k", r6(F.col("h")).alias("h"))


@query("agg_block_residual_map", "AGG-57", f"""WITH {S.SOUNDINGS} SELECT CAST(floor(x / 2000) AS BIGINT) AS bx, CAST(floor(y / 2000) AS BIGINT) AS by_, count(*) AS n, round(median(z - 25), 6) AS med FROM sd GROUP BY 1, 2""")
def _(t: Tables):
    s = S.soundings(t).select(F.floor(F.col("x") / 2000).alias("bx"), F.floor(F.col("y") / 2000).alias("by_"), (F.col("z") - 25).alias("r"))
    return B.summarise(s, ["bx", "by_"], {"n": F.count(F.lit(1))}, {"med": ("r", 0.5)}).withColumn("med", r6(F.col("med")))


@query("agg_scenarios", "AGG-59", f"""WITH {S.LEVELS}, {S.DAILY}, {_boot_sql(16, 'dl', 'station', 'day', 'cm')}, q AS (SELECT station, quantile_cont(med, 0.025) AS lo, quantile_cont(med, 0.975) AS hi FROM md GROUP BY 1) SELECT station, ref, CASE WHEN lo - ref <= 0 AND hi - ref >= 0 THEN 1 ELSE 0 END AS has_zero, round(lo - ref, 6) AS lo, round(hi - ref, 6) AS hi FROM q, (VALUES (40.0::DOUBLE), (50.0::DOUBLE), (60.0::DOUBLE)) AS g(ref)""")
def _(t: Tables):
    q = RS.boot_median(S.daily(t), ["station"], "cm", ["day"], REPS, 16).withColumn("ref", F.explode(F.array(F.lit(40.0), F.lit(50.0), F.lit(60.0))))
    lo, hi = F.col("ci_lo") - F.col("ref"), F.col("ci_hi") - F.col("ref")
    return q.select("station", "ref", ((lo <= 0) & (hi >= 0)).cast("int").alias("has_zero"), r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("agg_envelope_check", "AGG-61", f"""WITH {S.LEVELS}, {S.POINTS}, g AS (SELECT CAST(floor(chain / 48) AS BIGINT) AS reach, quantile_cont(h, 0.05) AS lo, quantile_cont(h, 0.95) AS hi FROM pt GROUP BY 1) SELECT reach, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN greatest(lo, 0.1 * reach) <= least(hi, 0.1 * reach + 0.5) THEN 1 ELSE 0 END AS overlaps FROM g""")
def _(t: Tables):
    p = S.points(t).withColumn("reach", F.floor(F.col("chain") / 48))
    g = B.quantiles(p, ["reach"], "h", {"lo": 0.05, "hi": 0.95})
    ok = F.greatest(F.col("lo"), 0.1 * F.col("reach")) <= F.least(F.col("hi"), 0.1 * F.col("reach") + 0.5)
    return g.select("reach", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), ok.cast("int").alias("overlaps"))


@query("agg_version_invariants", "AGG-62", f"""WITH {S.CELLS}, a AS (SELECT row, col, max(cls) AS c, max(qty) AS z FROM cl WHERE year <= 1997 GROUP BY 1, 2), b AS (SELECT row, col, max(cls) AS c, max(qty) AS z FROM cl WHERE year > 1997 GROUP BY 1, 2) SELECT count(*) AS n, count(*) FILTER (b.c = 1 AND a.c <> 1) AS class1_grew, count(*) FILTER (a.c = 7 AND b.c = 7 AND a.z <> b.z) AS class7_moved, count(*) FILTER (abs(a.z - b.z) > 20) AS big_step FROM a JOIN b USING (row, col)""")
def _(t: Tables):
    c = S.cells(t)
    side = lambda cond, s: c.where(cond).groupBy("row", "col").agg(F.max("cls").alias(f"c{s}"), F.max("qty").alias(f"z{s}"))
    j = side(F.col("year") <= 1997, "a").join(side(F.col("year") > 1997, "b"), ["row", "col"])
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("cb") == 1) & (F.col("ca") != 1)).alias("class1_grew"), F.count_if((F.col("ca") == 7) & (F.col("cb") == 7) & (F.col("za") != F.col("zb"))).alias("class7_moved"), F.count_if(F.abs(F.col("za") - F.col("zb")) > 20).alias("big_step"))


@query("agg_coverage_matrix", "AGG-63", """WITH pr AS (SELECT s_suppkey AS product, s_suppkey * 900 % 90000 AS w, s_nationkey * 2000 AS s FROM supplier), dm AS (SELECT r_regionkey AS domain, r_regionkey * 20000 AS w FROM region),
 o AS (SELECT product, domain, greatest(0, least(pr.w + 12000, dm.w + 15000) - greatest(pr.w, dm.w))::DOUBLE * greatest(0, least(pr.s + 30000, 60000) - pr.s)::DOUBLE / 9e8 AS share FROM pr, dm)
 SELECT product, domain, round(share, 6) AS share, CASE WHEN share >= 0.4 THEN 'full' WHEN share > 0 THEN 'partial' ELSE 'gap' END AS status FROM o""")
def _(t: Tables):
    p = t.supplier.select(F.col("s_suppkey").alias("product"), (F.col("s_suppkey") * 900 % 90000).alias("w"), (F.col("s_nationkey") * 2000).alias("s"))
    # the domain list has five fixed entries by construction of the zones, packed into one array
    dm = t.region.agg(F.collect_list("r_regionkey").alias("ds")).withColumn("one", F.lit(1))
    o = p.withColumn("one", F.lit(1)).join(F.broadcast(dm), "one").withColumn("domain", F.explode("ds"))
    dw = F.col("domain") * 20000
    ox = F.greatest(F.lit(0), F.least(F.col("w") + 12000, dw + 15000) - F.greatest(F.col("w"), dw))
    oy = F.greatest(F.lit(0), F.least(F.col("s") + 30000, F.lit(60000)) - F.col("s"))
    sh = ox.cast("double") * oy.cast("double") / 9e8
    return o.select("product", "domain", r6(sh).alias("share"), F.when(sh >= 0.4, "full").when(sh > 0, "partial").otherwise("gap").alias("status"))
