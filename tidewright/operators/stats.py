"""Grouped statistics.  Sums, moments and ranks are aggregates; quantiles go through ``blocks``."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, few_rows
from . import blocks as B

NMAD_SCALE = 1.4826       # fixed value: median absolute deviation to standard deviation


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return a.join(broadcast_if_small(b), list(keys), "left")
    return a.withColumn("__one", F.lit(1)).join(F.broadcast(b.withColumn("__one", F.lit(1))), "__one").drop("__one")


def nmad(df: DataFrame, keys: Sequence[str], value: str, out: str = "nmad", times: str | None = None) -> DataFrame:
    src = df.select(*keys, value, *([times] if times else []))
    dev = B.attach_median(src, keys, value, "__med", times).withColumn("__d", F.abs(F.col(value) - F.col("__med")))
    q = B.quantiles(dev, keys, "__d", {"__m": 0.5}, times)
    return q.select(*keys, (F.col("__m") * NMAD_SCALE).alias(out))


def residual_stats(df: DataFrame, keys: Sequence[str], value: str, within: float = 0.10) -> DataFrame:
    """n, median, NMAD, MAE, RMSE and the share within a tolerance, one row per group."""
    v = F.col(value)
    wide = B.summarise(df, keys, {
        "n": F.count(v), "mae": F.avg(F.abs(v)), "rmse": F.sqrt(F.avg(v * v)),
        "within_pct": 100 * F.avg((F.abs(v) <= within).cast("double")),
    }, {"median": (value, 0.5)})
    return _join(wide, nmad(df, keys, value), keys)


def accuracy(df: DataFrame, keys: Sequence[str], value: str, min_n: int, tail: float = -5.0) -> DataFrame:
    """LE90, LE95, worst error and tail share; below ``min_n`` only n is reported."""
    src = df.withColumn("__a", F.abs(F.col(value)))
    out = B.summarise(src, keys, {
        "n": F.count(value), "worst": F.max("__a"), "tail_share": F.avg((F.col(value) < tail).cast("double"))},
        {"le90": ("__a", 0.90), "le95": ("__a", 0.95)})
    return out.select(*keys, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c)
                                    for c in ("le90", "le95", "worst", "tail_share")])


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Line, r2 and the NMAD of its residuals."""
    fit = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                                F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    res = _join(df, fit, keys).withColumn("__r", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    return _join(fit, nmad(res, keys, "__r", "resid_nmad"), keys)


def deming(df: DataFrame, keys: Sequence[str], x: str, y: str, lam: float = 1.0) -> DataFrame:
    m = df.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("sxx"),
                              F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"))
    d = F.col("syy") - lam * F.col("sxx")
    m = m.withColumn("slope", (d + F.sqrt(d * d + 4 * lam * F.col("sxy") * F.col("sxy"))) / (2 * F.col("sxy")))
    return m.select(*keys, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho") -> DataFrame:
    r = B.tied_rank(B.tied_rank(df.select(*keys, x, y), keys, x, "__rx"), keys, y, "__ry")
    return r.groupBy(*keys).agg(F.corr("__rx", "__ry").alias(out))


def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Cross products of the design columns (with an intercept) and the response, one row per group."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(a * F.col(y)).alias(f"b{i}"))
        aggs += [F.sum(a * cols[j]).alias(f"g{i}_{j}") for j in range(i, len(cols))]
    return df.groupBy(*keys).agg(*aggs)


def _solve_rows(sums: DataFrame, keys: Sequence[str], k: int, inverse: bool) -> DataFrame:
    names = [f"beta{i}" for i in range(k)] + ([f"h{i}_{j}" for i in range(k) for j in range(i, k)] if inverse else [])
    schema = T.StructType([sums.schema[c] for c in [*keys, "n"]] + [T.StructField("rank", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in names])

    def solve(batches):
        for pdf in batches:
            g = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    g[:, i, j] = g[:, j, i] = pdf[f"g{i}_{j}"].to_numpy(float)
            b = pdf[[f"b{i}" for i in range(k)]].to_numpy(float)
            scale = np.sqrt(np.einsum("nii->ni", g))
            scale[~(scale > 0)] = 1.0
            rank = np.linalg.matrix_rank(g / (scale[:, :, None] * scale[:, None, :]), tol=1e-10, hermitian=True) if len(pdf) else np.zeros(0, int)
            bad = rank < k
            g[bad] = np.eye(k)
            inv = np.linalg.inv(g)
            beta = np.einsum("nij,nj->ni", inv, b)
            beta[bad] = np.nan
            out = {c: pdf[c] for c in [*keys, "n"]} | {"rank": rank.astype(np.int64)}
            out |= {f"beta{i}": beta[:, i] for i in range(k)}
            if inverse:
                out |= {f"h{i}_{j}": inv[:, i, j] for i in range(k) for j in range(i, k)}
            yield pd.DataFrame(out)

    return sums.mapInPandas(solve, schema)


def ols_multi(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, robust: bool = False) -> DataFrame:
    """Least squares on several columns: one aggregate for the sums, a batched tiny solve, and with ``robust`` a second
    pass for the leverages of the HC3 standard errors."""
    k = len(xs) + 1
    fit = _solve_rows(gram(df, keys, xs, y), keys, k, robust)
    if not robust:
        return fit
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    rows = _join(df, fit, keys)
    h = lambda i, j: F.col(f"h{min(i, j)}_{max(i, j)}")
    dot = lambda i: sum((h(i, j) * cols[j] for j in range(1, k)), h(i, 0) * cols[0])
    pred = sum((F.col(f"beta{i}") * cols[i] for i in range(1, k)), F.col("beta0") * cols[0])
    rows = rows.select(*keys, *[dot(i).alias(f"__z{i}") for i in range(k)], (F.col(y) - pred).alias("__e"),
                       sum((dot(i) * cols[i] for i in range(1, k)), dot(0) * cols[0]).alias("__lev"))
    scaled = F.col("__e") / (1 - F.col("__lev"))
    se = rows.groupBy(*keys).agg(*[F.sqrt(F.sum(F.pow(F.col(f"__z{i}") * scaled, 2))).alias(f"se{i}") for i in range(k)])
    return _join(fit.select(*keys, "n", "rank", *[f"beta{i}" for i in range(k)]), se, keys)


#: Levels that a category may have as dummies of a design.
MOST_LEVELS = 50


def design(df: DataFrame, numeric: Sequence[str], interactions: Sequence[tuple[str, str]] = (), categories: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Columns of a linear model: numbers, products of two columns, and a dummy for each level of a category but its first (the reference).

    Returns the rows with the columns added and {term: column}; terms are ``x``, ``x:w`` and ``category=level``."""
    terms = {c: c for c in numeric}
    for c in categories:
        levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect())
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
        for k, level in enumerate(levels[1:]):
            df = df.withColumn(f"__{c}_{k}", (F.col(c) == level).cast("double"))
            terms[f"{c}={level}"] = f"__{c}_{k}"
    for a, b in interactions:
        df = df.withColumn(f"__{a}_x_{b}", F.col(terms.get(a, a)) * F.col(terms.get(b, b)))
        terms[f"{a}:{b}"] = f"__{a}_x_{b}"
    return df, terms


def ols_design(df: DataFrame, keys: Sequence[str], y: str, numeric: Sequence[str], interactions: Sequence[tuple[str, str]] = (), categories: Sequence[str] = ()) -> DataFrame:
    """``keys, n, rank, term, beta, se``: a linear model per group with HC3 errors, one row a term; NULL where the group's columns are
    linearly dependent (``rank`` below the number of terms).  Rows with a missing value take no part."""
    keys = list(keys)
    rows, terms = design(df, numeric, interactions, categories)
    for c in [y, *numeric, *categories]:
        rows = rows.where(F.col(c).isNotNull())
    fit = ols_multi(rows, keys, list(terms.values()), y, robust=True)
    k, names = len(terms) + 1, ["intercept", *terms]
    whole = F.col("rank") == k
    lines = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.when(whole, F.col(f"beta{i}")).alias("beta"), F.when(whole, F.col(f"se{i}")).alias("se")) for i, n in enumerate(names)]))
    return fit.select(*keys, "n", "rank", lines.alias("t")).select(*keys, "n", "rank", "t.*")


def planar_residual(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str, out: str, soft_scale: float | None = None,
                    passes: int = 5) -> DataFrame:
    """Residual from a plane; with ``soft_scale`` large residuals are down-weighted as 1/sqrt(1+(r/s)^2) in fixed passes."""
    rows = df.withColumn("__w", F.lit(1.0))
    for i in range(passes if soft_scale else 1):
        w = F.col("__w")
        cols = [F.lit(1.0), F.col(x), F.col(y)]
        aggs = [F.count(F.lit(1)).alias("n")]
        for a in range(3):
            aggs.append(F.sum(w * cols[a] * F.col(z)).alias(f"b{a}"))
            aggs += [F.sum(w * cols[a] * cols[b]).alias(f"g{a}_{b}") for b in range(a, 3)]
        fit = few_rows(_solve_rows(rows.groupBy(*keys).agg(*aggs), keys, 3, False).drop("n"))
        rows = _join(rows.drop(out), fit, keys)
        rows = rows.withColumn(out, F.col(z) - F.col("beta0") - F.col("beta1") * F.col(x) - F.col("beta2") * F.col(y))
        if soft_scale:
            rows = rows.withColumn("__w", 1 / F.sqrt(1 + F.pow(F.col(out) / soft_scale, 2)))
        rows = rows.drop("beta0", "beta1", "beta2")
    return rows.drop("__w")


def n_eff(df: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str) -> DataFrame:
    """Effective sample size n (1 - r1 r2) / (1 + r1 r2) from the lag-1 autocorrelations of two series."""
    lagged = B.neighbour(df, keys, order, {"__a": a, "__b": b})
    g = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), F.corr(a, "__a").alias("r1"),
                                  F.corr(b, "__b").alias("r2"))
    p = F.col("r1") * F.col("r2")
    return g.withColumn("n_eff", F.col("n") * (1 - p) / (1 + p))


def rank_sum(df: DataFrame, keys: Sequence[str], value: str, is_b: str) -> DataFrame:
    """Mann-Whitney U of sample b, Cliff's delta, the rank AUC and the tie-corrected normal score."""
    r = B.tied_rank(df.select(*keys, value, is_b), keys, value, "__r")
    g = r.groupBy(*keys).agg(F.sum(F.col(is_b).cast("long")).alias("nb"), F.count(F.lit(1)).alias("n"),
                             F.sum(F.when(F.col(is_b).cast("int") == 1, F.col("__r"))).alias("rb"))
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__t"))
    ties = ties.groupBy(*keys).agg(F.sum(F.pow("__t", 3) - F.col("__t")).alias("tie"))
    g = _join(g, ties, keys).withColumn("na", F.col("n") - F.col("nb"))
    g = g.withColumn("u", F.col("rb") - F.col("nb") * (F.col("nb") + 1) / 2)
    g = g.withColumn("auc", F.col("u") / (F.col("na") * F.col("nb"))).withColumn("cliff", 2 * F.col("auc") - 1)
    sd = F.sqrt(F.col("na") * F.col("nb") / 12.0 * (F.col("n") + 1 - F.col("tie") / (F.col("n") * (F.col("n") - 1))))
    return g.withColumn("z", (F.col("u") - F.col("na") * F.col("nb") / 2) / sd).select(
        *keys, "na", "nb", "u", "auc", "cliff", "z")


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; the engine has no error function."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else float("nan"))


def ks(df: DataFrame, keys: Sequence[str], value: str, is_b: str) -> DataFrame:
    """Largest gap between two empirical distribution functions, on distinct values."""
    keys = list(keys)
    c = df.groupBy(*keys, value).agg(F.sum(F.col(is_b).cast("long")).alias("__b"), F.count(F.lit(1)).alias("__n"))
    c = c.withColumn("__a", F.col("__n") - F.col("__b"))
    tot = c.groupBy(*keys).agg(F.sum("__a").alias("na"), F.sum("__b").alias("nb"))
    c = B.running_sum(c, keys, [value], F.col("__a"), "__ca")
    c = B.running_sum(c, keys, [value], F.col("__b"), "__cb")
    c = _join(c, tot, keys).where("na > 0 and nb > 0")
    return c.groupBy(*keys).agg(F.max(F.abs(F.col("__ca") / F.col("na") - F.col("__cb") / F.col("nb"))).alias("d"),
                                F.max("na").alias("na"), F.max("nb").alias("nb"))


def signed_rank(df: DataFrame, keys: Sequence[str], diff: str) -> DataFrame:
    """Sign counts and Wilcoxon's W+ and W- (zeros dropped, average ranks)."""
    d = df.where(F.col(diff) != 0).select(*keys, diff, F.abs(diff).alias("__a"))
    r = B.tied_rank(d, keys, "__a", "__r")
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(diff) > 0).alias("n_pos"),
        F.sum(F.when(F.col(diff) > 0, F.col("__r")).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(F.col(diff) < 0, F.col("__r")).otherwise(0.0)).alias("w_neg"))


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, and the number of groups."""
    r = B.tied_rank(df.select(*keys, group, value), keys, value, "__r")
    g = r.groupBy(*keys, group).agg(F.sum("__r").alias("__s"), F.count(F.lit(1)).alias("__n"))
    g = g.groupBy(*keys).agg(F.sum(F.col("__s") * F.col("__s") / F.col("__n")).alias("__q"), F.sum("__n").alias("n"),
                             F.count(F.lit(1)).alias("k"))
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__t"))
    ties = ties.groupBy(*keys).agg(F.sum(F.pow("__t", 3) - F.col("__t")).alias("tie"))
    n = F.col("n")
    g = _join(g, ties, keys)
    h = (12 / (n * (n + 1)) * F.col("__q") - 3 * (n + 1)) / (1 - F.col("tie") / (F.pow(n, 3) - n))
    return g.select(*keys, "n", "k", h.alias("h"))


def chi2_tail(x: Column, df: Column, terms: int = 400) -> Column:
    """Upper tail of the chi-square distribution with whole ``df``: the incomplete gamma function by its series below a + 1, by its
    continued fraction above; ``terms`` serve up to some thousand degrees of freedom."""
    a, z = df.cast("double") / 2, x.cast("double") / 2
    half = df % 2 == 1
    steps = F.sequence(F.lit(1), F.lit(terms))
    # gamma of a whole or half number, from 1 or the root of pi upwards
    up = F.when(df > 2, F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((df - 1) / 2)).cast("int"))).otherwise(F.array().cast("array<int>"))
    log_gamma = F.aggregate(up, F.when(half, F.lit(0.5 * np.log(np.pi))).otherwise(F.lit(0.0)), lambda s, i: s + F.log(i - F.when(half, 0.5).otherwise(0.0)))
    scale = F.exp(a * F.log(z) - z - log_gamma)
    series = F.aggregate(steps, F.struct((1 / a).alias("t"), (1 / a).alias("s")),
                         lambda acc, i: F.struct((acc["t"] * z / (a + i)).alias("t"), (acc["s"] + acc["t"] * z / (a + i)).alias("s")), lambda acc: acc["s"])
    b0 = z + 1 - a

    def lentz(acc, i):
        an, b = -i * (i - a), acc["b"] + 2
        d = 1 / (an * acc["d"] + b)
        c = b + an / acc["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    fraction = F.aggregate(steps, F.struct(b0.alias("b"), F.lit(1e300).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h")), lentz, lambda acc: acc["h"])
    return F.when(z <= 0, 1.0).when(z < a + 1, 1 - scale * series).otherwise(scale * fraction)


def offset_stability(scenes: DataFrame, groupings: Sequence[str], centre: str, spread: str, alpha: float = 0.05, most_ratio: float = 1.5) -> DataFrame:
    """One row a grouping: Kruskal-Wallis of the scenes' medians across its groups of two and more, its p and whether groups differ;
    between-scene spread against the median spread within scenes; and what that says of a common offset (PER_GROUP, CONSTANT, NO_CONSTANT)."""
    tests = None
    for g in groupings:
        several = scenes.groupBy(F.col(g).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        rows = scenes.join(broadcast_if_small(several), F.col(g) == F.col("__g")).select(F.lit(g).alias("grouping"), F.col("__g").cast("string").alias("grp"), centre)
        tests = rows if tests is None else tests.unionByName(rows)
    h = kruskal(tests, ["grouping"], "grp", centre)
    h = h.withColumn("p", chi2_tail(F.col("h"), F.col("k") - 1)).withColumn("structured", F.col("p") < alpha)
    s = B.summarise(scenes, [], {"between": F.max(centre) - F.min(centre)}, {"within": (spread, 0.5)}).withColumn("ratio", F.col("between") / F.col("within"))
    any_ = h.agg(F.max("structured").alias("any"))
    verdict = F.when(F.col("any"), "PER_GROUP").when(F.col("ratio") < most_ratio, "CONSTANT").otherwise("NO_CONSTANT")
    one = lambda d: F.broadcast(d.withColumn("__one", F.lit(1)))  # aggregates of one row
    return h.withColumn("__one", F.lit(1)).join(one(s), "__one").join(one(any_), "__one").withColumn("verdict", verdict).drop("__one", "any")


def confusion(pred: Column, truth: Column) -> dict[str, Column]:
    """Aggregates of a binary comparison; combine in one ``agg``."""
    tp, fp = F.count_if(pred & truth), F.count_if(pred & ~truth)
    fn, tn = F.count_if(~pred & truth), F.count_if(~pred & ~truth)
    n = tp + fp + fn + tn
    expect = ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "iou": F.try_divide(tp, tp + fp + fn), "kappa": F.try_divide((tp + tn) / n - expect, 1 - expect)}


def lda_fit(df: DataFrame, keys: Sequence[str], a: str, b: str, cls: str) -> DataFrame:
    """Two-channel linear discriminant between class 0 and class 1, with the cut at the midpoint of projected means."""
    m = df.groupBy(*keys).agg(*[
        f(F.when(F.col(cls) == c, F.col(v))).alias(f"{n}{v_i}{c}")
        for c in (0, 1) for v_i, v in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp))
    ], *[F.covar_samp(F.when(F.col(cls) == c, F.col(a)), F.when(F.col(cls) == c, F.col(b))).alias(f"c{c}") for c in (0, 1)])
    saa, sbb = (F.col("va0") + F.col("va1")) / 2, (F.col("vb0") + F.col("vb1")) / 2
    sab = (F.col("c0") + F.col("c1")) / 2
    da, db = F.col("ma1") - F.col("ma0"), F.col("mb1") - F.col("mb0")
    det = saa * sbb - sab * sab
    m = m.withColumn("wa", (sbb * da - sab * db) / det).withColumn("wb", (saa * db - sab * da) / det)
    mid = (F.col("wa") * (F.col("ma0") + F.col("ma1")) + F.col("wb") * (F.col("mb0") + F.col("mb1"))) / 2
    return m.select(*keys, "wa", "wb", mid.alias("cut"))


def separation(df: DataFrame, keys: Sequence[str], value: str, is_b: str) -> DataFrame:
    """Robust distance of two samples in pooled NMAD units, and the share of a above the 5th percentile of b."""
    keys = list(keys)
    both = [*keys, is_b]
    q = _join(B.quantiles(df, both, value, {"med": 0.5, "p05": 0.05}), nmad(df, both, value), both)
    side = lambda s, c: F.max(F.when(F.col(is_b).cast("int") == s, F.col(c)))
    w = q.groupBy(*keys).agg(side(0, "med").alias("ma"), side(1, "med").alias("mb"), side(0, "nmad").alias("sa"),
                             side(1, "nmad").alias("sb"), side(1, "p05").alias("b05"))
    share = _join(df.where(F.col(is_b).cast("int") == 0), w.select(*keys, "b05"), keys).groupBy(*keys).agg(
        F.avg((F.col(value) > F.col("b05")).cast("double")).alias("overlap"))
    pooled = F.sqrt(0.5 * (F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")))
    return _join(w, share, keys).select(*keys, F.try_divide(F.abs(F.col("mb") - F.col("ma")), pooled).alias("separation"), "overlap")


def decision_quality(df: DataFrame, keys: Sequence[str], value: str, is_b: str) -> DataFrame:
    """Two anchor samples about the middle of their medians: effect size and overlap in the mean of both NMADs, the share of all rows
    nearer to the decision than that scale, and the share of each sample on the wrong side."""
    keys = list(keys)
    both = [*keys, is_b]
    q = _join(B.quantiles(df, both, value, {"med": 0.5, "p05": 0.05, "p95": 0.95}), nmad(df, both, value), both)
    side = lambda s, c: F.max(F.when(F.col(is_b).cast("int") == s, F.col(c)))
    w = q.groupBy(*keys).agg(*[side(s, c).alias(f"{c}{s}") for s in (0, 1) for c in ("med", "p05", "p95", "nmad")])
    w = w.withColumn("scale", 0.5 * (F.col("nmad0") + F.col("nmad1"))).withColumn("at", 0.5 * (F.col("med0") + F.col("med1")))
    v, up = F.col(value), F.col("med1") > F.col("med0")
    wrong = F.when(F.col(is_b).cast("int") == 1, (v < F.col("at")) == up).otherwise((v > F.col("at")) == up) & (v != F.col("at"))
    share = lambda cond, s=None: F.avg((cond if s is None else F.when(F.col(is_b).cast("int") == s, cond)).cast("double"))
    n = _join(df, w.select(*keys, "scale", "at", "med0", "med1"), keys).groupBy(*keys).agg(
        share(F.abs(v - F.col("at")) < F.col("scale")).alias("near_decision"), share(wrong, 0).alias("wrong_a"), share(wrong, 1).alias("wrong_b"))
    overlap = F.when(F.col("med1") > F.col("med0"), F.col("p950") - F.col("p051")).otherwise(F.col("p951") - F.col("p050"))
    return _join(w, n, keys).select(*keys, F.try_divide(F.abs(F.col("med1") - F.col("med0")), F.col("scale")).alias("effect_size"), F.try_divide(overlap, F.col("scale")).alias("overlap_norm"),
                                    "near_decision", "wrong_a", "wrong_b")


def otsu_log(df: DataFrame, keys: Sequence[str], value: str, least: int = 1, bins: int = 256) -> DataFrame:
    """Otsu threshold over equal bins of the decimal logarithm, back on the value's own scale; NULL below ``least`` positive values."""
    rows = df.where(F.col(value) > 0).withColumn("__log", F.log10(value))
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    t = otsu(rows, keys, "__log", bins)
    return _join(enough, t, keys).select(*keys, "n", F.when(F.col("n") >= least, F.pow(F.lit(10.0), F.col("threshold"))).alias("threshold"))


def decompose(df: DataFrame, value: str, axes: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """What a residual hangs on: ``axis, bin, n, median, nmad`` by bins (upper edges in) of each candidate axis and, per axis, Spearman's
    rank correlation ``rho``.  ``axes`` names for each axis its column and inner edges."""
    one = F.array(*[F.struct(F.lit(n).alias("axis"), F.col(c).cast("double").alias("v"), sum((F.col(c) > e).cast("int") for e in edges).alias("bin"))
                    for n, (c, edges) in axes.items()])
    rows = df.select(value, F.explode(one).alias("a")).select(value, "a.*").where(F.col("v").isNotNull())
    rho = spearman(rows, ["axis"], value, "v")
    g = _join(B.summarise(rows, ["axis", "bin"], {"n": F.count(F.lit(1))}, {"median": (value, 0.5)}), nmad(rows, ["axis", "bin"], value), ["axis", "bin"])
    return g.join(broadcast_if_small(rho), "axis")


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins between each group's extremes, with empty bins kept."""
    keys = list(keys)
    lim = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    lim = lim.where("hi > lo")
    rows = _join(df.select(*keys, value), lim, keys).where("hi > lo")
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    cnt = rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = lim.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return full.join(cnt, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def otsu(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Between-class variance maximum over a histogram; the window runs over bins, never over rows."""
    from pyspark.sql.window import Window as W
    h = histogram(df, keys, value, bins)
    edge = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins
    p = F.col("n") / F.col("total")
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    h = h.withColumn("edge", edge).withColumn("omega", F.sum(p).over(w)).withColumn("mu", F.sum(p * F.col("edge")).over(w))
    h = h.withColumn("mu_t", F.sum(p * F.col("edge")).over(whole))
    s = F.pow(F.col("mu_t") * F.col("omega") - F.col("mu"), 2) / (F.col("omega") * (1 - F.col("omega")) + 1e-10)
    return h.withColumn("s", s).groupBy(*keys).agg(F.max_by("edge", F.struct("s", -F.col("bin"))).alias("threshold"))


def modality(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256, half: int = 4) -> DataFrame:
    """Number of separated histogram modes and the depth of the valley between the two largest."""
    from pyspark.sql.window import Window as W
    h = histogram(df, keys, value, bins)
    w = W.partitionBy(*keys).orderBy("bin")
    h = h.withColumn("sm", F.sum("n").over(w.rowsBetween(-half, half)) / (2.0 * half + 1))
    h = h.withColumn("sm", F.col("sm") / F.max("sm").over(W.partitionBy(*keys)))
    h = h.withColumn("peak", (F.col("sm") > F.coalesce(F.lag("sm").over(w), F.lit(-1.0)))
                     & (F.col("sm") > F.coalesce(F.lead("sm").over(w), F.lit(-1.0))) & (F.col("sm") > 0.02))
    h = h.withColumn("rk", F.when(F.col("peak"), F.row_number().over(
        W.partitionBy(*keys, "peak").orderBy(F.col("sm").desc(), "bin"))))
    top = h.groupBy(*keys).agg(F.count_if("peak").cast("long").alias("n_modes"),
                               F.min(F.when(F.col("rk") <= 2, F.col("bin"))).alias("b0"),
                               F.max(F.when(F.col("rk") <= 2, F.col("bin"))).alias("b1"),
                               F.min(F.when(F.col("rk") <= 2, F.col("sm"))).alias("low_peak"))
    inner = _join(h.select(*keys, "bin", "sm"), top, keys).where(F.col("bin").between(F.col("b0"), F.col("b1")))
    out = inner.groupBy(*keys).agg(F.max("n_modes").alias("n_modes"), F.max("low_peak").alias("lp"), F.min("sm").alias("v"))
    return out.select(*keys, "n_modes", F.when(F.col("n_modes") >= 2, F.col("lp") - F.col("v")).otherwise(0.0).alias("valley_depth"))


def robust_z(df: DataFrame, keys: Sequence[str], value: str, out: str, below: bool = True) -> DataFrame:
    """Deviation below the median (or both sides) in NMAD units; 0 when the spread is 0."""
    rows = B.attach_median(df, keys, value, "__med")
    rows = _join(rows, nmad(df, keys, value, "__mad"), keys)
    dev = F.col("__med") - F.col(value) if below else F.col(value) - F.col("__med")
    return rows.withColumn(out, F.when(F.col("__mad") > 0, dev / F.col("__mad")).otherwise(0.0)).drop("__med", "__mad")
