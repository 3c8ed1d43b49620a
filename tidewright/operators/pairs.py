"""Exact order statistics over all pairs of a group, without emitting the pairs.

Theil-Sen, Passing-Bablok and Hodges-Lehmann need chosen ranks of a value computed for every pair of rows.  A group
of at most ``WHOLE`` rows is settled in one task in n log n steps: pairs at or below a trial value are counted by sorting
(a slope is at most t where y - t x falls), the trial is narrowed, and the few pairs left are compared as computed.
A larger group is cut into chunks of at most ``CHUNK`` rows; each unordered pair of chunks is one unit of work, so no task
holds more than two chunks, and is settled by radix selection:
every unit returns a histogram of the next 16 bits of its values (at most 65,536 counts), the histograms are added by
a shuffle, the digit that holds the wanted rank is kept, and four rounds fix all 64 bits of the answer.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import broadcast_if_small, cut_lineage
from . import blocks as B

CHUNK = 4096
WHOLE = 2_000_000
STRIP = 256
FEW = 500_000               # pairs that a trial interval may hold before they are listed
Z95 = 1.959963984540054     # fixed value: two-sided 95 % normal quantile


def _values(pdf: pd.DataFrame, kind: str) -> Iterator[np.ndarray]:
    """All pair values of one unit, strip by strip.  ``u < v`` pairs the two chunks; ``u = v`` pairs a chunk with itself."""
    if kind == "shift":                              # b - a over the two samples
        a = pdf.loc[pdf["__s"] == 0, "__y"].to_numpy()
        b = pdf.loc[pdf["__s"] == 1, "__y"].to_numpy()
        for i in range(0, len(a), STRIP):
            yield (b[None, :] - a[i : i + STRIP, None]).ravel()
        return
    own = pdf["__u"].iloc[0] == pdf["__v"].iloc[0]
    left = pdf[pdf["__s"] == pdf["__u"]]
    right = pdf[pdf["__s"] == pdf["__v"]]
    x1, y1 = left["__x"].to_numpy(), left["__y"].to_numpy()
    x2, y2 = right["__x"].to_numpy(), right["__y"].to_numpy()
    for a in range(0, len(x1), STRIP):               # strips keep the work arrays small
        b = min(a + STRIP, len(x1))
        dx, dy = x2[None, :] - x1[a:b, None], y2[None, :] - y1[a:b, None]
        keep = dx != 0
        if own:
            keep &= np.arange(len(x2))[None, :] > np.arange(a, b)[:, None]
        yield dy[keep] / dx[keep]


def _to_ordered(v: np.ndarray) -> np.ndarray:
    bits = (v + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def _from_ordered(i: np.ndarray) -> np.ndarray:
    i = i.astype(np.int64)
    return np.where(i >= 0, i, i ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64)


def _falls(r: np.ndarray, w: np.ndarray | None, strict: bool = False) -> int:
    """Pairs of places i < j with ``r[j] <= r[i]`` (``<`` if strict), each counted ``w[i] * w[j]`` times.

    Places stand in the order of their values and are dealt to halves bit by bit; in a node, those of the right half that come before one of the left are its falls."""
    n = len(r)
    idx = np.arange(n)
    pos = np.lexsort((idx if strict else -idx, r))
    total = 0
    for b in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        bit = (pos >> b) & 1
        start = (pos >> (b + 1)) << (b + 1)
        ones = np.cumsum(bit) - bit
        before = ones - ones[start]
        left = bit == 0
        if w is None:
            total += int(before[left].sum())
        else:
            mine = w[pos]
            weight = np.cumsum(mine * bit) - mine * bit
            total += int((mine[left] * (weight - weight[start])[left]).sum())
        to = np.where(left, idx - before, start + (1 << b) + before)
        moved = np.empty_like(pos)
        moved[to] = pos
        pos = moved
    return total


def _slope_ranks(x: np.ndarray, y: np.ndarray, ranks: Sequence[int]) -> list[float]:
    """Slopes at the ranks (from 0) among all pairs of different ``x``, as their division gives them."""
    rows, w = np.unique(np.c_[x, y], axis=0, return_counts=True)
    x, y = rows[:, 0], rows[:, 1]
    w = None if w.max() == 1 else w.astype(np.int64)
    weight = np.ones(len(x), np.int64) if w is None else w
    away = x - x[0]
    fit = lambda t: y - t * away
    known: dict[float, int] = {}

    def at_most(t: float) -> int:
        if t not in known:
            known[t] = _falls(fit(t), w)
        return known[t]

    flat = (_falls(y, w, strict=True), at_most(0.0))
    gen = np.random.default_rng(0)
    i, j = gen.integers(0, len(x), (2, 40_000))
    apart = x[i] != x[j]
    trial = np.sort((y[j] - y[i])[apart] / (x[j] - x[i])[apart])
    step = np.diff(np.unique(x)).min()
    bound = 2 * (y.max() - y.min()) / step + 1
    n_pairs = at_most(bound)

    def listed(lo: float, hi: float, rank: int) -> float:
        mid, half = lo + (hi - lo) / 2, (hi - lo) / 2
        noise = 64 * np.finfo(float).eps * (np.abs(y).max() + max(abs(lo), abs(hi)) * max(away.max(), np.abs(x).max()))
        r, r_lo = fit(mid), fit(lo)
        order = np.argsort(r)
        rs = r[order]
        end = np.searchsorted(rs, rs + half * away.max() + noise, side="right")
        begin = np.arange(1, len(rs) + 1)
        size = np.maximum(end - begin, 0)
        edge = np.concatenate([[0], np.cumsum(size)])
        values, counts, below = [], [], 0
        a = 0
        while a < len(rs):
            z = max(a + 1, int(np.searchsorted(edge, edge[a] + 2_000_000, side="right")) - 1)
            p = np.repeat(np.arange(a, z), size[a:z])
            q = begin[p] + np.arange(len(p)) - (edge[p] - edge[a])
            p, q = order[p], order[q]
            p, q = np.minimum(p, q), np.maximum(p, q)      # rows stand in the order of x
            dx = x[q] - x[p]
            ok = (dx > 0) & (np.abs(r[q] - r[p]) <= half * dx + noise)
            p, q, dx = p[ok], q[ok], dx[ok]
            c = weight[p] * weight[q]
            below += int(c[r_lo[q] <= r_lo[p]].sum())
            v, back = np.unique((y[q] - y[p]) / dx, return_inverse=True)
            values.append(v)
            counts.append(np.bincount(back, c, len(v)) if len(v) else np.zeros(0))
            a = z
        v, back = np.unique(np.concatenate(values), return_inverse=True)
        c = np.bincount(back, np.concatenate(counts), len(v))
        return float(v[np.searchsorted(np.cumsum(c), rank - (at_most(lo) - below), side="right")])

    out = []
    for rank in ranks:
        if flat[0] <= rank < flat[1]:
            out.append(0.0)
            continue
        lo, hi = -bound, bound
        known[lo] = 0
        if len(trial):
            at = rank / n_pairs * len(trial)
            for d in (-3.0, 3.0):
                t = float(trial[int(np.clip(at + d * math.sqrt(len(trial)), 0, len(trial) - 1))])
                if at_most(t) <= rank:
                    lo = max(lo, t)
                else:
                    hi = min(hi, t)
        for t, c in list(known.items()):                   # what other ranks have counted
            lo, hi = (max(lo, t), hi) if c <= rank else (lo, min(hi, t))
        while at_most(hi) - at_most(lo) > FEW and hi - lo > 1e-11 * max(abs(lo), abs(hi)):
            t = lo + (hi - lo) / 2
            lo, hi = (t, hi) if at_most(t) <= rank else (lo, t)
        out.append(listed(lo, hi, rank))
    return out


def _shift_ranks(a: np.ndarray, b: np.ndarray, ranks: Sequence[int]) -> list[float]:
    """Differences b - a at the ranks (from 0), by halving the bits of the trial value."""
    a, na = np.unique(a, return_counts=True)
    b, nb = np.unique(b, return_counts=True)
    upto = np.concatenate([[0], np.cumsum(na)])
    known: dict[int, int] = {}

    def at_most(code: int) -> int:
        if code not in known:
            t = float(_from_ordered(np.array([code]))[0])
            k = np.searchsorted(a, b - t)                  # first a with b - a <= t, up to rounding
            while len(m := np.flatnonzero((k > 0) & (b - a[k - 1] <= t))):
                k[m] -= 1
            while len(m := np.flatnonzero((k < len(a)) & (b - a[np.minimum(k, len(a) - 1)] > t))):
                k[m] += 1
            known[code] = int((nb * (upto[-1] - upto[k])).sum())
        return known[code]

    ends = _to_ordered(np.array([b[0] - a[-1], b[-1] - a[0]]))
    out = []
    for rank in ranks:
        lo, hi = int(ends[0]), int(ends[1])
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if at_most(mid) <= rank else (lo, mid)
        out.append(float(_from_ordered(np.array([lo]))[0]))
    return out


def _units(df: DataFrame, keys: Sequence[str], kind: str, chunk: int) -> tuple[DataFrame, bool]:
    """Copy each row to the units of its chunk.  Columns ``__x, __y`` (and ``__s`` as sample for shifts)."""
    part = [*keys, "__s"] if kind == "shift" else list(keys)
    sizes = df.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("__g"))
    many = (sizes.agg(F.max("__g")).first()[0] or 1) > 1
    rows = df.join(broadcast_if_small(sizes), part)
    rows = rows.withColumn("__c", F.when(F.col("__g") == 1, 0).otherwise(
        F.pmod(F.xxhash64("__x", "__y", F.monotonically_increasing_id()), F.col("__g"))).cast("int"))
    if many:
        rows = cut_lineage(rows)     # chunk numbers must not change between rounds
    if kind == "shift":
        other = sizes.select(*keys, (1 - F.col("__s")).alias("__s"), F.col("__g").alias("__h"))
        rows = rows.join(broadcast_if_small(other), part)
        rows = rows.withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__h") - 1)))
        rows = rows.withColumn("__u", F.when(F.col("__s") == 0, F.col("__c")).otherwise(F.col("__p")))
        rows = rows.withColumn("__v", F.when(F.col("__s") == 0, F.col("__p")).otherwise(F.col("__c")))
    else:
        rows = rows.withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__g") - 1)))
        rows = rows.withColumn("__u", F.least("__c", "__p")).withColumn("__v", F.greatest("__c", "__p"))
        rows = rows.withColumn("__s", F.col("__c"))
    return rows.select(*keys, "__u", "__v", "__s", "__x", "__y"), many


def _spread(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Few bytes but much work per unit: a fixed partition count keeps AQE from merging the units into a few tasks."""
    spark = units.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return units.repartition(n, *keys)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _digits(keys: Sequence[str], kind: str, shift: int):
    """Histogram of the 16 bits at ``shift`` among the unit's values that share each wanted prefix."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = pdf["__r"].iloc[0]
        base = [-32768 if shift == 48 else int(w["prefix"]) << 16 for w in wanted]
        n = np.zeros((len(wanted), 65536), np.int64)
        for v in _values(pdf, kind):
            digit = _to_ordered(v) >> np.int64(shift)
            for i, least in enumerate(base):
                mine = digit if shift == 48 else digit[(digit >= least) & (digit < least + 65536)]
                n[i] += np.bincount(mine - least, minlength=65536)
        outs = []
        for w, least, row in zip(wanted, base, n):
            at = np.flatnonzero(row)
            # a key column keeps its type where a unit has no value of this prefix
            outs.append(pd.DataFrame({**{k: pdf[k].iloc[np.zeros(len(at), int)].array for k in keys}, "tid": np.int32(w["tid"]), "digit": at + least, "n": row[at]}))
        return pd.concat(outs, ignore_index=True)

    return count


def select_ranks(df: DataFrame, keys: Sequence[str], ranks: DataFrame, kind: str, chunk: int = CHUNK) -> DataFrame:
    """``ranks`` has ``keys, tid, rank`` (0-based); returns ``keys, tid, value``."""
    keys = list(keys)
    fields = _key_fields(df, keys)
    if (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= WHOLE:
        schema = T.StructType([*fields, T.StructField("tid", T.IntegerType()), T.StructField("value", T.DoubleType())])

        def settle(pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(want):
                return want[[*keys, "tid"]].iloc[:0].assign(value=np.zeros(0))
            x, y = pdf["__x"].to_numpy(), pdf["__y"].to_numpy()
            if kind == "shift":
                s = pdf["__s"].to_numpy()
                got = _shift_ranks(y[s == 0], y[s == 1], want["rank"].tolist())
            else:
                got = _slope_ranks(x, y, want["rank"].tolist())
            return want[[*keys, "tid"]].assign(value=got)

        columns = [*keys, "__x", "__y", *(["__s"] if kind == "shift" else [])]
        ranks = ranks.select(*[F.col(c).alias(c) for c in ranks.columns])      # columns of their own: they come from the same rows
        return _spread(df.select(*columns), keys).groupBy(*keys).cogroup(_spread(ranks, keys).groupBy(*keys)).applyInPandas(settle, schema)

    units, _ = _units(df, keys, kind, chunk)
    schema = T.StructType([*fields, T.StructField("tid", T.IntegerType()), T.StructField("digit", T.LongType()),
                           T.StructField("n", T.LongType())])
    state = ranks.select(*keys, "tid", F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix"))
    for rnd in range(4):
        shift = 48 - 16 * rnd
        wanted = state.groupBy(*keys).agg(F.collect_list(F.struct("tid", "prefix")).alias("__r"))
        joined = units.join(broadcast_if_small(wanted), keys)

        hist = _spread(joined, [*keys, "__u", "__v"]).groupBy(*keys, "__u", "__v").applyInPandas(_digits(keys, kind, shift), schema)
        hist = hist.groupBy(*keys, "tid", "digit").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*keys, "tid").orderBy("digit")            # at most 65,536 digits
        hist = hist.withColumn("cum", F.sum("n").over(w)).join(state.select(*keys, "tid", "rank"), [*keys, "tid"])
        hist = hist.where((F.col("cum") > F.col("rank")) & (F.col("cum") - F.col("n") <= F.col("rank")))
        state = cut_lineage(hist.select(*keys, "tid", (F.col("rank") - (F.col("cum") - F.col("n"))).alias("rank"),
                                        F.col("digit").alias("prefix")))
    out = T.StructType([*fields, T.StructField("tid", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def decode(batches):
        for pdf in batches:
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "tid": pdf["tid"],
                                "value": _from_ordered(pdf["prefix"].to_numpy())})

    return state.select(*keys, "tid", "prefix").mapInPandas(decode, out)


def _tie_sum(df: DataFrame, keys: list[str], col: str, expr, out: str) -> DataFrame:
    t = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__m"))
    return t.groupBy(*keys).agg(F.sum(expr(F.col("__m"))).alias(out))


def _gather(vals: DataFrame, keys: list[str], n: int) -> DataFrame:
    return vals.groupBy(*keys).agg(*[F.max(F.when(F.col("tid") == i, F.col("value"))).alias(f"v{i}") for i in range(n)])


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, interval: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Median pairwise slope, intercept and 95 % interval per group with at least one usable pair."""
    keys = list(keys)
    src = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    base = B.summarise(src, keys, {"n": F.count(F.lit(1))}, {"mx": ("__x", 0.5), "my": ("__y", 0.5)})
    choose2 = lambda m: m * (m - 1) / 2
    kendall = lambda m: m * (m - 1) * (2 * m + 5)
    base = base.join(_tie_sum(src, keys, "__x", choose2, "tx"), keys)
    if interval:
        base = base.join(_tie_sum(src, keys, "__x", kendall, "kx"), keys).join(
            _tie_sum(src, keys, "__y", kendall, "ky"), keys)
    base = base.withColumn("ns", (choose2(F.col("n")) - F.col("tx")).cast("long")).where("ns > 0")
    lo, hi = F.floor((F.col("ns") - 1) / 2), F.floor(F.col("ns") / 2)
    picks = [F.struct(F.lit(0).alias("tid"), lo.cast("long").alias("rank")),
             F.struct(F.lit(1).alias("tid"), hi.cast("long").alias("rank"))]
    if interval:
        sigma = F.sqrt((kendall(F.col("n")) - F.col("kx") - F.col("ky")) / 18.0)
        up = F.least(F.bround((F.col("ns") + Z95 * sigma) / 2).cast("long"), F.col("ns") - 1)
        dn = F.greatest(F.bround((F.col("ns") - Z95 * sigma) / 2).cast("long") - 1, F.lit(0).cast("long"))
        picks += [F.struct(F.lit(2).alias("tid"), dn.alias("rank")), F.struct(F.lit(3).alias("tid"), up.alias("rank"))]
    ranks = base.select(*keys, F.explode(F.array(*picks)).alias("__p")).select(*keys, "__p.tid", "__p.rank")
    got = _gather(select_ranks(src, keys, ranks, "slope", chunk), keys, len(picks))
    out = base.join(got, keys).withColumn("slope", (F.col("v0") + F.col("v1")) / 2)
    cols = [*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept")]
    if interval:
        cols += [F.col("v2").alias("slope_lo"), F.col("v3").alias("slope_hi")]
    return out.select(*cols)


def passing_bablok(df: DataFrame, keys: Sequence[str], x: str, y: str, chunk: int = CHUNK) -> DataFrame:
    """Shifted median of pairwise slopes: slopes of exactly -1 are dropped and the rank moves by those below -1.

    Where so many lie below -1 that the moved rank passes the last slope, slope and intercept are NULL."""
    keys = list(keys)
    src = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    units, _ = _units(src, keys, "slope", chunk)
    schema = T.StructType([*_key_fields(src, keys), T.StructField("n", T.LongType()), T.StructField("below", T.LongType()),
                           T.StructField("equal", T.LongType())])

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.array([[len(v), (v < -1).sum(), (v == -1).sum()] for v in _values(pdf, "slope")], np.int64).reshape(-1, 3).sum(0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": t[:1], "below": t[1:2], "equal": t[2:]})

    base = _spread(units, [*keys, "__u", "__v"]).groupBy(*keys, "__u", "__v").applyInPandas(tally, schema)
    base = base.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("below").alias("below"), F.sum("equal").alias("equal"))
    base = base.withColumn("m", F.col("n") - F.col("equal")).where("m > 0")
    ranks = [F.struct(F.lit(i).alias("tid"), (F.floor((F.col("m") - 1 + i) / 2) + F.col("below") + F.col("equal")).cast("long").alias("rank"))
             for i in (0, 1)]
    want = base.select(*keys, "n", F.explode(F.array(*ranks)).alias("__p")).where("__p.rank < n").select(*keys, "__p.tid", "__p.rank")
    got = _gather(select_ranks(src, keys, want, "slope", chunk), keys, 2)
    fit = base.join(got, keys, "left").select(*keys, F.col("m").alias("n_slopes"), ((F.col("v0") + F.col("v1")) / 2).alias("slope"))
    res = src.join(broadcast_if_small(fit), keys).withColumn("__r", F.col("__y") - F.col("slope") * F.col("__x"))
    return fit.join(B.quantiles(res, keys, "__r", {"intercept": 0.5}), keys, "left")


def hodges_lehmann(df: DataFrame, keys: Sequence[str], value: str, is_b: str, chunk: int = CHUNK) -> DataFrame:
    """Median of all differences b - a between the two samples of each group."""
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias("__y"), F.lit(0.0).alias("__x"),
                    F.col(is_b).cast("int").alias("__s"))
    n = src.groupBy(*keys).agg(F.sum("__s").alias("nb"), F.count(F.lit(1)).alias("n"))
    n = n.withColumn("m", F.col("nb") * (F.col("n") - F.col("nb"))).where("m > 0")
    ranks = [F.struct(F.lit(i).alias("tid"), F.floor((F.col("m") - 1 + i) / 2).cast("long").alias("rank")) for i in (0, 1)]
    want = n.select(*keys, F.explode(F.array(*ranks)).alias("__p")).select(*keys, "__p.tid", "__p.rank")
    got = _gather(select_ranks(src.join(broadcast_if_small(n.select(*keys)), keys, "left_semi"), keys, want, "shift", chunk), keys, 2)
    return n.select(*keys, "m").join(got, keys).select(*keys, F.col("m").alias("n_pairs"), ((F.col("v0") + F.col("v1")) / 2).alias("shift"))
