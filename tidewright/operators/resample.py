"""Bootstrap and permutation on declared independent units (an overpass, a track, a date), never on pixels.

Draws are integer congruences of (seed, replicate, position), so they repeat exactly in any engine.

A group of up to ``unit_limit`` units travels as one packed list, once for every block of draws; a task draws the block and returns one
number a draw, so no table of units x draws is made or shuffled.  Larger groups keep a replicate as multiplicities of distinct units:
counts are aggregated before anything is joined, and medians are read from cumulative multiplicities.  Both ways give the same numbers.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import mix, mix_array
from ..session import broadcast_if_small
from . import blocks as B


#: units of a group that one task may hold as a list, and units x draws of one block
UNIT_LIMIT = 200_000
BLOCK_DRAWS = 2_000_000


def by_size(df: DataFrame, keys: Sequence[str], unit_limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of groups within the limit, rows of larger groups); None where there are none."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    most, least = n.agg(F.max("__n"), F.min("__n")).first()
    if most is None or most <= unit_limit:
        return df, None
    if least > unit_limit:
        return None, df
    # large groups are few: each holds more than ``unit_limit`` rows
    return tuple(df.join(F.broadcast(n.where(F.col("__n") > unit_limit).select(*keys)), list(keys), how) for how in ("left_anti", "left_semi"))


def both(small: DataFrame | None, large: DataFrame | None) -> DataFrame:
    return small if large is None else large if small is None else small.unionByName(large)


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], reps: int, stat: Callable, out: Sequence[str]) -> DataFrame:
    """``keys, rep, out...``: ``stat(first draw, number of draws, {value: array})`` gives an array for each of ``out``.

    The rows of a group stand in ``order``; it has one packed row a block."""
    keys, values = list(keys), list(values)
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[F.col(v).alias(f"__{v}") for v in values]))).alias("u"))
    size = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_DRAWS) / F.greatest(F.size("u"), F.lit(1))))
    packed = packed.withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(reps).cast("long"), size)))
    packed = packed.select(*keys, "lo", F.least(size, reps + 1 - F.col("lo")).cast("long").alias("b"), *[F.col(f"u.__{v}").alias(f"__{v}") for v in values])
    packed = packed.repartition(packed.sparkSession.sparkContext.defaultParallelism, *keys, "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = [batch.column(c)[k].as_py() for c in ("lo", "b")]
                got = stat(*at, {v: batch.column(f"__{v}")[k].values.to_numpy(zero_copy_only=False) for v in values})
                lists = [pa.array([np.arange(at[0], at[0] + at[1])], pa.list_(pa.int64())), *[pa.array([x], pa.list_(pa.float64())) for x in got]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in keys], *lists], names=[*keys, "rep", *out])

    schema = T.StructType([*[packed.schema[c] for c in keys], T.StructField("rep", T.ArrayType(T.LongType())), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in out]])
    done = packed.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("rep", *out)).alias("z"))
    return done.select(*keys, "z.rep", *[F.when(~F.isnan(F.col("z")[c]), F.col("z")[c]).alias(c) for c in out])


def picks(seed: int, lo: int, b: int, n: int) -> np.ndarray:
    """Positions (from 0) that draws ``lo`` on take, a row each: what ``draws`` counts."""
    return mix_array(seed, np.arange(lo, lo + b)[:, None], np.arange(1, n + 1)) % n


def draws(units: DataFrame, keys: Sequence[str], order: Sequence[str], reps: int, seed: int) -> DataFrame:
    """``keys, rep, pos, m``: how often unit ``pos`` is drawn in replicate ``rep`` (n draws with replacement)."""
    keys = list(keys)
    u = B.row_position(units, keys, order, "pos", "n").select(*keys, "pos", "n")
    d = u.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    d = d.withColumn("pick", 1 + F.pmod(mix(seed, F.col("rep"), F.col("pos")), F.col("n")))
    return d.groupBy(*keys, "rep", F.col("pick").alias("pos")).agg(F.count(F.lit(1)).alias("m"))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Median of values repeated ``weight`` times."""
    keys = list(keys)
    c = df.groupBy(*keys, value).agg(F.sum(weight).alias("__m"))
    c = B.running_sum(c, keys, [value], F.col("__m"), "__cum")
    tot = c.groupBy(*keys).agg(F.sum("__m").alias("__t"))
    c = c.join(broadcast_if_small(tot), keys)
    lo, hi = F.floor((F.col("__t") - 1) / 2), F.floor(F.col("__t") / 2)
    g = c.groupBy(*keys).agg(F.min(F.when(F.col("__cum") > lo, F.col(value))).alias("__a"),
                             F.min(F.when(F.col("__cum") > hi, F.col(value))).alias("__b"))
    return g.select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias(out))


def _interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return B.quantiles(df, keys, value, {"ci_lo": 0.025, "ci_hi": 0.975})


def boot_medians(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], reps: int, seed: int, unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """``keys, rep, med``: the median of every replicate."""
    keys = list(keys)
    small, large = by_size(df.select(*keys, value, *[o for o in order if o != value]), keys, unit_limit)
    if small is not None:
        small = in_blocks(small, keys, order, [value], reps, lambda lo, b, v: [np.median(v[value][picks(seed, lo, b, v[value].size)], axis=1)], ["med"])
    if large is not None:
        pos = B.row_position(large, keys, order, "pos")
        large = weighted_median(draws(large, keys, order, reps, seed).join(pos.select(*keys, "pos", value), [*keys, "pos"]),
                                [*keys, "rep"], value, "m", "med").withColumn("rep", F.col("rep").cast("long"))
    return both(small, large)


def boot_median(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], reps: int, seed: int, unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """Interval of the median."""
    return _interval(boot_medians(df, keys, value, order, reps, seed, unit_limit), keys, "med")


def boot_corr(df: DataFrame, keys: Sequence[str], a: str, b: str, order: Sequence[str], reps: int, seed: int, unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """Interval of Pearson's r; moments per replicate."""
    keys = list(keys)
    df = df.select(*keys, a, b, *[o for o in order if o not in (a, b)])

    def r_of(n, sx, sy, sxx, syy, sxy, root):
        return (n * sxy - sx * sy) / root((n * sxx - sx * sx) * (n * syy - sy * sy))

    def stat(lo, size, v):
        p = picks(seed, lo, size, v[a].size)
        x, y = v[a][p].astype(float), v[b][p].astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            return [r_of(float(v[a].size), x.sum(1), y.sum(1), (x * x).sum(1), (y * y).sum(1), (x * y).sum(1), np.sqrt)]

    small, large = by_size(df, keys, unit_limit)
    if small is not None:
        small = in_blocks(small, keys, order, [a, b], reps, stat, ["r"])
    if large is not None:
        pos = B.row_position(large, keys, order, "pos").select(*keys, "pos", a, b)
        j = draws(large, keys, order, reps, seed).join(pos, [*keys, "pos"])
        m, x, y = F.col("m"), F.col(a), F.col(b)
        s = j.groupBy(*keys, "rep").agg(F.sum(m).alias("n"), F.sum(m * x).alias("sx"), F.sum(m * y).alias("sy"),
                                        F.sum(m * x * x).alias("sxx"), F.sum(m * y * y).alias("syy"), F.sum(m * x * y).alias("sxy"))
        large = s.select(*keys, F.col("rep").cast("long").alias("rep"), r_of(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")], F.sqrt).alias("r"))
    return _interval(both(small, large), keys, "r")


def boot_diff(df: DataFrame, keys: Sequence[str], value: str, side: str, order: Sequence[str], reps: int, seed: int, unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """Interval of median(b) - median(a), both sides resampled."""
    med = boot_medians(df, [*keys, side], value, order, reps, seed, unit_limit)
    d = med.groupBy(*keys, "rep").agg((F.max(F.when(F.col(side) == 1, F.col("med")))
                                       - F.max(F.when(F.col(side) == 0, F.col("med")))).alias("d"))
    return _interval(d.where("d is not null"), keys, "d")


def cluster_rows(df: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """All rows of each drawn cluster with its multiplicity ``m``, per replicate."""
    ids = df.select(cluster).distinct()
    pos = B.row_position(ids, [], [cluster], "pos")
    d = draws(ids, [], [cluster], reps, seed).join(broadcast_if_small(pos), "pos")
    return df.join(broadcast_if_small(d.select("rep", cluster, "m")), cluster)


def cluster_stats(df: DataFrame, cluster: str, keys: Sequence[str], value: str, reps: int, seed: int, unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """``keys, rep, mean, median`` of a value over the rows of drawn clusters; clusters are drawn from the whole table."""
    keys = list(keys)
    df = df.select(*keys, cluster, value).where(F.col(value).isNotNull())
    ids = df.select(cluster).distinct()
    total = ids.count()
    small, large = by_size(df, keys, unit_limit) if total <= unit_limit else (None, df)
    if small is not None:
        pos = B.row_position(ids, [], [cluster], "__pos").select(cluster, (F.col("__pos") - 1).alias("__pos"))

        def stat(lo, b, v):
            if not v[value].size:
                return [np.full(b, np.nan)] * 2
            m = np.bincount((np.arange(b)[:, None] * total + picks(seed, lo, b, total)).ravel(), minlength=b * total).reshape(b, total)
            w = m[:, v["__pos"]]
            up = np.cumsum(w, axis=1)
            n = up[:, -1]
            mid = [np.argmax(up > t[:, None], axis=1) for t in ((n - 1) // 2, n // 2)]
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = (w @ v[value]) / n
            return [mean, np.where(n > 0, (v[value][mid[0]] + v[value][mid[1]]) / 2, np.nan)]

        small = in_blocks(small.join(broadcast_if_small(pos), cluster), keys, [value, "__pos"], [value, "__pos"], reps, stat, ["mean", "median"])
    if large is not None:
        rows = cluster_rows(df, cluster, reps, seed)
        rows = rows if small is None else rows.join(large.select(*keys).distinct(), keys, "left_semi")
        mean = rows.groupBy(*keys, "rep").agg((F.sum(F.col("m") * F.col(value)) / F.sum("m")).alias("mean"))
        large = mean.join(weighted_median(rows, [*keys, "rep"], value, "m", "median"), [*keys, "rep"]).withColumn("rep", F.col("rep").cast("long"))
    return both(small, large)


def permutation(df: DataFrame, value: str, is_b: str, uid: str, reps: int, seed: int, keys: Sequence[str] = (), unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """Two-sided permutation test of the difference of medians: ``keys, obs, p`` with p = (c + 1) / (reps + 1); both NULL where a side is empty."""
    keys = list(keys)
    df = df.select(*keys, value, is_b, uid).where(F.col(value).isNotNull())

    def stat(lo, b, v):
        side = v[is_b].astype(bool)
        n_a = int((~side).sum())
        if n_a in (0, side.size):
            return [np.full(b, np.nan)] * 2
        order = np.argsort(mix_array(seed, np.arange(lo, lo + b)[:, None], v[uid]), axis=1, kind="stable")
        x = v[value].astype(float)[order]
        obs = np.median(v[value][side]) - np.median(v[value][~side])
        return [np.median(x[:, n_a:], axis=1) - np.median(x[:, :n_a], axis=1), np.full(b, obs)]

    small, large = by_size(df, keys, unit_limit)
    if small is not None:
        small = in_blocks(small, keys, [uid], [value, is_b, uid], reps, stat, ["d", "obs"])
    if large is not None:
        n_a = large.groupBy(*keys).agg(F.count_if(F.col(is_b) == 0).alias("n_a"))
        with_one = lambda d, side: d.join(F.broadcast(side), keys) if keys else d.crossJoin(F.broadcast(side))  # one row a large group
        rows = large.select(*keys, uid, value).withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(reps).cast("long"))))
        rows = rows.withColumn("key", mix(seed, F.col("rep"), F.col(uid)))
        rows = with_one(B.row_position(rows, [*keys, "rep"], ["key", uid], "pos"), n_a).withColumn("sb", (F.col("pos") > F.col("n_a")).cast("int"))
        diff = lambda d, k: d.groupBy(*k).agg((F.max(F.when(F.col("sb") == 1, F.col("med"))) - F.max(F.when(F.col("sb") == 0, F.col("med")))).alias("d"))
        per = diff(B.quantiles(rows, [*keys, "rep", "sb"], value, {"med": 0.5}), [*keys, "rep"])
        obs = diff(B.quantiles(large.withColumn("sb", F.col(is_b)), [*keys, "sb"], value, {"med": 0.5}), keys).withColumnRenamed("d", "obs")
        large = with_one(per, obs)
    per = both(small, large)
    return per.groupBy(*keys).agg(F.max("obs").alias("obs"), F.when(F.count("obs") > 0, (F.count_if(F.abs("d") >= F.abs("obs")) + 1) / F.lit(reps + 1.0)).alias("p"))
