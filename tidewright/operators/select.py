"""Choosing rows: ranked picks per group, strata, fills and set comparisons."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.rng import mix
from ..session import broadcast_if_small


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key.  Spark keeps n rows per key in each map task before the shuffle (window group limit), so a hot
    key reaches its reducer as n rows per task."""
    name = rank or "__rk"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str], largest: bool = False) -> DataFrame:
    """One row per key by an aggregate (combined before the shuffle)."""
    pick = F.max_by if largest else F.min_by
    g = df.groupBy(*keys).agg(pick(F.struct(*cols), F.struct(*order)).alias("__b"))
    return g.select(*keys, *[F.col("__b")[c].alias(c) for c in cols])


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return best(df, keys, order, rest).select(*df.columns)


def key_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Enrichment that can never multiply rows: the right side is reduced to one row per key first."""
    return left.join(broadcast_if_small(dedup(right, keys, order)), list(keys), "left")


def sample_strata(df: DataFrame, strata: Sequence[str], uid: str, n: int, seed: int) -> DataFrame:
    """Seeded n rows per stratum."""
    return first_n(df.withColumn("__k", mix(seed, F.col(uid))), strata, [F.col("__k"), F.col(uid)], n).drop("__k")


def fill(df: DataFrame, cells: Sequence[str], order: Sequence[Column], n: int, total: int, uid: str) -> DataFrame:
    """n best per cell; when that is short of ``total``, the best of the rest complete it."""
    ranked = df.withColumn("rk", F.row_number().over(W.partitionBy(*cells).orderBy(*order)))
    core = ranked.where(F.col("rk") <= n).withColumn("how", F.lit("cell")).drop("rk")
    have = core.agg(F.greatest(F.lit(0), F.lit(total) - F.count(F.lit(1))).alias("need")).withColumn("one", F.lit(1))
    rest = df.join(core.select(uid), uid, "left_anti").orderBy(*order).limit(total).withColumn("one", F.lit(1))
    rest = rest.join(F.broadcast(have), "one").withColumn("rk", F.row_number().over(W.partitionBy("one").orderBy(*order)))
    rest = rest.where(F.col("rk") <= F.col("need")).withColumn("how", F.lit("fill")).drop("one", "need", "rk")
    return core.unionByName(rest)


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows found in one frame more often than in the other, with the side; empty when the frames are equal as bags."""
    cols = a.columns
    tag = lambda d, s: d.select(*cols, F.lit(s).alias("__s"))
    g = tag(a, 1).unionByName(tag(b, -1)).groupBy(*cols).agg(F.sum("__s").alias("surplus"))
    return g.where("surplus <> 0").withColumn("side", F.when(F.col("surplus") > 0, "left").otherwise("right"))


def key_audit(manifest: DataFrame, cache: DataFrame, key: str, shape_m: str, shape_c: str) -> DataFrame:
    """One status per key: present, stale shape, missing from the cache, or orphan in it."""
    j = manifest.select(key, F.col(shape_m).alias("__m"), F.lit(1).alias("__im")).join(
        cache.select(key, F.col(shape_c).alias("__c"), F.lit(1).alias("__ic")), key, "full")
    return j.select(key, F.when(F.col("__ic").isNull(), "MISSING").when(F.col("__im").isNull(), "ORPHAN")
                    .when(~F.col("__m").eqNullSafe(F.col("__c")), "STALE").otherwise("OK").alias("status"))
