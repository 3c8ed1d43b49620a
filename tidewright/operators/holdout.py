"""Holdout designs.  The unit left out is a block, a track or a gauge; folds are columns, frozen by writing the table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import mix
from ..session import broadcast_if_small
from . import blocks as B


def block_folds(points: DataFrame, x: str, y: str, size: float, folds: int, seed: int) -> DataFrame:
    """Spatial blocks in a seeded order, dealt to folds in turn."""
    p = points.withColumn("bx", F.floor(F.col(x) / size)).withColumn("by", F.floor(F.col(y) / size))
    blocks = p.select("bx", "by").distinct().withColumn("k", mix(seed, F.col("bx"), F.col("by")))
    blocks = B.row_position(blocks, [], ["k", "bx", "by"], "pos").withColumn("fold", F.pmod(F.col("pos") - 1, F.lit(folds)))
    return p.join(broadcast_if_small(blocks.select("bx", "by", "fold")), ["bx", "by"])


def axis_folds(points: DataFrame, chain: str, block: float, buffer: float) -> tuple[DataFrame, DataFrame]:
    """Chainage blocks: test rows per block, and per block the rows kept out of training (its observed range and the
    buffer on both sides).  Training is everything else, so its sums are totals minus what is kept out; no row is copied
    once per block.  Blocks and rows meet on a grid of the widest range."""
    test = points.withColumn("block", F.floor(F.col(chain) / block))
    ends = test.groupBy("block").agg((F.min(chain) - buffer).alias("lo"), (F.max(chain) + buffer).alias("hi"))
    width = block + 2 * buffer
    ends = ends.withColumn("g", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    out = points.withColumn("g", F.floor(F.col(chain) / width)).join(broadcast_if_small(ends), "g")
    return test, out.where(F.col(chain).between(F.col("lo"), F.col("hi"))).drop("g", "lo", "hi")


def track_blocks(df: DataFrame, track: Sequence[str], along: str, length: float, min_rows: int) -> DataFrame:
    """Contiguous along-track blocks counted from each track's own start; the incomplete last block is left out."""
    track = list(track)
    ends = df.groupBy(*track).agg(F.min(along).alias("x0"), F.max(along).alias("x1"))
    rows = df.join(broadcast_if_small(ends), track)
    rows = rows.withColumn("blk", F.floor((F.col(along) - F.col("x0")) / length))
    rows = rows.where(F.col("x0") + (F.col("blk") + 1) * length <= F.col("x1"))
    size = rows.groupBy(*track, "blk").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)
    return rows.join(broadcast_if_small(size), [*track, "blk"]).drop("x0", "x1")


def embargo(df: DataFrame, blocks: DataFrame, track: Sequence[str], along: str, guard: float) -> DataFrame:
    """Rows per block that its guard zone removes from training: same track, inside the block widened by the guard.

    Blocks of one track are laid on a grid of guard + length cells, so a row meets only its neighbouring blocks."""
    track = list(track)
    width = blocks.agg(F.max(F.col("x1") - F.col("x0")).alias("w")).first().w + 2 * guard
    b = blocks.withColumn("g", F.explode(F.sequence(F.floor((F.col("x0") - guard) / width), F.floor((F.col("x1") + guard) / width))))
    r = df.withColumn("g", F.floor(F.col(along) / width))
    j = r.join(broadcast_if_small(b), [*track, "g"])
    return j.where((F.col(along) >= F.col("x0") - guard) & (F.col(along) < F.col("x1") + guard)).drop("g")


def greedy_tracks(tracks: DataFrame, key: str, rows: str, share: float, seed: int) -> DataFrame:
    """Whole tracks in a seeded order until the share of all rows is reached."""
    t = tracks.withColumn("k", mix(seed, F.col(key)))
    t = B.running_sum(t, [], ["k", key], F.col(rows), "cum")
    total = t.agg(F.sum(rows).alias("total")).withColumn("one", F.lit(1))
    t = t.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    return t.withColumn("held_out", (F.col("cum") - F.col(rows)) < share * F.col("total")).drop("one", "k", "total")


def leave_one_out_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every unit predicted by the mean of all other units, from two sums (no pairing of units)."""
    t = df.agg(F.sum(value).alias("s"), F.count(value).alias("n")).withColumn("one", F.lit(1))
    d = df.withColumn("one", F.lit(1)).join(F.broadcast(t), "one")
    return d.withColumn("pred", F.try_divide(F.col("s") - F.col(value), F.col("n") - 1)).drop("one", "s", "n")
