"""Session settings, the shared work folder and plan-time size checks.

Sizes decide two things only: whether a side may be broadcast, and whether a per-key window may run as one
plain window or has to be split into value blocks (see ``operators.blocks``).  Both thresholds are session
settings, so a test can force the large-data path on a small table.
"""
from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES_KEY = "tidewright.small.bytes"
BLOCK_ROWS_KEY = "tidewright.block.rows"
BROADCAST_BYTES_KEY = "tidewright.broadcast.bytes"
DEFAULTS = {
    SMALL_BYTES_KEY: 256 * 1024 * 1024,
    BLOCK_ROWS_KEY: 2_000_000,
    BROADCAST_BYTES_KEY: 64 * 1024 * 1024,
}


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(DEFAULTS[key])))


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on: UTC clock, AQE with skew-join handling.

    Worker functions travel with the plan, so executors need no copy of this package."""
    register_pickle_by_value(sys.modules[__package__])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # quantile maps of many small groups hash in memory; groups above the block size never reach that aggregate
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "8192")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster shares through ``spark.checkpoint.dir``.

    Only a local master with the setting absent (tests) falls back to a folder of this machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = os.environ.get("TIDEWRIGHT_TEST_DIR") or tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate; an upper bound for scans, filters and projections."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame) -> bool:
    return plan_bytes(df) <= setting(df.sparkSession, SMALL_BYTES_KEY)


def is_bounded(df: DataFrame) -> bool:
    """Small by estimate or, where the estimate is no use (joins), by counting up to the block size and no further."""
    if is_small(df):
        return True
    limit = setting(df.sparkSession, BLOCK_ROWS_KEY)
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def few_rows(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Summary rows, kept and hinted for a broadcast if they are few by count: estimates of aggregates and solves are those of their input."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.select(F.lit(1)).limit(most + 1).count() <= most else df


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only below the byte limit; above it the join shuffles and AQE splits skewed keys."""
    if plan_bytes(df) <= setting(df.sparkSession, BROADCAST_BYTES_KEY):
        return F.broadcast(df)
    return df
