"""Slice-replacing index, manifests and freezes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def replace_slice(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of every slice present in ``new`` are replaced by it; other slices stay."""
    slices = new.select(*keys).distinct()
    return existing.join(broadcast_if_small(slices), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def write_slices(new: DataFrame, root: str, keys: Sequence[str], csv_root: str | None = None) -> None:
    """The same upsert on disk: dynamic overwrite touches only the partitions in ``new``; a replay gives the same files."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)
    if csv_root:
        (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
         .option("header", True).csv(csv_root))


def index_rows(catalogue: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Catalogue entries with their transfer result; absent results are ``downloaded = false`` and typed NULLs."""
    r = results.select(key, "ok", "local_path", F.col("bytes").cast("long").alias("bytes"), "http_status", "error")
    j = catalogue.join(broadcast_if_small(r), key, "left")
    return j.withColumn("downloaded", F.coalesce("ok", F.lit(False))).drop("ok")


def table_hash(df: DataFrame) -> DataFrame:
    """Order-independent content hash and row count: row hashes are summed in two halves, so no sort and no collect."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("h1"), part(13).alias("h2")).select(
        "rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), F.col("h1").cast("string"), F.col("h2").cast("string")),
                       256).alias("sha"))


def manifest(df: DataFrame, **params: str) -> DataFrame:
    """One JSON line: row count, content hash and parameters."""
    p = [F.lit(v).alias(k) for k, v in sorted(params.items())]
    return table_hash(df).select(F.to_json(F.struct("rows", "sha", F.struct(*p).alias("parameters"))).alias("manifest"))
