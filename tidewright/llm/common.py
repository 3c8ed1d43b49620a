"""Column builders and small helpers that several operators of this subpackage share."""
from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root, cut_lineage, prepare, work_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that separates words once A-Z are lower case.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table with no more rows than this (and a fixed row width) may be broadcast.
BROADCAST_ROWS = 200_000
#: Words that a table of word lists may hold to be broadcast, some 40 bytes each.
BROADCAST_WORDS = 1_000_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character as it is.

    ``lower`` does just that, and faster than ``translate``, for a text without other capitals."""
    other = text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells rows apart that carry one id but different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back: lineage ends at files every executor sees.

    Zstandard frees its buffers with each page; Snappy's direct buffers wait for a collection and pile up over many small files."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(spark, value):
    """Broadcast an object of this package: its class travels inside, as executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    """The object in a task."""
    return pickle.loads(shared.value)


def broadcast_counted(df: DataFrame, rows: int, words: int = 0) -> DataFrame:
    """Hint a broadcast for a table of ``rows`` counted rows (with ``words`` words in their lists), if that is within the bounds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and words <= BROADCAST_WORDS else df


__all__ = ["BROADCAST_ROWS", "UPPER", "WORD_GAP", "ascii_lower", "broadcast_counted", "checkpoint_root", "cut_lineage", "opened", "prepare", "share",
           "stored", "table", "text_key", "words_of", "work_path"]
