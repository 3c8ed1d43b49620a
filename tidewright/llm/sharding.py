"""Consistent placement of keys by a permutation-filled lookup table.

Every shard has its own preference order over a prime number of slots (start and stride from hashes of its name).  The shards take
turns; each claims the first slot of its order that is still free, until all are taken, so slots per shard differ by one at
most and a changed shard list moves few keys.  The table has a fixed number of rows whatever the data's size and is broadcast: a key's
shard is one hash and one look-up, without a shuffle.

Defined results: a null key counts as an empty one; repeated rows go to one shard; repeated shard names count once; an empty shard list
is refused; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Position in ``shards`` (sorted, distinct) of each slot; ``slots`` must be prime and larger than the number of shards."""
    names = sorted(set(shards))
    if not names or slots <= len(names) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs shards and a larger prime number of slots")
    start = [_number(f"start {s}") % slots for s in names]
    stride = [_number(f"stride {s}") % (slots - 1) + 1 for s in names]
    table, left = np.full(slots, -1, np.int32), slots
    while True:
        for i, step in enumerate(stride):
            at = start[i]
            while table[at] >= 0:
                at = (at + step) % slots
            table[at], start[i] = i, (at + step) % slots
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Columns: row (the input row), slot, shard."""
    names = np.array(sorted(set(shards)))
    table = pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": names[lookup_table(shards, slots)]})
    lookup = F.broadcast(df.sparkSession.createDataFrame(table, "slot int, shard string"))
    return df.select(F.struct("*").alias("row"), slot_of(F.col(key), slots).alias("slot")).join(lookup, "slot").select("row", "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Parquet folders by shard.  A shard's rows are dealt over its files by a hash of the whole row, so a key that holds a third of all rows does not
    go through one task."""
    part = F.pmod(F.xxhash64("row"), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), part).select("row.*", "shard").write.partitionBy("shard").parquet(path)
