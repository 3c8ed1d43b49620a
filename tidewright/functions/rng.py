"""Portable draws: integer congruences only, so another engine can repeat them exactly."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A 31-bit multiplicative congruence; products stay inside 64-bit integers.
_M = 2147483647
_A = 48271
_B = 69621
_C = 40692


def mix(*parts: Column | int) -> Column:
    """A well-spread integer in [0, 2^31 - 1) from integer parts."""
    acc: Column = F.lit(1).cast("long")
    for p in parts:
        c = p if isinstance(p, Column) else F.lit(p)
        acc = (((acc * _A + c.cast("long") * _B + _C) % _M) * _A + 12345) % _M
    return acc


def mix_sql(*parts: str | int) -> str:
    """The same number as a SQL expression."""
    acc = "CAST(1 AS BIGINT)"
    for p in parts:
        acc = f"((((({acc}) * {_A} + CAST({p} AS BIGINT) * {_B} + {_C}) % {_M}) * {_A} + 12345) % {_M})"
    return acc


def mix_array(*parts: np.ndarray | int) -> np.ndarray:
    """The same number for NumPy integers, in tasks that draw for a whole block of replicates."""
    acc = np.int64(1)
    for p in parts:
        acc = (((acc * _A + np.asarray(p, np.int64) * _B + _C) % _M) * _A + 12345) % _M
    return acc


def uniform(*parts: Column | int) -> Column:
    return mix(*parts) / F.lit(float(_M))
