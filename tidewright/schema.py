"""Key constructors and missing-value rules.  Every key and every fill value is defined once, here."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Storage fills of the source products.
FILL_HEIGHT = -1e11      # node and lake heights
FILL_INDEX = -32768      # scaled int16 spectral indices
FILL_MASK = 255          # three-valued water masks
INDEX_SCALE = 10000      # int16 index storage: value * 10000


def clean(col: Column) -> Column:
    """NaN is missing, and Spark would otherwise carry it through every aggregate."""
    return F.nanvl(col, F.lit(None).cast("double"))


def clean_doubles(df: DataFrame) -> DataFrame:
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[clean(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def height_or_null(col: Column) -> Column:
    return F.when(col > F.lit(FILL_HEIGHT), col)


def mask_or_null(col: Column) -> Column:
    return F.when(col != F.lit(FILL_MASK), col)


def index_or_null(col: Column) -> Column:
    return F.when(col != F.lit(FILL_INDEX), col / F.lit(float(INDEX_SCALE)))


def overpass_key(track: Column, day: Column) -> Column:
    return F.concat_ws("_", track.cast("string"), F.date_format(day, "yyyyMMdd"))


def pass_key(cycle: Column, pas: Column, day: Column) -> Column:
    return F.concat_ws("_", F.lpad(cycle.cast("string"), 3, "0"), F.lpad(pas.cast("string"), 3, "0"),
                       F.date_format(day, "yyyyMMdd"))


def event_key(day: Column, orbit: Column, state: Column) -> Column:
    """``date_orbN_ASC``: one constructor, so case can never differ between writers."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_orb"), orbit.cast("string"), F.lit("_"),
                    F.upper(F.substring(state, 1, 3)))


def conform(df: DataFrame, schema) -> DataFrame:
    """Project to a declared schema; columns a file lacks become NULL of the declared type."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])
