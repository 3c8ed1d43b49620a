"""Dated cell tables: composites, neighbourhoods, occurrence and change.  A cell is a row ``(row, col, ...)``; a missing
observation is NULL and never votes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import broadcast_if_small
from . import blocks as B

CELL = ("row", "col")
# Scene-classification groups of the share product.
SCENE_GROUPS = {"veg": (4,), "notveg": (5,), "water": (6,), "cloud_shadow_snow": (3, 8, 9, 10, 11)}


def n_valid(cells: DataFrame, value: str, keys: Sequence[str] = CELL) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(value).alias("n_valid"))


def class_mode(cells: DataFrame, cls: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Most frequent observed class; ties go to the lowest code; 0 where nothing was ever observed."""
    votes = cells.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    seen = F.col(cls).isNotNull() & (F.col(cls) != 0)
    rank = F.when(seen, F.struct("n", -F.col(cls)))
    return votes.groupBy(*keys).agg(F.coalesce(F.max_by(cls, rank), F.lit(0)).cast("int").alias("mode"),
                                    F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("n_valid"))


def water_share(cells: DataFrame, water: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Percent of observed dates that are water, half-even rounding, NULL where never seen."""
    return cells.groupBy(*keys).agg(F.bround(100 * F.avg(F.col(water).cast("double"))).alias("water_share"))


def scene_shares(cells: DataFrame, scl: str, keys: Sequence[str] = CELL) -> DataFrame:
    seen = F.col(scl) != 0
    aggs = [F.bround(100 * F.avg(F.when(seen, F.col(scl).isin(*codes).cast("double")))).alias(f"share_{name}")
            for name, codes in SCENE_GROUPS.items()]
    return cells.groupBy(*keys).agg(F.count_if(seen).alias("n_seen"), *aggs)


def shifts(conn: int) -> list[tuple[int, int]]:
    four = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    return four if conn == 4 else four + [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def spread(mask: DataFrame, conn: int = 4, keys: Sequence[str] = (), own: bool = True) -> DataFrame:
    """Each cell sent to its neighbours (and itself), duplicates kept."""
    off = shifts(conn) + ([(0, 0)] if own else [])
    arr = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in off])
    return (mask.select(*keys, "row", "col", F.explode(arr).alias("o"))
            .select(*keys, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")))


def dilate(mask: DataFrame, frame: tuple[int, int, int, int] | None = None, n: int = 1, conn: int = 4,
           keys: Sequence[str] = ()) -> DataFrame:
    """Cells with at least one wet neighbour, inside the frame ``(row0, row1, col0, col1)``."""
    out = mask.select(*keys, "row", "col")
    for _ in range(n):
        out = spread(out, conn, keys).distinct()
        if frame:
            out = out.where(F.col("row").between(frame[0], frame[1]) & F.col("col").between(frame[2], frame[3]))
    return out


def erode(mask: DataFrame, n: int = 1, conn: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """Cells whose neighbours are all wet; the outside of the grid is dry."""
    out = mask.select(*keys, "row", "col")
    for _ in range(n):
        full = spread(out, conn, keys).groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("__n"))
        out = full.where(F.col("__n") == conn + 1).drop("__n")
    return out


def opened(mask: DataFrame, frame=None, n: int = 1, conn: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    return dilate(erode(mask, n, conn, keys), frame, n, conn, keys)


def closed(mask: DataFrame, frame=None, n: int = 1, conn: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    return erode(dilate(mask, frame, n, conn, keys), n, conn, keys)


def edge_ring(mask: DataFrame, frame=None, conn: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """Dilated but not eroded: the cells whose class is mixed."""
    return dilate(mask, frame, 1, conn, keys).join(erode(mask, 1, conn, keys), [*keys, "row", "col"], "left_anti")


def first_valid(cells: DataFrame, value: str, order: Sequence[str], source: str, keys: Sequence[str] = CELL) -> DataFrame:
    """The value of the first scene that observed the cell, and which scene it was."""
    seen = F.when(F.col(value).isNotNull(), F.struct(*order))
    return cells.groupBy(*keys).agg(F.min_by(value, seen).alias(value), F.min_by(source, seen).alias("source"))


def occurrence(cells: DataFrame, water: str, min_valid: int = 3, keys: Sequence[str] = CELL) -> DataFrame:
    """Occurrence class 1 never, 2 (0,25], 3 (25,50], 4 (50,75], 5 (75,100), 6 always; 0 below the support."""
    g = cells.groupBy(*keys).agg(F.count(water).alias("n_valid"), F.sum(water).alias("n_wet"))
    p = 100.0 * F.col("n_wet") / F.col("n_valid")
    c = (F.when(F.col("n_valid") < min_valid, 0).when(p == 0, 1).when(p <= 25, 2).when(p <= 50, 3).when(p <= 75, 4)
         .when(p < 100, 5).otherwise(6))
    return g.withColumn("occ_class", c)


def seen_periods(cells: DataFrame, period: str, flags: dict[str, Column], keys: Sequence[str] = CELL) -> DataFrame:
    """Per cell and block of 64 periods (``block``) one mask a flag: bit ``period % 64`` is set if the flag holds in a row of that period.

    Bits of one block stand for distinct periods, so rows are one a cell and not one a cell and period.  NULL is a period of its own."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(F.pmod(F.col(period), F.lit(64)), F.lit(0)).cast("int"))
    masks = [F.coalesce(F.bit_or(F.when(flag, bit)), F.lit(0).cast("long")).alias(name) for name, flag in flags.items()]
    return cells.groupBy(*keys, F.floor(F.col(period) / 64).alias("block")).agg(*masks)


def first_last(cells: DataFrame, when: str, cls: str, wet_codes: Sequence[int], keys: Sequence[str] = CELL) -> DataFrame:
    """First and last observed wet date, first observed dry date and the class at that date."""
    seen = F.col(cls).isNotNull() & (F.col(cls) != 0)
    wet = seen & F.col(cls).isin(*wet_codes)
    dry = seen & ~F.col(cls).isin(*wet_codes)
    return cells.groupBy(*keys).agg(
        F.min(F.when(wet, F.col(when))).alias("first_wet"), F.max(F.when(wet, F.col(when))).alias("last_wet"),
        F.min(F.when(dry, F.col(when))).alias("first_dry"),
        F.min_by(cls, F.when(dry, F.struct(when, cls))).alias("dry_class"), F.count_if(seen).alias("n_seen"))


def attach_shift(field: DataFrame, value: str, names: dict[str, tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Values of chosen neighbours as extra columns; one explode and one aggregate, whatever the number of neighbours."""
    arr = F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(n).alias("tag"))
                    for n, (dr, dc) in {**names, "__self": (0, 0)}.items()])
    e = field.select(*keys, "row", "col", value, F.explode(arr).alias("o"))
    e = e.select(*keys, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"),
                 F.col("o.tag").alias("tag"), value)
    agg = [F.max(F.when(F.col("tag") == n, F.col(value))).alias(n) for n in names]
    g = e.groupBy(*keys, "row", "col").agg(F.count_if(F.col("tag") == "__self").alias("__here"),
                                           F.max(F.when(F.col("tag") == "__self", F.col(value))).alias(value), *agg)
    return g.where("__here > 0").drop("__here")


def terrain(field: DataFrame, z: str, size: float) -> DataFrame:
    """Central-difference slope and aspect, 3x3 relief, mean and sample spread; cells at the border keep their 3x3 part."""
    s = attach_shift(field, z, {"up": (-1, 0), "dn": (1, 0), "lf": (0, -1), "rt": (0, 1)})
    gx = (F.col("rt") - F.col("lf")) / (2 * size)
    gy = (F.col("up") - F.col("dn")) / (2 * size)
    s = s.withColumn("slope", F.sqrt(gx * gx + gy * gy)).withColumn("aspect", F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0)))
    arr = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in shifts(8) + [(0, 0)]])
    e = field.select(F.explode(arr).alias("o"), "row", "col", z).select(
        (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), z)
    w = e.groupBy("row", "col").agg((F.max(z) - F.min(z)).alias("relief"), F.avg(z).alias("mean3"), F.stddev_samp(z).alias("sd3"))
    return s.select("row", "col", z, "slope", "aspect").join(w, ["row", "col"])


def distance(field: DataFrame, is_target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact Euclidean distance, in cells, of every grid cell to the nearest target cell.

    First pass: per column the nearest target above and below each cell, by ordered passes.  Second pass: along each
    row the lower envelope of parabolas; a band of 64 rows travels to one task, and its width is the grid's width.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    base = field.select(*keys, "row", "col", F.when(F.col(is_target), F.col("row")).alias("__hit"))
    base = B.known(base, [*keys, "col"], ["row"], "__hit", "__up")
    base = B.known(base, [*keys, "col"], ["row"], "__hit", "__dn", forward=True)
    g = F.least(F.col("row") - F.col("__up"), F.col("__dn") - F.col("row")).cast("double")
    base = base.select(*keys, "row", "col", g.alias("__g"), F.floor(F.col("row") / 64).alias("__band"))
    schema = T.StructType([base.schema[k] for k in [*keys, "row", "col"]] + [T.StructField("dist", T.DoubleType())])

    def envelope(c: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Distance along one row from columns ``c`` and squared vertical distances ``f``."""
        keep = np.flatnonzero(np.isfinite(f))
        if not len(keep):
            return np.full(len(c), np.nan)
        hull, start = [keep[0]], [-np.inf]
        for q in keep[1:]:
            while True:
                p = hull[-1]
                s = ((f[q] + c[q] ** 2) - (f[p] + c[p] ** 2)) / (2 * (c[q] - c[p]))
                if s > start[-1]:
                    break
                hull.pop(), start.pop()
            hull.append(q)
            start.append(s)
        at = np.array(hull)[np.searchsorted(np.array(start), c, side="right") - 1]
        return np.sqrt((c - c[at]) ** 2 + f[at])

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        row, c, f = pdf["row"].to_numpy(), pdf["col"].to_numpy(float), pdf["__g"].to_numpy(float) ** 2
        cut = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1), len(row)]
        dist = np.concatenate([envelope(c[a:b], f[a:b]) for a, b in zip(cut[:-1], cut[1:])])
        return pdf[[*keys, "row", "col"]].assign(dist=dist)

    return base.groupBy(*keys, "__band").applyInPandas(band, schema)


def seamless(layers: Sequence[tuple[str, DataFrame, Column]], z: str) -> DataFrame:
    """Priority merge: the first layer whose gate holds gives the cell, and its name is kept."""
    stacked = None
    for i, (name, df, gate) in enumerate(layers):
        part = df.select("row", "col", F.lit(i).alias("__p"), F.lit(name).alias("source"), F.when(gate, F.col(z)).alias(z))
        stacked = part if stacked is None else stacked.unionByName(part)
    seen = F.when(F.col(z).isNotNull(), F.col("__p"))
    return stacked.groupBy("row", "col").agg(F.min_by(z, seen).alias(z), F.min_by("source", seen).alias("source"))


def corner_blocks(field: DataFrame, z: str, level: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """2x2 blocks by their upper left cell: corners ``a b c d`` clockwise, ``level`` taken off; blocks with a missing corner go."""
    s = attach_shift(field, z, {"b": (0, 1), "c": (1, 1), "d": (1, 0)}, keys).where(f"{z} is not null and b is not null and c is not null and d is not null")
    return s.select(*keys, "row", "col", *[(F.col(src) - level).alias(n) for src, n in ((z, "a"), ("b", "b"), ("c", "c"), ("d", "d"))])


def block_segments(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Marching squares over ``corner_blocks``: one row per contour segment, ``seg`` 0 or 1 within its block, ends interpolated
    along the block's edges."""
    a, b, c, d = (F.col(n) for n in "abcd")
    code = (F.when(a > 0, 1).otherwise(0) + F.when(b > 0, 2).otherwise(0) + F.when(c > 0, 4).otherwise(0)
            + F.when(d > 0, 8).otherwise(0))
    cut = lambda p, q: p / (p - q)
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0 = F.col("col"), F.col("row")
    top, right = pt(x0 + cut(a, b), y0), pt(x0 + 1, y0 + cut(b, c))
    bottom, left = pt(x0 + cut(d, c), y0 + 1), pt(x0, y0 + cut(a, d))
    seg = lambda p, q: F.array(F.struct(p.alias("p"), q.alias("q")))
    two = lambda p, q, r, t: F.concat(seg(p, q), seg(r, t))
    lines = (F.when(F.col("code").isin(1, 14), seg(left, top)).when(F.col("code").isin(2, 13), seg(top, right))
             .when(F.col("code").isin(4, 11), seg(right, bottom)).when(F.col("code").isin(8, 7), seg(bottom, left))
             .when(F.col("code").isin(3, 12), seg(left, right)).when(F.col("code").isin(6, 9), seg(top, bottom))
             .when(F.col("code") == 5, two(left, top, right, bottom)).when(F.col("code") == 10, two(top, right, bottom, left)))
    out = blocks.withColumn("code", code).select("*", F.posexplode(lines).alias("seg", "s"))
    return out.select(*keys, "row", "col", "seg", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"),
                      F.col("s.q.y").alias("y2"))


def crossings(field: DataFrame, z: str, level: float) -> DataFrame:
    """Contour segments of a field at one level."""
    return block_segments(corner_blocks(field, z, level))


def transitions(a: DataFrame, b: DataFrame, cls: str, area: float, keys: Sequence[str] = CELL) -> DataFrame:
    """Area per (class before, class after)."""
    j = a.select(*keys, F.col(cls).alias("from_class")).join(b.select(*keys, F.col(cls).alias("to_class")), list(keys))
    return j.groupBy("from_class", "to_class").agg((F.count(F.lit(1)) * area).alias("area"))


def area_by_class(cells: DataFrame, keys: Sequence[str], value: str, area: str) -> DataFrame:
    """Cells, area, share of the area of all classes and area-weighted mean of a value (over cells that have one)."""
    known = F.when(F.col(value).isNotNull(), F.col(area))
    g = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"), (F.sum(F.col(value) * F.col(area)) / F.sum(known)).alias("weighted_mean"))
    total = g.agg(F.sum("area").alias("__total")).withColumn("__one", F.lit(1))  # one row
    return g.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").withColumn("share", F.col("area") / F.col("__total")).drop("__one", "__total")


def pyramid(base: DataFrame, keys: Sequence[str], counts: Sequence[str], levels: int) -> list[tuple[int, DataFrame]]:
    """(cell size, counts by cell) of cells once, twice, four times ... as wide, each level summed from the one before."""
    out, size, now = [(1, base)], 1, base
    for _ in range(levels - 1):
        now = now.groupBy(*keys, F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(*[F.sum(c).alias(c) for c in counts])
        size *= 2
        out.append((size, now))
    return out


def convergence(shares: DataFrame, by: Sequence[str], limit: float = 0.3) -> DataFrame:
    """``shares(by, size, method, cells, pct)`` to one row a size: median and range over methods, the step from the next coarser size,
    the drift from the coarsest to the finest and whether the last step is below ``limit``.  Sizes are few."""
    by = list(by)
    g = B.summarise(shares, [*by, "size"], {"cells": F.max("cells"), "lo": F.min("pct"), "hi": F.max("pct")}, {"pct": ("pct", 0.5)})
    w = W.partitionBy(*by).orderBy(F.col("size").desc())
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    g = g.withColumn("step", F.col("pct") - F.lag("pct").over(w)).withColumn("drift", F.last("pct").over(whole) - F.first("pct").over(whole))
    return g.withColumn("converged", F.abs(F.last("step").over(whole)) < limit)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def attach(cells: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.join(broadcast_if_small(side), list(keys), "left")
