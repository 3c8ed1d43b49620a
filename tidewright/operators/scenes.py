"""Structure and movement of dated masks and contours: parts and holes, the connected channel, distances between boundaries and the
way a contour moves along its normals.  Positions are in cells: x along columns, y along rows, cell corners of the field at integers."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage
from . import blocks as B
from . import cells as C
from . import labels as LB

_FOUR, _EIGHT = [(0, 1), (1, 0)], [(0, 1), (1, 0), (1, 1), (1, -1)]


def _runs(side: np.ndarray, conn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set cells along the lines of a grid: line, start, end (beyond the last cell) and the number of the part they belong to."""
    span = side.shape[1] + 1
    turn = np.flatnonzero(np.diff(np.pad(side, ((0, 0), (0, 1))).ravel().astype(np.int8), prepend=0, append=0))
    start, end = turn[::2], turn[1::2]
    # runs of the next line that meet a run: by a side, or for 8 neighbours by a corner
    lo = np.searchsorted(end, start + span, side="left" if conn == 8 else "right")
    hi = np.searchsorted(start, end + span, side="right" if conn == 8 else "left")
    size = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(start)), size)
    b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + lo[a]
    lab = np.arange(len(start))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        for ends in (a, b):
            np.minimum.at(new, ends, low)
            np.minimum.at(new, lab[ends], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return start // span, start % span, start % span + end - start, np.unique(lab, return_inverse=True)[1]


def scene_structure(mask: DataFrame, keys: Sequence[str], key_id: Column, box: tuple[int, int, int, int], tile: int = 256) -> DataFrame:
    """Per scene: parts (8 neighbours), largest part's share, hole cells and their share of the water.

    A hole is a part of the background (4 neighbours) that does not reach the frame ``(row0, row1, col0, col1)``.  Water and background
    are labelled together inside tiles; what leaves a tile is one row a part (cells, whether it reaches the frame) and its rim cells.
    A tile without water is one part of the background.  Touching parts are then joined in one run over all scenes.  Tiles hold
    ``tile * tile`` cells: where the frame is narrower than ``tile`` they are as much longer."""
    keys = list(keys)
    r0, r1, c0, c1 = box
    width, stride = c1 - c0 + 1, (r1 - r0 + 1) * (c1 - c0 + 1)
    tall = tile * tile // min(tile, width)
    tr, tc = F.floor((F.col("row") - r0) / tall), F.floor((F.col("col") - c0) / tile)
    m = mask.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1)).select(*keys, key_id.cast("long").alias("kid"), "row", "col", tr.alias("tr"), tc.alias("tc"))
    fields = [m.schema[k] for k in [*keys, "kid", "tr", "tc"]]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in ("local", "n", "rim", "row", "col")], T.StructField("wet", T.BooleanType())])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = r0 + int(pdf["tr"].iloc[0]) * tall, c0 + int(pdf["tc"].iloc[0]) * tile
        high, wide = min(tall, r1 - top + 1), min(tile, c1 - left + 1)
        wet = np.zeros((high, wide), bool)
        wet[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = True
        base = int(pdf["kid"].iloc[0]) * stride
        # cells beside another tile
        beside = np.zeros((high, wide), bool)
        for there, at in ((top > r0, np.s_[0]), (top + high - 1 < r1, np.s_[-1]), (left > c0, np.s_[:, 0]), (left + wide - 1 < c1, np.s_[:, -1])):
            beside[at] |= there
        er, ec = np.nonzero(beside)
        turned = high > wide                                       # runs go along the longer side
        out = []
        for side, conn in ((wet, 8), (~wet, 4)):
            line, start, end, of = _runs(side.T if turned else side, conn)
            if not line.size:
                continue
            r, c = (start, line) if turned else (line, start)
            r_end, c_end = (end - 1, line) if turned else (line, end - 1)
            ids = np.full(of.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(ids, of, base + (r + top - r0) * width + (c + left - c0))
            at_frame = (r + top == r0) | (r_end + top == r1) | (c + left == c0) | (c_end + left == c1)
            n, rim = np.bincount(of, end - start).astype(np.int64), np.bincount(of, at_frame) > 0
            out.append(pd.DataFrame({"local": ids, "n": n, "rim": rim.astype(np.int64), "row": -1, "col": -1, "wet": side is wet}))
            own = side[er, ec]
            span = side.shape[0 if turned else 1] + 1
            key = (ec * span + er if turned else er * span + ec)[own]
            lab = ids[of[np.searchsorted(line * span + start, key, side="right") - 1]]
            out.append(pd.DataFrame({"local": lab, "n": -1, "rim": -1, "row": er[own] + top, "col": ec[own] + left, "wet": side is wet}))
        got = pd.concat(out, ignore_index=True)
        for k in [*keys, "kid", "tr", "tc"]:
            got[k] = pdf[k].iloc[0]
        return got[[f.name for f in schema]]

    tiles = cut_lineage(m.distinct().groupBy(*keys, "kid", "tr", "tc").applyInPandas(inside, schema))
    parts = tiles.where("n > 0").select(*keys, F.col("local").alias("id"), "n", (F.col("rim") > 0).alias("at_frame"), "wet")
    rim = tiles.where("n < 0").select(*keys, "kid", "tr", "tc", "local", "row", "col", "wet")
    # tiles without water: the scenes' tiles less those that hold some
    spark, n_tr, n_tc = mask.sparkSession, (r1 - r0) // tall + 1, (c1 - c0) // tile + 1
    scenes = m.select(*keys, "kid").distinct()
    grid = scenes.withColumn("tr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tr - 1).cast("long")))).withColumn(
        "tc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tc - 1).cast("long"))))
    first_row, first_col = r0 + F.col("tr") * tall, c0 + F.col("tc") * tile
    rows, cols = F.least(F.lit(tall), r1 - first_row + 1), F.least(F.lit(tile), c1 - first_col + 1)
    dry = grid.join(tiles.select("kid", "tr", "tc").distinct(), ["kid", "tr", "tc"], "left_anti").withColumn(
        "local", F.col("kid") * stride + (first_row - r0) * width + (first_col - c0))
    at_frame = (F.col("tr") == 0) | (F.col("tr") == n_tr - 1) | (F.col("tc") == 0) | (F.col("tc") == n_tc - 1)
    parts = parts.unionByName(dry.select(*keys, F.col("local").alias("id"), (rows * cols).alias("n"), at_frame.alias("at_frame"), F.lit(False).alias("wet")))
    offsets = lambda o: F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in o]))
    edges = None
    for wet, o in ((True, _EIGHT), (False, _FOUR)):
        own = rim.where(F.col("wet") == wet)
        step = own.select("kid", F.col("local").alias("src"), F.col("tr").alias("sr"), F.col("tc").alias("sc"), offsets(o).alias("o"), "row", "col")
        step = step.select("kid", "src", "sr", "sc", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
        e = step.join(own.select("kid", "row", "col", F.col("local").alias("dst"), "tr", "tc"), ["kid", "row", "col"]).where("sr <> tr or sc <> tc").select("src", "dst")
        edges = e if edges is None else edges.unionByName(e)
    # background at the rim of a tile meets the dry tile beside it; dry tiles meet each other
    beside = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    out = rim.where(~F.col("wet")).select("kid", F.col("local").alias("src"), "tr", "tc", "row", "col", beside.alias("o"))
    out = out.select("kid", "src", F.floor((F.col("row") + F.col("o.a") - r0) / tall).alias("tr"), F.floor((F.col("col") + F.col("o.b") - c0) / tile).alias("tc"))
    out = out.unionByName(dry.select("kid", F.col("local").alias("src"), "tr", "tc", beside.alias("o")).select(
        "kid", "src", (F.col("tr") + F.col("o.a")).alias("tr"), (F.col("tc") + F.col("o.b")).alias("tc")))
    edges = edges.unionByName(out.distinct().join(dry.select("kid", "tr", "tc", F.col("local").alias("dst")), ["kid", "tr", "tc"]).select("src", "dst"))
    edges = cut_lineage(edges.distinct())
    lab = LB.components(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)
    whole = (parts.join(broadcast_if_small(lab), "id", "left").groupBy(*keys, F.coalesce("label", "id").alias("label"), "wet")
             .agg(F.sum("n").alias("n"), F.max("at_frame").alias("at_frame")))
    wet_n, hole_n = F.when(F.col("wet"), F.col("n")), F.when(~F.col("wet") & ~F.col("at_frame"), F.col("n"))
    return whole.groupBy(*keys).agg(F.count(wet_n).alias("parts"), (F.max(wet_n) / F.sum(wet_n)).alias("largest_share"),
                                    F.coalesce(F.sum(hole_n), F.lit(0)).alias("hole_cells"), (F.coalesce(F.sum(hole_n), F.lit(0)) / F.sum(wet_n)).alias("hole_share"))


def main_component(labels: DataFrame, keys: Sequence[str], row: int, col: int) -> DataFrame:
    """Per scene the component that holds the wet cell nearest to a point; ties go to the lower row, then column."""
    d2 = (F.col("row") - row) * (F.col("row") - row) + (F.col("col") - col) * (F.col("col") - col)
    return labels.groupBy(*keys).agg(F.min_by("label", F.struct(d2, "row", "col")).alias("label"))


def reach_from_start(bins: DataFrame, keys: Sequence[str], flag: str, n_bins: int, width: float, tolerance: float) -> DataFrame:
    """Length of the run of flagged bins ``k`` from bin 0, gaps up to ``tolerance`` allowed, and the longest gap met on the way.

    The flags of a scene are the list of its flagged bins, at most as many as the axis has."""
    runs = bins.where(flag).groupBy(*keys).agg(F.array_sort(F.collect_set("k")).alias("ks"))
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0.0).alias("gap"), F.lit(False).alias("over"))

    def step(acc, k):
        gap = (k - acc["last"] - 1) * width
        over = acc["over"] | (gap > tolerance)
        stop = F.floor(F.lit(tolerance / width)) + 1  # the bin at which the walk gives up
        return F.struct(F.when(over, acc["last"]).otherwise(k).alias("last"),
                        F.when(acc["over"], acc["gap"]).otherwise(F.greatest(acc["gap"], F.least(gap, stop * F.lit(width)))).alias("gap"), over.alias("over"))

    end = F.aggregate("ks", start, step)
    tail = F.least((F.lit(n_bins) - 1 - F.col("e.last")) * width, (F.floor(F.lit(tolerance / width)) + 1) * F.lit(width))
    return runs.select(*keys, end.alias("e")).select(*keys, ((F.col("e.last") + 1) * width).alias("reach_km"),
                                                     F.when(F.col("e.over"), F.col("e.gap")).otherwise(F.greatest(F.col("e.gap"), tail)).alias("max_gap"))


def channel_connectivity(labels: DataFrame, seen: DataFrame, nodes: DataFrame, keys: Sequence[str], start: tuple[int, int], bin_km: float,
                         n_bins: int, tolerance: float) -> DataFrame:
    """Connected and observable channel length per scene: axis nodes (row, col, chain_km) on the main component of the water, in bins.

    ``labels`` holds the wet cells with their components, ``seen`` the observed cells of every scene."""
    keys = list(keys)
    main = main_component(labels, keys, *start).withColumnRenamed("label", "main")
    n = nodes.withColumn("k", F.floor(F.col("chain_km") / bin_km)).where(F.col("k").between(0, n_bins - 1))
    scenes = seen.select(*keys).distinct()
    on = broadcast_if_small(n).join(seen.select(*keys, "row", "col").withColumn("seen", F.lit(True)), ["row", "col"])
    on = on.join(labels.select(*keys, "row", "col", "label"), [*keys, "row", "col"], "left").join(broadcast_if_small(main), keys, "left")
    per = on.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n_seen"), F.count("label").alias("n_wet"), F.count_if(F.col("label") == F.col("main")).alias("n_main"))
    per = cut_lineage(per)
    total = per.groupBy(*keys).agg(F.sum("n_seen").alias("n_observable"), F.sum("n_wet").alias("n_on_water"), F.sum("n_main").alias("n_in_main"))
    conn = reach_from_start(per.withColumn("f", F.col("n_main") > 0), keys, "f", n_bins, bin_km, tolerance)
    obs = reach_from_start(per, keys, "true", n_bins, bin_km, tolerance).select(*keys, F.col("reach_km").alias("observable_km"))
    longest = F.least(F.lit(n_bins * bin_km), (F.floor(F.lit(tolerance / bin_km)) + 1) * F.lit(bin_km))
    j = scenes.join(total, keys, "left").join(conn, keys, "left").join(obs, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(*keys, *[zero(c).cast("long").alias(c) for c in ("n_observable", "n_on_water", "n_in_main")], zero("reach_km").cast("double").alias("connected_km"),
                    zero("observable_km").cast("double").alias("observable_km"), F.coalesce("max_gap", longest).cast("double").alias("max_gap_km")).withColumn(
        "connected_fraction", F.when(F.col("observable_km") > 0, F.col("connected_km") / F.col("observable_km")))


def contour_vertices(segments: DataFrame) -> DataFrame:
    """The middle of every segment (``vid``, x, y) and the segment's length."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return segments.select(F.struct("row", "col", "seg").alias("vid"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"),
                           F.sqrt(dx * dx + dy * dy).alias("len"))


def segment_distance(px: Column, py: Column) -> Column:
    """Distance of a point to the segment x1, y1, x2, y2."""
    vx, vy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = vx * vx + vy * vy
    at = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * vx + (py - F.col("y1")) * vy) / n))).otherwise(0.0)
    ex, ey = px - (F.col("x1") + at * vx), py - (F.col("y1") + at * vy)
    return F.sqrt(ex * ex + ey * ey)


def nearest_segment(points: DataFrame, segments: DataFrame, size: int = 2) -> DataFrame:
    """``points(vid, x, y)`` with the distance to the nearest segment, exact and without a largest distance.

    Segments lie inside their block, so a segment outside the 3x3 buckets around a point is farther than a bucket; points that found
    none so near go on with buckets twice as wide."""
    left, pieces = cut_lineage(points.select("vid", "x", "y")), []
    lim = segments.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    span = points.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if lim[0] is None or span[0] is None:
        return points.withColumn("dist", F.lit(None).cast("double"))
    extent = max(max(lim[1] + 1, span[1]) - min(lim[0], span[0]), max(lim[3] + 1, span[3]) - min(lim[2], span[2])) + 1
    s = cut_lineage(segments.select("row", "col", "x1", "y1", "x2", "y2"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    while True:
        last = size >= extent
        q = left.select("vid", "x", "y", F.floor(F.col("y") / size).alias("br"), F.floor(F.col("x") / size).alias("bc"), around.alias("o"))
        q = q.select("vid", "x", "y", (F.col("br") + F.col("o.a")).alias("br"), (F.col("bc") + F.col("o.b")).alias("bc"))
        q = F.broadcast(q) if left.select(F.lit(1)).limit(10_001).count() <= 10_000 else q       # few points go to the segments
        met = q.join(s.withColumn("br", F.floor(F.col("row") / size)).withColumn("bc", F.floor(F.col("col") / size)).drop("row", "col"), ["br", "bc"])
        best = cut_lineage(met.groupBy("vid").agg(F.min(segment_distance(F.col("x"), F.col("y"))).alias("dist")).where(F.lit(last) | (F.col("dist") <= size)))
        pieces.append(best)
        if last:
            break
        left = cut_lineage(left.join(best, "vid", "left_anti"))
        if left.isEmpty():
            break
        size *= 2
    found = pieces[0]
    for p in pieces[1:]:
        found = found.unionByName(p)
    return points.join(found, "vid", "left")


def inside_level(points: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """``points(vid, x, y)`` with ``inside``: above the level by crossing parity, NULL where the block was not observed.

    The ray comes from the block's left edge at the point's height: the edge's own side, turned once for every segment on the way.
    Beyond the block the parity need not be counted, as the edge's side is what the rest of the ray would give."""
    p = points.select("vid", "x", "y", F.floor("y").alias("row"), F.floor("x").alias("col"))
    h = F.col("y") - F.col("row")
    at_edge = F.when((F.col("a") > 0) == (F.col("d") > 0), F.col("a") > 0).otherwise((h < F.col("a") / (F.col("a") - F.col("d"))) == (F.col("a") > 0))
    j = p.join(blocks.select("row", "col", "a", "d"), ["row", "col"], "left")
    spans = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    cut = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    turns = j.select("vid", "x", "y", "row", "col").join(segments, ["row", "col"]).where(spans & (cut < F.col("x"))).groupBy("vid").agg(F.count(F.lit(1)).alias("turns"))
    return j.join(turns, "vid", "left").select("vid", F.when(F.col("a").isNotNull(), at_edge == (F.coalesce("turns", F.lit(0)) % 2 == 0)).alias("inside"))


def _near_in_tile(size: int):
    """Distance of a tile's vertices to the segments about it (NULL beyond ``size``), and whether they lie above the level of their block."""

    def settle(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        p = p.drop(columns=["tr", "tc"])
        if not len(p) or not len(o):
            return p.assign(dist=np.nan, inside=pd.array([pd.NA] * len(p), dtype="boolean"))
        x, y = p["x"].to_numpy(), p["y"].to_numpy()
        row, col = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        o = o.sort_values(["row", "col"])
        left = min(o["col"].min(), col.min())
        width = max(o["col"].max(), col.max()) - left + 1
        mine, cells = row * width + col - left, (o["row"] * width + o["col"] - left).to_numpy()
        line, block = o["x1"].notna().to_numpy(), o["a"].notna().to_numpy()
        x1, y1, x2, y2 = (o[c].to_numpy()[line] for c in ("x1", "y1", "x2", "y2"))
        vx, vy = x2 - x1, y2 - y1
        n = vx * vx + vy * vy
        rows, of = o["row"].to_numpy()[line], cells[line]
        dist = np.full(len(p), np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            for r in np.unique(row):                              # lines of the rows that may be so near
                i, s = np.flatnonzero(row == r), slice(*np.searchsorted(rows, [r - 1 - size, r + 2 + size]))
                if s.start < s.stop:
                    px, py = x[i, None], y[i, None]
                    t = np.where(n[s] > 0, np.maximum(0.0, np.minimum(1.0, ((px - x1[s]) * vx[s] + (py - y1[s]) * vy[s]) / n[s])), 0.0)
                    ex, ey = px - (x1[s] + t * vx[s]), py - (y1[s] + t * vy[s])
                    dist[i] = np.sqrt((ex * ex + ey * ey).min(axis=1))
            # the block's edge, turned once for every line of the block on the way (see ``inside_level``)
            first, end = np.searchsorted(of, mine), np.searchsorted(of, mine, side="right")
            turns = np.zeros(len(p), np.int64)
            for k in range(int((end - first).max())):
                i = np.flatnonzero(first + k < end)
                s = first[i] + k
                turns[i] += ((y1[s] > y[i]) != (y2[s] > y[i])) & (x1[s] + (y[i] - y1[s]) * vx[s] / vy[s] < x[i])
            at = np.searchsorted(cells[block], mine)
            known = np.append(cells[block], cells.min() - 1)[at] == mine
            a, d = (np.append(o[c].to_numpy()[block], np.nan)[at] for c in ("a", "d"))
            edge = np.where((a > 0) == (d > 0), a > 0, (y - row < a / (a - d)) == (a > 0))
        inside = pd.array(edge == (turns % 2 == 0), dtype="boolean")
        inside[~known] = pd.NA
        return p.assign(dist=np.where(dist <= size, dist, np.nan), inside=inside)

    return settle


def boundary_distances(first: DataFrame, second: DataFrame, blocks1: DataFrame, blocks2: DataFrame, size: int = 4, tile: int = 256) -> DataFrame:
    """Both directions: ``direction, vid, len, dist`` and ``signed``, positive where the first extent is the larger one.

    A vertex of the first boundary inside the second extent means a smaller first extent, a vertex of the second one inside the
    first a larger one, so that both directions agree in sign.  ``signed`` is NULL where the other field was not observed.

    A vertex is sent once, to its tile, where the segments up to ``size`` beyond the tile are; what is no farther than that is exact.
    The others, few where lines are dense, go on by ``nearest_segment``."""
    both = None
    for tag, own, other, blocks, plus in (("first", first, second, blocks2, False), ("second", second, first, blocks1, True)):
        at = lambda c, by: F.floor(F.col(c) / by).cast("long")
        v = contour_vertices(own).select(F.col("vid.row").alias("row"), F.col("vid.col").alias("col"), F.col("vid.seg").alias("seg"), "x", "y", "len", at("y", tile).alias("tr"), at("x", tile).alias("tc"))
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - size) / tile).cast("long"), F.floor((F.col(c) + 1 + size) / tile).cast("long")))
        ends, none = ["x1", "y1", "x2", "y2"], F.lit(None).cast("double")
        lines = other.select(F.col("row").cast("long"), F.col("col").cast("long"), *ends, none.alias("a"), none.alias("d"), span("row").alias("tr")).select("*", span("col").alias("tc"))
        corners = blocks.select(F.col("row").cast("long"), F.col("col").cast("long"), *[none.alias(c) for c in ends], "a", "d", at("row", tile).alias("tr"), at("col", tile).alias("tc"))
        schema = T.StructType([*[f for f in v.schema if f.name not in ("tr", "tc")], T.StructField("dist", T.DoubleType()), T.StructField("inside", T.BooleanType())])
        d = cut_lineage(v.groupBy("tr", "tc").cogroup(lines.unionByName(corners).groupBy("tr", "tc")).applyInPandas(_near_in_tile(size), schema))
        d = d.select(F.struct("row", "col", "seg").alias("vid"), "x", "y", "len", F.nanvl("dist", none).alias("dist"), "inside")
        left = d.where("dist is null").select("vid", "x", "y", "len", "inside")
        if not left.isEmpty():
            d = d.where("dist is not null").unionByName(nearest_segment(left, other, 2 * size).select(*d.columns))
        sign = F.when(F.col("inside") == plus, 1.0).when(F.col("inside").isNotNull(), -1.0)
        d = d.select(F.lit(tag).alias("direction"), "vid", "len", "dist", (sign * F.col("dist")).alias("signed"))
        both = d if both is None else both.unionByName(d)
    return both


def bilinear(x: Column, y: Column) -> Column:
    """Value inside a block of corners a, b, c, d."""
    u, v = x - F.floor(x), y - F.floor(y)
    return (F.col("a") * (1 - u) + F.col("b") * u) * (1 - v) + (F.col("d") * (1 - u) + F.col("c") * u) * v


def normals(vertices: DataFrame, blocks: DataFrame) -> DataFrame:
    """Vertices with the unit vector ``ux, uy`` up the field; vertices on level ground have none and go."""
    x, y = F.col("x"), F.col("y")
    j = vertices.withColumn("row", F.col("vid.row")).withColumn("col", F.col("vid.col")).join(blocks, ["row", "col"])
    u, v = x - F.col("col"), y - F.col("row")
    gx = (F.col("b") - F.col("a")) * (1 - v) + (F.col("c") - F.col("d")) * v
    gy = (F.col("d") - F.col("a")) * (1 - u) + (F.col("c") - F.col("b")) * u
    j = j.withColumn("gx", gx).withColumn("gy", gy).withColumn("g", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    return j.where("g > 0").select("vid", "x", "y", "len", (F.col("gx") / F.col("g")).alias("ux"), (F.col("gy") / F.col("g")).alias("uy"))


def trace(lines: DataFrame, blocks: DataFrame, per_cell: int = 4, reach: int = 16) -> DataFrame:
    """Follow each line (vid, x, y, ux, uy) through a field until it turns from below to above the level or leaves what was observed.

    Columns: vid, start (the field at the vertex), dist (NULL without a crossing).  Lines are a frontier: a round samples the next
    ``reach`` steps of those still under way, and the next round goes twice as far, so that no distance is too long."""
    now = cut_lineage(lines.select("vid", "x", "y", "ux", "uy", F.lit(0).alias("k0"), F.lit(None).cast("double").alias("start")))
    b, pieces = cut_lineage(blocks), []
    while True:
        k = F.explode(F.sequence(F.col("k0"), F.col("k0") + reach))
        s = now.withColumn("k", k)
        s = s.withColumn("px", F.col("x") + F.col("ux") * F.col("k") / per_cell).withColumn("py", F.col("y") + F.col("uy") * F.col("k") / per_cell)
        s = s.withColumn("row", F.floor("py")).withColumn("col", F.floor("px")).join(b, ["row", "col"], "left")
        s = s.withColumn("f", bilinear(F.col("px"), F.col("py")))
        # the samples of a line are one short list: it ends at the first that is above the level or was not observed
        g = s.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("fs"), F.min(F.when(F.col("f").isNull() | (F.col("f") >= 0), F.col("k"))).alias("stop"))
        g = now.join(g, "vid")
        at = F.col("stop") - F.col("k0") + 1
        before, here = F.try_element_at("fs", (at - 1).cast("int"))["f"], F.try_element_at("fs", at.cast("int"))["f"]
        start = F.when(F.col("k0") == 0, F.col("fs")[0]["f"]).otherwise(F.col("start"))
        crossed = here.isNotNull() & (F.col("stop") > F.col("k0"))
        dist = F.when(crossed, (F.col("stop") - 1 + before / (before - here)) / per_cell)
        g = cut_lineage(g.select("vid", "x", "y", "ux", "uy", "stop", start.alias("start"), dist.alias("dist"), (F.col("k0") + reach).alias("k0")))
        pieces.append(g.where("stop is not null").select("vid", "start", "dist"))
        now = cut_lineage(g.where("stop is null").select("vid", "x", "y", "ux", "uy", "k0", "start"))
        if now.isEmpty():
            break
        reach *= 2
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def movement(early: DataFrame, late: DataFrame, rise: float, per_cell: int = 4) -> DataFrame:
    """Vertices of the early contour with ``flag`` (OK, NOT_NESTED, NO_CROSSING) and ``rate``: the way to the late contour along the
    early field's normal, for each unit of ``rise`` between both levels.  Fields are corner blocks about the level, wet below it."""
    v = cut_lineage(normals(contour_vertices(C.block_segments(early)), early))
    t = v.join(trace(v, late, per_cell), "vid")
    flag = F.when(F.col("start").isNull() | (F.col("start") >= 0), "NOT_NESTED").when(F.col("dist").isNull(), "NO_CROSSING").otherwise("OK")
    return t.withColumn("flag", flag).withColumn("rate", F.when(flag == "OK", F.col("dist") / rise))


def step_summary(moved: DataFrame) -> DataFrame:
    """One row: vertices, share of the length with each flag, quantiles of the rate."""
    share = lambda f: F.sum(F.when(F.col("flag") == f, F.col("len")).otherwise(0.0)) / F.sum("len")
    return B.summarise(moved, [], {"n": F.count(F.lit(1)), "ok_length": share("OK"), "not_nested_length": share("NOT_NESTED"), "no_crossing_length": share("NO_CROSSING")},
                       {"k_median": ("rate", 0.5), "k_p25": ("rate", 0.25), "k_p75": ("rate", 0.75), "k_p90": ("rate", 0.9)})
