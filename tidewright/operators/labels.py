"""Connected components over edges or cells, and the cell operators built on them.

Labels are the smallest member id.  Cells are first labelled inside square tiles, so only pairs of touching tile
components reach the graph.  The graph is contracted by alternating star steps, which shrink long thin components
geometrically; every round is a reliable checkpoint, and the loop ends when the edge set no longer changes."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage
from . import cells as C


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(id)`` and ``edges(src, dst)`` (any direction) to ``id, label``.

    Alternating large-star and small-star steps: a hub contributes one minimum, never the pairs of its members."""
    fingerprint = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())
    e = cut_lineage(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct())
    seen = fingerprint(e)
    while seen[0]:
        both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        down = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("src"), F.col("m").alias("dst")).union(low2.select("a", "m"))
        e = cut_lineage(small.where("src <> dst").distinct())
        now = fingerprint(e)
        if now == seen:
            break
        seen = now
    top = e.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("label"))
    return nodes.select("id").join(top, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _local_labels(row: np.ndarray, col: np.ndarray, ids: np.ndarray, conn: int) -> np.ndarray:
    """Smallest id of each component among the given cells."""
    order = np.argsort(ids)
    row, col, ids = row[order], col[order], ids[order]
    span = int(col.max() - col.min()) + 3
    code = (row - row.min()) * span + (col - col.min()) + 1
    rank = np.argsort(code)
    a, b = [], []
    for dr, dc in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else []):
        at = np.minimum(np.searchsorted(code, code + dr * span + dc, sorter=rank), len(code) - 1)
        hit = code[rank[at]] == code + dr * span + dc
        a.append(np.flatnonzero(hit))
        b.append(rank[at[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    lab = np.arange(len(ids))
    while True:
        la, lb = lab[a], lab[b]
        low = np.minimum(la, lb)
        new = lab.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = ids[lab]
    return out


def label_cells(mask: DataFrame, width: int, conn: int = 8, keys: Sequence[str] = (), key_id: Column | None = None,
                stride: int = 0, tile: int = 256) -> DataFrame:
    """Component label of each wet cell.  Cell id = key_id * stride + row * width + col, so one run labels all dates."""
    keys = list(keys)
    cid = F.col("row").cast("long") * width + F.col("col")
    if key_id is not None:
        cid = key_id.cast("long") * stride + cid
    n = mask.select(*keys, "row", "col", cid.alias("id"), F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    schema = T.StructType([*[n.schema[c] for c in [*keys, "row", "col", "tr", "tc"]], T.StructField("local", T.LongType())])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        lab = _local_labels(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["id"].to_numpy(), conn)
        return pdf.drop(columns="id").assign(local=lab)

    n = cut_lineage(n.groupBy(*keys, "tr", "tc").applyInPandas(inside, schema))
    off = [(0, 1), (1, 0)] if conn == 4 else [(0, 1), (1, 0), (1, 1), (1, -1)]
    arr = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in off])
    rim = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = n.where(rim("row") | rim("col"))
    step = border.select(*keys, F.col("local").alias("src"), F.col("tr").alias("sr"), F.col("tc").alias("sc"), F.explode(arr).alias("o"), "row", "col")
    step = step.select(*keys, "src", "sr", "sc", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    e = step.join(border.select(*keys, "row", "col", F.col("local").alias("dst"), "tr", "tc"), [*keys, "row", "col"])
    e = e.where("sr <> tr or sc <> tc").select("src", "dst")
    lab = components(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)
    out = n.join(broadcast_if_small(lab.withColumnRenamed("id", "local")), "local", "left")
    return out.select(*keys, "row", "col", F.coalesce("label", "local").alias("label"))


def component_table(labels: DataFrame, keys: Sequence[str] = (), cell_area: float = 1.0, noise_below: int = 1) -> DataFrame:
    """Size, area, box, centroid, exposed boundary length and noise flag per component."""
    keys = list(keys)
    inner = C.spread(labels, 4, [*keys, "label"], own=False).join(
        labels.select(*keys, "label", "row", "col"), [*keys, "label", "row", "col"]).groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("__in"))
    t = labels.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("row").alias("row0"), F.max("row").alias("row1"),
        F.min("col").alias("col0"), F.max("col").alias("col1"), F.avg("row").alias("c_row"), F.avg("col").alias("c_col"))
    t = t.join(inner, [*keys, "label"], "left")
    return (t.withColumn("boundary", 4 * F.col("n_cells") - F.coalesce("__in", F.lit(0))).drop("__in")
            .withColumn("area", F.col("n_cells") * cell_area).withColumn("is_noise", F.col("n_cells") < noise_below))


def complement(frame: DataFrame, mask: DataFrame) -> DataFrame:
    return frame.select("row", "col").join(mask.select("row", "col"), ["row", "col"], "left_anti")


def holes(mask: DataFrame, frame: DataFrame, box: tuple[int, int, int, int], width: int) -> DataFrame:
    """Labels of complement components that do not touch the frame border: ``row, col, label``."""
    lab = label_cells(complement(frame, mask), width, 4)
    rim = (F.col("row") == box[0]) | (F.col("row") == box[1]) | (F.col("col") == box[2]) | (F.col("col") == box[3])
    return lab.join(lab.where(rim).select("label").distinct(), "label", "left_anti")


def fill_holes(mask: DataFrame, frame: DataFrame, box: tuple[int, int, int, int], width: int,
               max_size: int | None = None) -> DataFrame:
    h = holes(mask, frame, box, width)
    if max_size is not None:
        keep = h.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_size)
        h = h.join(keep, "label", "left_semi")
    return mask.select("row", "col").unionByName(h.select("row", "col"))


def drop_small(mask: DataFrame, width: int, min_part: int, conn: int = 8) -> DataFrame:
    lab = label_cells(mask, width, conn)
    big = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_part)
    return lab.join(big, "label", "left_semi").select("row", "col")


def clean_water(mask: DataFrame, frame: DataFrame, box: tuple[int, int, int, int], width: int, min_part: int,
                min_hole: int) -> DataFrame:
    """Small parts removed, then small enclosed holes filled."""
    return fill_holes(cut_lineage(drop_small(mask, width, min_part)), frame, box, width, min_hole)


def main_region(mask: DataFrame, frame: DataFrame, box: tuple[int, int, int, int], width: int, min_part: int,
                grow: int = 1) -> DataFrame:
    """Largest part and every part above a size, holes filled, dilated."""
    lab = cut_lineage(label_cells(mask, width, 8))
    size = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = size.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    keep = size.where(F.col("n") >= min_part).select("label").union(best).distinct()
    part = cut_lineage(lab.join(keep, "label", "left_semi").select("row", "col"))
    return C.dilate(cut_lineage(fill_holes(part, frame, box, width)), box, grow)
