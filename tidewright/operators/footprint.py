"""Do axis-parallel footprints meet polygons?  Corner tests both ways plus edge crossings, all as bucket joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import spatial as P


def boxes_meet(boxes: DataFrame, rings: DataFrame, box_id: str, band: float) -> DataFrame:
    """Ids of boxes ``(w, s, e, n)`` that touch any domain."""
    corners = boxes.select(box_id, F.explode(F.array(*[F.struct(F.col(x).alias("ax"), F.col(y).alias("ay")) for x in ("w", "e") for y in ("s", "n")])).alias("c"))
    corners = corners.select(box_id, "c.ax", "c.ay").withColumn("cid", F.xxhash64(box_id, "ax", "ay"))
    hit_corner = P.in_domain(corners, rings, "cid", band).select("cid").distinct().join(corners, "cid").select(box_id)
    # An edge meets the closed box when the part of it inside the box's horizontal strip reaches the box's width.
    e = rings.groupBy("domain", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    e = e.select(F.posexplode("v").alias("i", "a"), "v")
    nxt = F.element_at("v", (F.col("i") + 1) % F.size("v") + 1)
    e = e.select(F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), nxt["x"].alias("x2"), nxt["y"].alias("y2"))
    e = e.withColumn("lo", F.least("y1", "y2")).withColumn("hi", F.greatest("y1", "y2"))
    e = e.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / band), F.floor(F.col("hi") / band))))
    b = boxes.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / band), F.floor(F.col("n") / band))))
    b, e, keys = P.salted(b, e, ["b"])
    j = b.join(broadcast_if_small(e), keys).where("hi >= s and lo <= n")
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(
        F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    flat = F.col("y1") == F.col("y2")
    xa = F.when(flat, F.col("x1")).otherwise(at(F.greatest("lo", "s")))
    xb = F.when(flat, F.col("x2")).otherwise(at(F.least("hi", "n")))
    hit_edge = j.where((F.least(xa, xb) <= F.col("e")) & (F.greatest(xa, xb) >= F.col("w"))).select(box_id)
    return hit_corner.union(hit_edge).distinct()
