"""Rings as arrays of (x, y): area by edge sums and clipping to a convex domain, as folds over the arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(ring: Column) -> Column:
    """The vertex after each one, the first after the last."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring), F.lit(1))), F.slice(ring, F.lit(1), F.lit(1)))


def signed_area(ring: Column) -> Column:
    """Half the sum of edge products: positive for a ring that turns left."""
    edges = F.zip_with(ring, _next(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + e) / 2


def area(ring: Column) -> Column:
    """Area of a simple ring; 0 with fewer than three vertices."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(signed_area(ring)))


def clip(ring: Column, domain: Column) -> Column:
    """The part of a ring inside a convex ``domain`` that turns left: each domain edge in turn keeps the side it bounds.

    An empty array where nothing is left.  A ring that the domain cuts into several parts keeps them joined along the domain's edge,
    which does not change its area."""
    vertex = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def side(e: Column, p: Column) -> Column:
        return (e["q"]["x"] - e["p"]["x"]) * (p["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (p["x"] - e["p"]["x"])

    def cut(now: Column, e: Column) -> Column:
        def piece(p: Column, q: Column) -> Column:
            a, b = side(e, p), side(e, q)
            t = a / (a - b)
            crossing = vertex(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            own = F.when(a >= 0, F.array(vertex(p["x"], p["y"]))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
            return F.when((a >= 0) != (b >= 0), F.concat(own, F.array(crossing))).otherwise(own)

        return F.flatten(F.zip_with(now, _next(now), piece))

    edges = F.zip_with(domain, _next(domain), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    start = F.transform(ring, lambda p: vertex(p["x"], p["y"]))
    return F.aggregate(edges, start, lambda now, e: F.when(F.size(now) == 0, now).otherwise(cut(now, e)))
