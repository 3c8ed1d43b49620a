"""Distances, the metric projection, cell indices and wind components as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEG_LON = 111.32
KM_PER_DEG_LAT = 110.57
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM36_MERIDIAN_DEG = 33.0
SETUP = {"fetch_m": 60e3, "depth_m": 5.0, "drag": 1.5e-3, "rho_air": 1.2, "rho_water": 1000.0, "g": 9.81}


def haversine_km(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    half_lat = F.sin((F.radians(lat0) - F.radians(lat)) / 2)
    half_lon = F.sin(F.radians(lon0 - lon) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def flat_xy(lon: Column, lat: Column, lat0: Column) -> tuple[Column, Column]:
    """Local flat-earth kilometres, good enough to snap a point to a river axis."""
    return lon * F.lit(KM_PER_DEG_LON) * F.cos(F.radians(lat0)), lat * F.lit(KM_PER_DEG_LAT)


# Krueger series for the transverse Mercator projection, order 4 in the third flattening (sub-millimetre in a zone).
_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_ECC = math.sqrt(WGS84_F * (2 - WGS84_F))


def _atanh(c: Column) -> Column:
    return F.log((1 + c) / (1 - c)) / 2


def to_metric(lon: Column, lat: Column, meridian: float = UTM36_MERIDIAN_DEG) -> tuple[Column, Column]:
    """WGS84 degrees to UTM metres (northern zone of the given central meridian)."""
    lam = F.radians(lon - F.lit(meridian))
    s = F.sin(F.radians(lat))
    t = F.sinh(_atanh(s) - F.lit(_ECC) * _atanh(F.lit(_ECC) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = F.lit(UTM_K0 * _RECT)
    return k * x + F.lit(UTM_FALSE_EASTING), k * y


def to_degrees(x: Column, y: Column, meridian: float = UTM36_MERIDIAN_DEG) -> tuple[Column, Column]:
    """UTM metres back to WGS84 degrees."""
    xi0 = y / F.lit(UTM_K0 * _RECT)
    eta0 = (x - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_K0 * _RECT)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - F.lit(b) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    lon = F.lit(meridian) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
    return lon, F.degrees(lat)


def cell_of(x: Column, x0: float, size: float) -> Column:
    return F.floor((x - F.lit(x0)) / F.lit(size))


def wind_vector(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    """Wind is reported as the direction it blows from."""
    th = F.radians(from_deg)
    return -speed * F.sin(th), -speed * F.cos(th)


def wind_from(u: Column, v: Column) -> Column:
    deg = F.degrees(F.atan2(-u, -v))
    return F.pmod(deg, F.lit(360.0))


def along_cross(u: Column, v: Column, axis_deg: float) -> tuple[Column, Column]:
    """Components on the axis bearing; positive along points east, positive cross points north."""
    ex, ey = math.sin(math.radians(axis_deg)), math.cos(math.radians(axis_deg))
    return u * F.lit(ex) + v * F.lit(ey), v * F.lit(ex) - u * F.lit(ey)


def setup_cm(u_along: Column) -> Column:
    p = SETUP
    scale = 100 * p["rho_air"] * p["drag"] * p["fetch_m"] / (p["rho_water"] * p["g"] * p["depth_m"])
    return F.lit(scale) * u_along * F.abs(u_along)


def inverse_barometer_cm(p_before: Column, p_after: Column) -> Column:
    return -(p_after - p_before)


def grid_cells(boxes, size: float, box_id: str):
    """Cell centres on multiples of the cell size inside each box ``(w, s, e, n)``: one row per cell."""
    span = lambda lo, hi: F.sequence(F.ceil(F.col(lo) / size), F.floor(F.col(hi) / size))
    g = boxes.select(box_id, F.explode(span("s", "n")).alias("row"), "w", "e").select(box_id, "row", F.explode(span("w", "e")).alias("col"))
    return g.select(box_id, "row", "col", (F.col("col") * size).alias("x"), (F.col("row") * size).alias("y"))


def points_along(edges, step: float, edge_id: str):
    """Points every ``step`` along each edge ``(x1, y1, x2, y2)``, its start included."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    p = edges.withColumn("len", length).where("len > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / step).cast("int"))))
    f = F.col("i") * step / F.col("len")
    return p.select(edge_id, "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * f).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * f).alias("y"))
