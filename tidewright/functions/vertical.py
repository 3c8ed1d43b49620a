"""Vertical chains: every height reaches one frame through these column builders."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import clean

# Permanent-tide term, metres.
TIDE_CONST = 0.06029
TIDE_SIN2 = 0.180873


def _zero(c: Column) -> Column:
    return F.coalesce(clean(c), F.lit(0.0))


def pixel_ellipsoidal(height: Column, solid: Column, load: Column, pole: Column) -> Column:
    """Pixel height without its three tides; a missing tide counts as zero."""
    return height - (_zero(solid) + _zero(load) + _zero(pole))


def free_to_mean(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(TIDE_CONST) - F.lit(TIDE_SIN2) * s * s


def tide_free_to_mean(height: Column, lat: Column) -> Column:
    return height + free_to_mean(lat)


def normal_height(ellipsoidal: Column, zeta: Column) -> Column:
    return ellipsoidal - zeta


def node_height(wse: Column, geoid: Column, zeta: Column) -> Column:
    return wse + geoid - zeta


def gauge_height(stage_m: Column, zero_m: Column, grid_offset_m: Column) -> Column:
    return stage_m + zero_m + grid_offset_m


def reframe(height: Column, geoid_from: Column, zeta_to: Column, shift: Column) -> Column:
    """Height above another geoid moved to the common frame."""
    return height + geoid_from - zeta_to + shift


def quadrature(*terms: Column) -> Column:
    """Root of the sum of squares; a missing term adds nothing."""
    total = F.lit(0.0)
    for t in terms:
        total = total + F.pow(_zero(t), F.lit(2.0))
    return F.sqrt(total)
