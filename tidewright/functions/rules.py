"""Scalar rules: spectral indices, masks, classes, grades, flags and reasons."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene-classification codes that veto a pixel, and class thresholds.
SCENE_REJECT = (0, 1, 3, 8, 9, 10, 11)
SCENE_WATER = 6
SCENE_BARE = 5
RELAXED_MARGIN = 0.15
UNDEFINED_INDEX = -9.0
NDVI_VEG = 0.30
NDVI_SPARSE = 0.15
NDMI_WET = 0.10
BSI_BARE = 0.10

# Surface class codes and names.
SURFACE = {
    0: "INVALID", 1: "OPEN_WATER", 2: "SHALLOW_OR_MIXED_WATER", 3: "WET_SEDIMENT", 4: "DRY_BARE_SEDIMENT",
    5: "SPARSE_HERBACEOUS", 6: "DENSE_HERBACEOUS", 7: "REED_OR_FLOODED_VEGETATION", 8: "BUILT_HARD_SURFACE",
    9: "AMBIGUOUS",
}
UNKNOWN_SURFACE = "UNATTRIBUTED"

# Roughness codes, names and Manning n (low, base, high).
ROUGHNESS = {
    "open_water": (1, 0.025, 0.030, 0.035), "intermittent_water": (2, 0.030, 0.040, 0.060),
    "wet_sediment": (3, 0.020, 0.025, 0.032), "bare_sand_silt": (4, 0.022, 0.028, 0.035),
    "sparse_herbaceous": (5, 0.025, 0.032, 0.045), "dense_herbaceous": (6, 0.030, 0.040, 0.060),
    "reed_tall_herb": (7, 0.045, 0.065, 0.090), "young_woody_sparse": (8, 0.040, 0.060, 0.090),
    "young_woody_dense": (9, 0.070, 0.100, 0.160), "mature_woody_legacy": (10, 0.100, 0.150, 0.200),
    "built": (11, 0.030, 0.080, 0.150), "cropland": (12, 0.020, 0.035, 0.050),
    "channel_sand": (13, 0.025, 0.030, 0.040), "wet_silt_depression": (14, 0.020, 0.028, 0.045),
    "sand_silt_flat": (15, 0.022, 0.030, 0.040),
}
WOODY_CODES = (8, 9, 10, 7)
LEAF_OFF_FACTOR = 0.7


def normalised(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); undefined stays missing."""
    return F.try_divide(a - b, a + b)


def indices(b02: Column, b03: Column, b04: Column, b08: Column, b11: Column, b12: Column) -> dict[str, Column]:
    return {
        "ndvi": normalised(b08, b04),
        "ndwi": normalised(b03, b08),
        "mndwi": normalised(b03, b11),
        "ndmi": normalised(b08, b11),
        "bsi": normalised(b11 + b04, b08 + b02),
        "aweish": b02 + 2.5 * b03 - 1.5 * (b08 + b11) - 0.25 * b12,
        "ndti": normalised(b04, b03),
    }


def reflectance(dn: Column, offset: Column, quantification: Column) -> Column:
    return (dn + F.coalesce(offset, F.lit(0.0))) / quantification


def observed(scl: Column, green: Column) -> Column:
    return ~scl.isin(*SCENE_REJECT) & F.coalesce(green > 0, F.lit(False))


def water(ndwi: Column, mndwi: Column, scl: Column, valid: Column, ndwi_cut: float = 0.0,
          mndwi_cut: float = 0.0) -> Column:
    """Both indices above their cut, or scene class water with a relaxed first index; only where observed."""
    first = F.coalesce(ndwi, F.lit(UNDEFINED_INDEX))
    second = F.coalesce(mndwi, F.lit(UNDEFINED_INDEX))
    strict = (first > ndwi_cut) & (second > mndwi_cut)
    relaxed = (scl == SCENE_WATER) & (first > ndwi_cut - RELAXED_MARGIN)
    return valid & ~scl.isin(*SCENE_REJECT) & (strict | relaxed)


def three_valued(is_water: Column, valid: Column) -> Column:
    """1 water, 0 land, NULL where nothing was seen."""
    return F.when(valid, is_water.cast("int"))


def surface_class(ndvi: Column, ndmi: Column, bsi: Column, scl: Column, is_water: Column, valid: Column,
                  edge: Column) -> Column:
    """Surface code.  Strongest evidence is tested first, which gives the same answer as letting weaker
    assignments be overwritten."""
    v, m, b = (F.coalesce(c, F.lit(UNDEFINED_INDEX)) for c in (ndvi, ndmi, bsi))
    dry = ~is_water
    return (
        F.when(~valid, 0)
        .when(dry & (v >= NDVI_VEG) & (m >= NDMI_WET), 7)
        .when(dry & (v >= NDVI_VEG), 6)
        .when(dry & (v >= NDVI_SPARSE) & (m < NDMI_WET), 5)
        .when(dry & (m >= NDMI_WET) & (b < BSI_BARE), 3)
        .when(dry & (v < NDVI_SPARSE) & (m < NDMI_WET) & ((scl == SCENE_BARE) | (b >= BSI_BARE)), 4)
        .when(edge, 2)
        .when(is_water, 1)
        .otherwise(9)
    )


def roughness_code(mode: Column, water_share: Column, woody: Column, woody_label: Column, built: Column,
                   crops: Column, legacy: Column, inside_pool: Column, allow_young: bool = True) -> Column:
    """Roughness code from the class mode and its companions; the last rule that applies decides."""
    wet = mode.isin(1, 2)
    green = mode.isin(5, 6, 7)
    share = F.coalesce(water_share, F.lit(0.0))
    wood = F.coalesce(woody, F.lit(0.0))
    young = F.lit(allow_young) & green & ~legacy
    return (
        F.when(mode == 0, 0)
        .when(built & ~wet, 11)
        .when(crops & mode.isin(5, 6) & ~inside_pool, 12)
        .when(green & legacy, 10)
        .when(young & woody_label, 9)
        .when(young & (wood >= 0.30), 8)
        .when(wet & (share >= 80), 1)
        .when(wet, 2)
        .when(mode.isin(3, 4, 5, 6, 7), mode)
        .otherwise(0)
    ).cast("int")


def decode(code: Column, names: Mapping[int, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit(default))


def decibel(sigma: Column, floor: float = 1e-6) -> Column:
    return 10 * F.log10(F.greatest(sigma, F.lit(floor)))


def clip01(c: Column) -> Column:
    return F.greatest(F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def canopy_risks(ndvi: Column, ndmi: Column, sd: Column, canopy_m: Column, photon_share: Column,
                 mixed: Column) -> dict[str, Column]:
    """Clipped linear ramps between published anchor values."""
    return {
        "vegetation_risk": clip01((ndvi - 0.10) / 0.40),
        "reed_risk": clip01(F.least((ndvi - 0.15) / 0.35, ndmi / 0.30)),
        "woody_risk": clip01(0.6 * clip01(canopy_m / 3.0) + 0.4 * clip01(photon_share / 0.3)),
        "mixed_risk": clip01(F.greatest(clip01(sd / 0.20), F.when(mixed, 1.0).otherwise(0.0))),
    }


def ladder(value: Column, steps: Sequence[tuple[float, str]], default: str, missing: str | None = None,
           inclusive: bool = True) -> Column:
    """Label of the first upper limit the value does not exceed."""
    out = F.when(value.isNull(), F.lit(missing)) if missing is not None else None
    for limit, name in steps:
        test = value <= limit if inclusive else value < limit
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(default))


def period(ts: Column, cuts: Sequence[tuple[str, str]], last: str) -> Column:
    """Label of the first cut date the timestamp lies before."""
    out = None
    for cut, name in cuts:
        test = ts < F.to_timestamp(F.lit(cut))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(last))


def season(ts: Column) -> Column:
    m = F.month(ts)
    return (F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA")
            .otherwise("SON"))


def reasons(tests: Mapping[str, Column]) -> Column:
    """Names of the predicates that hold; an unknown predicate never fires."""
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))


def interval_bin(value: Column, edges: Sequence[float], labels: Sequence[str], lowest: bool = False) -> Column:
    """Intervals open on the left and closed on the right; outside all of them is NULL."""
    out = None
    for i, name in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        left = value >= lo if lowest and i == 0 else value > lo
        test = left & (value <= hi)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def bound_violation(h: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """Above an upper bound or below a lower one, and by how much; never negative."""
    over = F.coalesce(F.greatest(h - upper, F.lit(0.0)), F.lit(0.0))
    under = F.coalesce(F.greatest(lower - h, F.lit(0.0)), F.lit(0.0))
    size = F.greatest(over, under)
    return size > 0, size


def soft_pull(pred: Column, lower: Column, upper: Column, weight: float) -> Column:
    """Move a prediction part of the way to a bound it violates: the upper bound first, then the lower."""
    first = F.when(upper.isNotNull() & (pred > upper), pred + weight * (upper - pred)).otherwise(pred)
    return F.when(lower.isNotNull() & (pred < lower), first + weight * (lower - first)).otherwise(first)
