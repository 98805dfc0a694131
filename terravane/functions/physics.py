"""Column expressions of soil, erosion, slope stability and flow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions.numbers import clip

# ---- fixed values: landcover lookups ---------------------------------------
C_FACTOR = {10: 0.01, 20: 0.05, 30: 0.10, 40: 0.30, 50: 0.05, 60: 1.00, 80: 0.00, 90: 0.00, 95: 0.01}
C_FACTOR_DEFAULT = 0.10
MANNING = {10: 0.10, 20: 0.07, 30: 0.035, 40: 0.04, 50: 0.015, 60: 0.02, 80: 0.03, 90: 0.05, 95: 0.10}
MANNING_DEFAULT = 0.035
# Second lookup, class -> (C, n); other classes get 0.
RECLASS = {
    10: (0.001, 0.100),
    20: (0.01, 0.040),
    30: (0.01, 0.040),
    40: (0.2, 0.035),
    50: (0.9, 0.015),
    60: (1.0, 0.025),
    70: (0.0, 0.010),
    80: (0.0, 0.015),
    90: (0.05, 0.050),
    95: (0.001, 0.080),
    100: (0.0, 0.050),
}
# Soil depth in metres; tree cover depends on the slope.
SOIL_DEPTH = {20: 0.8, 30: 0.7, 40: 1.4, 50: 0.3, 60: 0.2, 80: 0.0, 90: 0.1, 95: 0.3}
SOIL_DEPTH_TREES = {"steep": 1.1, "gentle": 1.7}
SOIL_DEPTH_DEFAULT = 1.0
STEEP_DEG = 15.0
# Regional soil averages, percent.
SOIL_AVERAGES = {"sand": 40.0, "silt": 30.0, "clay": 30.0, "soc": 2.0}
R_FACTOR = 3000.0
BASE_RAIN_MM_H = 100.0
SOIL_UNIT_WEIGHT = 18.0
WATER_UNIT_WEIGHT = 9.81
STABLE_FS = 999.0


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a small fixed table as a chain of comparisons (no join)."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


# ---- soil -------------------------------------------------------------------
def k_factor(sand: Column, silt: Column, clay: Column, soc: Column, structure: int = 1, permeability: int = 3) -> Column:
    """Soil erodibility 0..1 from percentages and the classes of structure (1 to 4) and permeability (1 to 6)."""
    particles = F.pow((silt + sand) * (F.lit(100.0) - clay), F.lit(1.14))
    classes = 3.25 * (structure - 2) + 2.5 * (permeability - 3)
    nomograph = particles * (F.lit(12.0) - F.lit(1.72) * soc) * F.lit(2.1e-4) + F.lit(classes)
    # US units to SI, and the nomograph counts in percent.
    return clip(nomograph * F.lit(0.1317 / 100.0), 0, 1)


def cohesion(silt: Column, clay: Column) -> Column:
    return F.when(clay > 35, F.lit(5.0)).when(silt > 50, F.lit(3.0)).otherwise(F.lit(0.0))


def friction_angle(silt: Column, clay: Column) -> Column:
    return F.when(clay > 35, F.lit(25.0)).when(silt > 50, F.lit(30.0)).otherwise(F.lit(35.0))


def soil_depth(landcover: Column, slope_deg: Column) -> Column:
    trees = F.when(slope_deg >= STEEP_DEG, F.lit(SOIL_DEPTH_TREES["steep"])).otherwise(
        F.lit(SOIL_DEPTH_TREES["gentle"])
    )
    return F.when(landcover == 10, trees).otherwise(lookup(landcover, SOIL_DEPTH, SOIL_DEPTH_DEFAULT))


def c_factor(landcover: Column) -> Column:
    return lookup(landcover, C_FACTOR, C_FACTOR_DEFAULT)


def manning_n(landcover: Column) -> Column:
    return lookup(landcover, MANNING, MANNING_DEFAULT)


def reclass_c(landcover: Column) -> Column:
    return lookup(landcover, {k: v[0] for k, v in RECLASS.items()}, 0.0)


def reclass_n(landcover: Column) -> Column:
    return lookup(landcover, {k: v[1] for k, v in RECLASS.items()}, 0.0)


# ---- erosion ----------------------------------------------------------------
def r_factor_const() -> Column:
    return F.lit(R_FACTOR)


def scale_by_rain(r: Column, rain_mm_h) -> Column:
    rain = rain_mm_h if isinstance(rain_mm_h, Column) else F.lit(float(rain_mm_h))
    return r * (rain / F.lit(BASE_RAIN_MM_H))


def ls_factor(slope_deg: Column) -> Column:
    ls = F.pow(slope_deg / F.lit(10.0), F.lit(1.3))
    return clip(ls, 0, 100)


def soil_loss(r: Column, k: Column, ls: Column, c: Column, p: float = 1.0) -> Column:
    return r * k * ls * c * F.lit(p)


# ---- slope stability ----------------------------------------------------------
def factor_of_safety(slope_deg: Column, depth: Column, coh: Column, phi: Column, saturated: bool = True) -> Column:
    """Infinite-slope factor of safety: a cohesion term plus a friction term; 999 where nothing drives (or is unknown)."""
    weight = SOIL_UNIT_WEIGHT / 2.0
    driving = depth * F.sin(F.radians(slope_deg) * 2.0) * F.lit(weight)
    buoyancy = 1.0 - WATER_UNIT_WEIGHT / SOIL_UNIT_WEIGHT if saturated else 1.0
    friction = F.tan(F.radians(phi)) / F.tan(F.radians(slope_deg)) * F.lit(buoyancy)
    return F.when(driving > 1e-6, coh / driving + friction).otherwise(F.lit(STABLE_FS))


def release_by_fs(fs: Column, depth: Column) -> Column:
    return F.when(fs < 1.0, depth).otherwise(F.lit(0.0))


def release_by_threshold(slope_deg: Column, depth: Column, min_slope: float = 30.0, min_depth: float = 0.5) -> Column:
    return F.when((slope_deg > min_slope) & (depth > min_depth), depth).otherwise(F.lit(0.0))


# ---- flow ---------------------------------------------------------------------
WET_DEPTH = 0.001


def water_depth(stage: Column, bed: Column) -> Column:
    return clip(stage - bed, 0)


def speed(depth: Column, xmom: Column, ymom: Column) -> Column:
    safe = F.greatest(depth, F.lit(1e-6))
    return F.when(depth > WET_DEPTH, F.hypot(xmom / safe, ymom / safe)).otherwise(F.lit(0.0))


def flow_surface(elev: Column, base_change: Column, *heights: Column) -> Column:
    """Bed after base change, cut to hundredths, plus the heights of the phases."""
    bed = ((elev + F.coalesce(base_change, F.lit(0.0))) * 100).cast("long") / F.lit(100.0)
    for h in heights:
        bed = bed + F.coalesce(h, F.lit(0.0))
    return bed


def flow_alpha(h: Column, minimum: float, reference: float, gamma: float) -> Column:
    return F.when(h >= minimum, F.pow(F.least(F.lit(1.0), h / F.lit(reference)), F.lit(gamma))).otherwise(F.lit(0.0))


def flow_alpha_max(h_max: Column, minimum: float, reference: float, gamma: float) -> Column:
    return clip(flow_alpha(h_max, minimum, reference, gamma), high=0.35)


def blend(colour, alpha: Column, grey: Column, grey_scale: float = 254.9) -> Column:
    """Colour share over the grey background (0..255)."""
    colour = colour if isinstance(colour, Column) else F.lit(float(colour))
    return colour * alpha + grey / F.lit(grey_scale) * (F.lit(1.0) - alpha)


def phase_share(h_phase: Column, h: Column, offset: Column | None = None, shift: float = 0.0) -> Column:
    """Share of one phase of the flow height, 0..1; a wave-height ``offset``
    and its base ``shift`` (0.5) apply in impulse-wave display."""
    share = F.lit(float(shift)) + h_phase / h
    if offset is not None:
        share = share + offset
    return clip(share, 0, 1)


def wave_offset(h: Column, bed: Column, h0: Column, bed0: Column, reference: float) -> Column:
    return F.lit(0.5) * (h + bed - h0 - bed0) / F.lit(reference)


def binary_reclass(value: Column, threshold: float) -> Column:
    return F.when(value > threshold, F.lit(1)).otherwise(F.lit(0))
