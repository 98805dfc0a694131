"""Column expressions on grid coordinates and cell values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per degree, region of interest (degrees), half width of
# the box drawn around a place.
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE_LAT = 110540.0
REGION = {"south": 8.0, "north": 13.0, "west": 74.5, "east": 78.0}
HALF_BOX = 0.05

# WGS84 ellipsoid and the transverse Mercator constants of a UTM zone.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0


def cell_x(x0: Column, dx: Column, col: Column) -> Column:
    """World x of a cell centre."""
    return x0 + (col + F.lit(0.5)) * dx


def cell_y(y0: Column, dy: Column, row: Column) -> Column:
    """World y of a cell centre; rows count from the north."""
    return y0 - (row + F.lit(0.5)) * dy


def col_of(x: Column, x0: Column, dx: Column) -> Column:
    return F.floor((x - x0) / dx).cast("int")


def row_of(y: Column, y0: Column, dy: Column) -> Column:
    return F.floor((y0 - y) / dy).cast("int")


def cell_width_m(dx_deg: Column, lat_centre: Column) -> Column:
    return dx_deg * F.lit(METRES_PER_DEGREE_LON) * F.cos(F.radians(lat_centre))


def cell_height_m(dy_deg: Column) -> Column:
    return dy_deg * F.lit(METRES_PER_DEGREE_LAT)


def in_box(x: Column, y: Column, west, south, east, north) -> Column:
    return x.between(west, east) & y.between(south, north)


def in_region(lon: Column, lat: Column) -> Column:
    return in_box(lon, lat, REGION["west"], REGION["south"], REGION["east"], REGION["north"])


def box_around(lon: Column, lat: Column, half: float = HALF_BOX) -> dict[str, Column]:
    h = F.lit(half)
    return {"west": lon - h, "south": lat - h, "east": lon + h, "north": lat + h}


def custom_site_name(lat: Column, lon: Column) -> Column:
    """Name of an unnamed box: hundredths of its centre, cut towards zero."""
    whole = lambda x: (x * 100).cast("int").cast("string")
    return F.concat(F.lit("custom_"), whole(lat), F.lit("_"), whole(lon))


def nodata_to_null(value: Column, sentinels=(), floor: float | None = None) -> Column:
    """NULL for sentinels, NaN, infinities and values below ``floor``."""
    v = value.cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    for s in sentinels:
        bad = bad | (v == F.lit(float(s)))
    if floor is not None:
        bad = bad | (v < F.lit(floor))
    return F.when(~bad, v)


def truncate_hundredths(value: Column) -> Column:
    return (value * 100).cast("long") / F.lit(100.0)


def utm(lon: Column, lat: Column, zone: int = 43) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) by the Krueger series to the
    fourth order of the third flattening."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    ecc = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(lat)
    lam = F.radians(lon - F.lit(float(zone * 6 - 183)))
    conformal = F.sinh(F.atanh(F.sin(phi)) - F.lit(ecc) * F.atanh(F.lit(ecc) * F.sin(phi)))
    xi = F.atan2(conformal, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(conformal * conformal + F.cos(lam) * F.cos(lam)))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    k = F.lit(UTM_SCALE * radius)
    return F.lit(UTM_FALSE_EASTING) + k * east, k * north
