"""Plane and spherical geometry."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import int_mod

#: Earth's radius in nautical miles and half the width of the Web Mercator plane in metres (fixed values).
EARTH_NM = 3443.89849
MERCATOR = 20037508.34


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def same_sign(a: Column, b: Column) -> Column:
    return a * b > 0


def between(a: Column, b: Column, x: Column) -> Column:
    """x lies between a and b, in either order, inclusive."""
    return x.between(F.least(a, b), F.greatest(a, b))


def radius_lat(nm: float) -> float:
    return nm / 60.0


def radius_lon(nm: float, lat: Column) -> Column:
    return F.lit(nm / 60.0) / F.cos(F.radians(lat))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in nautical miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_NM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.degrees(F.atan2(y, x))


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(MERCATOR / 180)


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan((lat + 90) * F.lit(pi / 360))) / F.lit(pi / 180) * F.lit(MERCATOR / 180)


def mercator_lon(x: Column) -> Column:
    return x / F.lit(MERCATOR) * 180


def mercator_lat(y: Column) -> Column:
    return F.lit(180 / pi) * (2 * F.atan(F.exp(y / F.lit(MERCATOR) * F.lit(pi))) - F.lit(pi / 2))


def true_heading(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.degrees(F.lit(pi / 2) - F.atan2(y2 - y1, x2 - x1))


def slope_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle in whole degrees, modulo 180."""
    return int_mod(F.degrees(F.atan2(y2 - y1, x2 - x1)), 180)


def intersection(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column, x4: Column, y4: Column) -> Column:
    """(x, y) at which the lines through points 1, 2 and 3, 4 cross; null if they are parallel."""
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    safe = F.when(d != 0, d)
    return F.struct(((a * (x3 - x4) - (x1 - x2) * b) / safe).alias("x"), ((a * (y3 - y4) - (y1 - y2) * b) / safe).alias("y"))


def in_page(x: Column, y: Column, width: Column, height: Column) -> Column:
    return x.between(F.lit(0.0), width) & y.between(F.lit(0.0), height)


def to_pixel(value: Column, upper_left: Column, scale: Column) -> Column:
    """Pixel of a coordinate on an axis-aligned chart; 0 without a scale."""
    return F.when(scale.isNull() | (scale == 0), F.lit(0.0)).otherwise(F.abs((upper_left - value) / F.when(scale != 0, scale)))


def _signed(value: Column, hemisphere: Column, most: Column) -> Column:
    return F.when((value <= most) & hemisphere.isin("N", "S", "E", "W"), F.when(hemisphere.isin("S", "W"), -value).otherwise(value))


def dms_parts(deg: Column, minutes: Column, seconds: Column, hemisphere: Column, any_case: bool = False) -> Column:
    """Decimal degrees; null without a known hemisphere or beyond 90 (N, S) or 180 (E, W).

    any_case also takes lower-case hemispheres; for these no range is checked.
    """
    value = deg + minutes / 60 + seconds / 3600
    upper = _signed(value, hemisphere, F.when(hemisphere.isin("N", "S"), 90.0).otherwise(180.0))
    if not any_case:
        return upper
    return F.coalesce(upper, F.when(hemisphere.isin("n", "e"), value), F.when(hemisphere.isin("s", "w"), -value))


def dms(c: Column) -> Column:
    """Decimal degrees of 'ddd-mm-ss.sN'; null if it doesn't parse or is out of range."""
    pattern = r"^(\d{1,3})-(\d{1,2})-(\d{1,2}(?:\.\d+)?)([NSEW])$"
    d, m, s = (F.regexp_extract(c, pattern, k).try_cast("double") for k in (1, 2, 3))
    return dms_parts(d, m, s, F.regexp_extract(c, pattern, 4))


def fixed_width(c: Column, unknown: float = -1.0) -> Column:
    """Decimal degrees of 'N42214300' (1+2+2+2+2) or 'W071002300' (1+3+2+2+2); another hemisphere gives `unknown`."""
    side = F.substring(c, 1, 1)

    def read(width: int) -> Column:
        at = 2
        parts = []
        for n in (width, 2, 2, 2):
            parts.append(F.substring(c, at, n).try_cast("double"))
            at += n
        return parts[0] + parts[1] / 60 + (parts[2] + parts[3] / 100) / 3600

    value = F.when(side.isin("N", "S"), read(2)).when(side.isin("E", "W"), read(3))
    return F.when(side.isin("S", "W"), -value).when(side.isin("N", "E"), value).when(c.isNotNull(), F.lit(unknown))


def fit_scale(width: Column, height: Column, most_width: Column, most_height: Column) -> Column:
    """The smaller of the two scales, so that a picture of this size fits into that one."""
    return F.least(most_width / F.when(width != 0, width), most_height / F.when(height != 0, height))
