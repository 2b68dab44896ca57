"""Affine maps as structs (m11, m12, m21, m22, tx, ty): x' = m11 x + m12 y + tx, y' = m21 x + m22 y + ty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("m11", "m12", "m21", "m22", "tx", "ty")


def affine(*values: Column | float) -> Column:
    cells = [v if isinstance(v, Column) else F.lit(float(v)) for v in values]
    return F.struct(*(c.cast("double").alias(n) for c, n in zip(cells, FIELDS, strict=True)))


def identity() -> Column:
    return affine(1, 0, 0, 1, 0, 0)


def cells(a: Column) -> list[Column]:
    return [a[n] for n in FIELDS]


def determinant(a: Column) -> Column:
    return a["m11"] * a["m22"] - a["m12"] * a["m21"]


def invert(a: Column) -> Column:
    """The inverse; null for a singular map."""
    m11, m12, m21, m22, tx, ty = cells(a)
    d = determinant(a)
    s = F.when(d != 0, d)
    out = affine(m22 / s, -m12 / s, -m21 / s, m11 / s, (m12 * ty - m22 * tx) / s, (m21 * tx - m11 * ty) / s)
    return F.when(d != 0, out)


def compose(a: Column, b: Column) -> Column:
    """First b, then a."""
    a11, a12, a21, a22, ax, ay = cells(a)
    b11, b12, b21, b22, bx, by = cells(b)
    return affine(a11 * b11 + a12 * b21, a11 * b12 + a12 * b22, a21 * b11 + a22 * b21, a21 * b12 + a22 * b22, a11 * bx + a12 * by + ax, a21 * bx + a22 * by + ay)


def apply(a: Column, x: Column, y: Column) -> Column:
    m11, m12, m21, m22, tx, ty = cells(a)
    return F.struct((m11 * x + m12 * y + tx).alias("x"), (m21 * x + m22 * y + ty).alias("y"))


def scaling(sx: Column | float, sy: Column | float) -> Column:
    return affine(sx, 0, 0, sy, 0, 0)


def translation(tx: Column | float, ty: Column | float) -> Column:
    return affine(1, 0, 0, 1, tx, ty)


def rotation(degrees: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return affine(c, -s, s, c, 0, 0)


def matrix_2x3(a: Column) -> Column:
    m11, m12, m21, m22, tx, ty = cells(a)
    return F.array(F.array(m11, m12, tx), F.array(m21, m22, ty))


def matrix_3x3(a: Column) -> Column:
    m11, m12, m21, m22, tx, ty = cells(a)
    return F.array(F.array(m11, m12, tx), F.array(m21, m22, ty), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def north_up(a: Column) -> Column:
    """The map with its vertical pixel size made negative."""
    m11, m12, m21, m22, tx, ty = cells(a)
    return affine(m11, m12, m21, -F.abs(m22), tx, ty)


def fit(x: str, y: str, u: str, v: str) -> tuple[list[Column], Column]:
    """Least-squares map (x, y) -> (u, v): aggregates to compute per group, and the map over their aliases.

    Sums are taken about the means, which regr_ and covar_ aggregates do, so that large coordinates lose no digits.
    Null with fewer than 3 points or with points on one line.
    """
    pairs = {"xx": (x, x), "yy": (y, y), "xy": (x, y), "xu": (x, u), "yu": (y, u), "xv": (x, v), "yv": (y, v)}
    used = [F.covar_pop(a, b).alias(f"_c{n}") for n, (a, b) in pairs.items()]
    used += [F.avg(c).alias(f"_m{n}") for n, c in zip("xyuv", (x, y, u, v), strict=True)]
    used.append(F.count(x).alias("_n"))
    c = {n: F.col(f"_c{n}") for n in pairs}
    m = {n: F.col(f"_m{n}") for n in "xyuv"}
    d = c["xx"] * c["yy"] - c["xy"] * c["xy"]
    ok = (F.col("_n") >= 3) & (d > 1e-9 * F.greatest(c["xx"] * c["yy"], F.lit(1e-300)))
    s = F.when(ok, d)
    m11, m12 = (c["xu"] * c["yy"] - c["yu"] * c["xy"]) / s, (c["yu"] * c["xx"] - c["xu"] * c["xy"]) / s
    m21, m22 = (c["xv"] * c["yy"] - c["yv"] * c["xy"]) / s, (c["yv"] * c["xx"] - c["xv"] * c["xy"]) / s
    out = affine(m11, m12, m21, m22, m["u"] - m11 * m["x"] - m12 * m["y"], m["v"] - m21 * m["x"] - m22 * m["y"])
    return used, F.when(ok, out)


def clamp_to_pixel(a: Column, lon: Column, lat: Column, width: Column, height: Column) -> Column:
    """Pixel of a coordinate by the inverse of the map pixel -> (lon, lat), clamped to the image."""
    at = apply(invert(a), lon, lat)
    return F.struct(F.greatest(F.lit(0.0), F.least(at["x"], width)).alias("x"), F.greatest(F.lit(0.0), F.least(at["y"], height)).alias("y"))
