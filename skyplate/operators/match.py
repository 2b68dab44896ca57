"""Spatial matching. Ranges become equi-joins on grid cells: the one side keeps its own cell, the other is copied to the
cells its range covers, and the exact predicate follows. No nested-loop join and no broadcast is needed at any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyplate.functions import geo
from skyplate.session import tasks

from .nearest import nearest_within

#: Parts that the lines of a chart are dealt into.
SHARES = 16


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))


def _span(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(low, size), _cell(high, size)))


def within(left: DataFrame, right: DataFrame, by: list[str], radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """Pairs of the same `by` at most `radius` apart, with their distance `dist`. Other column names must differ between the sides."""
    lx, ly = map(F.col, left_xy)
    rx, ry = map(F.col, right_xy)
    a = left.withColumns({"_cx": _cell(lx, radius), "_cy": _cell(ly, radius)})
    b = right.withColumn("_cx", _span(rx - radius, rx + radius, radius)).withColumn("_cy", _span(ry - radius, ry + radius, radius))
    pairs = a.join(b, [*by, "_cx", "_cy"]).drop("_cx", "_cy")
    return pairs.withColumn("dist", geo.distance(lx, ly, rx, ry)).where(F.col("dist") <= radius)


def nearest(pairs: DataFrame, by: list[str], key: str, other: str) -> DataFrame:
    """For each key the pair with the smallest dist; of equal ones the last `other` in string order."""
    w = Window.partitionBy(*by, key).orderBy(F.col("dist"), F.col(other).cast("string").desc())
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mutual_nearest(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Pairs in which each is the other's nearest."""
    a = nearest(pairs, by, left, right)
    b = nearest(pairs, by, right, left).select(*by, left, right)
    return a.join(b, [*by, left, right], "left_semi")


def same_type_if(icon_type: Column, db_type: Column, pattern: str = "VOR") -> Column:
    """Icons of a type that holds the pattern match only features of exactly that type."""
    return ~icon_type.contains(pattern) | (icon_type == db_type)


def away_from(left: DataFrame, right: DataFrame, by: list[str], key: str, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """Rows of left with no row of right within the radius."""
    near = within(left.select(*by, key, *left_xy), right.select(*by, *right_xy), by, radius, left_xy, right_xy).select(*by, key).distinct()
    return left.join(near, [*by, key], "left_anti")


def _box_cells(airports: DataFrame, features: DataFrame, nm: float, lat: str, lon: str, f_lat: str, f_lon: str) -> tuple[DataFrame, DataFrame]:
    """Airports with their own cell (_cy, _cx), so that all pairs of one are found in one place, and features copied to the cells from which a box can reach them.

    A cell is half a box high, and as wide as half a box is at its edge nearest a pole; near the poles a band is one cell.
    """
    size = geo.radius_lat(nm)
    high, more = size / 2, 1 + 1e-9  # more: for rounding at a cell's edge
    band = F.col("_cy")
    far = F.greatest(F.abs(band), F.abs(band + 1)) * F.lit(high)
    wide = F.when(far < 89, F.lit(size) / F.cos(F.radians(far)))

    def at(x: Column) -> Column:
        return F.when(x.isNotNull(), F.coalesce(F.floor(x / F.col("_w")), F.lit(0)))

    a = airports.withColumn("_cy", _cell(F.col(lat), high)).withColumn("_w", wide).withColumn("_cx", at(F.col(lon))).drop("_w")
    b = features.withColumn("_cy", _span(F.col(f_lat) - size * more, F.col(f_lat) + size * more, high)).withColumn("_w", wide)
    reach = F.coalesce(F.col("_w") * more, F.lit(0.0))
    b = b.withColumn("_cx", F.explode(F.sequence(at(F.col(f_lon) - reach), at(F.col(f_lon) + reach)))).drop("_w")
    return a, b


def in_box(airports: DataFrame, features: DataFrame, nm: float, lat: str = "lat", lon: str = "lon", f_lat: str = "f_lat", f_lon: str = "f_lon", by: tuple[str, ...] = ()) -> DataFrame:
    """Airports with the features, of the same `by`, in the box of ± nm nautical miles in latitude and the same width in longitude."""
    size, r_lon, n = geo.radius_lat(nm), geo.radius_lon(nm, F.col(lat)), tasks(airports)
    keys = [*by, "_cy", "_cx"]
    a, b = (side.repartition(n, *keys) for side in _box_cells(airports, features, nm, lat, lon, f_lat, f_lon))
    inside = F.col(f_lat).between(F.col(lat) - size, F.col(lat) + size) & F.col(f_lon).between(F.col(lon) - r_lon, F.col(lon) + r_lon)
    return a.join(b, keys).where(inside).drop("_cy", "_cx")


def nearest_in_box(airports: DataFrame, features: DataFrame, nm: float, key: str, other: str, group: str) -> DataFrame:
    """For each airport and group of features in its box (key, group) the nearest one's `other`; of equally near ones the westernmost, at the same place the largest. lat, lon, f_lat, f_lon as in in_box.

    The pairs of a cell are measured by numpy, an airport at a time, without rows: an aggregate by distance and `other` would have to sort them.
    """
    size, n = geo.radius_lat(nm), tasks(airports)
    a, b = _box_cells(airports.select(key, "lat", "lon", geo.radius_lon(nm, F.col("lat")).alias("r")), features.select(other, group, "f_lat", "f_lon"), nm, "lat", "lon", "f_lat", "f_lon")
    a, b = (side.where(F.col(column).isNotNull()).repartition(n, "_cy", "_cx").groupBy("_cy", "_cx") for side, column in ((a, key), (b, other)))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((airports, key), (features, group), (features, other))]

    def of_cell(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        names = [key, group, other, "_dist", "_lon"]
        two = two.sort_values([group, "f_lon", other], ascending=[True, True, False])
        if one.empty or two.empty:
            return pd.DataFrame({c: [] for c in names})
        los, las, who, groups = (two[c].to_numpy() for c in ("f_lon", "f_lat", other, group))
        found = []
        for k, y, x, r in zip(one[key], one["lat"], one["lon"], one["r"], strict=True):
            hit = np.flatnonzero((las >= y - size) & (las <= y + size) & (los >= x - r) & (los <= x + r))
            if not len(hit):
                continue
            g, dy, dx = groups[hit], y - las[hit], x - los[hit]
            dist = np.sqrt(dy * dy + dx * dx)
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            least = np.minimum.reduceat(dist, starts)
            at = np.flatnonzero(dist == np.repeat(least, np.diff(np.append(starts, len(g)))))
            first = at[np.searchsorted(at, starts)]
            found.append((np.full(len(first), k), g[first], who[hit][first], least, los[hit][first]))
        if not found:
            return pd.DataFrame({c: [] for c in names})
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*found, strict=True), strict=True)})

    best = a.cogroup(b).applyInPandas(of_cell, ", ".join(kinds) + ", _dist double, _lon double")
    return best.groupBy(key, group).agg(F.max(F.struct((-F.col("_dist")).alias("d"), (-F.col("_lon")).alias("l"), other)).alias("_m")).select(key, group, F.col(f"_m.{other}").alias(other))


def nearest_line(boxes: DataFrame, lines: DataFrame, by: list[str], box: str, line: str, vertical: bool, radius: float = 70.0) -> DataFrame:
    """For each box (bx, by_) the line of the wanted orientation whose nearer endpoint is closest, within the radius.

    lines: x1, y1, x2, y2, slope (0 to 179). Both endpoints enter, so that each pair is found by the nearer one.
    """
    wanted = F.col("slope").between(88, 92) if vertical else (F.col("slope") <= 2) | (F.col("slope") >= 178)
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    ends = lines.where(wanted).select(*by, line, ends.alias("_e")).select(*by, line, F.col("_e.x").alias("ex"), F.col("_e.y").alias("ey"))
    return nearest_within(boxes, ends, by, box, line, radius, ("bx", "by_"), ("ex", "ey")).drop("ex", "ey")


def in_band(left: DataFrame, right: DataFrame, by: list[str], a: str, b: str, width: float) -> DataFrame:
    """Pairs of the same `by` whose values a and b differ by at most width."""
    left = left.withColumn("_c", _cell(F.col(a), width))
    right = right.withColumn("_c", _span(F.col(b) - width, F.col(b) + width, width))
    return left.join(right, [*by, "_c"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_c")


def without_conflicts(df: DataFrame, by: list[str], slope: str, lat: str, width: float = 5.0) -> DataFrame:
    """Rows of which no other row of the group, at another latitude, has a slope less than width away. Both of a pair go."""
    other = df.select(*by, F.col(slope).alias("_s"), F.col(lat).alias("_l"), _span(F.col(slope) - width, F.col(slope) + width, width).alias("_c"))
    own = df.withColumn("_c", _cell(F.col(slope), width))
    conflict = (F.abs(own[slope] - other["_s"]) < width) & (own[lat] != other["_l"])
    keys = [own[k] == other[k] for k in [*by, "_c"]]
    condition = conflict
    for k in keys:
        condition = condition & k
    return own.join(other, condition, "left_anti").drop("_c")


def same_heading(icons: DataFrame, runways: DataFrame, by: list[str], heading: str = "heading", slope: str = "slope") -> DataFrame:
    """Runway lines on a chart with the runway records within 2 degrees of slope; end is LE where the heading is within 1 degree of le_heading, else HE."""
    pairs = in_band(icons, runways, by, slope, "r_slope", 2.0)
    return pairs.withColumn("end", F.when(F.abs(F.col(heading) - F.col("le_heading")) <= 1, "LE").otherwise("HE"))


def cross_lines(lat_lines: DataFrame, lon_lines: DataFrame, by: list[str]) -> DataFrame:
    """Intersections of each latitude line (a*) with each longitude line (b*) of the same chart, within the page (width, height).

    A chart's latitude lines are dealt into SHARES, each with a copy of its longitude lines, so that no task holds all pairs of a chart.
    """
    n, keys = tasks(lat_lines), [*by, "_s"]
    a = lat_lines.withColumn("_s", F.pmod(F.xxhash64(*lat_lines.columns), F.lit(SHARES)).cast("int")).repartition(n, *keys)
    b = lon_lines.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(n, *keys)
    pairs = a.join(b, keys).drop("_s")
    at = geo.intersection(*(F.col(c) for c in ("ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2")))
    pairs = pairs.withColumn("_p", at).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")
    return pairs.where(geo.in_page(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
