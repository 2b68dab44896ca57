"""Scales and extents from pairs of ground control points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.functions import geo
from skyplate.functions.ratio import PROCEDURE, polynomial

#: Latitude degrees per pixel of the chart scales in use, and the most longitude degrees per pixel (fixed values).
LAT_BANDS = ((0.00011, 0.00033), (0.00034, 0.00046), (0.00056, 0.00060))
MOST_LON = 0.0016
LEAST_PIXELS = 5.0
WEIGHTED = 0.09


def gcp_pairs(gcps: DataFrame, by: str, key: str) -> DataFrame:
    """All ordered pairs of different points of a chart (px, py, lon, lat; width, height, airport_lat of the chart), measured."""
    left = gcps.select(by, *(F.col(c).alias(f"{c}_i") for c in (key, "px", "py", "lon", "lat")), "width", "height", "airport_lat")
    right = gcps.select(by, *(F.col(c).alias(f"{c}_j") for c in (key, "px", "py", "lon", "lat")))
    p = left.join(right, by).where(F.col(f"{key}_i") != F.col(f"{key}_j"))
    p = p.withColumns({"dx": F.col("px_i") - F.col("px_j"), "dy": F.col("py_i") - F.col("py_j"), "dlon": F.col("lon_i") - F.col("lon_j"), "dlat": F.col("lat_i") - F.col("lat_j")})
    dx, dy, dlon, dlat = map(F.col, ("dx", "dy", "dlon", "dlat"))
    use_y = (F.abs(dy) > LEAST_PIXELS) & (dlat != 0)
    use_x = (F.abs(dx) > LEAST_PIXELS) & (dlon != 0)
    skip = use_y & geo.same_sign(dy, dlat)  # latitude grows upwards, pixels downwards: such a pair says nothing
    ry = F.abs(dlat) / F.when(dy != 0, F.abs(dy))
    rx = F.abs(dlon) / F.when(dx != 0, F.abs(dx))
    banded = F.lit(False)
    for low, high in LAT_BANDS:
        banded = banded | ry.between(low, high)
    turned = use_x & ~geo.same_sign(dx, dlon)
    p = p.where(~skip).withColumns({"ry": F.when(use_y & banded, ry), "bad_y": use_y & ~banded, "rx": F.when(use_x & ~turned & (rx <= MOST_LON), rx), "bad_x": use_x & ~turned & (rx > MOST_LON), "turned": turned})
    p = p.withColumns({"ul_y": F.col("lat_i") + F.col("py_i") * F.col("ry"), "lr_y": F.col("lat_i") - F.abs(F.col("height") - F.col("py_i")) * F.col("ry")})
    p = p.withColumns({"ul_x": F.col("lon_i") - F.col("px_i") * F.col("rx"), "lr_x": F.col("lon_i") + F.abs(F.col("width") - F.col("px_i")) * F.col("rx")})
    corners = (F.col("ul_x") != 0) & (F.col("ul_y") != 0) & (F.col("lr_x") != 0) & (F.col("lr_y") != 0)
    high = F.col("ul_y") - F.col("lr_y")
    ratio = F.abs((F.col("ul_x") - F.col("lr_x")) / F.when(high != 0, high))
    near = ratio - polynomial(F.col("airport_lat"), PROCEDURE) < WEIGHTED  # one-sided
    return p.withColumns({"twice": F.coalesce(corners & near & ~F.col("turned"), F.lit(False)), "off_ratio": F.coalesce(corners & ~near & ~F.col("turned"), F.lit(False))})


def samples(pairs: DataFrame, by: str, key: str) -> DataFrame:
    """The emitted samples: by, ord (order of emission), series (x, y, ul_x, ul_y, lr_x, lr_y), value. A pair that agrees with the expected ratio emits all six again."""
    cols = {"x": "rx", "y": "ry", "ul_x": "ul_x", "ul_y": "ul_y", "lr_x": "lr_x", "lr_y": "lr_y"}
    rows = F.array(*[F.struct(F.lit(turn).alias("turn"), F.lit(s).alias("series"), F.col(c).alias("value")) for turn in (0, 1) for s, c in cols.items()])
    e = pairs.select(by, F.concat_ws("|", F.col(f"{key}_i").cast("string"), F.col(f"{key}_j").cast("string")).alias("pair"), "twice", F.explode(rows).alias("e"))
    e = e.where(F.col("e.value").isNotNull() & ((F.col("e.turn") == 0) | F.col("twice")))
    return e.select(by, F.struct("pair", F.col("e.turn").alias("turn")).alias("ord"), F.col("e.series").alias("series"), F.col("e.value").alias("value"))


def mismatches(pairs: DataFrame, by: str, key: str) -> DataFrame:
    """How often each point took part in a pair with an implausible scale; each ordered pair counts for both."""
    bad = pairs.withColumn("bad", F.col("bad_y").cast("int") + F.col("bad_x").cast("int")).where("bad > 0")
    both = bad.select(by, F.explode(F.array(f"{key}_i", f"{key}_j")).alias(key), "bad")
    return both.groupBy(by, key).agg(F.sum("bad").alias("n_mismatches"))
