"""Georeferencing of procedure charts: features -> matches -> control points -> scales -> extents -> verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplate.functions.casts import true_number
from skyplate.functions.ratio import PROCEDURE, polynomial, procedure_status
from skyplate.operators.all_pairs import SERIES, medians
from skyplate.operators.match import away_from, in_box, same_type_if
from skyplate.operators.nearest import nearest_within

#: Points on the page: how far an icon and its text box may be apart, and how near a not-to-scale mark disqualifies.
MATCH_RADIUS = 115.0
MARK_RADIUS = 30.0
#: Nautical miles around the airport within which each kind of feature is looked for.
RADII = {"obstacle": 20.0, "fix": 50.0, "gps": 40.0, "navaid": 30.0}


def obstacles(airports: DataFrame, db: DataFrame, heights: DataFrame, group: str = "pdf_name", nearest_if_many: bool = False, tie: tuple[Column, ...] = ()) -> DataFrame:
    """Obstacles over 200 feet near a chart's airport whose height the chart shows: those alone with their height, or the nearest of each height, of equally near ones the northernmost, or the first by `tie`.

    heights: group, height; the charts of a group (a column of airports) show the same heights. Heights are matched within
    the cells of the grid, before there are pairs: as a key where each chart has its own, else as a list of each height's groups.
    """
    high = db.where("agl > 200")
    if group == "pdf_name":
        near = in_box(airports.join(heights.distinct(), group), high, RADII["obstacle"], by=("height",))
    else:
        shown = heights.groupBy("height").agg(F.collect_set(group).alias("_shown"))
        near = in_box(airports, high.join(shown, "height"), RADII["obstacle"]).where(F.array_contains("_shown", F.col(group))).drop("_shown")
    if not nearest_if_many:
        rest = [c for c in near.columns if c not in ("pdf_name", "height")]
        alone = near.groupBy("pdf_name", "height").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in rest))
        return alone.where("_n = 1").drop("_n")
    dist = F.sqrt(F.pow(F.col("lat") - F.col("f_lat"), 2) + F.pow(F.col("lon") - F.col("f_lon"), 2))
    best = near.withColumn("dist", dist).groupBy("pdf_name", "height").agg(F.min_by(F.struct(*near.columns), F.struct("dist", *(tie or [(-F.col("f_lat")).alias("t")]))).alias("_r"))
    return best.select("_r.*")


def match_icons(icons: DataFrame, boxes: DataFrame, db: DataFrame, marks: DataFrame, radius: float = MATCH_RADIUS) -> DataFrame:
    """Icons and text boxes that are each other's nearest, away from not-to-scale marks, with the feature of the box's text.

    icons: pdf_name, icon_id, icon_type, ix, iy. boxes: pdf_name, box_id, text, bx, by_. db: pdf_name, text, db_type, lat, lon. marks: pdf_name, mx, my.
    """
    kept = away_from(icons, marks, ["pdf_name"], "icon_id", MARK_RADIUS, ("ix", "iy"), ("mx", "my"))
    found = nearest_within(kept, boxes, ["pdf_name"], "icon_id", "box_id", radius, ("ix", "iy"), ("bx", "by_"), mutual=True).join(db, ["pdf_name", "text"])
    return found.where(same_type_if(F.col("icon_type"), F.col("db_type")) & true_number(F.col("ix")) & true_number(F.col("iy")) & true_number(F.col("lat")) & true_number(F.col("lon")))


def control_points(matches: dict[str, DataFrame], pages: DataFrame) -> DataFrame:
    """Union of the matches of each kind, keyed kind-text-icon, in raster pixels. pages: pdf_name, scale_x, scale_y, png_width, png_height, airport_lat."""
    rows = [m.select("pdf_name", F.concat_ws("-", F.lit(kind), "text", F.col("icon_id").cast("string")).alias("gcp_key"), "ix", "iy", "lon", "lat") for kind, m in matches.items()]
    all_rows = reduce(DataFrame.unionByName, rows).join(pages, "pdf_name")
    return all_rows.select("pdf_name", "gcp_key", (F.col("ix") * F.col("scale_x")).alias("px"), (F.col("png_height") - F.col("iy") * F.col("scale_y")).alias("py"), "lon", "lat", F.col("png_width").alias("width"), F.col("png_height").alias("height"), "airport_lat")


def estimate(gcps: DataFrame) -> DataFrame:
    """Per chart the robust scales and corners, the ratio, the target and the status. Charts with fewer than two points are AUTOBAD."""
    enough = gcps.groupBy("pdf_name").agg(F.count(F.lit(1)).alias("gcp_count"), F.first("airport_lat").alias("airport_lat"))
    wide = medians(gcps, "pdf_name", "gcp_key").groupBy("pdf_name").pivot("series", list(SERIES)).agg(F.first("median"))
    out = enough.join(wide, "pdf_name", "left")
    high = F.col("ul_y") - F.col("lr_y")
    out = out.withColumn("ratio", F.abs((F.col("ul_x") - F.col("lr_x")) / F.when(high != 0, high))).withColumn("target_ratio", polynomial(F.col("airport_lat"), PROCEDURE))
    status = F.when((F.col("gcp_count") < 2) | F.col("ratio").isNull(), "AUTOBAD").otherwise(procedure_status(F.col("ratio"), F.col("airport_lat")))
    return out.withColumn("status", status)
