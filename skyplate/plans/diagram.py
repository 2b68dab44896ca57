"""Georeferencing of airport diagrams from their printed graticule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.functions import affine
from skyplate.functions.ratio import LANDSCAPE, PORTRAIT, diagram_status, polynomial
from skyplate.operators.match import cross_lines, nearest_line


def control_points(boxes: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Crossings of the lines that latitude and longitude labels stand at. boxes: pdf_name, box_id, axis, value, bx, by_; lines: pdf_name, line_id, x1, y1, x2, y2, slope; pages: pdf_name, width, height, portrait."""
    ends = lines.select("pdf_name", "line_id", "x1", "y1", "x2", "y2")
    portrait = pages.select("pdf_name", "portrait")

    def of(axis: str, prefix: str) -> DataFrame:
        own = boxes.where(F.col("axis") == axis).join(portrait, "pdf_name")
        found = None
        for vertical in (True, False):
            upright = F.col("portrait") == F.lit(vertical == (axis == "lon"))
            hits = nearest_line(own.where(upright).drop("portrait"), lines, ["pdf_name"], "box_id", "line_id", vertical)
            found = hits if found is None else found.unionByName(hits)
        lined = found.join(ends, ["pdf_name", "line_id"])
        return lined.select("pdf_name", F.col("value").alias(axis), *(F.col(c).alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    return cross_lines(of("lat", "a").join(pages.select("pdf_name", "width", "height"), "pdf_name"), of("lon", "b"), ["pdf_name"]).select("pdf_name", "x", "y", "lon", "lat")


def fit(gcps: DataFrame, pages: DataFrame) -> DataFrame:
    """First-order fit per chart, its corners and status. pages: pdf_name, width, height, portrait, airport_lat."""
    used, out = affine.fit("x", "y", "lon", "lat")
    fitted = gcps.groupBy("pdf_name").agg(*used, F.count(F.lit(1)).alias("gcp_count")).withColumn("affine", out).join(pages, "pdf_name")
    ul, lr = affine.apply(F.col("affine"), F.lit(0.0), F.lit(0.0)), affine.apply(F.col("affine"), F.col("width"), F.col("height"))
    fitted = fitted.withColumns({"ul": ul, "lr": lr})
    high = F.col("ul.y") - F.col("lr.y")
    fitted = fitted.withColumn("ratio", F.abs((F.col("ul.x") - F.col("lr.x")) / F.when(high != 0, high)))
    fitted = fitted.withColumn("target_ratio", F.when(F.col("portrait"), polynomial(F.col("airport_lat"), PORTRAIT)).otherwise(polynomial(F.col("airport_lat"), LANDSCAPE)))
    status = diagram_status(F.col("ul.x"), F.col("ul.y"), F.col("lr.x"), F.col("lr.y"), F.col("ratio"), F.col("airport_lat"), F.col("portrait"))
    return fitted.select("pdf_name", "gcp_count", "affine", "ratio", "target_ratio", F.when(F.col("affine").isNull(), "AUTOBAD").otherwise(status).alias("status"))


def outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def squareness(gcps: DataFrame, affine_col: str, half_nm: float) -> DataFrame:
    """Sides and corner angle, in pixels and degrees, of the square of ± half_nm around each point under the inverse of its map."""
    d_lat = F.lit(half_nm / 60)
    d_lon = d_lat / F.cos(F.radians("lat"))
    inverse = affine.invert(F.col(affine_col))
    corner = {n: affine.apply(inverse, F.col("lon") + sx * d_lon, F.col("lat") + sy * d_lat) for n, sx, sy in (("_a", -1, 1), ("_b", 1, 1), ("_c", -1, -1))}
    rows = gcps.withColumns(corner)
    ux, uy, vx, vy = (F.col(f"_{p}.{c}") - F.col(f"_a.{c}") for p, c in (("b", "x"), ("b", "y"), ("c", "x"), ("c", "y")))
    angle = F.degrees(F.abs(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)))
    return rows.withColumns({"top": F.hypot(ux, uy), "left": F.hypot(vx, vy), "angle": angle}).drop("_a", "_b", "_c")
