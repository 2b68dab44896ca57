"""Feature extraction: from a chart's drawn content and words to its symbols, lines, boxes and text boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.operators import detect

from .georeference import control_points, estimate, match_icons, obstacles

BY = ["pdf_name"]
#: The kinds that each class of control point takes its symbols from.
CLASSES = {"obstacle": ("obstacle",), "fix": ("fix",), "gps": ("gps",), "navaid": ("vortac", "vor/dme", "ndb")}


def symbols(streams: DataFrame, kinds: tuple[str, ...] = tuple(d.kind for d in detect.SYMBOLS)) -> DataFrame:
    """pdf_name, icon_id, kind, icon_type, ix, iy of all symbols of these kinds. streams: pdf_name, stream_no, content."""
    found = [detect.hits(streams, ["pdf_name", "stream_no"], "content", d) for d in detect.SYMBOLS if d.kind in kinds]
    rows = [f.select("pdf_name", F.concat_ws("-", "stream_no", "feature_id").alias("icon_id"), "kind", F.upper("kind").alias("icon_type"), F.col("center_x").alias("ix"), F.col("center_y").alias("iy")) for f in found]
    return reduce(DataFrame.unionByName, rows)


def marks(streams: DataFrame) -> DataFrame:
    """pdf_name, mx, my of the not-to-scale marks."""
    return detect.hits(streams, ["pdf_name", "stream_no"], "content", detect.NOT_TO_SCALE).select("pdf_name", F.col("center_x").alias("mx"), F.col("center_y").alias("my"))


def boxes(words: DataFrame, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Text boxes of each class: pdf_name, box_id, text, bx, by_. words: pdf_name, line_no, x_min, y_min, x_max, y_max, text, page_height; names: pdf_name, name of the navaids near."""
    found = {"obstacle": detect.obstacle_boxes(words, BY), "fix": detect.fix_boxes(words, BY), "navaid": detect.navaid_boxes(words, BY, names)}
    found["gps"] = found["fix"]
    return {k: f.select("pdf_name", "box_id", "text", F.col("center_x").alias("bx"), F.col("center_y").alias("by_")) for k, f in found.items()}


def counts(charts: DataFrame, streams: DataFrame, words: DataFrame) -> DataFrame:
    """One row per chart with the number of its symbols of each kind and of its text boxes; 0 where there are none."""
    kinds = [d.kind for d in detect.SYMBOLS]
    by_kind = detect.count_by_kind(symbols(streams), BY, kinds)
    out = charts.select(*BY).distinct().join(by_kind, BY, "left")
    own = boxes(words)
    for k in ("obstacle", "fix", "navaid"):
        out = out.join(own[k].groupBy(*BY).agg(F.count(F.lit(1)).alias(f"{k}_boxes")), BY, "left")
    return out.na.fill(0)


def chart_points(streams: DataFrame, words: DataFrame, db: dict[str, DataFrame], pages: DataFrame, names: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Control points of all classes. db: class -> pdf_name, text, db_type, lat, lon of the features near each chart. mask: pdf_name, px, py, keep of whole pixels."""
    text, off = boxes(words, names), marks(streams)
    matched = {k: match_icons(symbols(streams, kinds).drop("kind"), text[k], db[k], off) for k, kinds in CLASSES.items() if k in db}
    points = control_points(matched, pages)
    if mask is not None:
        whole = points.withColumns({"_x": F.col("px"), "_y": F.col("py"), "px": F.floor("px"), "py": F.floor("py")})
        points = detect.masked(whole, mask, BY).withColumns({"px": F.col("_x"), "py": F.col("_y")}).drop("_x", "_y")
    return points


def georeference(streams: DataFrame, words: DataFrame, db: dict[str, DataFrame], pages: DataFrame, names: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """From drawn content to scales, corners and status of each chart."""
    return estimate(chart_points(streams, words, db, pages, names, mask))


def obstacle_features(airports: DataFrame, db: DataFrame, words: DataFrame) -> DataFrame:
    """The obstacles that a chart shows by their height alone, as features to match: pdf_name, text, db_type, lat, lon."""
    heights = detect.obstacle_heights(words, BY).select("pdf_name", F.col("text").try_cast("bigint").alias("height"))
    return obstacles(airports, db, heights).select("pdf_name", F.col("height").cast("string").alias("text"), F.lit("OBSTACLE").alias("db_type"), F.col("f_lat").alias("lat"), F.col("f_lon").alias("lon"))
