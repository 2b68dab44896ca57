"""Pattern detectors over the drawing operators and words of charts.

A detector is a multi-line regular expression over a content stream whose groups become columns, and a gate on the
derived sizes. One pass over the stream extracts the whole matches, posexplode numbers them, and the groups are taken
from each short match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyplate.functions import geo

from .aggregate import only_once
from .relational import contained, last_wins

NUMBER = r"[-.\d]+"
XY = rf"q\s1\s0\s0\s1\s+({NUMBER})\s+({NUMBER})\s+cm"
PLACED = rf"q\s1\s0\s0\s1\s+{NUMBER}\s+{NUMBER}\s+cm"
ORIGIN = r"0\s+0\s+m"
LINE = rf"{NUMBER}\s+{NUMBER}\s+l"
LINE_XY = rf"({NUMBER})\s+({NUMBER})\s+l"
CURVE = rf"(?:{NUMBER}\s+){{6}}c"


def lines(*parts: str) -> str:
    """Parts that each take a whole line."""
    return r"(?m)" + r"\s+".join(rf"^{p}$" for p in parts)


def curves(n: int) -> list[str]:
    return [CURVE] * n


@dataclass(frozen=True)
class Detector:
    """patterns: alternatives with the same groups. columns: derived from the groups c1, c2, ... gate: rows to keep."""

    kind: str
    patterns: tuple[str, ...]
    groups: int
    columns: dict[str, str]
    gate: str = "true"


def hits(streams: DataFrame, by: list[str], content: str, detector: Detector) -> DataFrame:
    """by, kind, feature_id, the detector's columns. Ids number the hits of a stream by pattern and place."""
    found = None
    for n, pattern in enumerate(detector.patterns):
        rows = streams.select(*by, F.posexplode(F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(0))).alias("_pos", "_m"))
        groups = [F.regexp_extract("_m", pattern, k + 1).try_cast("double").alias(f"c{k + 1}") for k in range(detector.groups)]
        rows = rows.select(*by, F.concat(F.lit(f"{detector.kind}-{n}-"), F.col("_pos").cast("string")).alias("feature_id"), *groups)
        found = rows if found is None else found.unionByName(rows)
    out = found.select(*by, F.lit(detector.kind).alias("kind"), "feature_id", *(F.expr(e).alias(c) for c, e in detector.columns.items()))
    return out.where(detector.gate)


AT = {"center_x": "c1", "center_y": "c2", "georef_x": "c1", "georef_y": "c2"}
BOX = {"center_x": "c1 + c3 / 2", "center_y": "c2 + c4 / 2", "georef_x": "c1 + c3 / 2", "georef_y": "c2 + c4 / 2", "width": "c3", "height": "c4"}

def drawn(*parts: str, end: str = "S") -> tuple[str, ...]:
    """A further shape of a symbol, wherever it is placed."""
    return (PLACED, ORIGIN, *parts, end, "Q")


# The order in which charts draw each symbol.
FILL = r"f\*"
FIRST_X = rf"({NUMBER})\s+0\s+l"
OBSTACLE = Detector(
    "obstacle",  # a triangle, and a dot in it
    (lines(XY, ORIGIN, r"([.0-9]+)\s+[.0-9]+\s+l", r"([.0-9]+)\s+[.0-9]+\s+l", "S", "Q", XY, ORIGIN, *curves(4), FILL, "Q"),),
    6,
    {"center_x": "c1 + c3", "center_y": "c2 + c4 / 2", "georef_x": "c1 + c3", "georef_y": "c2", "width": "2 * c3", "height": "c4"},
)
FIX = Detector("fix", (lines(XY, ORIGIN, rf"({NUMBER})\s+{NUMBER}\s+l", rf"{NUMBER}\s+({NUMBER})\s+l", r"0\s+0\s+l", "S", "Q"),), 4, BOX, "abs(height) >= 3")
GPS = Detector(
    "gps",
    tuple(lines(XY, ORIGIN, *curves(8), LINE_XY, *curves(n), LINE_XY, *curves(2), r"0\s+0\s+l", FILL, "Q") for n in (6, 8)),
    6,
    {"center_x": "c1 + case when c3 > 0 and c5 > 0 then 8 when abs(c3) - abs(c5) < 4 then 0 when c3 < 0 and c5 < 0 then -8 else abs(c3) - abs(c5) end", "center_y": "c2 + case when c3 > 0 and c5 > 0 then 0 when abs(c3) - abs(c5) < 4 then 8 when c3 < 0 and c5 < 0 then 0 else abs(c4) - abs(c6) end"},
)
_SIDES = (XY, ORIGIN, FIRST_X, "S", "Q", *drawn(LINE), *drawn(LINE))
_WEDGE = drawn(LINE, LINE, LINE, end=FILL)
VORTAC = Detector(
    "vortac",  # three sides and three wedges, drawn plainly, with an outline, or with a dot
    tuple(lines(*_SIDES, *between, *_WEDGE * 3) for between in ((), drawn(LINE, LINE, LINE), drawn(*curves(4), end=FILL))),
    3,
    {"center_x": "c1 + c3 / 2", "center_y": "c2 - 3", "georef_x": "c1 + c3 / 2", "georef_y": "c2 - 3", "length": "c3"},
    "length between 1 and 6",
)
VORDME = Detector("vor/dme", (lines(XY, ORIGIN, FIRST_X, LINE, rf"0\s+({NUMBER})\s+l", LINE, "S", "Q", *drawn(LINE, LINE), *drawn(LINE, LINE)),), 4, BOX, "width >= 7 and height >= 7")
NDB = Detector("ndb", tuple(lines(XY, ORIGIN, *curves(4), FILL, "Q", *width, *drawn(*curves(8))) for width in ((rf"{NUMBER} w ?",), ())), 2, AT)
INSET = Detector("inset", (lines(XY, ORIGIN, FIRST_X, LINE, rf"0\s+({NUMBER})\s+l", r"0\s+0\s+l", "S", "Q"),), 4, BOX, "abs(width) between 25 and 300 and abs(height) between 25 and 500")
PARTIAL_INSET = Detector("inset", tuple(lines(XY, ORIGIN, FIRST_X, rf"{NUMBER}\s+({NUMBER})\s+l", *side, "S", "Q") for side in ((), (rf"0\s+{NUMBER}\s+l",))), 4, BOX, "abs(width) between 50 and 300 and abs(height) between 50 and 500")
CIRCLE = Detector("circle", (lines(XY, ORIGIN, *curves(8), rf"({NUMBER})\s+(?:{NUMBER}\s+){{5}}c", *curves(7), "S", "Q"),), 3, {"center_x": "c1 - abs(c3) / 2", "center_y": "c2", "radius": "abs(c3) / 2", "width": "abs(c3)"}, "width >= 50")
HORIZONTAL = Detector("line", (lines(XY, ORIGIN, FIRST_X, "S", "Q"),), 3, {"x1": "c1", "y1": "c2", "x2": "c1 + c3", "y2": "c2", "length": "abs(c3)"}, "length >= 5")
VERTICAL = Detector("line", (lines(XY, ORIGIN, rf"0\s+({NUMBER})\s+l", "S", "Q"),), 3, {"x1": "c1", "y1": "c2", "x2": "c1", "y2": "c2 + c3", "length": "abs(c3)"}, "length >= 5")
NOT_TO_SCALE = Detector("not-to-scale", (lines(XY, ORIGIN, *[LINE] * 6, "S", "Q", PLACED, ORIGIN, *[LINE] * 6, "S", "Q"),), 2, AT)
RUNWAY = Detector("runway", (lines(XY, ORIGIN, LINE_XY, "S", "Q"),), 4, {"x1": "c1", "y1": "c2", "x2": "c1 + c3", "y2": "c2 + c4", "length": "sqrt(c3 * c3 + c4 * c4)", "heading": "round(degrees(pi() / 2 - atan2(c4, c3)))", "slope": "round(pmod(cast(degrees(atan2(c4, c3)) as int), 180))"}, "length between 4 and 22")
GRATICULE = tuple(
    Detector(f"graticule{n}", (lines(XY, ORIGIN, *[LINE] * (n - 1), LINE_XY, "S", "Q"),), 4, {"x1": "c1", "y1": "c2", "x2": "c1 + c3", "y2": "c2 + c4", "center_x": "c1 + c3 / 2", "center_y": "c2 + c4 / 2", "slope": "cast(round(pmod(cast(degrees(atan2(c4, c3)) as int), 180)) as int)", "length": "sqrt(c3 * c3 + c4 * c4)"}, f"length >= {least}")
    for n, least in ((1, 3), (2, 35), (3, 10), (4, 300))
)
#: Symbols that text boxes and database features are matched to; the types of navaids as the database names them.
SYMBOLS = (OBSTACLE, FIX, GPS, VORTAC, VORDME, NDB)
ICONS = (*SYMBOLS, INSET, PARTIAL_INSET, CIRCLE, NOT_TO_SCALE)


def axis_lines(streams: DataFrame, by: list[str], content: str) -> DataFrame:
    """Horizontal and vertical lines; those of other slopes are neither."""
    across, up = (hits(streams, by, content, d).withColumn("axis", F.lit(a)) for a, d in (("horizontal", HORIZONTAL), ("vertical", VERTICAL)))
    return across.unionByName(up)


def with_valid_heading(runway_lines: DataFrame, headings: DataFrame, by: list[str], most: float = 1.0) -> DataFrame:
    """Runway lines whose heading is within `most` degrees of one of their chart's runway headings (by, valid). The headings are copied to the cells of that width that they reach."""
    reach = F.explode(F.sequence(F.floor((F.col("valid") - most) / most), F.floor((F.col("valid") + most) / most)))
    wanted = headings.select(*(F.col(c).alias(f"_{c}") for c in by), "valid", reach.alias("_cell"))
    same = (F.floor(F.col("heading") / most) == F.col("_cell")) & (F.abs(F.col("heading") - F.col("valid")) <= most)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return runway_lines.join(wanted, same, "left_semi")


def large_boxes(boxes: DataFrame, page_width: str, page_height: str) -> DataFrame:
    """Boxes of half the page or more in both directions."""
    return boxes.where((F.abs("width") >= F.col(page_width) / 2) & (F.abs("height") >= F.col(page_height) / 2))


def count_by_kind(features: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """One count column per kind; kinds without a feature have 0."""
    return features.groupBy(*by).pivot("kind", kinds).count().na.fill(0, kinds)


def gate_text(rows: DataFrame, by: list[str], text: str, least: int = 5) -> DataFrame:
    """by, n_lines, not_to_scale, accepted: charts with at least `least` lines of text that nowhere say 'chart not to scale'."""
    marked = F.regexp_replace(F.col(text), r"\s+", "").ilike("%chartnott%")
    out = rows.groupBy(*by).agg(F.count(text).alias("n_lines"), F.coalesce(F.bool_or(marked), F.lit(False)).alias("not_to_scale"))
    return out.withColumn("accepted", (F.col("n_lines") >= least) & ~F.col("not_to_scale"))


def gate_points(gcps: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    return gcps.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points")).withColumn("accepted", F.col("n_points") >= least)


def masked(features: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """Features whose pixel the mask keeps."""
    return features.join(mask.where("keep").select(*by, "px", "py"), [*by, "px", "py"], "left_semi")


BOX_Y = {"middle": "page_height - y_min - (y_max - y_min) / 2", "top": "page_height - y_min"}


def text_boxes(words: DataFrame, by: list[str], pattern: str, y: str = "middle", last_by: str = "line_no") -> DataFrame:
    """Boxes of words that match the pattern as a whole, once per corner: the last by line. words have the page's height; _x and _y, if given, are the corner that counts."""
    corner = [F.col(f"_{c}") if f"_{c}" in words.columns else F.col(c) for c in ("x_min", "y_min")]
    found = words.where(F.col("text").rlike(rf"^(?:{pattern})$"))
    found = found.select(*by, last_by, "text", F.concat_ws(".", *(c.cast("string") for c in corner)).alias("box_id"), ((F.col("x_min") + F.col("x_max")) / 2).alias("center_x"), F.expr(BOX_Y[y]).alias("center_y"), (F.col("x_max") - F.col("x_min")).alias("width"), (F.col("y_max") - F.col("y_min")).alias("height"))
    return last_wins(found, [*by, "box_id"], [last_by])


def obstacle_boxes(words: DataFrame, by: list[str]) -> DataFrame:
    """Boxes of numbers, 2 points higher and 1 point narrower than the words' (fixed values)."""
    own = words.withColumns({"_x_min": F.col("x_min"), "_y_min": F.col("y_min"), "y_min": F.col("y_min") - 2, "x_max": F.col("x_max") - 1})
    return text_boxes(own, by, r"[1-9]\d+")


def obstacle_heights(words: DataFrame, by: list[str]) -> DataFrame:
    """Heights up to 30000 that a chart shows exactly once."""
    return only_once(words.where(F.col("text").rlike(r"^[1-9]\d{1,4}$") & (F.col("text").try_cast("int") <= 30000)), by, "text")


def fix_boxes(words: DataFrame, by: list[str]) -> DataFrame:
    return text_boxes(words, by, r"[A-Z]{5}", "top").where(~F.col("text").rlike("(?i)tower|south|radar"))


def navaid_boxes(words: DataFrame, by: list[str], names: DataFrame | None = None) -> DataFrame:
    """Boxes of three letters, 1 point narrower than the words', no higher than wide. names (by, name): only those that stand in the chart's list."""
    found = text_boxes(words.withColumn("x_max", F.col("x_max") - 1), by, r"[A-Z]{3}", "top").where((F.col("height") <= F.col("width")) & (F.abs("width") <= 50))
    return found if names is None else contained(found, names, "text", "name", by)


def coordinate_boxes(words: DataFrame, by: list[str]) -> DataFrame:
    """Coordinates printed in one, two or three consecutive words: 71 / 12.5' / W. by, line_no, axis (lat or lon), value, center_x, center_y."""
    w = Window.partitionBy(*by).orderBy("line_no")
    ahead = words.withColumns({"t1": F.lead("text", 1).over(w), "t2": F.lead("text", 2).over(w), "x1": F.lead("x_max", 1).over(w), "x2": F.lead("x_max", 2).over(w)})
    mark = "['’´`]"
    one = F.col("text")
    two = F.concat_ws(" ", "text", "t1")
    three = F.concat_ws(" ", "text", "t1", "t2")
    pattern = rf"^(\d{{2,3}})(?:[°-]\s?|\s)(\d{{1,2}}(?:\.\d+)?){mark}?\s?([NSEW])$"
    shape = F.when(one.rlike(pattern), one).when(F.col("t1").isNotNull() & two.rlike(pattern), two).when(F.col("t2").isNotNull() & three.rlike(pattern), three)
    right = F.when(one.rlike(pattern), F.col("x_max")).when(two.rlike(pattern), F.col("x1")).otherwise(F.col("x2"))
    got = ahead.withColumns({"_t": shape, "_r": right}).where(F.col("_t").isNotNull())
    side = F.regexp_extract("_t", pattern, 3)
    value = F.regexp_extract("_t", pattern, 1).cast("double") + F.regexp_extract("_t", pattern, 2).cast("double") / 60
    return got.select(*by, "line_no", F.when(side.isin("N", "S"), "lat").otherwise("lon").alias("axis"), F.when(side.isin("S", "W"), -value).otherwise(value).alias("value"), ((F.col("x_min") + F.col("_r")) / 2).alias("center_x"), F.expr(BOX_Y["middle"]).alias("center_y"))


def near_airport(boxes: DataFrame, airport_lat: str, airport_lon: str) -> DataFrame:
    """Coordinates of the airport's hemispheres whose degrees are at most one below the airport's; the test is one-sided.

    The airport's degrees are rounded down before the sign goes, so that those of -71.4 are 72.
    """
    home = F.when(F.col("axis") == "lat", F.col(airport_lat)).otherwise(F.col(airport_lon))
    south_or_west = (home < 0) == (F.col("value") < 0)
    return boxes.where((F.abs(F.floor(home)) - F.floor(F.abs("value")) <= 1) & south_or_west)


def orientation(boxes: DataFrame, by: list[str]) -> DataFrame:
    """portrait: latitude labels line up in x, so that the last two agree within .03; else landscape."""
    w = Window.partitionBy(*by, "axis").orderBy("line_no")
    step = boxes.withColumns({"dx": F.abs(F.col("center_x") - F.lag("center_x").over(w)), "dy": F.abs(F.col("center_y") - F.lag("center_y").over(w))})
    vote = F.when((F.col("axis") == "lat") & (F.col("dx") <= 0.03), True).when((F.col("axis") == "lat") & (F.col("dy") <= 0.03), False).when((F.col("axis") == "lon") & (F.col("dy") <= 0.03), True).when((F.col("axis") == "lon") & (F.col("dx") <= 0.03), False)
    return step.withColumn("_v", vote).where(F.col("_v").isNotNull()).groupBy(*by).agg(F.max_by("_v", "line_no").alias("portrait"))


def text_groups(streams: DataFrame, by: list[str], content: str) -> DataFrame:
    """BT ... ET groups: their shown strings joined in order with degree signs as dashes and spaces removed, and their bounds."""
    group = r"(?s)BT\b(.*?)\bET\b"
    g = streams.select(*by, F.posexplode(F.regexp_extract_all(F.col(content), F.lit(group), F.lit(1))).alias("group_no", "_b"))
    tm = rf"(?:{NUMBER}\s+){{4}}({NUMBER})\s+({NUMBER})\s+Tm"
    xs = F.transform(F.regexp_extract_all("_b", F.lit(tm), F.lit(1)), lambda v: v.try_cast("double"))
    ys = F.transform(F.regexp_extract_all("_b", F.lit(tm), F.lit(2)), lambda v: v.try_cast("double"))
    shown = F.array_join(F.regexp_extract_all("_b", F.lit(r"\(((?:[^()\\]|\\.)*)\)\s*Tj"), F.lit(1)), "")
    text = F.regexp_replace(F.replace(shown, F.lit("\\260"), F.lit("-")), r"\s+", "")
    return g.select(*by, "group_no", text.alias("text"), F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max")).where(F.col("x_min").isNotNull() & (F.col("text") != ""))


def text_coordinates(groups: DataFrame) -> DataFrame:
    """Coordinates that text groups show, as in 71-12.5'W: axis, value, centre, size, and portrait: the group runs along the page, within 15 degrees."""
    pattern = r"(\d{1,3})-([-.\d]+)[\s']*([NEWS])"
    side = F.regexp_extract("text", pattern, 3)
    value = F.regexp_extract("text", pattern, 1).try_cast("double") + F.regexp_extract("text", pattern, 2).try_cast("double") / 60
    width, height = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    found = groups.where(F.col("text").rlike(pattern)).withColumns({
        "axis": F.when(side.isin("N", "S"), "lat").otherwise("lon"), "value": F.when(side.isin("S", "W"), -value).otherwise(value),
        "center_x": F.col("x_min") + width / 2, "center_y": F.col("y_min") + height / 2, "width": width, "height": height,
        "portrait": geo.slope_angle(F.col("x_min"), F.col("y_min"), F.col("x_max"), F.col("y_max")) <= 15,
    })
    return found.where(F.col("value").isNotNull())
