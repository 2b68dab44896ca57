"""What charts are read from and written to: page text, streams, control points, world files and virtual rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplate.functions import affine
from skyplate.functions.text import gcp_option

DPI = 300


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """pdf_name, stream_no, content of streams dumped to <pdf>/<number>.txt. Numbers above the last but one are the reader's to filter."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("content"))
    return rows.select(F.regexp_extract("p", r"([^/]+)/\d+\.txt$", 1).alias("pdf_name"), F.regexp_extract("p", r"(\d+)\.txt$", 1).try_cast("int").alias("stream_no"), "content")


def whole_stream(streams: DataFrame) -> DataFrame:
    """All streams of a chart in one text, in order."""
    parts = F.array_sort(F.collect_list(F.struct("stream_no", "content")))
    return streams.groupBy("pdf_name").agg(F.array_join(F.transform(parts, lambda s: s["content"]), "\n").alias("content"))


def words(lines: DataFrame, by: list[str], line: str, line_no: str = "line_no") -> DataFrame:
    """Boxes of <word xMin= yMin= xMax= yMax=>text</word> lines."""
    n = r"(-?[.\d]+)"
    pattern = rf'<word xMin="{n}" yMin="{n}" xMax="{n}" yMax="{n}">(.*?)</word>'
    got = lines.where(F.col(line).rlike(pattern))
    parts = [F.regexp_extract(line, pattern, k + 1).try_cast("double").alias(c) for k, c in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return got.select(*by, line_no, *parts, F.regexp_extract(line, pattern, 5).alias("text"))


def page_size(lines: DataFrame, by: list[str], line: str, line_no: str = "line_no") -> DataFrame:
    """Width, height, centre and ratio of the page from the first line with four numbers in brackets; raster size and scale at 300 DPI."""
    n = r"(-?[.\d]+)"
    pattern = rf"\[\s*{n}\s+{n}\s+{n}\s+{n}\s*\]"
    first = lines.where(F.col(line).rlike(pattern)).groupBy(*by).agg(F.min_by(line, line_no).alias("_l"))
    w, h = (F.regexp_extract("_l", pattern, k).try_cast("double") for k in (3, 4))
    out = first.select(*by, w.alias("width"), h.alias("height")).withColumns({"center_x": F.col("width") / 2, "center_y": F.col("height") / 2, "ratio": F.try_divide("width", "height")})
    out = out.withColumns({"png_width": raster_size(F.col("width")), "png_height": raster_size(F.col("height"))})
    return out.withColumns({"scale_x": F.try_divide("png_width", "width"), "scale_y": F.try_divide("png_height", "height")})


def raster_size(points: Column) -> Column:
    return F.ceil(points / 72 * DPI)


def to_raster(x: Column, y: Column, scale_x: Column, scale_y: Column, png_height: Column) -> Column:
    """Raster pixel of a page point; the raster's origin is its upper left corner."""
    return F.struct((x * scale_x).alias("px"), (png_height - y * scale_y).alias("py"))


def save_points(gcps: DataFrame, path: str) -> None:
    """Snapshot of control points. It replaces the one that is there; merge with that first (resume_points) to keep its charts."""
    gcps.write.mode("overwrite").parquet(path)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pdf_name string, gcp_key string, pngx double, pngy double, pdfx double, pdfy double, lon double, lat double").parquet(path)


def resume_points(charts: DataFrame, saved: DataFrame, detected: DataFrame) -> DataFrame:
    """Saved points of charts that have some, detected ones of the others."""
    fresh = detected.join(saved.select("pdf_name"), "pdf_name", "left_anti")
    return saved.join(charts.select("pdf_name"), "pdf_name", "left_semi").unionByName(fresh.join(charts.select("pdf_name"), "pdf_name", "left_semi"))


def geotransform(ul_lon: Column, ul_lat: Column, lr_lon: Column, lr_lat: Column, width: Column, height: Column) -> Column:
    """North-up geotransform from corner extents: ulx, pixel width, 0, uly, 0, pixel height."""
    w, h = F.when(width != 0, width), F.when(height != 0, height)
    return F.array(ul_lon, (lr_lon - ul_lon) / w, F.lit(0.0), ul_lat, F.lit(0.0), (lr_lat - ul_lat) / h)


def world_file(a: Column, d: Column, b: Column, e: Column, c: Column, f: Column) -> Column:
    """Six lines A, D, B, E, C, F with ten decimals."""
    return F.concat_ws("\n", *(F.format_string("%.10f", x.cast("double")) for x in (a, d, b, e, c, f)))


def parse_world_file(text: Column) -> Column:
    """The affine map of a world file: lines m11, m21, m12, m22, tx, ty."""
    at = [F.get(F.split(text, "\n"), F.lit(n)).try_cast("double") for n in range(6)]
    return affine.affine(at[0], at[2], at[1], at[3], at[4], at[5])


def vrt(width: Column, height: Column, transform: Column, source: Column) -> Column:
    """A virtual raster of one source file with its geotransform."""
    numbers = F.array_join(F.transform(transform, lambda v: F.format_string("%.16e", v)), ",  ")
    return F.concat(F.format_string('<VRTDataset rasterXSize="%d" rasterYSize="%d">', width, height), F.lit("\n  <SRS>WGS84</SRS>\n  <GeoTransform>  "), numbers, F.lit("</GeoTransform>\n  <SourceFilename>"), source, F.lit("</SourceFilename>\n</VRTDataset>\n"))


def parse_vrt(text: Column) -> Column:
    """Size, geotransform and first source file of a virtual raster."""
    numbers = F.split(F.regexp_extract(text, r"<GeoTransform>([^<]*)</GeoTransform>", 1), ",")
    source = F.regexp_extract(text, r"<SourceFilename[^>]*>([^<]*)</SourceFilename>", 1)
    return F.struct(F.regexp_extract(text, r'rasterXSize="(\d+)"', 1).try_cast("int").alias("width"), F.regexp_extract(text, r'rasterYSize="(\d+)"', 1).try_cast("int").alias("height"), F.transform(numbers, lambda n: F.trim(n).try_cast("double")).alias("transform"), source.alias("source"))


def parse_info(text: Column) -> Column:
    """Size, pixel size and corners that a raster tool reports as text: Size is w, h; Pixel Size = (x,y); Upper Left (x, y); Lower Right (x, y)."""
    n = r"(-?[.\d]+(?:[eE][-+]?\d+)?)"

    def pair(label: str, k: int) -> Column:
        return F.regexp_extract(text, rf"{label}\s*=?\s*\(\s*{n}\s*,\s*{n}\s*\)", k).try_cast("double")

    size = [F.regexp_extract(text, r"Size is (\d+)\s*,\s*(\d+)", k).try_cast("int") for k in (1, 2)]
    return F.struct(size[0].alias("width"), size[1].alias("height"), pair("Pixel Size", 1).alias("x_pixel"), pair("Pixel Size", 2).alias("y_pixel"), *(pair(label, k).alias(f"{c}_{x}") for label, c in (("Upper Left", "ul"), ("Lower Right", "lr")) for k, x in ((1, "lon"), (2, "lat"))))


def failures(outcomes: DataFrame, key: str, reason: str) -> DataFrame:
    """Charts that failed, and why."""
    return outcomes.where(F.col(reason).isNotNull()).select(key, F.col(reason).alias("reason"))


def gcp_options(gcps: DataFrame, by: str) -> DataFrame:
    """Command-line options of a chart's control points, sorted."""
    option = gcp_option(F.col("pngx"), F.col("pngy"), F.col("lon"), F.col("lat"))
    return gcps.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(option)), " ").alias("options"))
