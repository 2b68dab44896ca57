"""Export of accepted charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.functions import affine, geo, text
from skyplate.operators.relational import catalog_join, not_deleted
from skyplate.sources.charts import world_file


def accepted(catalog: DataFrame, results: DataFrame, airports: DataFrame, keep_unknown: bool = False, status: str = "%MANUALGOOD%", airport: str = "%", state: str = "%") -> DataFrame:
    """Accepted charts with their airport's reference point. Charts of unknown airports are dropped, or kept with their upper left corner.

    airports: faa_code, ref_lat, ref_lon (fixed-width texts).
    """
    charts = catalog_join(catalog, results).where(F.col("chart_code").isin("IAP", "APD") & not_deleted(F.col("pdf_name")) & F.col("status").ilike(status) & F.col("faa_code").ilike(airport) & F.col("state_id").ilike(state))
    rows = charts.join(airports, "faa_code", "left" if keep_unknown else "inner")
    lat, lon = geo.fixed_width(F.col("ref_lat"), 0.0), geo.fixed_width(F.col("ref_lon"), 0.0)
    return rows.withColumns({"airport_lat": F.coalesce(lat, F.col("upper_left_lat")), "airport_lon": F.coalesce(lon, F.col("upper_left_lon"))})


def world_files(charts: DataFrame) -> DataFrame:
    """pdf_name, file name and text of each chart's world file; the vertical pixel size is negative."""
    m = affine.north_up(affine.affine(F.col("x_median"), F.col("x_skew"), F.col("y_skew"), F.col("y_median"), F.col("upper_left_lon"), F.col("upper_left_lat")))
    body = world_file(m["m11"], m["m21"], m["m12"], m["m22"], m["tx"], m["ty"])
    return charts.select("pdf_name", F.concat(text.pdf_base_name(F.col("pdf_name")), F.lit(".wld")).alias("file"), body.alias("body"))


def zooms(tiles: DataFrame, by: str, zoom: str) -> DataFrame:
    return tiles.groupBy(by).agg(F.min(zoom).alias("min_zoom"), F.max(zoom).alias("max_zoom"))
