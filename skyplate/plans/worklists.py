"""Review worklists: charts to look at, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.functions.casts import lenient_double
from skyplate.operators.relational import catalog_join, not_deleted


def _charts(catalog: DataFrame, results: DataFrame, airport: str = "%", state: str = "%") -> DataFrame:
    rows = catalog_join(catalog, results)
    keep = F.col("chart_code").isin("IAP", "APD") & F.col("faa_code").ilike(airport) & F.col("state_id").ilike(state) & not_deleted(F.col("pdf_name"))
    return rows.where(keep).withColumn("difference", F.abs(lenient_double(F.col("target_ratio")) - lenient_double(F.col("ratio"))))


def unreviewed(catalog: DataFrame, results: DataFrame, airport: str = "%", state: str = "%") -> DataFrame:
    """Not marked by a reviewer. NOGEOREF stays, null leaves."""
    return _charts(catalog, results, airport, state).where(~F.col("status").ilike("%MANUAL%")).orderBy("faa_code")


def marked_bad(catalog: DataFrame, results: DataFrame, airport: str = "%", state: str = "%") -> DataFrame:
    return _charts(catalog, results, airport, state).where(F.col("status").ilike("%MANUALBAD%")).orderBy("faa_code")


def added_or_changed(catalog: DataFrame, results: DataFrame, airport: str = "%", state: str = "%") -> DataFrame:
    """New and changed charts outside the military, whose code is compared with its case."""
    return _charts(catalog, results, airport, state).where(F.col("status").ilike("%ADDEDCHANGED%") & (F.col("military_use") != "M")).orderBy("faa_code")


def unreferenced(catalog: DataFrame, results: DataFrame, airport: str = "%", state: str = "%") -> DataFrame:
    """Charts of the queue without a transform, largest difference last."""
    return _charts(catalog, results, airport, state).where(F.coalesce(lenient_double(F.col("x_scale")), F.lit(0.0)) == 0).orderBy(F.col("difference").asc())


def rotated(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """Diagrams with a skew."""
    skewed = (lenient_double(F.col("x_skew")) != 0) | (lenient_double(F.col("y_skew")) != 0)
    return catalog_join(catalog, results).where((F.col("chart_code") == "APD") & skewed)


def random_chart(catalog: DataFrame, seed: int) -> DataFrame:
    """One chart drawn at random: a top-1 by a seeded hash, which needs no full sort."""
    return catalog.orderBy(F.xxhash64("pdf_name", F.lit(seed))).limit(1)
