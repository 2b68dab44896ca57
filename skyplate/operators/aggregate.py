"""Aggregates: counts, uniqueness, ordered concatenation, cut-offs and robust location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(conditions: dict[str, Column]) -> list[Column]:
    """One count per condition, all in one pass."""
    return [F.count_if(c).alias(n) for n, c in conditions.items()]


def stdev(c: Column) -> Column:
    """Sample standard deviation; 0 for one value."""
    return F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def only_once(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Values that occur exactly once in their group."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def first_of_each(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Distinct values with the position they first have."""
    return df.groupBy(*by, value).agg(F.min(order).alias(order))


def single(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows that are alone in their group."""
    keys = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(keys, by, "left_semi")


def ordered_concat(df: DataFrame, by: list[str], order: str, text: str, glue: str = "") -> DataFrame:
    """Texts of each group joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda s: s["t"]), glue).alias("joined"))


def bounds(c: str) -> list[Column]:
    """Running extent with the start values 99999 and 0."""
    return [F.least(F.min(c), F.lit(99999.0)).alias(f"{c}_min"), F.greatest(F.max(c), F.lit(0.0)).alias(f"{c}_max")]


def cutoffs(df: DataFrame, by: list[str], y: str, length: str, page_width: str, page_height: str) -> DataFrame:
    """Highest horizontal line of half the page's width or more below mid-page, lowest of .3 or more above it; else 0 and the page's height."""
    below = (F.col(y) < F.col(page_height) / 2) & (F.abs(length) >= 0.5 * F.col(page_width))
    above = (F.col(y) > F.col(page_height) / 2) & (F.abs(length) >= 0.3 * F.col(page_width))
    return df.groupBy(*by).agg(F.coalesce(F.max(F.when(below, F.col(y))), F.lit(0.0)).alias("lower"), F.coalesce(F.min(F.when(above, F.col(y))), F.max(page_height)).alias("upper"))


def trimmed(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df without outliers beyond median ± sample deviation of their group, in one pass that skips the neighbour of each removed one.

    Within each run of consecutive outliers the 1st, 3rd, 5th ... go and the 2nd, 4th ... stay. Both window passes
    partition by the group alone, so they share one shuffle.
    """
    whole = Window.partitionBy(*by)
    ranked = Window.partitionBy(*by).orderBy(order)
    df = df.withColumns({"_mid": F.median(value).over(whole), "_dev": F.coalesce(F.stddev_samp(value).over(whole), F.lit(0.0))})
    df = df.withColumn("_out", (F.col(value) < F.col("_mid") - F.col("_dev")) | (F.col(value) > F.col("_mid") + F.col("_dev")))
    df = df.withColumn("_rn", F.row_number().over(ranked))
    # position within the run of outliers: rows since the last row inside the band
    df = df.withColumn("_last", F.coalesce(F.max(F.when(~F.col("_out"), F.col("_rn"))).over(ranked), F.lit(0)))
    return df.where(~F.col("_out") | ((F.col("_rn") - F.col("_last")) % 2 == 0)).drop("_mid", "_dev", "_out", "_rn", "_last")


def robust_location(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Mean, median and sample deviation after trimming."""
    kept = trimmed(df.select(*by, order, value), by, order, value)
    return kept.groupBy(*by).agg(F.avg(value).alias("avg"), F.median(value).alias("median"), stdev(F.col(value)).alias("stdev"), F.count(F.lit(1)).alias("n_kept"))
