"""From one publication cycle to the next: carry results forward, flag what changed, find what is to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.operators.relational import merge_columns

TRANSFORM = ("x_median", "y_median", "upper_left_lon", "upper_left_lat", "x_skew", "y_skew")


def carry_forward(new: DataFrame, old: DataFrame, columns: list[str]) -> DataFrame:
    """New cycle's result rows with the old cycle's values where the chart existed. A true x scale makes the vertical pixel size negative."""
    if "y_median" in columns and "x_median" in columns:
        old = old.withColumn("y_median", F.when(F.col("x_median").isNotNull() & (F.col("x_median") != 0), -F.abs("y_median")).otherwise(F.col("y_median")))
    return merge_columns(new, old, "pdf_name", columns)


def flag_changed(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Status ADDEDCHANGED for procedures and diagrams that were added or changed."""
    changed = catalog.where(F.col("user_action").isin("A", "C") & F.col("chart_code").isin("IAP", "APD")).select("pdf_name").distinct()
    return merge_columns(results, changed.withColumn("status", F.lit("ADDEDCHANGED")), "pdf_name", ["status"])


def rollover(new: DataFrame, old: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Copy first, then flag."""
    return flag_changed(carry_forward(new, old, columns), catalog)


def write_statistics(results: DataFrame, statistics: DataFrame, columns: list[str]) -> DataFrame:
    return merge_columns(results, statistics, "pdf_name", columns)


def write_transform(results: DataFrame, transform: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keyed update of the six transform columns; procedures get no skew."""
    kind = catalog.groupBy("pdf_name").agg(F.max(F.col("chart_code").rlike("IAP")).alias("_iap"))
    rows = transform.join(kind, "pdf_name", "left")
    for c in ("x_skew", "y_skew"):
        rows = rows.withColumn(c, F.when(F.col("_iap"), F.lit(0.0)).otherwise(F.col(c)))
    return merge_columns(results, rows.drop("_iap"), "pdf_name", list(TRANSFORM))


def set_status(results: DataFrame, statuses: DataFrame) -> DataFrame:
    return merge_columns(results, statuses, "pdf_name", ["status"])


def action_tally(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("chart_code", "user_action").agg(F.count(F.lit(1)).alias("n"))


def action_counters(catalog: DataFrame) -> DataFrame:
    """Charts downloaded, deleted, changed and added among procedures and diagrams; an action can count for several."""
    a = F.coalesce(F.col("user_action"), F.lit(""))
    some = catalog.where(F.col("chart_code").isin("IAP", "APD"))
    return some.agg(F.count_if(~a.rlike("(?i)D")).alias("downloaded"), F.count_if(a.rlike("(?i)D")).alias("deleted"), F.count_if(a.rlike("(?i)C")).alias("changed"), F.count_if(a.rlike("(?i)A")).alias("added"))


def is_stale(modified: str, days: int = 28):
    """Is a reference file older than its cycle?"""
    return F.date_diff(F.current_date(), F.to_date(F.col(modified))) > days
