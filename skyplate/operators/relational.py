"""Filters, joins, ordering and keyed merges over the catalog and result relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def like_any(c: Column, *patterns: str) -> Column:
    """Case-insensitive LIKE against any of the patterns."""
    return reduce(lambda a, b: a | b, [c.ilike(p) for p in patterns])


def not_deleted(c: Column) -> Column:
    """NOT LIKE '%DELETED%' regardless of case; null stays out."""
    return ~c.ilike("%DELETED%")


def outside(c: Column, most: float) -> Column:
    """Beyond ±most; null is neither in nor out."""
    return (c < -most) | (c > most)


def catalog_join(catalog: DataFrame, results: DataFrame, key: str = "pdf_name") -> DataFrame:
    """Inner equi-join on a key that neither side holds unique: n x m rows per key. Result columns that the catalog has too get the prefix g_."""
    right = results.select(F.col(key).alias("_key"), *(F.col(c).alias(f"g_{c}" if c in catalog.columns else c) for c in results.columns if c != key))
    return catalog.join(right, catalog[key] == right["_key"]).drop("_key")


def catalog_join_once(catalog: DataFrame, results: DataFrame, key: str = "pdf_name") -> DataFrame:
    """The same with one result row per key, so that catalog rows don't multiply."""
    return catalog_join(catalog, results.dropDuplicates([key]), key)


def representative(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per group, the first by `order`, for selecting columns outside the grouping."""
    top = F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")
    return df.groupBy(*by).agg(top).select(*by, *(F.col(f"_r.{c}").alias(c) for c in columns))


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`, as when a map is assigned to row by row."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def overlay(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Union of two keyed sets in which rows of the second replace those of the first."""
    return last_wins(first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1))), key, ["_p"]).drop("_p")


def merge_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed update: columns of old take new's values where new has the key; other rows and columns stay.

    Where new repeats a key, its rows must agree; the largest is taken so that the update never multiplies rows.
    """
    fresh = new.groupBy(key).agg(F.max(F.struct(*columns)).alias("_n"))
    joined = old.join(fresh, key, "left")
    return joined.select(*(F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def not_yet(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work without an artefact yet."""
    return work.join(done.select(key), key, "left_anti")


def already(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key), key, "left_semi")


def contained(df: DataFrame, names: DataFrame, text: str, name: str, by: list[str]) -> DataFrame:
    """Rows whose text occurs anywhere in the space-joined sorted list of their chart's names. The lists are aggregates, joined by chart."""
    lists = names.groupBy(*by).agg(F.concat_ws(" ", F.array_sort(F.collect_set(name))).alias("_list"))
    return df.join(lists, by).where(F.col("_list").contains(F.col(text))).drop("_list")


def neighbours(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """position, previous and next key along a worklist; at its ends the row itself."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", F.row_number().over(w).cast("bigint").alias("position"), F.coalesce(F.lag(key).over(w), F.col(key)).alias("previous"), F.coalesce(F.lead(key).over(w), F.col(key)).alias("next"))


def assert_equal(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """The rows, or an error when executed if one has another value."""
    message = F.concat(F.lit(f"{column} is "), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(f", not {wanted}"))
    return df.where(F.coalesce(F.assert_true(F.coalesce(F.col(column) == wanted, F.lit(False)), message).cast("string"), F.lit("")) == "")


def land_runways(df: DataFrame, ident: str) -> DataFrame:
    """Runways on land: identifiers with H (helipads) or W (water) are left out; null stays out."""
    return df.where(~F.col(ident).rlike("(?i)[HW]"))


def usable_navaids(df: DataFrame, kind: str) -> DataFrame:
    """VORs of all kinds and NDBs, without test facilities."""
    return df.where(like_any(F.col(kind), "%VOR%", "%NDB%") & ~F.col(kind).rlike("VOT"))


def reporting_points(df: DataFrame, use: str) -> DataFrame:
    """Fixes whose use ends in REP-PT, regardless of case."""
    return df.where(F.col(use).ilike("%REP-PT"))
