"""One cycle from catalog to report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplate.operators.relational import assert_equal, not_yet

from .rollover import rollover


def run_cycle(catalog: DataFrame, cycle: str, old: DataFrame, columns: list[str], estimate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The new cycle's results: the catalog must be of that cycle; results are carried over, changes flagged, and charts
    without a result or with a changed one are estimated anew. estimate: pdf_name -> pdf_name and the columns."""
    charts = assert_equal(catalog, "tpp_cycle", cycle)
    blank = charts.select("pdf_name").distinct().select("pdf_name", *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns))
    rolled = rollover(blank, old, charts, columns)
    work = rolled.where(F.col("status").isNull() | (F.col("status") == "ADDEDCHANGED")).select("pdf_name")
    fresh = estimate(work).select("pdf_name", *columns)
    return not_yet(rolled, fresh, "pdf_name").unionByName(fresh)
