"""Quality funnel: how many charts pass and fail at each step. All counts of a relation come from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplate.functions.casts import lenient_double, lenient_long
from skyplate.operators.aggregate import counts
from skyplate.operators.relational import catalog_join, like_any, not_deleted, outside


#: Texts that the counts read as numbers, each parsed once a row: column -> (text, cast).
NUMBERS = {
    "_gcps": ("gcp_count", lenient_double), "_text": ("pdftotext", lenient_double), "_target": ("target_ratio", lenient_double), "_ratio": ("ratio", lenient_double),
    "_x": ("x_scale", lenient_double), "_y": ("y_scale", lenient_double), "_xi": ("x_scale", lenient_long), "_yi": ("y_scale", lenient_long),
}


def conditions() -> tuple[dict[str, Column], dict[str, Column]]:
    """Conditions over catalog rows alone, and over rows of the catalog joined to the results."""
    diagram = (F.col("chart_code") == "APD") & not_deleted(F.col("pdf_name"))
    procedure = (F.col("chart_code") == "IAP") & not_deleted(F.col("pdf_name"))
    military, civil = F.col("military_use").ilike("M"), ~F.col("military_use").ilike("M")
    gcps, text, x, y = map(F.col, ("_gcps", "_text", "_x", "_y"))
    diff = F.col("_target") - F.col("_ratio")
    scaled = (x > 0) & (y > 0)
    unscaled = (F.col("_xi") < 1) | (F.col("_yi") < 1)
    visual, high = F.col("chart_name").ilike("%VISUAL%"), like_any(F.col("chart_name"), "%HI-%", "%TACAN%")
    joined = {"apd": diagram}
    for name, side in (("military", military), ("civil", civil)):
        joined |= {
            f"apd_{name}": diagram & side,
            f"apd_{name}_good": diagram & side & (gcps > 1) & diff.between(-0.12, 0.12),
            f"apd_{name}_no_text": diagram & side & (text < 5),
            f"apd_{name}_no_gcps": diagram & side & (gcps < 2),
        }
    with_text = procedure & civil & (text > 4)
    joined |= {
        "iap_civil": procedure & civil,
        "iap_civil_text": with_text,
        "iap_civil_good": with_text & (gcps > 1) & scaled & diff.between(-0.09, 0.09),
        "iap_civil_bad": with_text & (gcps > 1) & scaled & outside(diff, 0.09),
        "iap_civil_no_gcps": with_text & (gcps < 2),
        "iap_civil_no_gcps_visual": with_text & (gcps < 2) & visual,
        "iap_civil_no_gcps_high": with_text & (gcps < 2) & high,
        "iap_civil_no_final": with_text & (gcps > 1) & unscaled,
        "iap_civil_no_final_visual": with_text & (gcps > 1) & unscaled & visual,
        "iap_civil_no_final_high": with_text & (gcps > 1) & unscaled & high,
        "iap_military_good": procedure & military & (gcps > 1) & (x > 1) & (y > 1) & diff.between(-0.09, 0.09),
    }
    return {"iap": procedure, "iap_military": procedure & military}, joined


def funnel(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """One row with the 22 counts."""
    alone, joined = conditions()
    charts = catalog.where(F.col("chart_code").isin("IAP", "APD") & not_deleted(F.col("pdf_name")))  # what every count asks for
    left = charts.agg(*counts(alone))
    numbers = results.select("pdf_name", *(cast(F.col(text)).alias(n) for n, (text, cast) in NUMBERS.items()))
    right = catalog_join(charts, numbers).agg(*counts(joined))
    return left.crossJoin(right)  # one row each


def by_ratio(catalog: DataFrame, results: DataFrame, code: str, most: float, good: bool = True) -> DataFrame:
    """Charts by how far their ratio is off, within or beyond the tolerance, in order of the difference."""
    diff = lenient_double(F.col("target_ratio")) - lenient_double(F.col("ratio"))
    rows = catalog_join(catalog, results).where((F.col("chart_code") == code) & not_deleted(F.col("pdf_name"))).withColumn("difference", diff)
    rows = rows.where(F.col("difference").between(-most, most) if good else outside(F.col("difference"), most))
    return rows.orderBy(F.col("difference").asc(), "pdf_name")
