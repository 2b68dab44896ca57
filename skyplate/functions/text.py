"""Functions over names, paths and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def procedure_file_name(c: Column) -> Column:
    """White space and / \\ . ( ) become dashes."""
    return F.regexp_replace(c, r"[\s/\\.()]", "-")


def diagram_file_name(c: Column) -> Column:
    """White space and | / \\ . become dashes."""
    return F.regexp_replace(c, r"[\s\x7C/\\.]", "-")


def output_name(state: Column, airport: Column, pdf: Column, chart: Column) -> Column:
    return F.concat_ws("-", state, airport, pdf, chart)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def base_name(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(path, r"^(?:.*/)?([^/]*?)(?:\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    """The last extension with its dot, or nothing."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def pdf_base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?i)(\w+)\.PDF", 1)


def degrees_to_dash(c: Column) -> Column:
    """The octal escape of the degree sign becomes a dash."""
    return F.replace(c, F.lit("\\260"), F.lit("-"))


def field(c: Column, n: int) -> Column:
    """The n-th line, from 0."""
    return F.get(F.split(c, "\n"), F.lit(n))


def is_vhf(c: Column) -> Column:
    """A frequency of the form 1[1-3]d.d between 118 and 137."""
    shaped = F.regexp_extract(c, r"^(1[1-3]\d\.\d+)$", 1)
    value = shaped.try_cast("double")
    return F.coalesce((shaped != "") & (value >= 118) & (value < 137), F.lit(False))


def gcp_option(px: Column, py: Column, lon: Column, lat: Column) -> Column:
    return F.concat_ws(" ", F.lit("-gcp"), *(x.cast("string") for x in (px, py, lon, lat)))


def parse_typed_point(c: Column) -> Column:
    """(lon, lat) of typed 'dd-mm.mE,dd-mm.mN', or of '.lon,lat' in decimals; null where neither form fits."""
    typed = r"^\s*(\d+)-(\d+(?:\.\d+)?)\s*([EWew])\s*,\s*(\d+)-(\d+(?:\.\d+)?)\s*([NSns])"
    plain = r"^\s*\.\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"

    def part(n: int) -> Column:
        return F.regexp_extract(c, typed, n).try_cast("double")

    sign = lambda n, minus: F.when(F.upper(F.regexp_extract(c, typed, n)) == minus, -1.0).otherwise(1.0)
    lon, lat = (part(1) + part(2) / 60) * sign(3, "W"), (part(4) + part(5) / 60) * sign(6, "S")
    return F.struct(F.coalesce(lon, F.regexp_extract(c, plain, 1).try_cast("double")).alias("lon"), F.coalesce(lat, F.regexp_extract(c, plain, 2).try_cast("double")).alias("lat"))
