"""Lenient conversions of text to numbers, truth and integer modulo as scripts of loosely typed text use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REAL_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
INT_PREFIX = r"^\s*([+-]?\d+)"


def lenient_double(c: Column) -> Column:
    """The longest numeric prefix as a double, else 0; null stays null."""
    return F.when(c.isNotNull(), F.coalesce(F.regexp_extract(c, REAL_PREFIX, 1).try_cast("double"), F.lit(0.0)))


def lenient_long(c: Column) -> Column:
    """The longest integer prefix, else 0; null stays null."""
    return F.when(c.isNotNull(), F.coalesce(F.regexp_extract(c, INT_PREFIX, 1).try_cast("bigint"), F.lit(0).cast("bigint")))


def true_number(c: Column) -> Column:
    """A number that counts as true: neither null nor zero."""
    return c.isNotNull() & (c != 0)


def true_text(c: Column) -> Column:
    """A text that counts as true: neither null, empty nor '0'. '0.0' is true."""
    return c.isNotNull() & ~c.isin("", "0")


def or_zero(c: Column) -> Column:
    """Null in a numeric context is 0."""
    return F.coalesce(c, F.lit(0.0))


def int_mod(c: Column, n: int) -> Column:
    """Modulo of the truncated operand, with the divisor's sign."""
    return F.pmod(c.cast("bigint"), F.lit(n).cast("bigint"))
