"""Expected ratio of longitude to latitude scale by airport latitude, and acceptance of charts by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the regressions, from the highest power down.
PROCEDURE = (0.000000000065, -0.000000010206, 0.000000614793, -0.000014000833, 0.000124430097, 0.003297052219, 0.618729977577)
PORTRAIT = (0.000000051883, -0.000001722090, 0.000085600681, 0.000722467637, 0.657580020775)
LANDSCAPE = (0.000911470377, -0.036596412556, 2.032481875410)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def procedure_status(ratio: Column, lat: Column) -> Column:
    """AUTOBAD if the ratio is more than .1 off."""
    return F.when(F.abs(ratio - polynomial(lat, PROCEDURE)) > 0.1, "AUTOBAD").otherwise("AUTOGOOD")


def diagram_status(ul_lon: Column, ul_lat: Column, lr_lon: Column, lr_lat: Column, ratio: Column, lat: Column, portrait: Column) -> Column:
    """AUTOBAD if the extent is too wide (> .2 degrees) or high (> .12), or the ratio is off by .1 (portrait) or .12 (landscape) or more."""
    wide = (ul_lon - lr_lon > 0.2) | (ul_lat - lr_lat > 0.12)
    near = F.when(portrait, F.abs(ratio - polynomial(lat, PORTRAIT)) < 0.1).otherwise(F.abs(ratio - polynomial(lat, LANDSCAPE)) < 0.12)
    return F.when(wide, "AUTOBAD").when(near, "AUTOGOOD").otherwise("AUTOBAD")
