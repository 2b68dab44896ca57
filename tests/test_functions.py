import math

import pytest
from pyspark.sql import functions as F

from skyplate.functions import affine, geo, ratio, text
from skyplate.functions.casts import int_mod, lenient_double, lenient_long, or_zero, true_number, true_text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("given", "wanted"), [("  -12.5e2abc", -1250.0), ("abc", 0.0), (None, None), ("", 0.0), ("12d", 12.0), (".5x", 0.5), ("+3.", 3.0)])
def test_lenient_double(spark, given, wanted):
    assert one(spark, lenient_double(F.lit(given).cast("string")))[0] == wanted


@pytest.mark.parametrize(("given", "wanted"), [("7.9", 7), ("-3x", -3), ("x", 0), (None, None)])
def test_lenient_long(spark, given, wanted):
    assert one(spark, lenient_long(F.lit(given).cast("string")))[0] == wanted


def test_truth(spark):
    r = one(spark, true_text(F.lit("0")), true_text(F.lit("0.0")), true_text(F.lit("")), true_number(F.lit(0.0)), true_number(F.lit(-1)), or_zero(F.lit(None).cast("double")))
    assert list(r) == [False, True, False, False, True, 0.0]


def test_int_mod_takes_the_divisors_sign(spark):
    assert one(spark, int_mod(F.lit(-45.5), 180))[0] == 135


def test_dms_and_fixed_width(spark):
    r = one(spark, geo.dms(F.lit("42-21-43.5N")), geo.dms(F.lit("91-00-00.0N")), geo.dms(F.lit("42-21-43.5")), geo.fixed_width(F.lit("W071002300")), geo.fixed_width(F.lit("X1"), 0.0))
    assert r[0] == pytest.approx(42 + 21 / 60 + 43.5 / 3600)
    assert r[1] is None
    assert r[2] is None
    assert r[3] == pytest.approx(-(71 + 23 / 3600))
    assert r[4] == 0.0


def test_dms_parts_takes_lower_case_only_if_asked(spark):
    args = [F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("s")]
    assert one(spark, geo.dms_parts(*args))[0] is None
    assert one(spark, geo.dms_parts(*args, any_case=True))[0] == -10.5


def test_mercator_round_trip(spark):
    r = one(spark, geo.mercator_lat(geo.mercator_y(F.lit(42.5))), geo.mercator_lon(geo.mercator_x(F.lit(-71.25))))
    assert r[0] == pytest.approx(42.5)
    assert r[1] == pytest.approx(-71.25)


def test_parallel_lines_have_no_intersection(spark):
    p = geo.intersection(*(F.lit(float(v)) for v in (0, 0, 1, 1, 0, 1, 1, 2)))
    assert one(spark, p["x"])[0] is None


def test_affine_identities(spark):
    a = affine.affine(2, 0.5, -1, 3, 10, -4)
    back = affine.compose(affine.invert(a), a)
    r = one(spark, back.alias("b"), affine.invert(affine.affine(1, 2, 2, 4, 0, 0)).alias("n"), affine.matrix_3x3(a).alias("m"))
    assert list(r.b) == pytest.approx([1, 0, 0, 1, 0, 0])
    assert r.n is None
    assert r.m[0] == [2.0, 0.5, 10.0]
    turned = affine.apply(affine.rotation(F.lit(90.0)), F.lit(1.0), F.lit(0.0))
    assert one(spark, turned["y"])[0] == pytest.approx(1.0)


def test_affine_fit_recovers_a_map(spark):
    pts = spark.createDataFrame([(x * 100.0, y * 90.0 + x) for x in range(4) for y in range(4)], "x double, y double")
    pts = pts.withColumns({"u": -71 + 0.0004 * F.col("x") + 0.00001 * F.col("y"), "v": 43 - 0.0003 * F.col("y")})
    used, fitted = affine.fit("x", "y", "u", "v")
    got = pts.agg(*used).select(fitted.alias("a")).first().a
    assert list(got) == pytest.approx([0.0004, 0.00001, 0, -0.0003, -71, 43], abs=1e-9)
    assert pts.limit(2).agg(*used).select(fitted.alias("a")).first().a is None


def test_ratio_of_known_latitude(spark):
    lat = 42.363
    wanted = sum(c * lat ** (6 - k) for k, c in enumerate(ratio.PROCEDURE))
    assert one(spark, ratio.polynomial(F.lit(lat), ratio.PROCEDURE))[0] == pytest.approx(wanted)
    assert one(spark, ratio.procedure_status(F.lit(wanted + 0.2), F.lit(lat)))[0] == "AUTOBAD"


def test_names(spark):
    p = F.lit("/a/b.c/00058IL4R.PDF")
    r = one(spark, text.base_name(p), text.extension(p), text.directory(p), text.pdf_base_name(p), text.degrees_to_dash(F.lit("42\\26021")), text.is_vhf(F.lit("118.3")), text.is_vhf(F.lit("137.0")), text.field(F.lit("a\nb"), 1))
    assert list(r) == ["00058IL4R", ".PDF", "/a/b.c/", "00058IL4R", "42-21", True, False, "b"]


def test_typed_points(spark):
    r = one(spark, text.parse_typed_point(F.lit("071-30.0W,42-15.0N")).alias("a"), text.parse_typed_point(F.lit(".-71.5,42.25")).alias("b"), text.parse_typed_point(F.lit("x")).alias("c"))
    assert (r.a.lon, r.a.lat) == pytest.approx((-71.5, 42.25))
    assert (r.b.lon, r.b.lat) == pytest.approx((-71.5, 42.25))
    assert r.c.lon is None


def test_great_circle_quarter(spark):
    d = one(spark, geo.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))[0]
    assert d == pytest.approx(geo.EARTH_NM * math.pi / 2)
