"""Nearest partners against the operators that make a row of each pair."""

import random

import pytest

from skyplate.operators import match, nearest


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_nearest_and_mutual_equal_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rnd = random.Random(6)
    places = [(rnd.choice(["p", "q", "r", "only" + "ab"[i % 2]]), i, rnd.randrange(-20, 20) * 5.0, rnd.randrange(-20, 20) * 5.0) for i in range(300)]
    places += [("p", 400, None, 5.0), ("p", 401, 3.0, float("nan"))]
    both = spark.createDataFrame(places, "page string, id int, x double, y double")
    left = both.where("id % 2 = 0").selectExpr("page", "id as a", "x", "y", "concat('t', id) as t")
    right = both.where("id % 2 = 1").selectExpr("page", "id as b", "x as u", "y as v")
    pairs = match.within(left, right, ["page"], 31.0, ("x", "y"), ("u", "v"))
    for mutual, want in ((False, match.nearest(pairs, ["page"], "a", "b")), (True, match.mutual_nearest(pairs, ["page"], "a", "b"))):
        got = nearest.nearest_within(left, right, ["page"], "a", "b", 31.0, ("x", "y"), ("u", "v"), mutual)
        assert {tuple(r) for r in got.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_nearest_line_and_crossings_make_no_row_of_a_pair_of_an_undealt_chart(spark, capsys):
    boxes = spark.createDataFrame([("p", 1, 0.0, 0.0)], "page string, box int, bx double, by_ double")
    lines = spark.createDataFrame([("p", 1, 0.0, 5.0, 0.0, 90.0, 90), ("p", 2, 0.0, 5.0, 0.0, 80.0, 90)], "page string, line int, x1 double, y1 double, x2 double, y2 double, slope int")
    found = match.nearest_line(boxes, lines, ["page"], "box", "line", True)
    assert [(r.line, r.dist) for r in found.collect()] == [(2, 5.0)]
    found.explain()
    assert "Join" not in capsys.readouterr().out
    rows = [("p", float(i), 0.0, float(i), 9.0, 400.0, 600.0) for i in range(50)]
    a = spark.createDataFrame(rows, "page string, ax1 double, ay1 double, ax2 double, ay2 double, width double, height double")
    b = spark.createDataFrame([("p", 0.0, float(i), 9.0, float(i)) for i in range(50)], "page string, bx1 double, by1 double, bx2 double, by2 double")
    crossings = match.cross_lines(a, b, ["page"])
    assert crossings.count() == 2500
    assert crossings.rdd.glom().map(len).max() < 1500


def test_a_repeated_key_takes_its_westernmost_place_of_those_equally_near(spark):
    right = spark.createDataFrame([("p", 1, 0.0, 0.0)], "page string, b int, u double, v double")
    for rows in ([("p", 7, 3.0, 4.0), ("p", 7, -3.0, 4.0), ("p", 7, 4.0, -3.0)], [("p", 7, -3.0, 4.0), ("p", 7, 4.0, -3.0), ("p", 7, 3.0, 4.0)]):
        left = spark.createDataFrame(rows, "page string, a int, x double, y double")
        for mutual in (False, True):
            got = nearest.nearest_within(left, right, ["page"], "a", "b", 9.0, ("x", "y"), ("u", "v"), mutual).collect()
            assert [(r.x, r.y, r.b) for r in got] == [(-3.0, 4.0, 1)]
