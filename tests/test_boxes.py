"""Joins of airports with the features in a box around them."""

import math
import random

from pyspark.sql import functions as F

from skyplate.operators import match
from skyplate.plans import georeference


def places(spark, n=80, spread=6.0):
    rnd = random.Random(9)
    at = [(i, rnd.choice([-60.0, 0.0, 44.0, 88.5]) + rnd.uniform(-spread, spread) / 4, rnd.uniform(-spread, spread)) for i in range(2 * n)]
    return at[:n], at[n:], spark.createDataFrame(at[:n], "apt int, lat double, lon double"), spark.createDataFrame(at[n:], "feat int, f_lat double, f_lon double")


def inside(a, f, nm):
    r = nm / 60
    wide = r / math.cos(math.radians(a[1]))
    return a[1] - r <= f[1] <= a[1] + r and a[2] - wide <= f[2] <= a[2] + wide


def test_boxes_equal_the_naive_ones_up_to_the_poles(spark):
    ours, theirs, airports, features = places(spark)
    got = sorted((r.apt, r.feat) for r in match.in_box(airports, features, 50.0).collect())
    assert got == sorted((a[0], f[0]) for a in ours for f in theirs if inside(a, f, 50.0))
    assert got


def test_boxes_are_dealt_over_tasks_by_cells(spark):
    _, _, airports, features = places(spark, 400)
    pairs = match.in_box(airports.coalesce(1), features.coalesce(1), 50.0)
    counts = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 4 and max(counts) < sum(counts) / 2


def test_nearest_in_box_of_equally_near_ones_is_the_westernmost(spark):
    airports = spark.createDataFrame([(1, 40.0, -100.0), (2, 40.0, -90.0)], "apt int, lat double, lon double")
    features = spark.createDataFrame([(5, 7, 40.0, -99.5), (9, 7, 40.0, -100.5), (4, 7, 40.0, -100.5), (3, 8, 40.0, -99.0), (2, 8, 40.0, -98.0), (6, 7, 80.0, -90.0), (8, None, 40.0, -90.0)], "feat int, h int, f_lat double, f_lon double")
    got = {tuple(r) for r in match.nearest_in_box(airports, features.where("h is not null"), 150.0, "apt", "feat", "h").collect()}
    assert got == {(1, 7, 9), (1, 8, 3)}


def test_obstacles_by_group_equal_those_by_chart_and_make_no_list_of_charts(spark):
    rnd = random.Random(3)
    airports = spark.createDataFrame([(i, 40 + rnd.uniform(-1, 1), -100 + rnd.uniform(-1, 1), i % 3) for i in range(40)], "pdf_name int, lat double, lon double, r int")
    db = spark.createDataFrame([(i, 201 + rnd.randrange(30), 40 + rnd.uniform(-1, 1), -100 + rnd.uniform(-1, 1)) for i in range(200)], "feat int, height int, f_lat double, f_lon double").withColumn("agl", F.col("height"))
    shown = db.select((F.col("feat") % 3).alias("r"), "height").distinct()
    own = airports.select("pdf_name", "r").join(shown, "r").drop("r")
    for nearest in (False, True):
        a = {(r.pdf_name, r.height, r.feat) for r in georeference.obstacles(airports, db, shown, "r", nearest_if_many=nearest).collect()}
        b = {(r.pdf_name, r.height, r.feat) for r in georeference.obstacles(airports, db, own, nearest_if_many=nearest).collect()}
        assert a == b and a
