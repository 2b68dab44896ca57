"""Statistics over all pairs against the operators that make a row of each sample."""

import random

import pytest
from pyspark.sql import functions as F

from skyplate.operators import all_pairs
from skyplate.operators.aggregate import robust_location
from skyplate.operators.pairwise import gcp_pairs, samples
from skyplate.plans import georeference

SCHEMA = "pdf_name string, key string, px double, py double, lon double, lat double, width double, height double, airport_lat double"


def points(spark, different=100):
    """Charts of 1 to 60 points, some off by so much that they are outliers, with null and prefixed keys, of which `different` differ, and null coordinates."""
    rnd = random.Random(7)
    rows = []
    for chart, n in (("one", 1), ("two", 2), ("few", 7), ("many", 60), ("rough", 45)):
        for k in range(n):
            px, py = rnd.uniform(0, 1613), rnd.uniform(0, 2475)
            noise = 0.2 if chart == "rough" or k % 9 == 0 else 0.002
            rows.append((chart, str(k % different), px, py, -71 + 0.0004 * px + rnd.gauss(0, noise), 43 - 0.0003 * py + rnd.gauss(0, noise), 1613.0, 2475.0, 42.5 if k % 2 else 61.0))
    rows += [("few", None, 5.0, 5.0, -71.0, 43.0, 1613.0, 2475.0, 42.5), ("many", "x", None, 900.0, -71.0, 43.0, 1613.0, 2475.0, 42.5), ("many", "y", 600.0, 70.0, -71.0, None, 1613.0, 2475.0, 42.5)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize(("unit", "block", "bins"), [(1 << 24, 1 << 15, 1 << 14), (200, 100, 3)])
def test_medians_and_totals_equal_those_of_all_samples(spark, monkeypatch, unit, block, bins):
    for name, value in (("UNIT", unit), ("BLOCK", block), ("BINS", bins)):
        monkeypatch.setattr(all_pairs, name, value)
    gcps = points(spark)
    each = samples(gcp_pairs(gcps, "pdf_name", "key"), "pdf_name", "key")
    want = {(r.pdf_name, r.series): r.median for r in robust_location(each, ["pdf_name", "series"], "ord", "value").collect()}
    got = {(r.pdf_name, r.series): r.median for r in all_pairs.medians(gcps, "pdf_name", "key").collect()}
    assert want.keys() == got.keys()
    assert got == pytest.approx(want, rel=1e-12)
    gcps = points(spark, 50)
    each = samples(gcp_pairs(gcps, "pdf_name", "key"), "pdf_name", "key")
    sums = {(r.pdf_name, r.series): (r.n, r.total) for r in each.groupBy("pdf_name", "series").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    own = {(r.pdf_name, r.series): (r.n, r.total) for r in all_pairs.totals(gcps, "pdf_name", "key").collect()}
    assert own.keys() == sums.keys()
    assert all(own[k] == pytest.approx(sums[k], rel=1e-9) for k in sums)


def test_estimate_makes_no_row_of_a_pair(spark, capsys):
    georeference.estimate(points(spark).withColumnRenamed("key", "gcp_key")).explain()
    plan = capsys.readouterr().out
    assert "px_i" not in plan and "Window" not in plan
