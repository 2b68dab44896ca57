import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyplate.functions import affine
from skyplate.operators import aggregate, detect, match, relational
from skyplate.plans import diagram, rollover, worklists
from skyplate.sources import catalog, charts
from skyplate.streaming.cycles import follow_cycles


def loop_trim(values):
    """One forward pass that removes outliers while it walks, so that the element after a removed one is skipped."""
    n = len(values)
    s = sorted(values)
    mid = (s[(n - 1) // 2] + s[n // 2]) / 2
    mean = sum(values) / n
    dev = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5 if n > 1 else 0.0
    out, i = list(values), 0
    while i < len(out):
        if out[i] < mid - dev or out[i] > mid + dev:
            del out[i]
        i += 1
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-50, 50), min_size=1, max_size=30), min_size=1, max_size=20))
def test_trim_equals_the_loop(spark, groups):
    rows = [(g, i, float(v)) for g, vs in enumerate(groups) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, ord int, x double")
    got = {g: [] for g in range(len(groups))}
    for r in aggregate.trimmed(df, ["g"], "ord", "x").orderBy("g", "ord").collect():
        got[r.g].append(r.x)
    assert got == {g: loop_trim([float(v) for v in vs]) for g, vs in enumerate(groups)}


def test_grid_join_equals_the_naive_one(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.choice("ab"), rnd.uniform(-300, 300), rnd.uniform(-300, 300)) for i in range(300)]
    left = spark.createDataFrame(pts[:150], "a int, page string, x double, y double")
    right = spark.createDataFrame(pts[150:], "b int, page string, u double, v double")
    got = {(r.a, r.b) for r in match.within(left, right, ["page"], 40.0, ("x", "y"), ("u", "v")).collect()}
    want = {(p[0], q[0]) for p in pts[:150] for q in pts[150:] if p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 1600}
    assert got == want


def test_mutual_match_is_symmetric(spark):
    rnd = random.Random(5)
    a = spark.createDataFrame([(i, "p", rnd.uniform(0, 200), rnd.uniform(0, 200)) for i in range(40)], "a int, page string, x double, y double")
    b = spark.createDataFrame([(i, "p", rnd.uniform(0, 200), rnd.uniform(0, 200)) for i in range(40)], "b int, page string, u double, v double")
    pairs = match.within(a, b, ["page"], 60.0, ("x", "y"), ("u", "v"))
    one = {(r.a, r.b) for r in match.mutual_nearest(pairs, ["page"], "a", "b").collect()}
    other = {(r.a, r.b) for r in match.mutual_nearest(pairs, ["page"], "b", "a").collect()}
    assert one == other
    assert one


def test_ties_take_the_last_key_in_string_order(spark):
    pairs = spark.createDataFrame([("p", 1, 9, 5.0), ("p", 1, 10, 5.0)], "page string, a int, b int, dist double")
    assert match.nearest(pairs, ["page"], "a", "b").first().b == 9


def test_no_nested_loop_in_range_joins(spark, capsys):
    a = spark.range(10).select(F.col("id").alias("apt"), (F.col("id") + 30.0).alias("lat"), (F.col("id") - 90.0).alias("lon"))
    b = spark.range(10).select(F.col("id").alias("f"), (F.col("id") + 30.0).alias("f_lat"), (F.col("id") - 90.0).alias("f_lon"))
    match.in_box(a, b, 50.0).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_overlay_and_merge(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4), ("z", 4)], "k string, v int")
    assert {tuple(r) for r in relational.overlay(a, b.distinct(), ["k"]).collect()} == {("x", 1), ("y", 3), ("z", 4)}
    assert sorted(tuple(r) for r in relational.merge_columns(a, b, "k", ["v"]).collect()) == [("x", 1), ("y", 3)]


def test_fan_out_and_wrong_header(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2)], "pdf_name string, n int")
    b = spark.createDataFrame([("p", "s"), ("p", "t")], "pdf_name string, status string")
    assert relational.catalog_join(a, b).count() == 4
    with pytest.raises(Exception, match="not 2402"):
        relational.assert_equal(spark.createDataFrame([("2401",)], "cycle string"), "cycle", "2402").collect()


def test_squiggle_circle_and_fix_detectors(spark):
    squiggle = "q 1 0 0 1 {} {} cm\n0 0 m\n" + "1.5 2 l\n" * 6 + "S\nQ\n"
    circle = "q 1 0 0 1 100 200 cm\n0 0 m\n" + "1 2 3 4 5 6 c\n" * 8 + "-62 0 1 2 3 4 c\n" + "1 2 3 4 5 6 c\n" * 7 + "S\nQ\n"
    fix = "q 1 0 0 1 10 20 cm\n0 0 m\n3 9 l\n6 5 l\n0 0 l\nS\nQ\n"
    df = spark.createDataFrame([("p", squiggle.format(7, 8) + squiggle.format(9, 9)), ("c", circle), ("f", fix)], "pdf_name string, content string")
    found = {d.kind: detect.hits(df, ["pdf_name"], "content", d).collect() for d in (detect.NOT_TO_SCALE, detect.CIRCLE, detect.FIX)}
    assert [(r.pdf_name, r.center_x) for r in found["not-to-scale"]] == [("p", 7.0)]
    assert [(r.center_x, r.radius) for r in found["circle"]] == [(69.0, 31.0)]
    assert [(r.center_x, r.center_y) for r in found["fix"]] == [(11.5, 22.5)]
    for d in detect.ICONS + detect.GRATICULE:
        detect.hits(df, ["pdf_name"], "content", d).collect()


def test_coordinate_words(spark):
    rows = [("p", 1, "82", 0.0, 5.0), ("p", 2, "33.0’W", 6.0, 20.0), ("p", 3, "40", 30.0, 35.0), ("p", 4, "23’", 36.0, 40.0), ("p", 5, "N", 41.0, 44.0)]
    df = spark.createDataFrame([(p, n, t, a, 10.0, b, 18.0, 792.0) for p, n, t, a, b in rows], "pdf_name string, line_no int, text string, x_min double, y_min double, x_max double, y_max double, page_height double")
    got = sorted((r.axis, round(r.value, 4)) for r in detect.coordinate_boxes(df, ["pdf_name"]).collect())
    assert got == [("lat", 40.3833), ("lon", -82.55)]
    up = [("p", n, axis, x, y) for n, (axis, x, y) in enumerate([("lat", 5.0, 10.0), ("lon", 90.0, 700.0), ("lat", 5.01, 60.0), ("lon", 140.0, 700.02)])]
    across = [("q", n, axis, y, x) for _, n, axis, x, y in up]
    labels = spark.createDataFrame(up + across, "pdf_name string, line_no int, axis string, center_x double, center_y double")
    assert dict(map(tuple, detect.orientation(labels, ["pdf_name"]).collect())) == {"p": True, "q": False}


def test_numbers_too_long_for_a_height(spark):
    df = spark.createDataFrame([("p", 1, "123456789012", 0.0, 10.0, 40.0, 18.0, 792.0), ("p", 2, "1234", 0.0, 30.0, 20.0, 38.0, 792.0)], "pdf_name string, line_no int, text string, x_min double, y_min double, x_max double, y_max double, page_height double")
    got = {r.text: (r.center_x, r.center_y, r.width, r.height) for r in detect.obstacle_boxes(df, ["pdf_name"]).collect()}
    assert got["1234"] == (9.5, 759.0, 19.0, 10.0) and len(got) == 2
    assert [r.text for r in detect.obstacle_heights(df, ["pdf_name"]).collect()] == ["1234"]


def test_degrees_of_an_airport_are_rounded_down_with_their_sign(spark):
    rows = [("lon", -71.0, -71.4), ("lon", -70.0, -71.4), ("lon", 71.0, -71.4), ("lat", 41.5, 42.9), ("lat", 40.5, 42.9)]
    df = spark.createDataFrame([(a, v, 42.9, h) for a, v, h in rows], "axis string, value double, lat double, lon double")
    assert sorted((r.axis, r.value) for r in detect.near_airport(df, "lat", "lon").collect()) == [("lat", 41.5), ("lon", -71.0)]


def test_streams_from_files(spark, tmp_path):
    for name, n, text in (("A", 2, "BT\nET"), ("A", 1, "q\nQ"), ("B", 10, "S")):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{n}.txt").write_text(text)
    streams = charts.read_streams(spark, f"{tmp_path}/*")
    assert sorted(map(tuple, streams.collect())) == [("A", 1, "q\nQ"), ("A", 2, "BT\nET"), ("B", 10, "S")]
    assert {r.pdf_name: r.content for r in charts.whole_stream(streams).collect()} == {"A": "q\nQ\nBT\nET", "B": "S"}


def test_tables_over_jdbc_and_by_name(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.createDataFrame([(i, f"F{i}") for i in range(20)], "id int, name string")
    rows.write.format("jdbc").option("url", url).option("dbtable", "fixes").option("driver", driver).option("createTableColumnTypes", "name varchar(20)").save()
    got = catalog.read_table(spark, url, "fixes", ("id", 0, 20, 4), driver=driver)
    assert got.rdd.getNumPartitions() == 4
    catalog.attach(spark, {"db_fixes": got, "charts": spark.createDataFrame([("F3",)], "name string")})
    assert [tuple(r) for r in spark.sql("select id, charts.name from charts join db_fixes on charts.name = db_fixes.name").collect()] == [(3, "F3")]


def test_snapshot_of_points(spark, tmp_path):
    schema = "pdf_name string, gcp_key string, pngx double, pngy double, pdfx double, pdfy double, lon double, lat double"
    points = spark.createDataFrame([("p", "fix-A-1", 1.0, 2.0, 3.0, 4.0, -71.0, 42.0)], schema)
    charts.save_points(points, f"{tmp_path}/gcp")
    assert [tuple(r) for r in charts.load_points(spark, f"{tmp_path}/gcp").collect()] == [tuple(r) for r in points.collect()]


def test_squares_of_a_true_map_are_square(spark):
    lat = 42.0
    k = 1 / math.cos(math.radians(lat))
    rows = spark.createDataFrame([(-71.0, lat)], "lon double, lat double").withColumn("a", affine.affine(0.001 * k, 0, 0, -0.001, -71.2, 42.2))
    r = diagram.squareness(rows, "a", 0.25).first()
    assert r.top == pytest.approx(r.left) and r.angle == pytest.approx(90)


def test_a_random_chart_depends_on_the_seed(spark):
    cat = spark.createDataFrame([(f"P{i}",) for i in range(50)], "pdf_name string")
    drawn = {worklists.random_chart(cat, seed).first().pdf_name for seed in range(12)}
    assert len(drawn) > 4 and worklists.random_chart(cat, 3).first() == worklists.random_chart(cat, 3).first()


def test_stale_files(spark):
    df = spark.sql("select date_sub(current_date(), 40) as old, date_sub(current_date(), 3) as new")
    assert tuple(df.select(rollover.is_stale("old"), rollover.is_stale("new")).first()) == (True, False)


def test_text_groups(spark):
    body = "BT\n1 0 0 1 10 20 Tm\n(42) Tj\n1 0 0 1 12 20 Tm\n(\\26030) Tj\nET\nBT\n(none) Tj\nET"
    got = detect.text_groups(spark.createDataFrame([("p", body)], "pdf_name string, content string"), ["pdf_name"], "content").collect()
    assert [(r.text, r.x_min, r.x_max) for r in got] == [("42-30", 10.0, 12.0)]


def test_vrt_round_trip(spark):
    t = charts.geotransform(*(F.lit(v) for v in (-71.5, 43.0, -70.8, 42.0)), F.lit(1613), F.lit(2475))
    r = spark.range(1).select(charts.parse_vrt(charts.vrt(F.lit(1613), F.lit(2475), t, F.lit("x.png"))).alias("v")).first().v
    assert (r.width, r.height, r.source) == (1613, 2475, "x.png")
    assert list(r.transform) == pytest.approx([-71.5, 0.7 / 1613, 0, 43.0, 0, -1 / 2475])


def test_catalog_xml_file(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text('<digital_tpp cycle="2401"><state_code ID="MA"><city_name ID="B" volume="NE-1"><airport_name ID="L" apt_ident="BOS" military="N"><record><chartseq>1</chartseq><chart_code>IAP</chart_code><chart_name>ILS</chart_name><useraction>A</useraction><pdf_name>X.PDF</pdf_name><faanfd18> a b </faanfd18></record><record><chart_code>APD</chart_code><pdf_name>DELETED_JOB.PDF</pdf_name></record></airport_name></city_name></state_code></digital_tpp>')
    df = catalog.read_catalog(spark, str(path))
    assert [(r.state_id, r.tpp_volume, r.faa_code, r.pdf_name, r.faanfd18_code) for r in df.orderBy("pdf_name").collect()] == [("MA", "NE-1", "BOS", "DELETED_JOB.PDF", None), ("MA", "NE-1", "BOS", "X.PDF", "ab")]
    assert [r.path for r in catalog.download_list(df).collect()] == ["BOS/X.PDF"]


def test_rollover_order_and_stream(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0, 0.3, "MANUALGOOD"), ("b", 2.0, 0.3, "AUTOBAD")], "pdf_name string, x_median double, y_median double, status string")
    cat = spark.createDataFrame([("a", "IAP", "C"), ("b", "APD", ""), ("c", "IAP", "A"), ("d", "MIN", "A")], "pdf_name string, chart_code string, user_action string")
    blank = cat.select("pdf_name", *(F.lit(None).cast(t).alias(c) for c, t in (("x_median", "double"), ("y_median", "double"), ("status", "string"))))
    want = {("a", 1.0, -0.3, "ADDEDCHANGED"), ("b", 2.0, -0.3, "AUTOBAD"), ("c", None, None, "ADDEDCHANGED"), ("d", None, None, None)}
    columns = ["x_median", "y_median", "status"]
    assert {tuple(r) for r in rollover.rollover(blank, old, cat, columns).collect()} == want
    cat.write.parquet(str(tmp_path / "in"))
    stored = {}
    stream = spark.readStream.schema(cat.schema).parquet(str(tmp_path / "in"))
    run = follow_cycles(stream, lambda: old, lambda df, n: stored.update({n: {tuple(r) for r in df.collect()}}), columns)
    run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert set().union(*stored.values()) == want


def test_one_cycle(spark):
    from skyplate.plans.cycle import run_cycle

    cat = spark.createDataFrame([("a", "IAP", "C"), ("b", "APD", ""), ("c", "IAP", "A")], "pdf_name string, chart_code string, user_action string").withColumn("tpp_cycle", F.lit("2401"))
    old = spark.createDataFrame([("a", 1.0, "AUTOGOOD"), ("b", 2.0, "MANUALGOOD")], "pdf_name string, x double, status string")
    estimate = lambda work: work.select("pdf_name", F.lit(9.0).alias("x"), F.lit("AUTOGOOD").alias("status"))
    got = {tuple(r) for r in run_cycle(cat, "2401", old, ["x", "status"], estimate).collect()}
    assert got == {("a", 9.0, "AUTOGOOD"), ("b", 2.0, "MANUALGOOD"), ("c", 9.0, "AUTOGOOD")}


def test_tables_are_appended_and_replaced(spark):
    df = spark.range(3).withColumn("v", F.lit("x"))
    catalog.replace_table(df, "cycle_rows")
    catalog.append_rows(df, "cycle_rows")
    assert spark.table("cycle_rows").count() == 6
    catalog.replace_table(df, "cycle_rows")
    assert spark.table("cycle_rows").count() == 3
    spark.sql("DROP TABLE cycle_rows")


def test_windowed_counts(spark, tmp_path):
    from skyplate.streaming.cycles import status_counts

    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:59", "a"), ("2024-01-01 00:01:00", "b")]
    spark.createDataFrame(rows, "ts string, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, event_type string").parquet(str(tmp_path / "in"))
    out = status_counts(stream, "ts", "1 minute", "1 minute").writeStream.format("memory").queryName("windowed").outputMode("complete")
    out.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("windowed").collect()) == [("a", 2), ("b", 1)]
