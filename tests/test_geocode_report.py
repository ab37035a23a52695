import datetime
import json
import os
import random
import threading

from pyspark.sql import functions as F

from lotusgrid.operators import geocode
from lotusgrid.sources import report


def test_crossings_and_markers(spark):
    segs = spark.createDataFrame([("Đường  A", 0.0, 0.0, 1000.0, 0.0), ("đường b", 500.0, -300.0, 500.0, 300.0), ("đường c", 0.0, 50.0, 1000.0, 50.0), (None, 0.0, 0.0, 1.0, 1.0)], "name string, ax double, ay double, bx double, by double")
    req = spark.createDataFrame([(1, "ĐƯỜNG A", "Đường B"), (2, "đường a", "đường c"), (3, "x", None)], "request int, street_a string, street_b string")
    assert [tuple(r) for r in geocode.crossings(req, segs).collect()] == [(1, 500.0, 0.0)]
    road = spark.createDataFrame([("q", 1, 0.0, 0.0, 300.0, 400.0), ("q", 2, 300.0, 400.0, 300.0, 1400.0), ("q", 3, 300.0, 1400.0, 300.0, 1400.0)], "road string, seq int, ax double, ay double, bx double, by double")
    marks = spark.createDataFrame([(1, "q", 250.0), (2, "q", 500.0), (3, "q", 1500.0), (4, "q", 1501.0), (5, "z", 1.0)], "request int, road string, metres double")
    assert {tuple(r) for r in geocode.at_marker(marks, road).collect()} == {(1, 150.0, 200.0), (2, 300.0, 400.0), (3, 300.0, 1400.0)}
    inc = spark.createDataFrame([(1, 300.0), (2, 301.0), (3, None)], "id int, geo_confidence double")
    assert [r.id for r in geocode.precise(inc).collect()] == [1]


SEGMENTS, REQUESTS = "name string, ax double, ay double, bx double, by double", "request int, street_a string, street_b string"


def test_crossings_of_requests_that_share_a_number(spark):
    segs = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0), ("b", 0.0, 5.0, 10.0, 5.0), ("c", 0.0, 9.0, 10.0, 9.0), ("d", 5.0, -1.0, 5.0, 1.0)], SEGMENTS)
    req = spark.createDataFrame([(1, "a", "b"), (1, "c", "d"), (2, "a", "d"), (2, "b", "c"), (None, "d", "a")], REQUESTS)
    assert {tuple(r) for r in geocode.crossings(req, segs).collect()} == {(2, 5.0, 0.0), (None, 5.0, 0.0)}


def test_crossings_against_all_pairs(spark):
    g = random.Random(3)
    rows = [(n, x, y, x + g.uniform(-90, 90), y + g.uniform(-90, 90)) for n in "abc" for x, y in ((g.uniform(0, 400), g.uniform(0, 300)) for _ in range(60))]
    rows += [("far", 1000.0 + i, 0.0, 1000.0 + i, 90.0) for i in range(40)] + [("far", 1030.0, 100.0, 1040.0, 110.0), ("bar", 1029.0, 110.0, 1041.0, 100.0)]

    def at(s, t):
        (_, ax, ay, bx, by), (_, cx, cy, dx, dy) = s, t
        den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        p, q = (((cx - ax) * v - (cy - ay) * u) / den if den else -1 for u, v in ((dx - cx, dy - cy), (bx - ax, by - ay)))
        return (ax + p * (bx - ax), ay + p * (by - ay)) if 0 <= p <= 1 and 0 <= q <= 1 else None

    asked = [(1, "a", "b"), (2, "b", "a"), (3, "c", "b"), (4, "a", "far"), (5, "far", "bar"), (6, "a", "a"), (7, "a", "c"), (7, "far", "bar"), (7, "B ", "a"), (7, "c", "b")]
    places = [(k, x) for k, a, b in asked for s in rows for t in rows if (s[0], t[0]) == (a.strip().lower(), b) and (x := at(s, t))]
    want = {k: min(x for j, x in places if j == k) for k, _ in places}
    assert set(want) == {1, 2, 3, 5, 6, 7} and want[7] not in (want[5], max(x for j, x in places if j == 7))
    for step in (40.0, 500.0):
        got = geocode.crossings(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(rows, SEGMENTS), step).collect()
        assert {r.request: (r.x, r.y) for r in got} == want


def test_crossings_are_worked_out_once_for_two_streets(spark):
    """20,000 requests of two streets with 1,000 segments each in one tile: 20 billion pairs of segments if done for each request."""
    i = F.col("id")
    segs = spark.range(1000).select(F.lit("a").alias("name"), F.lit(0.0).alias("ax"), (i / 10).alias("ay"), F.lit(100.0).alias("bx"), (i / 10).alias("by"))
    segs = segs.union(spark.range(1000).select(F.lit("b"), 50 + i / 100, F.lit(0.0), 50 + i / 100, F.lit(100.0)))
    req = spark.range(20000).select(i.alias("request"), F.lit("a").alias("street_a"), F.lit("b").alias("street_b"))
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = geocode.crossings(req, segs).groupBy("x", "y").count().collect()
    finally:
        stop.cancel()
    assert [tuple(r) for r in got] == [(50.0, 0.0, 20000)]


def test_report(spark, tmp_path):
    cols = "parsed_ok boolean, has_exact_time boolean, has_vague_time boolean, location_level string, n_vehicle_types int, has_casualty boolean, casualty_numeric boolean, has_weather boolean, filter_keep boolean, filter_needs_review boolean"
    rows = [(True, True, True, "precise", 2, True, False, False, True, False)] * 3 + [(True, False, True, "street", 0, False, False, True, False, True), (False, True, True, "coarse", 1, True, True, True, True, True)]
    m = report.metrics(spark.createDataFrame(rows, cols)).first().asDict()
    assert m == {"total": 5, "parsed": 4, "exact_time": 3, "vague_only": 1, "precise": 3, "street": 1, "coarse": 0, "vehicle": 3, "casualty": 3, "casualty_number": 0, "weather": 1, "kept": 3, "review": 1}
    assert report.verdicts(m) == {"parsed": "CAN XEM LAI", "kept": "OK", "exact_time": "OK", "precise": "OK", "vehicle": "CAN XEM LAI"}
    assert report.needed_articles(m) == 3733
    text = report.markdown(m, [("b", 1), ("a", 1), ("c", 3)])
    assert text.index("| c | 3 |") < text.index("| a | 1 |") < text.index("| b | 1 |") and "| kept | 3 | 75% | OK |" in text
    none = report.metrics(spark.createDataFrame([], cols)).first().asDict()
    assert set(report.verdicts(none).values()) == {None} and "n/a" in report.markdown(none, [])
    df = spark.createDataFrame([(1, "xin, chào"), (2, None)], "id int, t string")
    report.write_csv(df, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_bytes() == "﻿id,t\r\n1,\"xin, chào\"\r\n2,\r\n".encode()
    report.write_json(df.limit(1), str(tmp_path / "q" / "x.json"))
    assert json.loads((tmp_path / "q" / "x.json").read_text()) == {"id": 1, "t": "xin, chào"}
    pages = spark.createDataFrame([("a.example", "k", "<p>")], "domain string, sha1 string, html string")
    report.write_pages(pages, str(tmp_path / "raw"))
    report.write_pages(pages.unionByName(pages.withColumn("sha1", F.lit("l"))), str(tmp_path / "raw"))
    assert sorted(r.sha1 for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == ["k", "l"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    for _ in range(2):
        report.write_table(df, str(tmp_path / "t"))
        report.write_parsed(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and any(".zstd." in f for f in os.listdir(tmp_path / "t"))
    lines = sorted(x for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"id": 1, "t": "a"}, {"id": 2, "t": None}]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    now = spark.range(1).select(report.utc_now().alias("t")).first().t
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert abs((datetime.datetime.now(datetime.UTC) - datetime.datetime.fromisoformat(now)).total_seconds()) < 120
    flags = spark.createDataFrame([("x" * 199,), ("x" * 200,), (None,)], "t string").select(report.parsed_ok(F.col("t")).alias("p")).collect()
    assert [r.p for r in flags] == [False, True, False]
