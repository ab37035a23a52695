import gzip
import json

import pytest
from pyspark.sql import functions as F

from lotusgrid.sources import geojson, manifest, sitemap


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    rec = lambda u, t: json.dumps({"url": u, "fetched_at": t, "bytes": 3})
    p.write_text("\n".join([rec("a", "1"), "", "{broken", rec("a", "2"), json.dumps({"domain": "x"}), rec("b", "1"), "[]"]) + "\n")
    t = manifest.read_tolerant(spark, str(p))
    assert sorted((r.url, r.fetched_at) for r in t.collect()) == [("a", "1"), ("a", "2"), ("b", "1")]
    assert {(r.url, r.fetched_at) for r in manifest.last_wins(t, "url", ["fetched_at"]).collect()} == {("a", "2"), ("b", "1")}
    with pytest.raises(Exception, match="(?i)malformed|bad record"):
        manifest.read_strict(spark, str(p)).collect()
    c = spark.createDataFrame([("a",), ("c",), (None,)], "url string")
    assert {r.url for r in manifest.pending(c, t).collect()} == {"c", None}
    manifest.append(t.limit(1), str(tmp_path / "log"))
    manifest.append(t.limit(2), str(tmp_path / "log"))
    assert manifest.read_strict(spark, str(tmp_path / "log")).count() == 3


def test_pages(spark, tmp_path):
    (tmp_path / "k1.html").write_bytes("<p>xin chào</p>".encode() + b"\xff")
    log = spark.createDataFrame([("a", "raw/k1.html"), ("b", "raw/gone.html")], "url string, path string")
    got = {r.url: r.html for r in manifest.with_pages(log, manifest.pages(spark, str(tmp_path))).collect()}
    assert got["a"].startswith("<p>xin chào</p>") and got["b"] is None


URLSET = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.example/a?x=1&amp;y=2 </loc><lastmod>2020-01-01</lastmod></url><url><loc>https://s.example/b</loc></url></urlset>'


def index(children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


def test_sitemaps(spark):
    docs = [("root", index([f"c{i}" for i in range(8)])), ("small", index(["c5", "c6", "c7"])), ("c7", URLSET), ("c2", URLSET), ("c6", index(["d1"])), ("d1", index(["e1"])), ("e1", URLSET), ("bad", "not xml"), ("null", None)]
    df = spark.createDataFrame(docs, "url string, body string")
    e = sitemap.entries(df.where("url = 'c7'")).orderBy("pos").collect()
    assert [(r.loc, r.lastmod) for r in e] == [("https://s.example/a?x=1&y=2", "2020-01-01"), ("https://s.example/b", None)]
    assert [r.child for r in sitemap.children(df.where("url = 'root'")).collect()] == [f"c{i}" for i in range(3, 8)]
    assert [r.child for r in sitemap.children(df.where("url = 'small'")).collect()] == ["c5", "c6", "c7"]
    got = sitemap.crawl(df, spark.createDataFrame([("root",)], "url string"))
    assert got.select("source").distinct().collect()[0].source == "c7"  # c2 is not among the last five, e1 is one level too deep
    assert sitemap.crawl(df, spark.createDataFrame([("root",)], "url string"), depth=3).count() == 4


def test_robots(spark):
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /x\nAllow: /x/open\nSitemap: https://a.example/m.xml"), ("b.example", ""), ("c.example", "User-agent: other\nDisallow: /")], "domain string, body string")
    urls = [("a.example", "https://a.example/x/1"), ("a.example", "https://a.example/x/open/2"), ("a.example", "https://a.example/"), ("b.example", "https://b.example/x"), ("c.example", "https://c.example/x"), ("d.example", "https://d.example/x")]
    ok = {r.url for r in sitemap.allowed(spark.createDataFrame(urls, "domain string, url string"), robots).collect()}
    assert ok == {u for _, u in urls} - {"https://a.example/x/1"}
    grouped = [
        ("a.example", "User-agent: other\nUser-agent: *\nDisallow: /x  # no\n\nUser-agent: mine\nDisallow: /own\nAllow: /own/*.html$"),
        ("b.example", "User-agent: mine\nDisallow:\n\nUser-agent: *\nDisallow: /"),
        ("c.example", "Disallow: /\nUser-agent: mine\nCrawl-delay: 3\nUser-agent: x\nDisallow: /?q="),
    ]
    grouped = spark.createDataFrame(grouped, "domain string, body string")
    urls = spark.createDataFrame([(f"{d}.example", f"https://{d}.example{p}") for d in "abc" for p in ("/x/1", "/own/a", "/own/a.html", "/own/a.html?x", "?q=1")], "domain string, url string")
    banned = lambda agent: {r.url[8:] for r in urls.subtract(sitemap.allowed(urls, grouped, agent)).collect()}
    assert banned("*") == {"a.example/x/1"} | {f"b.example{p}" for p in ("/x/1", "/own/a", "/own/a.html", "/own/a.html?x", "?q=1")}
    assert banned("Mine/2.0") == {"a.example/own/a", "a.example/own/a.html?x", "c.example?q=1"}  # consecutive agents share a group
    assert banned("X") == {"a.example/x/1", "c.example?q=1"} | {f"b.example{p}" for p in ("/x/1", "/own/a", "/own/a.html", "/own/a.html?x", "?q=1")}
    stored = spark.createDataFrame([("https://b.example/sitemaps.xml", "<x/>"), ("https://b.example/sitemap.xml", "no")], "url string, body string")
    assert {tuple(r) for r in sitemap.discover(robots, stored).collect()} == {("a.example", "https://a.example/m.xml"), ("b.example", "https://b.example/sitemaps.xml")}


def test_geojson(spark, tmp_path):
    ring = [[105.0, 21.0], [105.1, 21.0], [105.1, 21.1], [105.0, 21.0]]
    poly = {"type": "Polygon", "coordinates": [ring]}
    multi = {"type": "MultiPolygon", "coordinates": [[ring]]}
    for k, doc in {"f": {"type": "Feature", "properties": {"ward": "x"}, "geometry": poly}, "g": multi, "c": {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"ward": "x"}, "geometry": multi}]}}.items():
        (tmp_path / f"{k}.geojson").write_text(json.dumps(doc))
        r = geojson.read(spark, str(tmp_path / f"{k}.geojson")).collect()
        assert len(r) == 1 and r[0].polygons == [[ring]] and (k == "g" or r[0].properties["ward"] == "x")
    (tmp_path / "two.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": poly}] * 2}))
    with pytest.raises(ValueError):
        geojson.single(spark, str(tmp_path / "two.geojson"))
    (tmp_path / "line.geojson").write_text(json.dumps({"type": "LineString", "coordinates": ring}))
    with pytest.raises(ValueError):
        geojson.single(spark, str(tmp_path / "line.geojson"))
    cells = spark.createDataFrame([("a", 8, ring[:-1])], "h3_index string, resolution int, ring array<array<double>>")
    geojson.write(cells.withColumn("ring", geojson.closed("ring")), str(tmp_path / "out"), ["h3_index", "resolution"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    doc = json.loads(text)
    assert doc["features"][0]["geometry"]["coordinates"] == [ring] and doc["features"][0]["properties"] == {"h3_index": "a", "resolution": 8}
    wards = {"wards": [{"id": 7, "name": "x", "type": "p", "area": 1.5, "population": 10, "density": 2.0, "center": [105.0, 21.0], "polygons": [ring[:-1]]}]}
    (tmp_path / "wards.json").write_text(json.dumps(wards))
    w = geojson.wards(spark, str(tmp_path / "wards.json"), "2025").first()
    many = geojson.wards(spark, str(tmp_path / "wards.json"), "2025")
    assert geojson.select_ward(many, name="x").count() == 1 == geojson.select_ward(many, ward_id="7").count() == geojson.check_wards(many, 1, ("x",)).count()
    for bad in ({"name": "y"}, {"ward_id": "8"}):
        with pytest.raises(ValueError):
            geojson.select_ward(many, **bad)
    for args in ((2, ()), (1, ("y",))):
        with pytest.raises(ValueError):
            geojson.check_wards(many, *args)
    for twice in (many.unionByName(many), many.unionByName(many.withColumn("ward", F.lit("y"))), many.unionByName(many.withColumns({"ward": F.lit(None), "ward_id": F.lit("9")}))):
        with pytest.raises(ValueError):
            geojson.check_wards(twice, 2, ())
    with pytest.raises(ValueError):
        geojson.select_ward(many, name="x", ward_id="7")
    provinces = spark.createDataFrame([({"GID_1": "VNM.27_1"},), ({"GID_1": "VNM.28_1"},)], "properties map<string,string>")
    assert geojson.select_province(provinces).count() == 1
    with pytest.raises(ValueError):
        geojson.select_province(provinces, "VNM.1_1")
    assert w.ward_id == "7" and w.geometry == [[ring]] and w.center_lat_source == 21.0


def test_pbf(spark, tmp_path):
    from lotusgrid.sources import pbf

    p = tmp_path / "x.osm.pbf"
    nodes = [(5, 105.85, 21.03, {"highway": "crossing"}), (7, 105.86, 21.04, {}), (9, -0.5, -10.25, {"name": "đường"})]
    ways = [(3, {"highway": "primary"}, [5, 7, 9, 5]), (4, {}, [])]
    p.write_bytes(pbf.encode(nodes, ways))
    n, w = pbf.read(spark, str(p))
    assert sorted((r.id, round(r.lon, 7), round(r.lat, 7), r.tags) for r in n.collect()) == nodes
    assert sorted((r.id, r.tags, r.refs) for r in w.collect()) == ways


def test_geotiff(spark, tmp_path):
    import numpy as np

    from lotusgrid.sources import geotiff

    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    a[1, 2] = -99999
    p = tmp_path / "x.tif"
    p.write_bytes(geotiff.encode(a, 105.0, 21.0, 0.5, nodata=-99999))
    df = geotiff.read(spark, str(p))
    got = {(r.row, r.col): (r.lon, r.lat, r.value) for r in df.collect()}
    assert len(got) == 11 and (1, 2) not in got and got[(0, 0)] == (105.25, 20.75, 0.0) and got[(2, 3)] == (106.75, 19.75, 11.0)


def test_png():
    import zlib

    from lotusgrid.functions import render

    px = render.canvas(20, 10)
    render.polygon(px, [(2, 2), (8, 2), (8, 8), (2, 8)], (0, 0, 0))
    render.line(px, [(10, 5), (19, 5)], (255, 0, 0), 1)
    assert tuple(px[5, 5]) == (0, 0, 0) and tuple(px[5, 15]) == (255, 0, 0) and tuple(px[0, 0]) == render.BACKGROUND
    data = render.png(px)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and len(zlib.decompress(data[data.index(b"IDAT") + 4 : -16])) == 10 * (20 * 3 + 1)
    sheet = render.contact_sheet([px] * 5, 4)
    assert sheet.shape == (20, 80, 3)


def test_gzip_text(spark, tmp_path):
    (tmp_path / "s.xml.gz").write_bytes(gzip.compress(URLSET.encode()))
    got = spark.read.text(str(tmp_path / "s.xml.gz"), wholetext=True).select(F.lit("g").alias("url"), F.col("value").alias("body"))
    assert sitemap.entries(got).count() == 2
    raw = spark.createDataFrame([(1, gzip.compress(URLSET.encode())), (2, URLSET.encode()), (3, b"\x1f\x8bno gzip"), (4, None), (5, gzip.compress(b"cut")[:12])], "k int, b binary")
    texts = {r.k: r.t for r in raw.select("k", sitemap.text_of(F.col("b")).alias("t")).collect()}
    assert texts[1] == texts[2] == URLSET and texts[3].endswith("no gzip") and texts[4] is None and texts[5] is not None


def test_cell_images(spark):
    from lotusgrid.functions import render
    from lotusgrid.operators import roads

    views = spark.createDataFrame([("a", (0.0, 0.0, 100.0, 100.0)), ("b", (0.0, 0.0, 1.0, 1.0))], "h3_index string, box struct<x0: double, y0: double, x1: double, y1: double>")
    shapes = spark.createDataFrame([("a", "primary", [[0.0, 50.0], [100.0, 50.0]]), ("a", "water", [[10.0, 10.0], [90.0, 10.0], [90.0, 90.0], [10.0, 90.0]]), ("a", "footpath", [[0.0, 0.0], [1.0, 1.0]])], "h3_index string, kind string, points array<array<double>>")
    got = {r.h3_index: bytes(r.image) for r in render.cell_images(views, shapes).collect()}
    assert got["b"] == render.png(render.canvas()) and got["a"] != got["b"] and got["a"] == render.draw(0, 0, 100, 100, [("primary", [[0, 50], [100, 50]]), ("water", [[10, 10], [90, 10], [90, 90], [10, 90]])])
    t = spark.createDataFrame([({"natural": "water"}, [1, 2, 3, 1]), ({"waterway": "stream"}, [1, 2, 1]), ({}, [])], "tags map<string,string>, refs array<long>")
    assert [tuple(r) for r in t.select(roads.is_water(F.col("tags")), roads.is_closed_polygon(F.col("refs"))).collect()] == [(True, True), (False, False), (False, False)]
    styles = spark.createDataFrame([("primary_link",), (None,)], "h string").select(roads.style_key(F.col("h")).alias("s")).collect()
    assert [r.s for r in styles] == ["primary", None]
    assert render.style("primary") == ((0xFD, 0xAE, 0x61), 1.8 * 100 / 72) and render.style("service")[1] == 1.0 and len(render.ROADS) == 8


def test_map_pipeline(spark):
    from lotusgrid.functions import render

    nodes = spark.createDataFrame([(k, 105.0 + k % 2 * 0.001, 21.0 + k // 2 * 0.001, {}) for k in range(4)] + [(9, None, None, {})], "id long, lon double, lat double, tags map<string,string>")
    ways = [(1, {"highway": "primary_link"}, [0, 9, 1]), (2, {"building": "yes", "natural": "water"}, [0, 1, 3, 0]), (3, {"building": "yes"}, [0, 1, 0]), (4, {"highway": "path"}, [0, 1]), (5, {"highway": "service"}, [0, 9]), (6, {"highway": "residential", "building": "no"}, [0, 1, 3, 0])]
    shapes = render.map_shapes(spark.createDataFrame(ways, "id long, tags map<string,string>, refs array<long>"), nodes)
    assert sorted((r.id, r.kind, len(r.points)) for r in shapes.collect()) == [(1, "primary", 2), (2, "building", 4), (2, "water", 4), (6, "building", 4), (6, "residential", 4)]
    x, y = shapes.where("id = 1").first().points[0]
    ring = lambda cx, cy, r: [[cx - r, cy - r], [cx + r, cy - r], [cx + r, cy + r], [cx - r, cy + r], [cx - r, cy - r]]
    cells = spark.createDataFrame([("a", 8, ring(x, y, 50.0)), ("b", 8, ring(x + 9e5, y, 20.0)), ("c", 9, ring(x, y, 10.0))], "h3_index string, resolution int, ring array<array<double>>")
    views = render.views(cells)
    boxes = {r.h3_index: r.box for r in views.collect()}
    assert boxes["a"].x1 - boxes["a"].x0 == pytest.approx(130) == boxes["b"].y1 - boxes["b"].y0 and boxes["c"].x1 - boxes["c"].x0 == pytest.approx(26)
    seen = render.in_views(shapes, views, 500.0)
    assert sorted((r.h3_index, r.kind) for r in seen.collect()) == [(c, k) for c in "ac" for k in ("building", "building", "primary", "residential", "water")]
    images = {r.h3_index: bytes(r.image) for r in render.cell_images(views, seen).collect()}
    assert images["b"] == render.png(render.canvas()) != images["a"]
    assert [tuple(r) for r in render.sheet_places(cells, "h3_index", 3, 2).orderBy("h3_index").collect()] == [("a", 0, 0), ("b", 1, 0), ("c", 0, 1)]


def test_fetching(spark, tmp_path):
    from lotusgrid.sources import fetch

    asked, waits = [], []

    def opener(url):
        asked.append(url)
        if "busy" in url:
            return (503, b"") if len(asked) < 3 else (200, b"late")
        if "down" in url:
            raise OSError
        return (404, b"x") if "gone" in url else (200, b"ok")

    assert fetch.get("https://a/busy", opener, 1.5, 3, waits.append) == (200, b"late") and waits == [3.0, 6.0]
    assert fetch.get("https://a/gone", opener, sleep=waits.append) == (404, None) and fetch.get("https://a/down", opener, sleep=waits.append) == (None, None)
    assert waits[2:] == [1.5, 3.0, 4.5]

    def plain(url):
        return (404, b"") if "gone" in url else (200, url.encode())

    urls = spark.createDataFrame([("a", "https://a/1"), ("a", "https://a/gone"), ("b", "https://b/1"), ("a", "https://a/1"), (None, "x"), ("b", None)], "domain string, url string")
    got = {r.url: (r.status, r.body and bytes(r.body)) for r in fetch.pages(urls, plain, 0.05).collect()}
    assert got == {"https://a/1": (200, b"https://a/1"), "https://a/gone": (404, None), "https://b/1": (200, b"https://b/1")}

    def station(url):
        return 200, b'{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, null], "precipitation": [0, 1], "visibility": [9, 9], "wind_speed_10m": [2, 3], "relative_humidity_2m": [50, 60]}}'

    def closed(url):
        raise OSError

    req = spark.createDataFrame([("c1", 21.0, 105.0, "2024-01-01", "2024-01-01")], "h3_index string, latitude double, longitude double, start_date string, end_date string")
    cache = str(tmp_path / "cache")
    first = fetch.hourly(req, station, "https://w.example/v1", cache).orderBy("ts").collect()
    assert [(r.h3_index, r.temperature_2m, r.precipitation) for r in first] == [("c1", 1.5, 0.0), ("c1", None, 1.0)]
    assert fetch.hourly(req, closed, "https://w.example/v1", cache).orderBy("ts").collect() == first
    with pytest.raises(Exception, match="no weather"):
        fetch.hourly(req, closed, "https://w.example/v1", str(tmp_path / "other"), tries=1).collect()
