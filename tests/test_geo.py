import math

import pytest
from pyspark.sql import functions as F

from lotusgrid import contracts
from lotusgrid.functions import geo, timebin
from lotusgrid.operators import panel, population, roads, weather

HEX = [[4.0, 0.0], [2.0, 3.0], [-2.0, 3.0], [-4.0, 0.0], [-2.0, -3.0], [2.0, -3.0], [4.0, 0.0]]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def ring(r):
    return F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in r])


def test_rings(spark):
    r = one(spark, a=geo.covers(ring(HEX), F.lit(4.0), F.lit(0.0)), b=geo.covers(ring(HEX), F.lit(3.0), F.lit(1.5)), c=geo.covers(ring(HEX), F.lit(3.1), F.lit(1.5)), d=geo.centroid(ring(HEX)), e=geo.bounds(ring(HEX)), n=geo.normal_ring(ring(HEX[:-1])), bad=geo.normal_ring(ring([[500, 0], [1, 1], [2, 2]])), few=geo.normal_ring(ring([[0, 0], [1, 1]])))
    assert r.a and r.b and not r.c and abs(r.d.x) < 1e-12 and abs(r.d.y) < 1e-12
    assert (r.e.x0, r.e.y0, r.e.x1, r.e.y1) == (-4, -3, 4, 3) and r.n == HEX and r.bad is None and r.few is None


@pytest.mark.parametrize(
    "seg,want",
    [((-10, 0, 10, 0), 8), ((0, 0, 1, 0), 1), ((-10, 3, 10, 3), 4), ((-10, 4, 10, 4), 0), ((0, -10, 0, 10), 6), ((4, 0, 4, 0), 0), ((5, 5, 9, 9), 0)],
)
def test_clip(spark, seg, want):
    for r in (HEX, HEX[::-1]):
        got = one(spark, v=geo.clipped_length(ring(r), *[F.lit(float(x)) for x in seg])).v
        assert got == pytest.approx(want, abs=1e-9)


def test_utm_and_rounding(spark):
    r = one(spark, u=geo.utm(F.lit(105.0), F.lit(0.0)), v=geo.utm(F.lit(105.85), F.lit(21.03)), m=geo.round3(F.lit(2.0005)), n=geo.round3(F.lit(1.0005)), x=geo.intersection(*[F.lit(float(v)) for v in (0, 0, 2, 2, 0, 2, 2, 0)]), y=geo.intersection(*[F.lit(float(v)) for v in (0, 0, 1, 1, 0, 1, 1, 2)]))
    assert r.u.easting == pytest.approx(500000) and r.u.northing == pytest.approx(0)
    # Length along the central meridian from the equator and scale there.
    assert r.v.easting == pytest.approx(588361, abs=60) and r.v.northing == pytest.approx(2325700, abs=300)
    assert (r.m, r.n) == (2.001, 1.0) and (r.x.x, r.x.y) == (1, 1) and r.y is None


NODES = [(1, 0.0, 0.0, {"highway": "traffic_signals"}), (2, 2.0, 0.0, {"crossing": "zebra"}), (3, 10.0, 0.0, {}), (4, None, None, {}), (5, 0.0, 2.0, {"amenity": "school"}), (6, 1.0, 2.0, {"shop": ""}), (7, 1.0, -2.0, {"amenity": "hospital", "shop": "x"})]
WAYS = [
    (10, {"highway": "primary_link"}, [1, 2, 3]), (11, {"highway": "residential"}, [2, 4, 5]), (12, {"highway": "footway"}, [1, 2]), (13, {"highway": "service"}, [2, 2, 1]),
    (14, {"highway": "primary"}, [4]), (15, {"shop": "y"}, [1, 2, 5, 1]), (16, {}, []),
]


def tables(spark):
    return spark.createDataFrame(NODES, contracts.NODES), spark.createDataFrame(WAYS, contracts.WAYS)


def test_road_relations(spark):
    nodes, ways = tables(spark)
    e = roads.eligible(ways)
    assert {r.id for r in e.collect()} == {10, 11, 13}
    assert {r.node for r in roads.intersections(e).collect()} == {2}
    pts = roads.way_points(e, nodes)
    assert {(r.id, r.n_missing) for r in roads.unresolved(pts).collect()} == {(11, 1)}
    segs = {(r.id, r.seq): (r.ax, r.ay, r.bx, r.by) for r in roads.segments(pts).collect()}
    assert segs[(11, 1)] == (2.0, 0.0, 0.0, 2.0) and len([k for k in segs if k[0] == 10]) == 2
    c = {r.id: (r.lon, r.lat) for r in roads.way_centres(roads.way_points(ways.where("id = 15"), nodes)).collect()}
    assert c[15] == (0.5, 0.5)  # the closing node counts twice
    cut, kept = roads.clip_extract(ways, nodes, ring([[-1, -1], [1, -1], [1, 1], [-1, 1], [-1, -1]]))
    assert {r.id for r in cut.collect()} == {10, 12, 13, 15} and {r.id for r in kept.collect()} == {1, 2, 3, 5}


def test_cells(spark):
    nodes, ways = tables(spark)
    cells = spark.createDataFrame([("a", HEX, 2.0), ("b", [[x + 8, y] for x, y in HEX], 4.0)], "h3_index string, ring array<array<double>>, area_km2 double")
    px = spark.createDataFrame([(0, 0, 4.0, 0.0, 2.0), (0, 1, 0.0, 0.0, 1.5), (0, 2, 0.0, 1.0, None), (0, 3, 0.0, 1.0, float("nan"))], contracts.PIXELS)
    f = {r.h3_index: r for r in population.population_features(cells, px, nodes, ways, 8.0).collect()}
    assert (f["a"].population, f["a"].population_density, f["b"].population) == (3.5, 1.75, 2.0)  # the shared corner counts in both
    assert (f["a"].n_schools, f["a"].n_hospitals, f["a"].n_commercial_poi, f["b"].n_schools) == (1, 1, 1, 0)


def test_road_features_in_metres(spark):
    d = 0.01
    cells = spark.createDataFrame([("a", [[105 + x * d, 21 + y * d] for x, y in HEX]), ("far", [[106 + x * d, 21 + y * d] for x, y in HEX])], "h3_index string, ring array<array<double>>")
    nodes = spark.createDataFrame([(1, 105 - 0.1, 21.0, {"highway": "traffic_signals"}), (2, 105 + 0.1, 21.0, {}), (3, 105.0, 21.0, {"highway": "crossing"})], contracts.NODES)
    ways = spark.createDataFrame([(1, {"highway": "secondary"}, [1, 3, 2]), (2, {"highway": "service"}, [3, 1]), (3, {"highway": "service"}, [3, 2])], contracts.WAYS)
    f = {r.h3_index: r for r in roads.road_features(cells, nodes, ways).collect()}
    want = 2 * 4 * d * math.pi / 180 * 6378137 * math.cos(math.radians(21)) / math.sqrt(1 - 0.00669438 * math.sin(math.radians(21)) ** 2) * 0.9996
    assert f["a"].road_length_secondary == pytest.approx(want, rel=1e-3) and f["a"].has_major_road and f["a"].n_crossings == 1 and f["a"].n_intersections == 1 and f["a"].n_traffic_signals == 0
    assert tuple(f["far"])[1:] == (0, 0.0, 0.0, 0.0, 0, 0, False)


def test_weather(spark):
    hours = [f"2020-01-0{1 + h // 24}T{h % 24:02d}:00" for h in range(48)]
    v = [float(h) for h in range(48)]
    rows = [(c, (hours, v, v, [None] * 6 + v[6:], v, v)) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "h3_index string, " + weather.PAYLOAD)
    w = weather.six_hour(weather.decode_payload(df)).cache()
    first = w.where("h3_index = 'a'").orderBy("time_bin").first()
    assert tuple(first) == ("a", "2020-01-01T00:00:00+07:00", 2.5, 15.0, None, 5.0, 2.5)
    cells = spark.createDataFrame([("a",), ("b",)], "h3_index string")
    assert weather.checked(w, cells, 8).count() == 16
    q = weather.quality(w).first()
    assert (q.rows, q.cells, q.null_visibility_min, q.temp_max, q.precipitation_total) == (16, 2, 2, 44.5, 2256.0)
    for bad, n in ((w.limit(15), 8), (w.unionByName(w.limit(1)), 8), (w, 9)):
        with pytest.raises(contracts.ContractError):
            weather.checked(bad, cells, n)
    nan = spark.createDataFrame([("a", "2020-01-01 01:00:00", float("nan"))] * 2, "h3_index string, t string, x double").select("h3_index", F.to_timestamp_ntz("t").alias("ts"), *[F.col("x").alias(f) for f in weather.HOURLY])
    assert tuple(weather.six_hour(nan).first())[2:] == (None, 0.0, None, None, None)


def test_panel(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "h3_index string")
    p = panel.skeleton(cells, "2019-01-01", "2025-12-31")
    assert p.count() == 2 * 10228 and p.distinct().count() == 2 * 10228
    inc = p.where("h3_index = 'a'").limit(1).select("h3_index", "bin")
    got = panel.build(cells, p.limit(0).withColumn("temp_mean", F.lit(1.0)), inc.unionByName(inc), "2019-01-01", "2025-12-31").groupBy("label", "n_incidents").count().collect()
    assert {(r.label, r.n_incidents, r["count"]) for r in got} == {(1, 2, 1), (0, 0, 20455)}


def test_local_bins(spark):
    df = spark.createDataFrame([("2020-12-31 17:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    r = df.select(timebin.iso(timebin.floor_bin(timebin.local_wall(F.col("t"), "Asia/Ho_Chi_Minh"))).alias("b"), timebin.vague_bin(F.lit(" Chiều tối")).alias("v"), timebin.is_covid_period(F.col("t")).alias("c")).first()
    assert tuple(r) == ("2021-01-01T00:00:00+07:00", 18, True)


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (3, 6)], "k int, w int")
    assert {tuple(r) for r in contracts.key_difference(a, b, "k").collect()} == {(2, "left"), (3, "right")}
    with pytest.raises(contracts.ContractError):
        contracts.one_to_one(a, b, "k")
    assert contracts.one_to_one(b, a.where("v = 'x'"), "k").columns == ["k", "w", "v"]
    with pytest.raises(contracts.ContractError):
        contracts.exactly_one(a.where("k = 2"), "k")
    with pytest.raises(contracts.ContractError):
        contracts.require_rows(a.limit(0), "a")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["k", "q"])
    with pytest.raises(contracts.ContractError):
        contracts.of_resolution(a, 16)
    assert [r.v for r in contracts.absent_names(a, "v", ["x", "q"]).collect()] == ["q"]
    contracts.require_crs("epsg:4326")
