import numpy as np
import pytest
from pyspark.sql import functions as F

from lotusgrid.functions import hexgrid as g

# Known cells with their centres and areas in square kilometres.
KNOWN = {
    "87414345bffffff": (20.810965, 105.911249), "8741437a2ffffff": (20.823708, 105.870407), "88414345b1fffff": (20.810965, 105.911249), "88414345b3fffff": (20.812143, 105.901987),
    "874143693ffffff": (21.044021, 105.740086), "8841436903fffff": (21.027972, 105.747687), "8841436907fffff": (21.034822, 105.753164),
}
AREAS = {"87414345bffffff": 5.6588, "8741437a2ffffff": 5.6600, "874143693ffffff": 5.65360, "88414345b1fffff": 0.80840, "88414345b3fffff": 0.80845, "8841436903fffff": 0.80774, "8841436907fffff": 0.80765}


@pytest.mark.parametrize("cell", KNOWN)
def test_known_cells(cell):
    lat, lon = KNOWN[cell]
    h = g.number([cell])
    res = int(g.resolution(h)[0])
    assert g.text(g.cells_at(np.array([lat]), np.array([lon]), res)) == [cell]
    a, b = g.centres(h, res)
    assert a[0] == pytest.approx(lat, abs=1e-6) and b[0] == pytest.approx(lon, abs=1e-6)
    assert g.areas_km2(h, res)[0] == pytest.approx(AREAS[cell], abs=1.5e-4 if res == 7 else 2e-5)


def test_round_trip_and_nesting():
    rng = np.random.default_rng(1)
    lat, lon = 20.6 + rng.random(500), 105.2 + rng.random(500)
    for res in range(0, 13):
        h = g.cells_at(lat, lon, res)
        assert g.is_known(h).all()
        a, b = g.centres(h, res)
        assert (g.cells_at(a, b, res) == h).all()
        if res >= 6:
            r = g.rings(h, res)
            assert all(g.inside([[ring.tolist()]], np.array([y]), np.array([x]))[0] for ring, x, y in zip(r[:20], b, a))
    assert (g.cells_at(np.array([48.0, np.nan]), np.array([2.0, 1.0]), 7) == 0).all()


def test_cells_tile_a_box():
    box = [[[[105.8, 21.0], [105.9, 21.0], [105.9, 21.1], [105.8, 21.1], [105.8, 21.0]]]]
    h = g.polygon_cells(box, 8)
    lat, lon = g.centres(h, 8)
    assert g.inside(box, lat, lon).all() and len(np.unique(h)) == len(h)
    rng = np.random.default_rng(2)
    p = g.cells_at(21.02 + rng.random(2000) * 0.06, 105.82 + rng.random(2000) * 0.06, 8)
    assert set(p.tolist()) <= set(h.tolist())  # every cell well inside is there
    area = 0.1 * np.pi / 180 * g.RADIUS_KM * 0.1 * np.pi / 180 * g.RADIUS_KM * np.cos(np.radians(21.05))
    assert g.areas_km2(h, 8).sum() == pytest.approx(area, rel=0.05)
    hole = [[box[0][0], [[105.82, 21.02], [105.88, 21.02], [105.88, 21.08], [105.82, 21.08], [105.82, 21.02]]]]
    assert 0 < len(g.polygon_cells(hole, 8)) < len(h)


def test_columns(spark):
    df = spark.createDataFrame([(21.0, 105.8), (None, 105.8), (0.0, 0.0)], "lat double, lon double")
    got = [r.h for r in df.select(g.cell_at(F.col("lat"), F.col("lon"), 8).alias("h")).collect()]
    assert got[0].startswith("88414") and got[1:] == [None, None]
    d = spark.createDataFrame([(got[0],), ("zz",), (None,), ("872830828ffffff",)], "h string").select(g.cell(F.col("h")).alias("c")).collect()
    assert d[0].c.resolution == 8 and len(d[0].c.ring) == 7 and d[0].c.ring[0] == d[0].c.ring[-1] and d[0].c.area_km2 == pytest.approx(0.8, abs=0.05)
    assert all(r.c is None for r in d[1:])
    box = [[[[105.8, 21.0], [105.85, 21.0], [105.85, 21.05], [105.8, 21.0]]]]
    w = spark.createDataFrame([("x", box), ("y", None)], "ward string, polygons array<array<array<array<double>>>>")
    out = g.grid(w, [7, 8]).collect()
    assert {r.resolution for r in out} == {7, 8} and [r.h3_index for r in out if r.resolution == 8] == sorted(r.h3_index for r in out if r.resolution == 8)
    with pytest.raises(ValueError):
        g.grid(w, [16])
