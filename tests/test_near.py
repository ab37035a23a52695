import math
import random

import numpy as np
import pytest

from lotusgrid.operators import near

COLS = "h string, r int, lat double, lon double, g string, id string, y double"


def brute(rows, d):
    pts = {}
    for h, r, la, lo, *_ in rows:
        if h is None or la is None or lo is None or not math.isfinite(la) or not math.isfinite(lo) or abs(la) > 90 or abs(lo) > 180:
            continue
        k = (r, h)
        pts[k] = min(pts.get(k, (la, lo)), (la, lo))
    ks, out = sorted(pts), set()
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if a[0] == b[0]:
                (p, q), (s, t) = pts[a], pts[b]
                h = math.sin(math.radians(s - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(s)) * math.sin(math.radians(t - q) / 2) ** 2
                if 2 * 6371000 * math.asin(min(1, math.sqrt(h))) <= d:
                    out.add((a[1], b[1]))
    return out


def pairs(spark, rows, d, **how):
    df = spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], COLS)
    got = [(r.id_a, r.id_b) for r in near.near_points(df, d, "h", "lat", "lon", "r", **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_matches_brute_force_with_dirty_rows(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", rng.choice([8, 9]), 20.9 + rng.random() * 0.06, 105.4 + rng.random() * 0.06) for i in range(400)]
    rows += rows[:20] + [("n1", 8, None, 105.4), ("n2", 8, 20.9, float("nan")), (None, 8, 20.9, 105.4), ("out", 8, 200.0, 105.4), ("a1", 9, 20.91, 105.41), ("a2", 9, 20.91, 105.41)]
    want = brute(rows, 400)
    assert ("a1", "a2") in want and len(want) > 200
    assert pairs(spark, rows, 400.0) == want


def test_dense_spot_is_split_into_blocks(spark):
    rng = random.Random(6)
    rows = [(f"c{i}", 9, 20.9 + rng.random() * 0.002, 105.4 + rng.random() * 0.002) for i in range(150)]
    assert pairs(spark, rows, 100.0, block=20, strips_of=3.0) == brute(rows, 100)


def test_antimeridian_high_latitude_and_empty(spark):
    rows = [("e", 1, 70.0, 179.999), ("w", 1, 70.0, -179.999), ("f", 1, 70.0, 179.0), ("p", 1, 89.9999, 10.0), ("q", 1, 89.9999, -170.0)]
    assert pairs(spark, rows, 400.0) == brute(rows, 400) == {("e", "w"), ("p", "q")}
    assert pairs(spark, [], 400.0) == set()


def test_sweep_gives_all_close_pairs_once():
    rng = np.random.default_rng(1)
    owner = np.repeat([0, 1, 2], 100)
    y, x = np.concatenate([np.sort(rng.random(100)) for _ in range(3)]), rng.random(300)
    two = owner == 1
    side = np.where(two, rng.integers(0, 2, 300), 0)
    got = [(min(p), max(p)) for i, j in near.sweep(owner, side, two, y, x, 0.05, 0.07, 50) for p in zip(i.tolist(), j.tolist())]
    close = {(a, b) for a in range(300) for b in range(a + 1, 300) if owner[a] == owner[b] and abs(y[b] - y[a]) <= 0.05 and abs(x[a] - x[b]) <= 0.07}
    want = {(a, b) for a, b in close if not two[a] or side[a] != side[b]}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 100
    assert set(got) - want <= {(a, b) for a, b in got if abs(abs(x[a] - x[b]) - 0.07) < 1e-6}


def test_sweep_of_one_spot_comes_in_pieces():
    n = 3000
    sizes = [len(i) for i, _ in near.sweep(np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool), np.zeros(n), np.zeros(n), 0.01, 0.01, 100_000)]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= 100_000 + n


def test_containing_regions(spark):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    regions = spark.createDataFrame([("a", ring), ("b", [[p[0] + 1, p[1]] for p in ring]), (None, ring), ("n", None), ("s", ring[:3]), ("h", [[0.0, None], *ring])], "region string, ring array<array<double>>")
    pts = spark.createDataFrame([("in", 0.5, 0.5), ("edge", 0.5, 1.0), ("corner", 0.0, 0.0), ("out", 2.0, 2.0), ("null", None, 0.5), ("in", 0.5, 0.5)], "region string, lat double, lon double")
    find = lambda p, r, **k: [(x.id, x.region) for x in near.containing_regions(p, r, "region", "lat", "lon", "region", "ring", **k).collect()]
    got = find(pts, regions)
    assert len(got) == len(set(got)) and set(got) == {("in", "a"), ("edge", "a"), ("edge", "b"), ("corner", "a")}
    assert find(pts.limit(0), regions) == [] == find(pts, regions.limit(0))


def test_containing_regions_against_brute_force(spark):
    rng = random.Random(8)
    star = lambda cx, cy, r: [[cx + r * (1 if k % 2 else 0.4) * math.cos(k * math.pi / 7), cy + r * (1 if k % 2 else 0.4) * math.sin(k * math.pi / 7)] for k in range(14)]
    rings = {f"r{k}": star(105 + rng.random(), 20 + rng.random(), 0.02 + rng.random() * 0.4) for k in range(12)}
    rings = {k: [*r, r[0]] for k, r in rings.items()}
    pts = {f"p{k}": (20 + rng.random() * (0.01 if k % 3 else 1), 105 + rng.random()) for k in range(600)}

    def holds(r, y, x):
        odd = False
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    want = {(p, k) for p, (y, x) in pts.items() for k, r in rings.items() if holds(r, y, x)}
    a = spark.createDataFrame([(p, y, x) for p, (y, x) in pts.items()], "id string, lat double, lon double")
    b = spark.createDataFrame(list(rings.items()), "region string, ring array<array<double>>")
    for block in (20_000, 7):
        got = [(x.id, x.region) for x in near.containing_regions(a, b, "id", "lat", "lon", "region", "ring", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


@pytest.mark.parametrize("lat", [0.0, 45.0, 89.99])
def test_margin_is_wide_enough(lat):
    assert near.lon_margin(400.0, lat) * math.cos(math.radians(lat)) * math.pi / 180 * 6371000 >= 400.0 * 0.999
