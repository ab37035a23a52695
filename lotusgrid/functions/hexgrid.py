"""The hierarchical hexagon grid of the cell ids, for one base cell.

Aperture-7 hexagons on the gnomonic projection of one icosahedron face. The constants
are those of the face and base cell that hold the Red River delta (base cell 32);
places and cells of other base cells give null rather than wrong ids. Everything is
vectorised over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Face centre (radians), azimuth of its first axis, scale and rotation of the grid.
FACE_LAT, FACE_LON = 0.172745327415618701, 1.678146885280433686
FACE_AXIS = 2.692877706530642877
SCALE_0 = 0.38196601125010500003
TURN = 0.333473172251832115336090755351070070
# The base cell's number, its place on the face and the turns of its digits.
BASE, BASE_IJK, BASE_TURNS = 32, (0, 1, 0), 0
# Sphere radius of cell areas in km.
RADIUS_KM = 6371.007180918475

_SIN60 = np.sqrt(3) / 2
_UNITS = np.array([(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0)])
_CCW = np.array([0, 5, 3, 1, 6, 4, 2, 7])


def _plane(lat: np.ndarray, lon: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid-plane coordinates of places (radians), in units of cells of a resolution."""
    dl = lon - FACE_LON
    r = 2 * np.arcsin(np.sqrt(np.sin((lat - FACE_LAT) / 2) ** 2 + np.cos(FACE_LAT) * np.cos(lat) * np.sin(dl / 2) ** 2))
    az = np.arctan2(np.cos(lat) * np.sin(dl), np.cos(FACE_LAT) * np.sin(lat) - np.sin(FACE_LAT) * np.cos(lat) * np.cos(dl))
    t = FACE_AXIS - az - (TURN if res % 2 else 0.0)
    r = np.tan(r) / SCALE_0 * np.sqrt(7.0) ** res
    return r * np.cos(t), r * np.sin(t)


def _place(x: np.ndarray, y: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude (radians) of grid-plane coordinates."""
    r = np.arctan(np.hypot(x, y) / np.sqrt(7.0) ** res * SCALE_0)
    az = FACE_AXIS - np.arctan2(y, x) - (TURN if res % 2 else 0.0)
    sin_lat = np.sin(FACE_LAT) * np.cos(r) + np.cos(FACE_LAT) * np.sin(r) * np.cos(az)
    lat = np.arcsin(np.clip(sin_lat, -1, 1))
    lon = FACE_LON + np.arctan2(np.sin(az) * np.sin(r) * np.cos(FACE_LAT), np.cos(r) - np.sin(FACE_LAT) * sin_lat)
    return lat, (lon + np.pi) % (2 * np.pi) - np.pi


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised ijk of the cell that holds plane coordinates."""
    j = y / _SIN60
    c = np.stack([x + j / 2, -j, j / 2 - x], axis=-1)
    r = np.rint(c)
    d = np.abs(r - c)
    worst = d.argmax(axis=-1)
    fixed = r.copy()
    idx = np.arange(len(r))
    fixed[idx, worst] = r[idx, worst] - r.sum(axis=-1)
    return _normal(np.stack([fixed[:, 0], -fixed[:, 1], np.zeros(len(r))], axis=-1).astype(np.int64))


def _normal(ijk: np.ndarray) -> np.ndarray:
    return ijk - ijk.min(axis=-1, keepdims=True)


def _xy(ijk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = ijk[:, 0] - ijk[:, 2], ijk[:, 1] - ijk[:, 2]
    return i - j / 2, j * _SIN60


def _up(ijk: np.ndarray, odd: bool) -> np.ndarray:
    i, j = ijk[:, 0] - ijk[:, 2], ijk[:, 1] - ijk[:, 2]
    a, b = ((3 * i - j) / 7, (i + 2 * j) / 7) if odd else ((2 * i + j) / 7, (3 * j - i) / 7)
    return _normal(np.stack([np.rint(a), np.rint(b), np.zeros(len(a))], axis=-1).astype(np.int64))


def _down(ijk: np.ndarray, odd: bool) -> np.ndarray:
    v = np.array([(3, 0, 1), (1, 3, 0), (0, 1, 3)] if odd else [(3, 1, 0), (0, 3, 1), (1, 0, 3)])
    return _normal(ijk @ v)


def _turned(digits: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times % 6):
        digits = _CCW[digits]
    return digits


def _digits(ijk: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits, ijk of the base cell)."""
    out = np.zeros((len(ijk), res), np.int64)
    for r in range(res, 0, -1):
        up = _up(ijk, r % 2 == 1)
        diff = _normal(ijk - _down(up, r % 2 == 1))
        out[:, r - 1] = (diff[:, None, :] == _UNITS[None]).all(-1).argmax(1)
        ijk = up
    return out, ijk


def _index(digits: np.ndarray, res: int) -> np.ndarray:
    h = np.full(len(digits), (1 << 59) | (res << 52) | (BASE << 45) | ((1 << (3 * (15 - res))) - 1), np.int64)
    for r in range(res):
        h |= digits[:, r] << np.int64(3 * (14 - r))
    return h


def cells_at(lat: np.ndarray, lon: np.ndarray, res: int) -> np.ndarray:
    """Cell numbers of places in degrees; 0 outside the base cell."""
    x, y = _plane(np.radians(lat), np.radians(lon), res)
    ok = np.isfinite(x) & np.isfinite(y)
    digits, base = _digits(_nearest(np.where(ok, x, 0), np.where(ok, y, 0)), res)
    ok &= (base == BASE_IJK).all(axis=1)
    return np.where(ok, _index(_turned(digits, BASE_TURNS), res), 0)


def _ijk(h: np.ndarray, res: int) -> np.ndarray:
    digits = np.stack([(h >> np.int64(3 * (14 - r))) & 7 for r in range(res)], axis=-1) if res else np.zeros((len(h), 0), np.int64)
    digits = _turned(digits, -BASE_TURNS)
    ijk = np.tile(np.array(BASE_IJK, np.int64), (len(h), 1))
    for r in range(1, res + 1):
        ijk = _normal(_down(ijk, r % 2 == 1) + _UNITS[np.minimum(digits[:, r - 1], 6)])
    return ijk


def is_known(h: np.ndarray) -> np.ndarray:
    """Whether numbers are cells of the base cell."""
    res = (h >> np.int64(52)) & 15
    ok = ((h >> np.int64(59)) == 1) & (((h >> np.int64(45)) & 127) == BASE)
    for r in range(15):
        d = (h >> np.int64(3 * (14 - r))) & 7
        ok &= np.where(r < res, d != 7, d == 7)
    return ok


def resolution(h: np.ndarray) -> np.ndarray:
    return (h >> np.int64(52)) & 15


def centres(h: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees of cells of one resolution."""
    x, y = _xy(_ijk(h, res))
    lat, lon = _place(x, y, res)
    return np.degrees(lat), np.degrees(lon)


def rings(h: np.ndarray, res: int) -> np.ndarray:
    """Open rings of six [lon, lat] corners, counter-clockwise."""
    x, y = _xy(_ijk(h, res))
    a = np.radians(30 + 60 * np.arange(6))
    lat, lon = _place(x[:, None] + np.cos(a) / np.sqrt(3), y[:, None] + np.sin(a) / np.sqrt(3), res)
    ring = np.stack([np.degrees(lon), np.degrees(lat)], axis=-1)
    nxt = np.roll(ring, -1, axis=1)
    turn = (ring[..., 0] * nxt[..., 1] - nxt[..., 0] * ring[..., 1]).sum(axis=1)
    return np.where((turn < 0)[:, None, None], ring[:, ::-1], ring)


def areas_km2(h: np.ndarray, res: int) -> np.ndarray:
    """Spherical area of each cell: the triangles of its centre and edges."""
    vec = lambda lat, lon: np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)
    lat, lon = centres(h, res)
    c = vec(np.radians(lat), np.radians(lon))[:, None]
    r = np.radians(rings(h, res))
    p = vec(r[..., 1], r[..., 0])
    q = np.roll(p, -1, axis=1)
    triple = np.abs((c * np.cross(p, q)).sum(-1))
    return 2 * np.arctan2(triple, 1 + (c * p).sum(-1) + (p * q).sum(-1) + (q * c).sum(-1)).sum(axis=1) * RADIUS_KM**2


def inside(polygons: list, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Whether polygons of rings (first outer, others holes) hold places, even-odd."""
    out = np.zeros(len(lat), bool)
    for polygon in polygons:
        hit = np.zeros(len(lat), bool)
        for ring in polygon:
            p = np.asarray(ring, float)
            for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0)):
                if ay != by:
                    hit ^= ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax)
        out |= hit
    return out


def polygon_cells(polygons: list, res: int) -> np.ndarray:
    """Sorted cells whose centre lies in the polygons."""
    pts = np.concatenate([np.asarray(r, float) for p in polygons for r in p])
    x, y = _plane(np.radians(pts[:, 1]), np.radians(pts[:, 0]), res)
    # Plane coordinates are nearly affine over a boundary; a margin covers the bend of long edges.
    grow = 2 + 0.01 * max(np.ptp(x), np.ptp(y))
    j = np.arange(np.floor((y.min() - grow) / _SIN60), np.ceil((y.max() + grow) / _SIN60) + 1)
    i = np.arange(np.floor(x.min() - grow), np.ceil(x.max() + grow) + 1)
    jj, ii = np.meshgrid(j, i, indexing="ij")
    ii = ii + np.floor(jj / 2)
    ijk = _normal(np.stack([ii.ravel(), jj.ravel(), np.zeros(ii.size)], axis=-1).astype(np.int64))
    lat, lon = _place(*_xy(ijk), res)
    keep = inside(polygons, np.degrees(lat), np.degrees(lon))
    digits, base = _digits(ijk[keep], res)
    return np.sort(_index(_turned(digits, BASE_TURNS), res)[(base == BASE_IJK).all(axis=1)])


def text(h: np.ndarray) -> list[str | None]:
    return [format(int(v), "x") if v else None for v in h]


def number(ids: list[str | None]) -> np.ndarray:
    def one(s: str | None) -> int:
        try:
            return int(s.strip(), 16) if s else 0
        except ValueError:
            return 0

    v = [one(s) for s in ids]
    return np.array([x if 0 < x < 1 << 62 else 0 for x in v], np.int64)


def cell_at(lat: Column, lon: Column, res: int) -> Column:
    """Cell id of a place in degrees; null outside the base cell or without coordinates."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(text(cells_at(a.to_numpy(float), b.to_numpy(float), res)), dtype=object)

    return run(lat.cast("double"), lon.cast("double"))


CELL = "resolution int, centroid_lat double, centroid_lon double, area_km2 double, ring array<array<double>>"


def described(ids: list[str | None]) -> list[dict | None]:
    """Resolution, centre, area and closed ring of each id; None for unknown ones."""
    h = number(ids)
    ok = is_known(h)
    res = resolution(h)
    out: list[dict | None] = [None] * len(h)
    for r in np.unique(res[ok]).tolist():
        at = np.flatnonzero(ok & (res == r))
        g = h[at]
        lat, lon = centres(g, r)
        for k, y, x, area, ring in zip(at.tolist(), lat.tolist(), lon.tolist(), areas_km2(g, r).tolist(), rings(g, r).tolist()):
            out[k] = {"resolution": r, "centroid_lat": y, "centroid_lon": x, "area_km2": area, "ring": [*ring, ring[0]]}
    return out


def cell(h3_index: Column) -> Column:
    """Struct of resolution, centre, exact area and closed ring; null for unknown ids."""
    kind = pa.struct([("resolution", pa.int32()), ("centroid_lat", pa.float64()), ("centroid_lon", pa.float64()), ("area_km2", pa.float64()), ("ring", pa.list_(pa.list_(pa.float64())))])

    @F.arrow_udf(CELL)
    def run(s: pa.Array) -> pa.Array:
        return pa.array(described(s.to_pylist()), kind)

    return run(h3_index)


def grid(boundaries: DataFrame, resolutions: list[int]) -> DataFrame:
    """(ward, h3_index, resolution): the cells of ``boundaries(ward, polygons)`` whose centre a boundary holds, sorted within each."""
    if bad := [r for r in resolutions if not 0 <= r <= 15]:
        raise ValueError(f"resolutions {bad} are not in 0..15")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ward, polygons in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in resolutions if polygons else []:
                    ids = text(polygon_cells(polygons, r))
                    yield pa.RecordBatch.from_arrays([pa.array([ward] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array([r] * len(ids), pa.int64())], names=["ward", "h3_index", "resolution"])

    return boundaries.select("ward", "polygons").mapInArrow(run, "ward string, h3_index string, resolution long")
