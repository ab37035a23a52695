"""Points near other points, and the region that contains a point (problem 1).

Both operators cut latitude into strips and strips into longitude tiles, range-partition
the strips, sort locally and sweep each tile from south to north.

``near_points`` finds all pairs within a distance. Strips and tiles are wider than the
distance; a point near the lower edge of its strip or tile is copied over that edge,
and a pair belongs to the lower strip and lower tile of its two points, so each pair
has one owner. Tiles of more than ``block`` points (a dense city, one spot) are split
into blocks of points that meet two by two, and a block is only held against the other
one. The sweep line moves in steps of the distance; the active set, ordered by
longitude, is the step at the line and the one south of it. Candidates leave it in
pieces of at most ``most``, each verified on the great circle before the next, so memory
does not follow the number of pairs.

``containing_regions`` sends each region to the tiles it touches: with the edges of its
ring that lie in the strip where its border crosses the tile, and with none where the
tile is all inside. Points of a tile, ordered by longitude, are held against each
region's span there. Tiles of many points or many regions are split into blocks.

Defined results: points with a null or non-finite coordinate, or outside the given
ranges, are not used; repeated ids count once (the least coordinates); points at one
spot are near each other; pairs across the antimeridian are found; an empty table
gives no pairs; rings that are null, short or hold nulls contain nothing. Columns of
other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Degrees to whole numbers of 1e-8, moved to be positive, and the bits they take.
_UNIT, _SHIFT, _BITS = 1e8, 1 << 36, 38


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Distance in metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def lon_margin(distance: float, max_abs_lat: float) -> float:
    """Degrees of longitude that two points within the distance can differ by, up to a latitude."""
    s = math.sin(min(math.pi / 2, distance / EARTH_M / 2))
    c = math.cos(math.radians(min(90.0, max_abs_lat + math.degrees(distance / EARTH_M))))
    return 360.0 if c <= s else math.degrees(2 * math.asin(s / c)) * (1 + 1e-9)


def _ranges(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of the places lo[row] to hi[row], in pieces of about ``most``, one row's places at least."""
    n = np.maximum(hi - lo, 0)
    rows = np.flatnonzero(n)
    if not len(rows):
        return
    ends = np.cumsum(n[rows])
    a, done = 0, 0
    while a < len(rows):
        e = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        r = rows[a:e]
        k = n[r]
        first = np.cumsum(k) - k
        yield np.repeat(r, k), np.arange(int(k.sum())) - np.repeat(first - lo[r], k)
        a, done = e, int(ends[e - 1])


def sweep(owner: np.ndarray, side: np.ndarray, two: np.ndarray, lat: np.ndarray, lon: np.ndarray, d_lat: float, d_lon: float, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (i, j) in pieces: at most d_lat and d_lon apart, of one owner, each pair once.

    Rows come ordered by owner and latitude. ``two`` marks owners of two blocks, whose
    pairs have one point on either ``side`` (0 or 1).
    """
    if not len(lat):
        return
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(lat))))
    step = np.floor((lat - lat[start][of]) / d_lat).astype(np.int64)
    last = step[np.append(start[1:], len(lat)) - 1]
    base = np.cumsum(2 * last + 6) - (2 * last + 6)  # a gap, so that no step is next to another owner's
    g = base[of] + 2 * step + 4 + side
    at = np.round(lon * _UNIT).astype(np.int64) + _SHIFT
    d = int(d_lon * _UNIT) + 2
    key = (g << _BITS) + at
    order = np.argsort(key, kind="stable")
    key = key[order]
    g, at, y, sides, pairs = g[order], at[order], lat[order], side[order], two[order]
    here = np.arange(len(key))
    same = np.where(pairs, g + 1, g)
    south = np.where(pairs, np.where(sides == 0, g - 1, g - 3), g - 2)
    for target, level in ((same, True), (south, False)):
        row = (target << _BITS) + at
        lo, hi = np.searchsorted(key, row - d, side="left"), np.searchsorted(key, row + d, side="right")
        if level:  # one owner of one block: only what follows in longitude; of two blocks: only from the first
            lo = np.where(pairs, lo, here + 1)
            hi = np.where(pairs & (sides == 1), lo, hi)
        for i, j in _ranges(lo, hi, most):
            ok = np.abs(y[i] - y[j]) <= d_lat
            yield order[i[ok]], order[j[ok]]


def _whole(rows: pa.Table, owner: list[str]) -> tuple[np.ndarray, int]:
    """Number of each row's owner, and where the last owner, which may go on, begins."""
    change = np.zeros(rows.num_rows, bool)
    for c in owner:
        v = rows.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change), int(np.flatnonzero(change)[-1]) if change.any() else 0


def _owned(batches: Iterator[pa.RecordBatch], owner: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole owners, which come one after the other, with each row's owner number."""
    held: list[pa.RecordBatch] = []
    known = None
    for b in batches:
        if not b.num_rows:
            continue
        last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in owner)
        held.append(b)
        if known is not None and last == known:
            continue  # the same owner goes on
        known = last
        rows = pa.Table.from_batches(held).combine_chunks()
        number, cut = _whole(rows, owner)
        if cut:
            yield rows.slice(0, cut).combine_chunks(), number[:cut]
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, _whole(rows, owner)[0]


def near_points(points: DataFrame, distance: float, id_col: str, lat: str, lon: str, group: str | None = None, lat_range: tuple[float, float] = (-90.0, 90.0), lon_range: tuple[float, float] = (-180.0, 180.0), block: int = 20_000, strips_of: float = 12.0, most: int = 1_000_000) -> DataFrame:
    """(id_a, id_b, metres) of all pairs of different ids of one group within ``distance`` metres."""
    key = F.col(group) if group else F.lit(0)
    p = points.select(F.col(id_col).alias("id"), key.alias("g"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    p = p.where(F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("y").between(*lat_range) & F.col("x").between(*lon_range))
    p = p.groupBy("g", "id").agg(F.min(F.struct("y", "x")).alias("at")).select("g", "id", "at.y", "at.x")
    top = max(abs(lat_range[0]), abs(lat_range[1]))
    if top > 89:  # the widest longitude margin that the data needs
        top = p.agg(F.max(F.abs("y"))).first()[0] or 0.0
    d_lat, d_lon = math.degrees(distance / EARTH_M) * (1 + 1e-9), lon_margin(distance, top)
    high, wide = d_lat * strips_of, max(d_lon * strips_of, d_lon)
    kind = dict(p.dtypes)["id"]
    if d_lon < 180:
        over = p.where(F.col("x") <= -180 + d_lon).withColumn("x", F.col("x") + 360).withColumn("moved", F.lit(True))
        p = p.withColumn("moved", F.lit(False)).unionByName(over)
    else:
        p = p.withColumn("moved", F.lit(False))
    p = p.withColumn("s", F.floor(F.col("y") / high).cast("int")).withColumn("t", F.floor(F.col("x") / wide).cast("int"))
    south = F.array(F.lit(0), F.when(F.col("y") - F.col("s") * F.lit(high) <= d_lat, F.lit(1)))
    west = F.array(F.lit(0), F.when(F.col("x") - F.col("t") * F.lit(wide) <= d_lon, F.lit(1)))
    p = p.withColumn("ds", F.explode(F.array_compact(south))).withColumn("dt", F.explode(F.array_compact(west)))
    p = p.select(F.xxhash64("g").alias("gh"), (F.col("s") - F.col("ds")).alias("s"), (F.col("t") - F.col("dt")).alias("t"), "ds", "dt", "id", "y", "x", "moved")
    dense = p.groupBy("gh", "s", "t").agg(F.count("*").alias("n")).where(F.col("n") > block)
    dense = dense.select("gh", "s", "t", F.ceil(F.col("n") / block).cast("int").alias("k"))
    p = p.join(dense, ["gh", "s", "t"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    p = p.withColumn("b", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    p = p.select("s", "gh", "t", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "y", "x", "id", "ds", "dt", "moved")
    owner = ["s", "gh", "t", "b1", "b2"]
    p = p.repartitionByRange(*owner).sortWithinPartitions(*owner, "y", "x", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in _owned(batches, owner):
            y, x, b, b1, b2, ds, dt = (rows.column(c).to_numpy() for c in ("y", "x", "b", "b1", "b2", "ds", "dt"))
            moved, ids = rows.column("moved").to_numpy(zero_copy_only=False), rows.column("id").combine_chunks()
            two = b1 != b2
            for i, j in sweep(number, (two & (b == b2)).astype(np.int64), two, y, x, d_lat, d_lon, most):
                # The owner is the lower strip and tile: one of the two points must be at home there in each direction.
                ok = ((ds[i] == 0) | (ds[j] == 0)) & ((dt[i] == 0) | (dt[j] == 0)) & ~(moved[i] & moved[j])
                i, j = i[ok], j[ok]
                m = _metres(y[i], x[i], y[j], x[j])
                ok = m <= distance
                if ok.any():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[ok])), ids.take(pa.array(j[ok])), pa.array(m[ok])], names=["i", "j", "metres"])

    pairs = p.mapInArrow(run, f"i {kind}, j {kind}, metres double").where("i <> j")
    return pairs.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), "metres")


def ring_tiles(ring: np.ndarray, high: float, wide: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(strip, tile, edges) of the tiles that a closed ring of [x, y] touches; no edges: the tile is all inside."""
    e = np.hstack([ring[:-1], ring[1:]])
    low, top = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for s in range(math.floor(low.min() / high), math.floor(top.max() / high) + 1):
        on = e[(low <= (s + 1) * high) & (top >= s * high)]
        if not len(on):
            continue
        ax, ay, bx, by = on.T
        # Where each edge lies within the strip.
        dy = np.where(by == ay, 1.0, by - ay)
        t0 = np.where(by == ay, 0.0, np.clip((s * high - ay) / dy, 0, 1))
        t1 = np.where(by == ay, 1.0, np.clip(((s + 1) * high - ay) / dy, 0, 1))
        xa, xb = ax + t0 * (bx - ax), ax + t1 * (bx - ax)
        left, right = np.minimum(xa, xb), np.maximum(xa, xb)
        slack = 1e-9 * wide
        for t in range(math.floor((left.min() - slack) / wide), math.floor((right.max() + slack) / wide) + 1):
            cross = (left <= (t + 1) * wide + slack) & (right >= t * wide - slack)
            if cross.any():
                yield s, t, on[np.maximum(ax, bx) >= t * wide - slack]
            elif inside(on, np.array([(t + 0.5) * wide]), np.array([(s + 0.5) * high]))[0]:
                yield s, t, on[:0]


def inside(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points edges (ax, ay, bx, by) enclose by the even-odd rule, or have on them."""
    odd, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ax, ay, bx, by in e:
        on |= ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd | on


def containing_regions(points: DataFrame, regions: DataFrame, id_col: str, lat: str, lon: str, region_col: str, ring_col: str, tile_deg: float = 0.05, block: int = 20_000) -> DataFrame:
    """(id, region): the regions whose closed ring of [lon, lat] covers a point, edge included."""
    p = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    p = p.where("id is not null and y between -90 and 90 and x between -180 and 180")
    p = p.withColumn("s", F.floor(F.col("y") / tile_deg).cast("int")).withColumn("t", F.floor(F.col("x") / tile_deg).cast("int"))
    r = regions.select(F.col(region_col).alias("region"), F.col(ring_col).alias("ring"))
    r = r.where("region is not null and size(ring) >= 4 and not exists(ring, v -> v is null or v[0] is null or v[1] is null)")
    id_kind, region_kind = dict(p.dtypes)["id"], dict(r.dtypes)["region"]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, s, t, e.tobytes()) for k, ring in enumerate(b.column(1).to_pylist()) for s, t, e in ring_tiles(np.array([v[:2] for v in ring], dtype=np.float64), tile_deg, tile_deg)]
            cols = [pa.array([x[c] for x in rows], kind) for c, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in rows], pa.int64())), *cols], names=["region", "s", "t", "edges"])

    r = r.mapInArrow(tiles, f"region {region_kind}, s int, t int, edges binary")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy("s", "t").agg(F.count("*").alias("n")).where(F.col("n") > block)
        return n.select("s", "t", F.ceil(F.col("n") / block).cast("int").alias(name))

    kp, kr = blocks(p, "kp"), blocks(r, "kr")

    def split(rows: DataFrame, value: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        rows = rows.join(kp, ["s", "t"], "left").join(kr, ["s", "t"], "left").withColumn("kp", F.coalesce("kp", F.lit(1))).withColumn("kr", F.coalesce("kr", F.lit(1)))
        rows = rows.withColumn(names[0], F.pmod(F.xxhash64(value), F.col(own)).cast("int"))
        return rows.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    a = split(p, "id", "kp", "kr", ("bp", "br")).select("s", "t", "bp", "br", F.lit(1).alias("kind"), "id", F.lit(None).cast(region_kind).alias("region"), "y", "x", F.lit(None).cast("binary").alias("edges"))
    b = split(r, "region", "kr", "kp", ("br", "bp")).select("s", "t", "bp", "br", F.lit(0).alias("kind"), F.lit(None).cast(id_kind).alias("id"), "region", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("x"), "edges")
    owner = ["s", "t", "bp", "br"]
    rows = a.unionByName(b).repartitionByRange(*owner).sortWithinPartitions(*owner, "kind", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, number in _owned(batches, owner):
            starts = np.append(np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])), len(number))
            is_point = got.column("kind").to_numpy() == 1
            ids, names, edges = (got.column(c).combine_chunks() for c in ("id", "region", "edges"))
            y, x = got.column("y").to_numpy(), got.column("x").to_numpy()
            for lo, end in zip(starts[:-1], starts[1:]):
                first = lo + int(np.count_nonzero(~is_point[lo:end]))
                if first in (lo, end):
                    continue
                xs, ys = x[first:end], y[first:end]
                for k in range(lo, first):
                    e = np.frombuffer(edges[k].as_py(), np.float64).reshape(-1, 4)
                    hit = np.arange(end - first)
                    if len(e):  # the ray goes east, so points behind the last edge are outside
                        z = int(np.searchsorted(xs, e[:, [0, 2]].max(), side="right"))
                        hit = np.flatnonzero(inside(e, xs[:z], ys[:z]))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit + first)), names.take(pa.array(np.full(len(hit), k)))], names=["id", "region"])

    return rows.mapInArrow(run, f"id {id_kind}, region {region_kind}").distinct()
