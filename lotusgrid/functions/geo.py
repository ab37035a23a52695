"""Geometry as column expressions: rings are arrays of [x, y] pairs, closed (first = last)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_ring(ring: Column) -> Column:
    """The ring of doubles, closed; null when it has fewer than three corners or leaves the degree domain."""
    r = F.transform(ring, lambda v: F.array(v[0].cast("double"), v[1].cast("double")))
    closed = F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    ok = (F.size(closed) >= 4) & ~F.exists(closed, lambda v: v[0].isNull() | v[1].isNull() | ~v[0].between(-180, 180) | ~v[1].between(-90, 90))
    return F.when(ok, closed)


def multipolygon(rings: Column) -> Column:
    """Each ring a polygon of its own, without holes."""
    return F.transform(rings, lambda r: F.array(normal_ring(r)))


def edges(ring: Column) -> Column:
    """Array of structs (ax, ay, bx, by)."""
    return F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(ring[i - 1][0].alias("ax"), ring[i - 1][1].alias("ay"), ring[i][0].alias("bx"), ring[i][1].alias("by")),
    )


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring covers a point, its edge included (even-odd rule)."""
    e = edges(ring)
    on = F.exists(
        e,
        lambda s: ((s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"]) == 0)
        & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"]))
        & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"])),
    )
    crossings = F.size(F.filter(e, lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / (s["by"] - s["ay"]) + s["ax"])))
    return on | (crossings % 2 == 1)


def twice_area(ring: Column) -> Column:
    """Twice the signed area; positive when counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda a, s: a + s["ax"] * s["by"] - s["bx"] * s["ay"])


def centroid(ring: Column) -> Column:
    """Struct (x, y): the area centroid."""
    a = twice_area(ring)
    cx = F.aggregate(edges(ring), F.lit(0.0), lambda t, s: t + (s["ax"] + s["bx"]) * (s["ax"] * s["by"] - s["bx"] * s["ay"]))
    cy = F.aggregate(edges(ring), F.lit(0.0), lambda t, s: t + (s["ay"] + s["by"]) * (s["ax"] * s["by"] - s["bx"] * s["ay"]))
    return F.struct((cx / (a * 3)).alias("x"), (cy / (a * 3)).alias("y"))


def bounds(ring: Column) -> Column:
    """Struct (x0, y0, x1, y1)."""
    xs, ys = F.transform(ring, lambda v: v[0]), F.transform(ring, lambda v: v[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two bounds overlap, touching included."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def clipped_length(ring: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Length of the part of a segment inside a convex ring (Cyrus-Beck), edge included.

    The ring's direction is found once and carried along, so the work is linear in its corners.
    """
    dx, dy = bx - ax, by - ay

    def step(acc: Column, s: Column) -> Column:
        ex, ey = s["bx"] - s["ax"], s["by"] - s["ay"]
        den = acc["side"] * (ex * dy - ey * dx)
        num = acc["side"] * (ex * (ay - s["ay"]) - ey * (ax - s["ax"]))
        t = -num / F.nullif(den, F.lit(0.0))
        low = F.when(den > 0, F.greatest(acc["t0"], t)).otherwise(acc["t0"])
        high = F.when(den < 0, F.least(acc["t1"], t)).when((den == 0) & (num < 0), F.lit(-1.0)).otherwise(acc["t1"])
        return F.struct(low.alias("t0"), high.alias("t1"), acc["side"].alias("side"))

    side = F.when(twice_area(ring) >= 0, 1.0).otherwise(-1.0)
    start = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), side.alias("side"))
    inside = F.aggregate(edges(ring), start, step, lambda a: F.greatest(F.lit(0.0), a["t1"] - a["t0"]))
    return inside * F.sqrt(dx * dx + dy * dy)


def utm(lon: Column, lat: Column, zone: int = 48) -> Column:
    """Struct (easting, northing) of WGS84 degrees in a northern UTM zone (Krueger series, fourth order)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - F.lit(e) * F.atanh(F.lit(e) * sin_lat))
    dl = F.radians(lon - F.lit(zone * 6.0 - 183.0))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, k in enumerate(alpha, 1):
        east = east + F.lit(k) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(k) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    scale = F.lit(0.9996 * a)
    return F.struct((F.lit(500000.0) + scale * east).alias("easting"), (scale * north).alias("northing"))


def round3(x: Column) -> Column:
    """Three decimals, the scaled value rounded half to even."""
    return F.rint(x * 1000) / 1000


def intersection(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Struct (x, y) of the crossing of segments ab and cd; null when they are parallel or do not meet."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.when(den != 0, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den)
    u = F.when(den != 0, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den)
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))
