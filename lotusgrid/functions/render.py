"""Small raster images of cells: a numpy canvas and a PNG writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import roads
from . import geo

# Size, background and layers of a cell image.
SIZE = 224
BACKGROUND = (0xED, 0xF1, 0xF4)
WATER, BUILDING = (0x9E, 0xCA, 0xE1), (0xBD, 0xBD, 0xBD)
# Colour and line width in points of the roads that are drawn.
ROADS = {
    "motorway": ("#d73027", 2.2), "trunk": ("#fc8d59", 2.0),
    "primary": ("#fdae61", 1.8), "secondary": ("#fee08b", 1.5),
    "tertiary": ("#f6e8c3", 1.1), "residential": ("#ffffff", 0.65),
    "service": ("#ffffff", 0.45), "unclassified": ("#ffffff", 0.55),
}
#: Pixels of a point at 100 dots an inch; a view is wider than its widest cell by this factor.
POINT, ROOM = 100 / 72, 1.3


def style(kind: str) -> tuple[tuple[int, int, int], float]:
    """Colour and width in pixels of a kind of road."""
    colour, width = ROADS[kind]
    return (int(colour[1:3], 16), int(colour[3:5], 16), int(colour[5:7], 16)), max(1.0, width * POINT)


def canvas(width: int = SIZE, height: int = SIZE) -> np.ndarray:
    return np.full((height, width, 3), BACKGROUND, np.uint8)


def polygon(px: np.ndarray, ring: list[tuple[float, float]], colour: tuple[int, int, int]) -> None:
    """Fill a ring of pixel places (even-odd, pixel centres)."""
    h, w, _ = px.shape
    y, x = np.mgrid[0:h, 0:w] + 0.5
    inside = np.zeros((h, w), bool)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    px[inside] = colour


def line(px: np.ndarray, points: list[tuple[float, float]], colour: tuple[int, int, int], width: float) -> None:
    h, w, _ = px.shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / n, 0, 1) if n else 0.0
        px[(x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= (width / 2) ** 2 + 1e-9] = colour


def png(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def contact_sheet(images: list[np.ndarray], across: int = 4) -> np.ndarray:
    h, w, _ = images[0].shape
    sheet = canvas(w * across, h * -(-len(images) // across))
    for k, px in enumerate(images):
        sheet[k // across * h : k // across * h + h, k % across * w : k % across * w + w] = px
    return sheet


def draw(x0: float, y0: float, x1: float, y1: float, shapes: list[tuple[str, list[list[float]]]], size: int = SIZE) -> bytes:
    """PNG of a view: water, then buildings, then roads."""
    px = canvas(size, size)
    place = lambda p: ((p[0] - x0) / (x1 - x0) * size, (y1 - p[1]) / (y1 - y0) * size)
    rank = {"water": 0, "building": 1}
    for kind, pts in sorted(shapes, key=lambda s: rank.get(s[0], 2)):
        at = [place(p) for p in pts]
        if kind in rank:
            polygon(px, at, WATER if kind == "water" else BUILDING)
        elif kind in ROADS:
            line(px, at, *style(kind))
    return png(px)


def cell_images(views: DataFrame, shapes: DataFrame) -> DataFrame:
    """(h3_index, image) of views ``(h3_index, box)`` with their shapes ``(h3_index, kind, points)``; views without shapes are plain."""
    s = shapes.groupBy("h3_index").agg(F.collect_list(F.struct("kind", "points")).alias("shapes"))
    v = views.select("h3_index", "box.x0", "box.y0", "box.x1", "box.y1").join(s, "h3_index", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [draw(r.x0, r.y0, r.x1, r.y1, [(x["kind"], x["points"]) for x in r.shapes] if r.shapes is not None else []) for r in b.itertuples()]
            yield pd.DataFrame({"h3_index": b["h3_index"], "image": got})

    return v.mapInPandas(run, "h3_index string, image binary")


def extents(boxes: DataFrame, group: str = "resolution", box: str = "box") -> DataFrame:
    """(group, extent_x, extent_y): half the width and height of a group's views, its widest cell with some room."""
    half = lambda a, e: F.max((F.col(f"{box}.{e}") - F.col(f"{box}.{a}")) * F.lit(ROOM / 2))
    return boxes.groupBy(group).agg(half("x0", "x1").alias("extent_x"), half("y0", "y1").alias("extent_y"))


def views(cells: DataFrame) -> DataFrame:
    """(h3_index, box) of the views of projected cells ``(h3_index, resolution, ring)``: around the centroid, as wide as the resolution's extent."""
    c = cells.withColumn("box", geo.bounds(F.col("ring"))).withColumn("at", geo.centroid(F.col("ring")))
    c = c.join(extents(c), "resolution")
    box = F.struct((F.col("at.x") - F.col("extent_x")).alias("x0"), (F.col("at.y") - F.col("extent_y")).alias("y0"), (F.col("at.x") + F.col("extent_x")).alias("x1"), (F.col("at.y") + F.col("extent_y")).alias("y1"))
    return c.select("h3_index", box.alias("box"))


def map_shapes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind, points) of what is drawn: roads of a style, closed buildings and closed water, from two located nodes on (P9, P10). A way may be several."""
    pts = roads.projected(roads.way_points(ways, nodes).where("lon is not null"))
    pts = pts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p")).where("size(p) >= 2")
    pts = pts.select("id", F.transform("p", lambda v: F.array(v["x"], v["y"])).alias("points"))
    tags, ring = F.col("tags"), (F.size("points") >= 4) & (F.element_at("points", 1) == F.element_at("points", -1))
    key = roads.style_key(roads.tag(tags, "highway"))
    kinds = F.array_compact(F.array(F.when(key.isin(list(ROADS)), key), F.when(ring & roads.is_building(tags), "building"), F.when(ring & roads.is_water(tags), "water")))
    return pts.join(ways.select("id", "tags"), "id").select("id", F.explode(kinds).alias("kind"), "points")


def in_views(shapes: DataFrame, views_: DataFrame, step: float) -> DataFrame:
    """(h3_index, kind, points) of the shapes whose box meets a view's."""
    s = shapes.select("kind", "points", geo.bounds(F.col("points")).alias("of"))
    return roads.boxes_join(s, views_.select("h3_index", "box"), "of", "box", step).select("h3_index", "kind", "points")


def sheet_places(cells: DataFrame, order: str, n: int = 12, across: int = 4) -> DataFrame:
    """(order, col, row) of the first n cells on a contact sheet (W3). The window runs over those n rows only."""
    first = cells.select(order).orderBy(order).limit(n)
    k = F.row_number().over(Window.orderBy(order)) - 1
    return first.withColumn("_k", k).select(order, (F.col("_k") % across).alias("col"), F.floor(F.col("_k") / across).alias("row"))
