"""Road features of cells from map nodes and ways.

``nodes(id, lon, lat, tags)`` and ``ways(id, tags, refs)`` are plain tables; cells come
as ``(h3_index, ring)`` with projected rings. Line and point tests meet cells by an
equi-join on a square grid wider than a typical cell, then exact expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import lexicon as L


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def eligible(ways: DataFrame) -> DataFrame:
    """Ways that vehicles use, of two nodes at least."""
    h = tag(F.col("tags"), "highway")
    return ways.where(h.isNotNull() & ~h.isin(L.NON_VEHICLE_HIGHWAYS) & (F.size("refs") >= 2)).withColumn("highway", h)


def is_signal(tags: Column) -> Column:
    return F.coalesce(tag(tags, "highway") == "traffic_signals", F.lit(False))


def is_crossing(tags: Column) -> Column:
    return F.coalesce(tag(tags, "highway") == "crossing", F.lit(False)) | F.coalesce(F.map_contains_key(tags, "crossing"), F.lit(False))


def road_class(highway: Column) -> Column:
    pairs = [F.lit(x) for kv in L.ROAD_CLASSES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), highway)


def is_major(highway: Column) -> Column:
    return highway.isin(L.MAJOR_HIGHWAYS)


def poi_category(tags: Column) -> Column:
    """First match of school, hospital, shop (F16)."""
    shop = tag(tags, "shop")
    return F.when(tag(tags, "amenity") == "school", "n_schools").when(tag(tags, "amenity") == "hospital", "n_hospitals").when(shop.isNotNull() & (shop != ""), "n_commercial_poi")


def style_key(highway: Column) -> Column:
    return F.replace(highway, F.lit("_link"), F.lit(""))


def is_closed_polygon(refs: Column) -> Column:
    return (F.size(refs) >= 4) & (F.element_at(refs, 1) == F.element_at(refs, -1))


def is_building(tags: Column) -> Column:
    return F.coalesce(F.map_contains_key(tags, "building"), F.lit(False))


def is_water(tags: Column) -> Column:
    return F.coalesce(tag(tags, "natural") == "water", F.lit(False)) | F.coalesce(tag(tags, "waterway").isin("riverbank", "dock"), F.lit(False)) | F.coalesce(tag(tags, "landuse") == "reservoir", F.lit(False))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pos, node, lon, lat) of a way's references in order; unknown nodes have null places."""
    r = ways.select("id", F.posexplode("refs").alias("pos", "node"))
    n = nodes.where("lon is not null and lat is not null").select(F.col("id").alias("node"), "lon", "lat")
    return r.join(n, "node", "left").select("id", "pos", "node", "lon", "lat")


def unresolved(points: DataFrame) -> DataFrame:
    """(id, n_missing): ways with references that no located node has."""
    return points.groupBy("id").agg(F.count_if(F.col("lon").isNull()).alias("n_missing")).where("n_missing > 0")


def segments(points: DataFrame) -> DataFrame:
    """(id, seq, ax, ay, bx, by): consecutive resolved vertices; the line bridges unresolved ones."""
    w = Window.partitionBy("id").orderBy("pos")
    p = points.where("lon is not null").withColumn("bx", F.lead("lon").over(w)).withColumn("by", F.lead("lat").over(w)).withColumn("seq", F.row_number().over(w))
    return p.where("bx is not null").select("id", "seq", F.col("lon").alias("ax"), F.col("lat").alias("ay"), "bx", "by")


def intersections(ways: DataFrame, least: int = 3) -> DataFrame:
    """Nodes that at least ``least`` different ways use."""
    r = ways.select("id", F.explode("refs").alias("node"))
    return r.groupBy("node").agg(F.count_distinct("id").alias("n_ways")).where(F.col("n_ways") >= least)


def way_centres(points: DataFrame) -> DataFrame:
    """(id, lon, lat): mean of resolved references; a closed way counts its first node twice (A10)."""
    return points.groupBy("id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count_if(F.col("lon").isNull()).alias("n_missing"))


def _span(lo: Column, hi: Column, step: float) -> Column:
    return F.sequence(F.floor(lo / step).cast("int"), F.floor(hi / step).cast("int"))


def cell_tiles(cells: DataFrame, step: float) -> DataFrame:
    """Cells once for every grid tile that their box touches."""
    b = geo.bounds(F.col("ring"))
    c = cells.withColumn("box", b)
    return c.withColumn("tx", F.explode(_span(F.col("box.x0"), F.col("box.x1"), step))).withColumn("ty", F.explode(_span(F.col("box.y0"), F.col("box.y1"), step)))


def points_in_cells(points: DataFrame, cells: DataFrame, step: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points with every cell that covers them, edges included: a point on a shared edge counts in both."""
    p = points.withColumn("tx", F.floor(F.col(x) / step).cast("int")).withColumn("ty", F.floor(F.col(y) / step).cast("int"))
    hit = p.join(cell_tiles(cells.select("h3_index", "ring"), step), ["tx", "ty"]).where(geo.covers(F.col("ring"), F.col(x), F.col(y)))
    return hit.drop("tx", "ty", "box", "ring")


def lengths_in_cells(segs: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """Segments with every cell they cross and the length inside, in the units of the projection."""
    s = segs.withColumn("tx", F.explode(_span(F.least("ax", "bx"), F.greatest("ax", "bx"), step))).withColumn("ty", F.explode(_span(F.least("ay", "by"), F.greatest("ay", "by"), step)))
    keys = ["id", "seq", "ax", "ay", "bx", "by"]
    pairs = s.join(cell_tiles(cells.select("h3_index", "ring"), step), ["tx", "ty"]).select(*keys, "h3_index", "ring").dropDuplicates(["id", "seq", "h3_index"])
    inside = geo.clipped_length(F.col("ring"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pairs.withColumn("length", inside).where("length > 0").drop("ring")


def once(segs: DataFrame) -> DataFrame:
    """Segments without those that a line retraces, in either direction (G5); partly overlapping ones stay."""
    a, b = (F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab")
    s = segs.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    return s.dropDuplicates(["id", "_lo", "_hi"]).drop("_lo", "_hi")


def lengths_by_class(pieces: DataFrame, key: str = "h3_index") -> DataFrame:
    """Length by road class, zero where there is none, and the major-road flag, of pieces ``(key, highway, length)``."""
    cls = road_class(F.col("highway"))
    sums = [F.coalesce(F.sum(F.when(cls == k, F.col("length"))), F.lit(0.0)).alias(f"road_length_{k}") for k in ("primary", "secondary", "residential")]
    return pieces.groupBy(key).agg(*sums, F.coalesce(F.bool_or(is_major(F.col("highway"))), F.lit(False)).alias("has_major_road"))


def trainable(cells: DataFrame) -> DataFrame:
    """Cells with a primary, secondary or greater road, which models are trained on."""
    return cells.where("has_major_road")


def boxes_join(a: DataFrame, b: DataFrame, box_a: str, box_b: str, step: float) -> DataFrame:
    """Rows of both tables whose boxes (x0, y0, x1, y1) overlap, touching included.

    Boxes meet in the tiles of a grid of ``step`` and are compared only in the tile of
    the lower left corner of their overlap, so each pair comes once.
    """
    tiled = lambda d, c: d.withColumn("_tx", F.explode(_span(F.col(f"{c}.x0"), F.col(f"{c}.x1"), step))).withColumn("_ty", F.explode(_span(F.col(f"{c}.y0"), F.col(f"{c}.y1"), step)))
    hit = tiled(a, box_a).join(tiled(b, box_b), ["_tx", "_ty"]).where(geo.boxes_meet(F.col(box_a), F.col(box_b)))
    corner = lambda v: F.floor(F.greatest(f"{box_a}.{v}", f"{box_b}.{v}") / step)
    return hit.where((F.col("_tx") == corner("x0")) & (F.col("_ty") == corner("y0"))).drop("_tx", "_ty")


def projected(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    u = geo.utm(F.col(lon), F.col(lat))
    return df.withColumn("_u", u).withColumn(x, F.col("_u.easting")).withColumn(y, F.col("_u.northing")).drop("_u")


def projected_ring(ring: Column) -> Column:
    def one(v: Column) -> Column:
        u = geo.utm(v[0], v[1])
        return F.array(u["easting"], u["northing"])

    return F.transform(ring, one)


def road_features(cells: DataFrame, nodes: DataFrame, ways: DataFrame, step: float = 2000.0) -> DataFrame:
    """Per cell: intersections, lengths by class, signals, crossings, major-road flag; zero where nothing is.

    ``cells`` has (h3_index, ring in degrees).
    """
    flat = cells.select("h3_index", projected_ring(F.col("ring")).alias("ring"))
    roads = eligible(ways)
    pts = way_points(roads, nodes)
    segs = segments(projected(pts.where("lon is not null")).select("id", "pos", F.col("x").alias("lon"), F.col("y").alias("lat")))
    lengths = lengths_by_class(lengths_in_cells(once(segs), flat, step).join(roads.select("id", "highway"), "id"))
    marks = nodes.select("id", "lon", "lat", is_signal(F.col("tags")).alias("signal"), is_crossing(F.col("tags")).alias("crossing"))
    marks = marks.join(intersections(roads).select(F.col("node").alias("id"), F.lit(True).alias("meet")), "id", "left").withColumn("meet", F.coalesce("meet", F.lit(False)))
    marks = projected(marks.where("(signal or crossing or meet) and lon is not null"))
    counts = points_in_cells(marks, flat, step).groupBy("h3_index").agg(F.count_if("meet").alias("n_intersections"), F.count_if("signal").alias("n_traffic_signals"), F.count_if("crossing").alias("n_crossings"))
    out = cells.select("h3_index").join(lengths, "h3_index", "left").join(counts, "h3_index", "left")
    zero = {c: 0 for c in ("n_intersections", "n_traffic_signals", "n_crossings")} | {f"road_length_{k}": 0.0 for k in ("primary", "secondary", "residential")}
    out = out.fillna(zero).withColumn("has_major_road", F.coalesce("has_major_road", F.lit(False)))
    for k in ("primary", "secondary", "residential"):
        out = out.withColumn(f"road_length_{k}", geo.round3(F.col(f"road_length_{k}")))
    return out.select("h3_index", "n_intersections", "road_length_primary", "road_length_secondary", "road_length_residential", "n_traffic_signals", "n_crossings", "has_major_road")


def clip_extract(ways: DataFrame, nodes: DataFrame, ring: Column) -> tuple[DataFrame, DataFrame]:
    """Ways with a node in a polygon, whole, and all their nodes."""
    inside = nodes.where(F.col("lon").isNotNull() & geo.covers(ring, F.col("lon"), F.col("lat"))).select(F.col("id").alias("node"))
    refs = ways.select("id", F.explode("refs").alias("node"))
    keep = ways.join(refs.join(inside, "node", "left_semi").select("id").distinct(), "id", "left_semi")
    used = keep.select(F.explode("refs").alias("id")).distinct()
    return keep, nodes.join(used, "id", "left_semi")
