"""Places of incidents from street names: crossings and kilometre markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut
from .roads import _span


def name_key(name: Column) -> Column:
    """Street names compared without case and with single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


#: Segments of a street in a tile that are tried first, for a bound on the answer.
FIRST = 16


def crossings(requests: DataFrame, segments: DataFrame, step: float = 200.0) -> DataFrame:
    """(request, x, y): where two named streets cross.

    ``requests(request, street_a, street_b)``, ``segments(name, ax, ay, bx, by)``. Segments
    of the two streets meet in grid tiles, then the crossing is computed; a pair that
    crosses more than once gives the first by place. Streets that do not meet give no row.

    Each two streets are worked out once, however many requests name them. The most western
    segments of every tile are tried first; then all segments that do not lie wholly east of
    the crossing found there.
    """
    s = segments.where("name is not null").select(name_key(F.col("name")).alias("k"), *[F.col(c).cast("double") for c in ("ax", "ay", "bx", "by")])
    tiled = lambda d: d.withColumn("tx", F.explode(_span(F.least("ax", "bx"), F.greatest("ax", "bx"), step))).withColumn("ty", F.explode(_span(F.least("ay", "by"), F.greatest("ay", "by"), step)))
    names = requests.select("street_a", "street_b").where("street_a is not null and street_b is not null").distinct()
    names = cut(names.withColumns({"ka": name_key(F.col("street_a")), "kb": name_key(F.col("street_b"))}), "crossing-names")
    asked = names.select("ka", "kb").distinct()
    order = Window.partitionBy("k", "tx", "ty").orderBy(F.least("ax", "bx"))
    first = tiled(s).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST)
    bound = _least(*[asked.join(first.withColumnRenamed("k", k), k) for k in ("ka", "kb")])
    x = F.col("at.x")  # a crossing is computed along one of its segments, so its place is rounded
    asked = asked.join(bound, ["ka", "kb"], "left").select("ka", "kb", (x + 1e-6 * (1 + F.abs(x))).alias("east"))
    kept = lambda k: tiled(asked.join(s.withColumnRenamed("k", k), k).where(F.col("east").isNull() | (F.least("ax", "bx") <= F.col("east"))))
    hit = names.join(_least(kept("ka"), kept("kb")), ["ka", "kb"]).select("street_a", "street_b", "at.*")
    hit = cut(hit.orderBy("x", "y").withColumn("n", F.monotonically_increasing_id()), "crossings")  # in order of place; its size is known then, and requests need no shuffle to meet a small one
    r = requests.select("request", "street_a", "street_b").join(hit, ["street_a", "street_b"])
    return r.groupBy("request").agg(*[F.min_by(c, "n").alias(c) for c in ("x", "y")])


def _least(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ka, kb, at): the first crossing by place of segments that two streets have in a tile."""
    ends = ("ax", "ay", "bx", "by")
    side = lambda d, k: d.select("ka", "kb", "tx", "ty", F.struct(*ends).alias(k))
    at = geo.intersection(*[F.col(f"{k}.{c}") for k in ("_a", "_b") for c in ends])
    hit = side(a, "_a").join(side(b, "_b"), ["ka", "kb", "tx", "ty"])
    return hit.withColumn("at", at).where("at is not null").groupBy("ka", "kb").agg(F.min("at").alias("at"))


def along(segments: DataFrame) -> DataFrame:
    """Segments ``(road, seq, ax, ay, bx, by)`` with the length before and after each."""
    d = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    w = Window.partitionBy("road").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = segments.withColumn("length", d).withColumn("after", F.sum("length").over(w))
    return s.withColumn("before", F.col("after") - F.col("length"))


def at_marker(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """(request, x, y): the point ``metres`` along a road. ``requests(request, road, metres)``; beyond the road's ends there is none."""
    hit = requests.select("request", "road", "metres").join(along(segments), "road")
    hit = hit.where((F.col("metres") >= F.col("before")) & (F.col("metres") <= F.col("after")))
    t = F.when(F.col("length") > 0, (F.col("metres") - F.col("before")) / F.col("length")).otherwise(0.0)
    p = hit.select("request", F.struct("seq", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y")).alias("p"))
    return p.groupBy("request").agg(F.min("p").alias("p")).select("request", "p.x", "p.y")


def precise(incidents: DataFrame, metres: float = 300.0) -> DataFrame:
    """Incidents whose place is known to that many metres; unknown precision does not pass."""
    return incidents.where(F.col("geo_confidence") <= metres)
