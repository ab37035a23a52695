"""Population and points of interest of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import roads

CATEGORIES = ["n_schools", "n_hospitals", "n_commercial_poi"]


def zonal_sum(pixels: DataFrame, cells: DataFrame, step: float = 0.05) -> DataFrame:
    """(h3_index, population): sum of the pixels whose centre a cell covers, 0 where there is none."""
    valid = pixels.where("value is not null and not isnan(value)").select("lon", "lat", "value")
    hit = roads.points_in_cells(valid, cells, step, "lon", "lat").groupBy("h3_index").agg(F.sum("value").alias("population"))
    return cells.select("h3_index").join(hit, "h3_index", "left").withColumn("population", F.coalesce("population", F.lit(0.0)))


def poi_counts(nodes: DataFrame, ways: DataFrame, cells: DataFrame, step: float = 0.05) -> DataFrame:
    """Points of interest by category, nodes at their place and ways at the mean of their nodes."""
    cat = roads.poi_category(F.col("tags"))
    a = nodes.withColumn("category", cat).where("category is not null and lon is not null").select("lon", "lat", "category")
    w = ways.withColumn("category", cat).where("category is not null")
    centres = roads.way_centres(roads.way_points(w, nodes)).where("lon is not null")
    b = centres.join(w.select("id", "category"), "id").select("lon", "lat", "category")
    hit = roads.points_in_cells(a.unionByName(b), cells, step, "lon", "lat").groupBy("h3_index").pivot("category", CATEGORIES).count()
    return cells.select("h3_index").join(hit, "h3_index", "left").fillna(0, CATEGORIES)


def population_features(cells: DataFrame, pixels: DataFrame, nodes: DataFrame, ways: DataFrame, step: float = 0.05) -> DataFrame:
    """``cells`` has (h3_index, ring in degrees, area_km2). Density comes from the unrounded population (M2)."""
    p = zonal_sum(pixels, cells, step).join(cells.select("h3_index", "area_km2"), "h3_index")
    p = p.select("h3_index", geo.round3(F.col("population")).alias("population"), geo.round3(F.col("population") / F.col("area_km2")).alias("population_density"))
    return p.join(poi_counts(nodes, ways, cells, step), "h3_index").select("h3_index", "population", "population_density", *CATEGORIES)
