"""GeoJSON in and out. Polygons and MultiPolygons are read into one shape: polygons of rings of [lon, lat]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..functions import geo

_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(properties, kind, polygons) of each feature of collections, features and bare geometries."""
    raw = spark.read.text(path, wholetext=True).select("value")
    kind = F.get_json_object("value", "$.type")
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    one = F.when(kind == "FeatureCollection", features).when(kind == "Feature", F.array("value")).otherwise(F.array(F.to_json(F.named_struct(F.lit("type"), F.lit("Feature"), F.lit("geometry"), F.parse_json("value")))))
    f = raw.select(F.explode(one).alias("f"))
    g = F.get_json_object("f", "$.geometry")
    f = f.select(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object(g, "$.type").alias("kind"), F.get_json_object(g, "$.coordinates").alias("c"))
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", _POLYGON))).when(F.col("kind") == "MultiPolygon", F.from_json("c", _MULTI))
    return f.select("properties", "kind", polygons.alias("polygons"))


def single(spark: SparkSession, path: str) -> DataFrame:
    """The one area feature of a file; an error when there are more, none, or another kind."""
    df = contracts.exactly_one(read(spark, path), path)
    contracts.require(df.where("polygons is null"), f"{path} is no area")
    return df


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(h3_index, resolution, ring) of cell polygons; every feature needs its index."""
    df = read(spark, path).select(F.col("properties")["h3_index"].alias("h3_index"), F.col("properties")["resolution"].cast("int").alias("resolution"), F.col("polygons")[0][0].alias("ring"))
    contracts.require_rows(df, path)
    contracts.require(df.where("h3_index is null"), "a cell without index")
    return df


def wards(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Wards of a source file, in the contract's columns; each source ring becomes a polygon of its own."""
    schema = "wards array<struct<id: string, name: string, type: string, area: double, population: bigint, density: double, center: array<double>, polygons: array<array<array<double>>>>>"
    w = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("wards").alias("w")).select("w.*")
    return w.select(
        F.col("id").alias("ward_id"), F.col("name").alias("ward"), F.col("type").alias("unit_type"), F.col("area").alias("area_km2_source"), F.col("population").alias("population_source"),
        F.col("density").alias("density_source"), F.col("center")[0].alias("center_lon_source"), F.col("center")[1].alias("center_lat_source"), F.lit(version).alias("admin_geography_version"),
        geo.multipolygon(F.col("polygons")).alias("geometry"),
    )


def check_wards(df: DataFrame, expected: int = 126, required: tuple[str, ...] = ("Từ Liêm", "Xuân Phương")) -> DataFrame:
    """The wards when there are as many as expected, each with an own id, an own name and polygons, and the required ones among them; else an error."""
    n = df.count()
    if n != expected:
        raise contracts.ContractError(f"{n} wards, not {expected}")
    contracts.require(df.where("ward is null or ward = '' or size(geometry) < 1 or exists(geometry, p -> exists(p, r -> r is null))"), "a ward without name or polygons")
    for key in ("ward", "ward_id"):
        contracts.require(contracts.duplicate_keys(df.where(F.col(key).isNotNull()), [key]), f"{key} repeats")
    contracts.require(contracts.absent_names(df, "ward", list(required)), "a required ward is missing")
    return df


def select_ward(df: DataFrame, name: str | None = None, ward_id: str | None = None) -> DataFrame:
    """The one ward of a name or of an id, which is compared as text (P5)."""
    if (name is None) == (ward_id is None):
        raise ValueError("either a name or an id")
    hit = df.where(F.col("ward") == name) if name is not None else df.where(F.col("ward_id").cast("string") == ward_id)
    return contracts.exactly_one(hit, f"ward {name or ward_id}")


def select_province(df: DataFrame, gid: str = "VNM.27_1") -> DataFrame:
    """The one feature of ``read`` whose province id is ``gid``."""
    return contracts.exactly_one(df.where(F.col("properties")["GID_1"] == gid), f"province {gid}")


def closed(ring: str) -> Column:
    return F.concat(F.col(ring), F.slice(ring, 1, 1))


def feature(ring: Column, properties: list[str]) -> Column:
    """A feature's text, compact."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")), {"ignoreNullFields": "false"})


def write(df: DataFrame, path: str, properties: list[str], ring: str = "ring") -> None:
    """One feature collection in one file. A boundary or grid file is read whole by its users, so one task writes it, streaming."""
    f = df.select(feature(F.col(ring), properties).alias("f")).coalesce(1)

    def lines(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        yield pd.DataFrame({"value": ['{"type":"FeatureCollection","features":[']})
        first = True
        for b in batches:
            out = []
            for x in b["f"]:
                out.append(x if first else "," + x)
                first = False
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["]}"]})

    f.mapInPandas(lines, "value string").write.mode("overwrite").text(path)
