"""Table contracts and the checks that enforce them.

Checks return small DataFrames of what is wrong (empty when all is well);
``require`` turns one into an error. Types are those of the written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


MANIFEST = "url string, domain string, lastmod string, fetched_at string, sha1 string, path string, bytes long, batch string"
WARDS = "ward_id string, ward string, unit_type string, area_km2_source double, population_source long, density_source double, center_lon_source double, center_lat_source double, admin_geography_version string, geometry array<array<array<array<double>>>>"
CELLS = "h3_index string, resolution long, centroid_lat double, centroid_lon double, district string, ward string"
ROAD_FEATURES = "n_intersections long, road_length_primary double, road_length_secondary double, road_length_residential double, n_traffic_signals long, n_crossings long, has_major_road boolean"
POPULATION_FEATURES = "population double, population_density double, n_schools long, n_hospitals long, n_commercial_poi long"
WEATHER = "h3_index string, time_bin string, temp_mean double, precipitation_sum double, visibility_min double, wind_speed_max double, humidity_mean double"
INCIDENTS = (
    "incident_id string, source_urls array<string>, primary_url string, published_at string, occurred_at string, time_confidence string, location_text string, lat double, lon double, "
    "geo_confidence double, geo_method string, h3_r7 string, h3_r8 string, time_bin string, road_type string, vehicles_involved array<string>, fatalities int, injuries int, "
    "weather_mentioned string, cause_mentioned string, extraction_method string, raw_text string"
)
NODES = "id long, lon double, lat double, tags map<string,string>"
WAYS = "id long, tags map<string,string>, refs array<long>"
PIXELS = "row int, col int, lon double, lat double, value double"


class ContractError(ValueError):
    """A table breaks its contract."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their number (V1)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of nulls of each column (V5)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns that are absent (V4)."""
    return [c for c in wanted if c not in df.columns]


def wrong_group_sizes(df: DataFrame, key: str, expected: int, all_keys: DataFrame | None = None) -> DataFrame:
    """Keys with another number of rows than expected; with ``all_keys``, keys without any row as well (V6)."""
    n = df.groupBy(key).agg(F.count("*").alias("n_rows"))
    if all_keys is not None:
        n = all_keys.select(key).distinct().join(n, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return n.where(F.col("n_rows") != expected)


def distinct_per_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """Number of different keys of each group (A3, U4)."""
    return df.select(group, key).distinct().groupBy(group).agg(F.count("*").alias("n"))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys of one table that the other lacks; empty when the key sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    left = x.join(y, key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def absent_names(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Required names that no row has (V8)."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], f"`{column}` string")
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def coverage(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Share of rows that have a value."""
    g = df.groupBy(group) if group else df.groupBy()
    return g.agg((F.count(column) / F.count("*")).alias("coverage"), F.count("*").alias("n_rows"))


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    """The table when it has exactly one row, else an error (V2)."""
    n = len(df.limit(2).take(2))
    if n != 1:
        raise ContractError(f"{what}: {'no' if n == 0 else 'more than one'} match")
    return df


def require_whole_numbers(df: DataFrame, column: str) -> DataFrame:
    """The table when a column is of whole numbers of at most 64 bits."""
    kind = df.select(column).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ContractError(f"{column} must be of whole numbers, not {kind}: number the records first")
    return df


def require(bad: DataFrame, what: str) -> None:
    """An error when a check found anything."""
    rows = bad.take(3)
    if rows:
        raise ContractError(f"{what}: {rows}")


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    if absent := missing_columns(df, wanted):
        raise ContractError(f"missing columns: {absent}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table when it has a row (V3)."""
    if df.isEmpty():
        raise ContractError(f"{what} is empty")
    return df


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that is unique on both sides; columns of ``a`` first."""
    require(duplicate_keys(a, [key]), f"left {key} repeats")
    require(duplicate_keys(b, [key]), f"right {key} repeats")
    return a.join(b, key, "inner").select(*[a[c] for c in a.columns], *[b[c] for c in b.columns if c != key])


def of_resolution(df: DataFrame, resolution: int) -> DataFrame:
    """Rows of one resolution: cells of different resolutions overlap and are never summed together."""
    if not 0 <= resolution <= 15:
        raise ContractError(f"resolution {resolution} is not in 0..15")
    return df.where(F.col("resolution") == resolution)


def require_crs(crs: str, wanted: str = "EPSG:4326") -> None:
    """V7."""
    if crs.upper() != wanted:
        raise ContractError(f"{crs} is not {wanted}")
