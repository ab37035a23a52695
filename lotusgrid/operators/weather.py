"""Hourly weather to six-hour bins of local time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts
from ..functions import timebin

# Fields of the hourly payload.
HOURLY = ["temperature_2m", "precipitation", "visibility", "wind_speed_10m", "relative_humidity_2m"]
PAYLOAD = "hourly struct<time: array<string>, " + ", ".join(f"{f}: array<double>" for f in HOURLY) + ">"


def decode_payload(payloads: DataFrame) -> DataFrame:
    """(h3_index, ts, fields) from parallel arrays of a payload."""
    arrays = [F.col("hourly.time").alias("time"), *[F.col(f"hourly.{f}").alias(f) for f in HOURLY]]
    z = payloads.select("h3_index", F.explode(F.arrays_zip(*arrays)).alias("z"))
    return z.select("h3_index", F.to_timestamp_ntz("z.time").alias("ts"), *[F.col(f"z.{f}") for f in HOURLY])


def six_hour(hourly: DataFrame, offset: str = "+07:00", counts: bool = False) -> DataFrame:
    """Means, sum, minimum and maximum by cell and six-hour bin (A1). NaN counts as missing, as do null keys. ``counts`` adds the number of rows, ``n_rows``."""
    v = {f: F.when(~F.isnan(f), F.col(f)) for f in HOURLY}
    rows = hourly.where("h3_index is not null and ts is not null").withColumn("bin", timebin.floor_bin(F.col("ts")))
    out = rows.groupBy("h3_index", "bin").agg(
        F.avg(v["temperature_2m"]).alias("temp_mean"), F.coalesce(F.sum(v["precipitation"]), F.lit(0.0)).alias("precipitation_sum"), F.min(v["visibility"]).alias("visibility_min"),
        F.max(v["wind_speed_10m"]).alias("wind_speed_max"), F.avg(v["relative_humidity_2m"]).alias("humidity_mean"), F.count("*").alias("n_rows"),
    )
    return out.select("h3_index", timebin.iso(F.col("bin"), offset).alias("time_bin"), "temp_mean", "precipitation_sum", "visibility_min", "wind_speed_max", "humidity_mean", *["n_rows"] * counts)


def checked(weather: DataFrame, cells: DataFrame, bins_each: int) -> DataFrame:
    """The table when its keys are unique, its core columns full and every cell has all bins, else an error."""
    contracts.require(contracts.duplicate_keys(weather, ["h3_index", "time_bin"]), "cell and bin repeat")
    core = ["h3_index", "time_bin", "temp_mean", "precipitation_sum", "wind_speed_max", "humidity_mean"]
    nulls = contracts.null_counts(weather, core)
    contracts.require(nulls.where(" or ".join(f"{c} > 0" for c in core)), "nulls")
    contracts.require(contracts.wrong_group_sizes(weather, "h3_index", bins_each, cells), "wrong number of bins")
    return weather


def quality(weather: DataFrame) -> DataFrame:
    """One row of totals."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in weather.columns]
    return weather.agg(
        F.count("*").alias("rows"), F.count_distinct("h3_index").alias("cells"), *nulls, F.min("temp_mean").alias("temp_min"), F.max("temp_mean").alias("temp_max"),
        F.sum("precipitation_sum").alias("precipitation_total"),
    )
