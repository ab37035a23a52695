"""The panel: every cell in every six-hour bin, with weather and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timebin


def skeleton(cells: DataFrame, first: str, last: str) -> DataFrame:
    """(h3_index, bin) without holes, both days whole (J11). Bins are generated beside each cell, so nothing is shuffled or joined."""
    start, end = F.to_timestamp_ntz(F.lit(f"{first} 00:00:00")), F.to_timestamp_ntz(F.lit(f"{last} 18:00:00"))
    return cells.select("h3_index", F.explode(F.sequence(start, end, F.expr("interval 6 hours"))).alias("bin"))


def incident_counts(incidents: DataFrame, cell: str = "h3_index", bin_col: str = "bin") -> DataFrame:
    """(h3_index, bin, n_incidents)."""
    return incidents.where(F.col(cell).isNotNull() & F.col(bin_col).isNotNull()).groupBy(F.col(cell).alias("h3_index"), F.col(bin_col).alias("bin")).agg(F.count("*").alias("n_incidents"))


def build(cells: DataFrame, weather: DataFrame, incidents: DataFrame, first: str, last: str) -> DataFrame:
    """Skeleton with weather and counts; no incident means 0, label is whether there was one."""
    p = skeleton(cells, first, last).join(weather, ["h3_index", "bin"], "left").join(incident_counts(incidents), ["h3_index", "bin"], "left")
    p = p.withColumn("n_incidents", F.coalesce("n_incidents", F.lit(0)))
    return p.withColumn("label", (F.col("n_incidents") > 0).cast("int")).withColumn("is_covid_period", timebin.is_covid_period(F.col("bin")))
