"""Streaming twins of the batch operators: late-tolerant six-hour bins and exactly-once urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def six_hour_stream(hourly: DataFrame, ts: str, key: str, value: str, late: str = "12 hours") -> DataFrame:
    """Mean, sum, minimum, maximum and count by key and six-hour bin; rows later than ``late`` are left out."""
    rows = hourly.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    v = F.when(~F.isnan(value), F.col(value))
    out = rows.groupBy(F.col(key).alias("key"), F.window(ts, "6 hours").alias("w"))
    out = out.agg(F.avg(v).alias("mean"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("bin"), "mean", "total", "low", "high", "n")


def new_urls(entries: DataFrame, ts: str, url: str = "url", late: str = "30 days") -> DataFrame:
    """The first entry of each url within the watermark."""
    return entries.where(F.col(url).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark([url])


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Parquet sink that ends when the waiting input is done; restarts go on from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The groups that a batch changed, as one folder a batch, which a repeated batch writes again; the watermark frees the state of finished ones."""
    one = lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return stream.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each group that ``write_updates`` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Keeps the last row of each key in a table of versions: batch n writes version n from version n - 1, so a repeated batch writes the same."""

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = None
        if n > 0:
            before = spark.read.parquet(f"{path}/v={n - 1}")
        rows = batch if before is None else before.unionByName(batch)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*rows.columns))).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
