"""The crawl log: one JSON record a line, last record of a url wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts


def read_tolerant(spark: SparkSession, path: str, schema: str = contracts.MANIFEST) -> DataFrame:
    """Records of a log; blank and undecodable lines and records without url are left out."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"))
    return rows.where("r is not null and r.url is not null").select("r.*")


def read_strict(spark: SparkSession, path: str, schema: str = contracts.MANIFEST) -> DataFrame:
    """All records, repeats included; a bad line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key by the given columns. Window group limits keep the sort small."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def pending(candidates: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that the log does not have; null keys stay pending."""
    return candidates.join(done.select(key), key, "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of stored pages."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def with_pages(log: DataFrame, stored: DataFrame) -> DataFrame:
    """Records with their page; ``html`` is null where the file is missing. Undecodable bytes are replaced."""
    name = F.substring_index("path", "/", -1)
    files = stored.select(name.alias("_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    return log.withColumn("_file", name).join(files, "_file", "left").drop("_file")


def reason_counts(df: DataFrame, column: str) -> DataFrame:
    """(reason, n) of reasons joined by semicolons, empty ones left out."""
    return df.select(F.explode(F.split(column, ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def counters(df: DataFrame, by: list[str]) -> DataFrame:
    """Number of records by the given columns, such as batch and status."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def merge_copies(df: DataFrame, text: str, record: str, source: str) -> DataFrame:
    """(representative, n_copies, sources) of texts that stand more than once: the least record, and all sources in order."""
    d = df.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("_h"))
    d = d.agg(F.min(record).alias("representative"), F.count("*").alias("n_copies"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))
    return d.where("n_copies > 1").drop("_h")
