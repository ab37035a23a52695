from pyspark.sql import functions as F

from lotusgrid.streaming import bins

SCHEMA = "url string, ts timestamp_ntz, v double"


def write(spark, path, rows, k):
    df = spark.createDataFrame(rows, "url string, t string, v double").select("url", F.to_timestamp_ntz("t").alias("ts"), "v")
    df.coalesce(1).write.mode("append").parquet(f"{path}/{k}")


def stream(spark, path):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def test_bins_with_late_rows(spark, tmp_path):
    src = str(tmp_path / "src")
    write(spark, src, [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 05:59:59", 3.0), ("a", "2024-01-01 06:00:00", float("nan")), (None, "2024-01-01 00:00:00", 1.0)], 1)
    write(spark, src, [("a", "2024-01-05 00:00:00", 1.0)], 2)
    write(spark, src, [("a", "2024-01-06 00:00:00", 1.0)], 3)  # the watermark drops late rows one batch after it has moved
    write(spark, src, [("a", "2024-01-01 01:00:00", 99.0), ("a", "2024-01-09 00:00:00", 1.0)], 4)
    q = bins.write_once(bins.six_hour_stream(stream(spark, src), "ts", "url", "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {str(r.bin): (r.mean, r.total, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 00:00:00"] == (2.0, 4.0, 2) and got["2024-01-01 06:00:00"] == (None, 0.0, 1)


def test_updates_keep_the_last_state(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    write(spark, src, [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 07:00:00", 5.0)], 1)
    write(spark, src, [("a", "2024-01-01 05:00:00", 3.0)], 2)
    for _ in range(2):
        bins.write_updates(bins.six_hour_stream(stream(spark, src), "ts", "url", "v"), out, cp).awaitTermination(120)
    got = {(r.key, str(r.bin)): (r.mean, r.n) for r in bins.read_updates(spark, out, ["key", "bin"]).collect()}
    assert got == {("a", "2024-01-01 00:00:00"): (2.0, 2), ("b", "2024-01-01 06:00:00"): (5.0, 1)}


def test_urls_once_and_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    write(spark, src, [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 01:00:00", 1.0)], 1)
    bins.write_once(bins.new_urls(stream(spark, src), "ts"), out, cp).awaitTermination(120)
    write(spark, src, [("a", "2024-01-02 00:00:00", 1.0), ("c", "2024-01-02 00:00:00", 1.0)], 2)
    bins.write_once(bins.new_urls(stream(spark, src), "ts"), out, cp).awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_upsert(spark, tmp_path):
    src = str(tmp_path / "src")
    write(spark, src, [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 2.0)], 1)
    write(spark, src, [("a", "2024-01-02 00:00:00", 5.0), ("b", "2023-01-01 00:00:00", 9.0)], 2)
    bins.upsert_latest(stream(spark, src), str(tmp_path / "t"), str(tmp_path / "cp"), "url", "ts").awaitTermination(120)
    assert {(r.url, r.v) for r in spark.read.parquet(str(tmp_path / "t" / "v=1")).collect()} == {("a", 5.0), ("b", 2.0)}
