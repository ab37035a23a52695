"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
_CUTS: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "lotusgrid", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC as its zone and adaptive execution on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; it may be one file or a directory of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests), a temporary folder is made, set in the session and removed at exit;
    on a cluster an unset folder is an error, as machines would not see each other's parts.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lotusgrid-")
        _LOCAL_DIRS.append(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


@atexit.register
def _clean() -> None:
    for at in _LOCAL_DIRS:
        shutil.rmtree(at, ignore_errors=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``drop_cuts`` deletes what is there."""
    at = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _CUTS.append(at)
    return at


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends here: a lost executor costs a re-read, not a recomputation. The
    write is atomic through Spark's committer, and the shuffle files behind it are
    removed as soon as it is done.
    """
    spark = df.sparkSession
    at = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` wrote; DataFrames that read them end here. To be called when results are stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _CUTS:
        p = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        p.getFileSystem(conf).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that run at once, as far as the session knows."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in enough partitions for every core.

    A table of few files gives few tasks however large they are; then, and only then,
    its rows are shuffled by ``key``. The number of partitions never falls, and the files
    are listed only where there are few partitions.
    """
    cores = parallelism(df.sparkSession)
    parts = df.rdd.getNumPartitions()
    if parts >= cores and (parts >= 4 * cores or len(df.inputFiles()) >= cores):
        return df
    return df.repartition(max(parts, 2 * cores), key)
