"""Agreement and ranking metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, kappa; ratios are null where undefined. Rows with a null are not counted."""
    p, a = F.col(predicted).cast("boolean"), F.col(actual).cast("boolean")
    c = df.where(p.isNotNull() & a.isNotNull()).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    agree = (F.col("tp") + F.col("tn")) / F.nullif(n, F.lit(0))
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / F.nullif(n * n, F.lit(0))
    return c.select(
        "*",
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"),
        (F.lit(2.0) * F.col("tp") / F.nullif(F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"),
        ((agree - chance) / F.nullif(F.lit(1.0) - chance, F.lit(0.0))).alias("kappa"),
    )


def running_sums(df: DataFrame, order: str, values: list[str], buckets: int = 200) -> DataFrame:
    """``df`` with run_<value>: sums of all rows of no lower ``order`` (a number), and total_<value>.

    A running sum over everything in one window would be one task. Here rows fall into
    buckets of about equal size by quantiles; sums of whole buckets (at most
    ``buckets`` + 1 rows) are put before the sums within each.
    """
    cuts = df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.001) if buckets > 1 else []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    b = df.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= F.col(order).cast("double"))))
    sums = b.groupBy("_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("_b", *[F.coalesce(F.sum(f"_s_{v}").over(above), F.lit(0)).alias(f"_a_{v}") for v in values], *[F.sum(f"_s_{v}").over(whole).alias(f"total_{v}") for v in values])
    within = Window.partitionBy("_b").orderBy(F.col(order).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.join(F.broadcast(sums), "_b")
    for v in values:
        out = out.withColumn(f"run_{v}", F.sum(v).over(within) + F.col(f"_a_{v}"))
    return out.drop("_b", *[f"_a_{v}" for v in values])


def _by_score(df: DataFrame, score: str, actual: str) -> DataFrame:
    by = df.where(F.col(score).isNotNull() & F.col(actual).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(actual).cast("int")).alias("p"), F.count("*").alias("n"))
    return running_sums(by, "score", ["p", "n"])


def pr_curve(df: DataFrame, score: str, actual: str) -> DataFrame:
    """(score, tp, fp, precision, recall) at each distinct score; rows are summed by score first."""
    r = _by_score(df, score, actual)
    return r.select("score", F.col("run_p").alias("tp"), (F.col("run_n") - F.col("run_p")).alias("fp"), (F.col("run_p") / F.col("run_n")).alias("precision"), (F.col("run_p") / F.nullif("total_p", F.lit(0))).alias("recall"))


def average_precision(df: DataFrame, score: str, actual: str) -> DataFrame:
    """One row: the area under the curve, as a step function."""
    r = _by_score(df, score, actual)
    return r.agg(F.sum(F.col("p") / F.nullif("total_p", F.lit(0)) * F.col("run_p") / F.col("run_n")).alias("average_precision"))
