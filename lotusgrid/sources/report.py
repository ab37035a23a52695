"""Reports: survey sheet, metrics in Markdown, quality totals as JSON. One row or a sheet per run; the metrics are one aggregate."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

# Thresholds that headline shares have to exceed.
THRESHOLDS = {"parsed": 0.95, "kept": 0.40, "exact_time": 0.40, "precise": 0.70, "vehicle": 0.80}
MIN_CHARS = 200


def parsed_ok(text: Column) -> Column:
    """Whether a text is long enough to have been parsed (P4); null is not."""
    return F.coalesce(F.length(text) >= MIN_CHARS, F.lit(False))


def metrics(articles: DataFrame) -> DataFrame:
    """One row of counts over articles ``(parsed_ok, flags...)``; all but ``total`` and ``parsed`` over parsed ones."""
    ok = F.col("parsed_ok")
    n = lambda c: F.count_if(ok & c)
    level = lambda v: F.col("location_level") == v
    return articles.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("parsed"), n(F.col("has_exact_time")).alias("exact_time"), n(F.col("has_vague_time") & ~F.col("has_exact_time")).alias("vague_only"),
        n(level("precise")).alias("precise"), n(level("street")).alias("street"), n(level("coarse")).alias("coarse"), n(F.col("n_vehicle_types") > 0).alias("vehicle"),
        n(F.col("has_casualty")).alias("casualty"), n(F.col("casualty_numeric")).alias("casualty_number"), n(F.col("has_weather")).alias("weather"),
        n(F.col("filter_keep")).alias("kept"), n(F.col("filter_needs_review")).alias("review"),
    )


def verdicts(m: dict[str, int]) -> dict[str, str | None]:
    """OK where a share exceeds its threshold; None without a base."""
    base = {k: m["total"] if k == "parsed" else m["parsed"] for k in THRESHOLDS}
    return {k: None if not base[k] else "OK" if m[k] / base[k] > t else "CAN XEM LAI" for k, t in THRESHOLDS.items()}


def needed_articles(m: dict[str, int], incidents: int = 2000, per_incident: float = 1.4) -> int | None:
    """Articles to crawl for a number of incidents at the measured retention."""
    return round(incidents / (m["kept"] / m["parsed"]) * per_incident) if m["parsed"] and m["kept"] else None


def markdown(m: dict[str, int], reasons: list[tuple[str, int]], title: str = "Report") -> str:
    v = verdicts(m)
    percent = lambda n, total: f"{100 * n / total:.0f}%" if total else "n/a"
    lines = [f"# {title}", "", "| metric | n | share | verdict |", "|---|---|---|---|"]
    for k, n in m.items():
        if k != "total":
            lines.append(f"| {k} | {n} | {percent(n, m['total'] if k == 'parsed' else m['parsed'])} | {v.get(k) or ''} |")
    lines += ["", f"Articles: {m['total']}. Needed for 2,000 incidents: {needed_articles(m) or 'n/a'}.", "", "| reject reason | n |", "|---|---|"]
    lines += [f"| {r} | {n} |" for r, n in sorted(reasons, key=lambda x: (-x[1], x[0]))]
    return "\n".join(lines) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    """A sheet for review: one file, UTF-8 with byte order mark, so that spreadsheet programs read it. Rows stream through the driver."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in r])


def write_json(one_row: DataFrame, path: str) -> None:
    """Quality totals of a run."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(one_row.first().asDict(recursive=True), ensure_ascii=False, indent=2, default=str) + "\n")


def write_pages(df: DataFrame, path: str) -> None:
    """Raw pages ``(domain, sha1, html)``, partitioned by domain; stored pages are never changed, and one that is there is not added again (K5)."""
    new = df.select("domain", "sha1", "html").dropDuplicates(["domain", "sha1"])
    try:
        stored = df.sparkSession.read.parquet(path).select("domain", "sha1")
        new = new.join(stored, ["domain", "sha1"], "left_anti")
    except AnalysisException:  # nothing stored yet
        pass
    new.write.mode("append").partitionBy("domain").option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A table in place of the one that may be there (K1)."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_parsed(articles: DataFrame, path: str) -> None:
    """Parsed articles with their flags as JSON, one object a line, nulls written (K6)."""
    articles.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def utc_now() -> Column:
    """The present time, ISO 8601 with offset, whatever the session's zone (T5)."""
    sec = F.unix_seconds(F.current_timestamp())
    return F.concat(F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=sec.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
