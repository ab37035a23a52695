"""Queries of the general data problems: near points, instants."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import near, times
from ..session import cut, spread, table

CITY_ZONE = "Asia/Ho_Chi_Minh"
CANONICAL_BIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+07:00$"


def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with one spelling of the id."""
    return table(spark, sf_dir, "cells").withColumn("h3_index", F.lower(F.trim("h3_index")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near.near_points(clean_cells(spark, sf_dir), 400.0, "h3_index", "centroid_lat", "centroid_lon", "resolution", (19.0, 24.0), (102.0, 110.0))
    return pairs.select(F.col("id_a").alias("h3_a"), F.col("id_b").alias("h3_b"))


P1_SQL = """
WITH p AS (
  SELECT resolution, lower(trim(h3_index)) AS h, min(centroid_lat) AS y, min(centroid_lon) AS x FROM cells
  WHERE centroid_lat BETWEEN 19 AND 24 AND centroid_lon BETWEEN 102 AND 110 GROUP BY 1, 2)
SELECT a.h AS h3_a, b.h AS h3_b FROM p a JOIN p b ON a.resolution = b.resolution AND a.h < b.h
WHERE abs(a.y - b.y) < 0.004 AND 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.y - a.y) / 2), 2)
  + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 400
"""


def p1_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which L-shaped regions (0.03 degrees wide, without their north-east quarter, around coarse cells' centres) contain each finest cell's centre."""
    cells = clean_cells(spark, sf_dir).where("centroid_lat between 19 and 24 and centroid_lon between 102 and 110")
    cells = cells.groupBy("h3_index", "resolution").agg(F.min("centroid_lat").alias("lat"), F.min("centroid_lon").alias("lon"))
    corner = lambda sx, sy: F.array(F.col("lon") + sx * 0.015, F.col("lat") + sy * 0.015)
    ring = F.array(*[corner(*c) for c in ((-1, -1), (1, -1), (1, 0), (0, 0), (0, 1), (-1, 1), (-1, -1))])
    regions = cells.where("resolution = 7").select(F.col("h3_index").alias("region"), ring.alias("ring"))
    points = cells.where("resolution = 9").select("h3_index", "lat", "lon")
    return near.containing_regions(points, regions, "h3_index", "lat", "lon", "region", "ring").select(F.col("id").alias("h3_index"), "region")


P1_CONTAINING_SQL = """
WITH c AS (
  SELECT resolution, lower(trim(h3_index)) AS h, min(centroid_lat) AS y, min(centroid_lon) AS x FROM cells
  WHERE centroid_lat BETWEEN 19 AND 24 AND centroid_lon BETWEEN 102 AND 110 GROUP BY 1, 2)
SELECT p.h AS h3_index, r.h AS region FROM c p JOIN c r ON p.resolution = 9 AND r.resolution = 7
 AND p.x BETWEEN r.x + -1 * 0.015 AND r.x + 1 * 0.015 AND p.y BETWEEN r.y + -1 * 0.015 AND r.y + 1 * 0.015
 AND (p.x <= r.x + 0 * 0.015 OR p.y <= r.y + 0 * 0.015)
"""


def manifest_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, site, wall, off, seen, tz) of the manifest's publication times; tz as declared, or null."""
    m = table(spark, sf_dir, "manifest")
    host = F.regexp_extract(F.lower(F.trim("url")), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    site = F.regexp_replace(host, r"^(?:www|m)\.", "")
    sites = table(spark, sf_dir, "sites").select("site", "tz", "date_order")
    m = m.select(F.col("record_id").alias("row_id"), site.alias("site"), "published_at", "fetched_at").where("published_at is not null")
    rows = spread(m.join(sites, "site", "left"), "row_id")
    t = times.parsed(F.col("published_at"), F.coalesce("date_order", F.lit("dmy")))
    seen = F.unix_seconds(F.try_to_timestamp("fetched_at"))
    rows = rows.withColumn("t", t).select("row_id", "site", "t.wall", "t.off", seen.alias("seen"), "tz").where("wall is not null")
    return cut(rows, "manifest-times")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones are estimated for all sites; the declared one is evidence, and the only one there is where a site gives no other."""
    m = manifest_times(spark, sf_dir)
    zones = times.estimate_zones(m, "site", "wall", "off", "seen", "tz")
    m = times.with_zones(m, zones, "site", "wall")
    sec = times.instants(F.col("wall"), F.col("off"), F.coalesce("zone", "tz"))
    a = m.select(F.lit("manifest").alias("tab"), "row_id", times.utc_text(sec).alias("utc"))
    w = table(spark, sf_dir, "weather").select(F.col("reading_id").alias("row_id"), "time_bin")
    w = w.where(F.col("time_bin").isNotNull() & ~F.col("time_bin").rlike(CANONICAL_BIN))
    w = w.withColumn("t", times.parsed(F.col("time_bin"), F.lit("dmy"))).where("t.wall is not null")
    sec = times.instants(F.col("t.wall"), F.col("t.off"), F.lit(CITY_ZONE))
    b = w.select(F.lit("weather").alias("tab"), "row_id", times.utc_text(sec).alias("utc"))
    return a.unionByName(b).where("utc is not null")


def p3_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's zone estimated with all declarations hidden, told by the offsets that it gives the site's own values without zone.

    ``offset_sum`` adds up wall-clock time less UTC, in seconds, over the values that fix an instant.
    """
    m = manifest_times(spark, sf_dir)
    declared = [r[0] for r in table(spark, sf_dir, "sites").select("tz").where(F.col("tz").isin(sorted(zoneinfo.available_timezones()))).groupBy("tz").count().orderBy(F.desc("count"), "tz").collect()]
    zones = times.estimate_zones(m, "site", "wall", "off", "seen", prefer=declared)
    m = times.with_zones(m.where("off is null"), zones, "site", "wall")
    sec = times.zone_instant(F.col("wall"), F.col("zone"))
    return m.withColumn("sec", sec).where("sec is not null").groupBy("site").agg(F.count("*").alias("n"), F.sum(F.col("wall") - F.col("sec")).alias("offset_sum"))


def p3_sql(result: str, all_bins: bool = False) -> str:
    """The same notations, calendars and zones in SQL (needs the database's zone tables)."""
    names = ["y", "mo", "d", "p", "q", "name", "h", "mi", "s", "half", "zone"]
    parts = []
    for rx in times.NOTATIONS:
        pattern = rx.pattern.replace("'", "''")
        groups = sorted(rx.groupindex, key=rx.groupindex.get)
        cols = ", ".join(f"g.{n} AS {n}" if n in groups else f"'' AS {n}" for n in names)
        keys = ", ".join(f"'{g}'" for g in groups)
        parts.append(f"SELECT tab, row_id, site, tz, ord, {cols} FROM (SELECT *, regexp_extract(v, '^(?:{pattern})$', [{keys}]) AS g FROM v WHERE regexp_full_match(v, '{pattern}'))")
    abbreviations = " ".join(f"WHEN '{k}' THEN {v * 3600}" for k, v in times.ABBREVIATIONS.items())
    site = "regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1), '^(?:www|m)\\.', '')"
    return f"""
    WITH v AS (
      SELECT 'manifest' AS tab, m.record_id AS row_id, trim(regexp_replace(published_at, '\\s+', ' ', 'g')) AS v, site, tz, coalesce(date_order, 'dmy') AS ord
      FROM (SELECT *, {site} AS site FROM manifest) m LEFT JOIN sites USING (site) WHERE published_at IS NOT NULL
      UNION ALL SELECT 'weather', reading_id, trim(time_bin), NULL, '{CITY_ZONE}', 'dmy' FROM weather WHERE time_bin IS NOT NULL AND ({str(all_bins).lower()} OR NOT regexp_matches(time_bin, '{CANONICAL_BIN}'))),
     g AS ({" UNION ALL ".join(parts)}),
     n AS (SELECT *, CASE WHEN name <> '' THEN list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(name[1:3])) WHEN mo <> '' THEN try_cast(mo AS INT) WHEN ord = 'mdy' THEN try_cast(p AS INT) ELSE try_cast(q AS INT) END AS month,
       CASE WHEN d <> '' THEN try_cast(d AS INT) WHEN ord = 'mdy' THEN try_cast(q AS INT) ELSE try_cast(p AS INT) END AS day, upper(replace(half, '.', '')) AS ap, replace(trim(zone, '()'), ' ', '') AS z FROM g),
     t AS (SELECT *, CASE WHEN ap = '' THEN try_cast(h AS INT) WHEN try_cast(h AS INT) BETWEEN 1 AND 12 THEN try_cast(h AS INT) % 12 + CASE WHEN ap IN ('PM', 'CH') THEN 12 ELSE 0 END ELSE 99 END AS hour,
       regexp_extract(z, '^(?:GMT|UTC)?([+-])(\\d{{1,2}}):?(\\d{{2}})?$', ['sign', 'oh', 'om']) AS o FROM n),
     w AS (SELECT tab, row_id, site, tz, z, try_cast(format('{{}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', y, month, day, hour, CASE WHEN mi = '' THEN 0 ELSE try_cast(mi AS INT) END, CASE WHEN s = '' THEN 0 ELSE try_cast(s AS INT) END) AS TIMESTAMP) AS ts,
       CASE WHEN o.oh <> '' THEN (try_cast(o.oh AS INT) * 3600 + CASE WHEN o.om = '' THEN 0 ELSE try_cast(o.om AS INT) END * 60) * CASE WHEN o.sign = '-' THEN -1 ELSE 1 END ELSE CASE z {abbreviations} END END AS off FROM t WHERE month IS NOT NULL AND hour < 24),
     u AS (SELECT *, timezone(tz, ts) AS u FROM w WHERE ts IS NOT NULL AND (z = '' OR off IS NOT NULL)),
     r AS (SELECT tab, row_id, site, z, ts, CASE WHEN z <> '' THEN ts - off * INTERVAL 1 SECOND
        WHEN timezone(tz, u) = ts AND timezone(tz, u + INTERVAL 1 HOUR) <> ts AND timezone(tz, u - INTERVAL 1 HOUR) <> ts THEN timezone('UTC', u) END AS inst FROM u
      UNION ALL SELECT tab, row_id, site, 'Z', NULL, make_timestamp(CASE WHEN length(v) = 13 THEN try_cast(v AS BIGINT) // 1000 ELSE try_cast(v AS BIGINT) END * 1000000) FROM v WHERE regexp_full_match(v, '\\d{{9,10}}|\\d{{13}}'))
    {result}"""


P3_FOUND = "SELECT tab, row_id, strftime(inst, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM r WHERE inst IS NOT NULL"
P3_ZONES = "SELECT site, count(*) AS n, sum(epoch(ts) - epoch(inst))::BIGINT AS offset_sum FROM r WHERE tab = 'manifest' AND z = '' AND inst IS NOT NULL GROUP BY 1"


QUERIES = {f.__name__: f for f in (p1_found, p1_containing, p3_found, p3_zones)}
SQL = {"p1_found": P1_SQL, "p1_containing": P1_CONTAINING_SQL, "p3_found": p3_sql(P3_FOUND), "p3_zones": p3_sql(P3_ZONES)}
