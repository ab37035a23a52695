"""Queries of the engine's own operators over the test tables, with their SQL.

Timestamps without zone are compared as text, doubles rounded to fixed places.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts
from ..functions import geo, render, text, timebin
from ..functions import lexicon as L
from ..operators import evaluate, geocode, panel, population, roads, times, weather
from ..session import shared_path, spread, table
from ..sources import manifest, report, sitemap
from ..streaming import bins
from .problems import p3_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _lit(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


ISO = "yyyy-MM-dd'T'HH:mm:ss"
CITY_ZONE = "Asia/Ho_Chi_Minh"


# ---------------------------------------------------------------- time bins, weather, panel


@query("""
SELECT user_id, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%dT%H:%M:%S') || '+07:00' AS bin, round(avg(value), 6) AS temp_mean,
 round(sum(value), 6) AS precipitation_sum, round(min(value), 6) AS visibility_min, round(max(value), 6) AS wind_speed_max, count(*) AS n_rows
FROM events GROUP BY 1, 2""")
def q_timebin_6h_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A1 over the events' value as every hourly field."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("h3_index"), "ts", *[F.col("value").alias(f) for f in weather.HOURLY])
    out = weather.six_hour(e, counts=True).withColumnsRenamed({"h3_index": "user_id", "time_bin": "bin"})
    return out.select("user_id", "bin", *[r6(c).alias(c) for c in ("temp_mean", "precipitation_sum", "visibility_min", "wind_speed_max")], "n_rows")


@query("""
SELECT user_id AS key, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%dT%H:%M:%S') AS bin, round(avg(value), 6) AS mean, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high, count(*) AS n
FROM events GROUP BY 1, 2""")
def q_stream_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming twin of the bins, run over the table as a stream until its input is used up."""
    path = shared_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    at = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    rows = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet").withColumn("ts", at)  # a pattern: a stream does not take the name of one file
    q = bins.write_updates(bins.six_hour_stream(rows, "ts", "user_id", "value"), f"{path}/table", f"{path}/state")
    q.awaitTermination()
    wall = timebin.local_wall(F.col("bin"), "UTC")
    return bins.read_updates(spark, f"{path}/table", ["key", "bin"]).select("key", F.date_format(wall, ISO).alias("bin"), r6("mean").alias("mean"), r6("total").alias("total"), "low", "high", "n")


@query("SELECT DISTINCT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%dT%H:%M:%S') || '+07:00' AS time_bin FROM events")
def q_timebin_iso(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(timebin.iso(timebin.floor_bin(F.col("ts"))).alias("time_bin")).distinct()


@query(p3_sql(f"""
, b AS (SELECT row_id, strftime(time_bucket(INTERVAL '6 hours', inst + INTERVAL 7 HOUR), '%Y-%m-%dT%H:%M:%S') || '+07:00' AS time_bin FROM r WHERE tab = 'weather' AND inst IS NOT NULL)
SELECT h3_index, b.time_bin, round(avg(temp_mean), 6) AS temp_mean, round(coalesce(sum(precipitation_sum), 0), 6) AS precipitation_sum, round(min(visibility_min), 6) AS visibility_min,
 round(max(wind_speed_max), 6) AS wind_speed_max, round(avg(humidity_mean), 6) AS humidity_mean, count(*) AS n_rows FROM weather w JOIN b ON b.row_id = w.reading_id WHERE h3_index IS NOT NULL GROUP BY 1, 2""", all_bins=True))
def q_weather_bins(spark: SparkSession, sf: str) -> DataFrame:
    """A1 over the weather table: readings of a cell and bin are united, in whatever notation the bin is written."""
    w = table(spark, sf, "weather").withColumn("t", times.parsed(F.col("time_bin"), F.lit("dmy")))
    sec = times.instants(F.col("t.wall"), F.col("t.off"), F.lit(CITY_ZONE))
    fields = dict(zip(weather.HOURLY, ("temp_mean", "precipitation_sum", "visibility_min", "wind_speed_max", "humidity_mean")))
    hourly = w.withColumn("ts", timebin.local_wall(F.timestamp_seconds(sec), CITY_ZONE)).select("h3_index", "ts", *[F.col(c).alias(f) for f, c in fields.items()])
    out = weather.six_hour(hourly, counts=True)
    return out.select("h3_index", "time_bin", *[r6(c).alias(c) for c in fields.values()], "n_rows")


@query("SELECT o_orderkey, year(o_orderdate) + 27 IN (2020, 2021) AS is_covid_period FROM orders")
def q_covid_flag(spark: SparkSession, sf: str) -> DataFrame:
    """T6 over the orders' days, 27 years later, so that both values come up."""
    later = F.add_months("o_orderdate", 27 * 12)
    return table(spark, sf, "orders").select("o_orderkey", timebin.is_covid_period(later).alias("is_covid_period"))


@query("""
SELECT count(*) AS rows, count(DISTINCT h3_index) AS cells, count(*) - count(h3_index) AS null_h3_index, count(*) - count(time_bin) AS null_time_bin, count(*) - count(temp_mean) AS null_temp_mean,
 count(*) - count(precipitation_sum) AS null_precipitation_sum, count(*) - count(visibility_min) AS null_visibility_min, count(*) - count(wind_speed_max) AS null_wind_speed_max,
 count(*) - count(humidity_mean) AS null_humidity_mean, min(temp_mean) AS temp_min, max(temp_mean) AS temp_max, round(sum(precipitation_sum), 4) AS precipitation_total FROM weather""")
def q_weather_quality(spark: SparkSession, sf: str) -> DataFrame:
    cols = [c.split()[0] for c in contracts.WEATHER.split(", ")]
    return weather.quality(table(spark, sf, "weather").select(*cols)).withColumn("precipitation_total", r6("precipitation_total", 4))


@query("""
WITH b AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS bin FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS n_rows FROM b GROUP BY 1 HAVING count(*) <> 52""")
def q_bins_per_key_check(spark: SparkSession, sf: str) -> DataFrame:
    bins = table(spark, sf, "events").select("user_id", timebin.floor_bin(F.col("ts")).alias("bin")).distinct()
    return contracts.wrong_group_sizes(bins, "user_id", timebin.expected_bins(datetime.date(2024, 1, 1), datetime.date(2024, 1, 13)))


@query("""
WITH c AS (SELECT DISTINCT user_id FROM events), t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 18:00:00', INTERVAL '6 hours')) AS bin),
 n AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS bin, count(*) AS n FROM events WHERE event_type = 'error' OR value > 150 GROUP BY 1, 2),
 w AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS bin, round(avg(value), 6) AS temp_mean FROM events GROUP BY 1, 2)
SELECT c.user_id AS h3_index, strftime(t.bin, '%Y-%m-%dT%H:%M:%S') AS bin, w.temp_mean, coalesce(n.n, 0) AS n_incidents, CASE WHEN n.n > 0 THEN 1 ELSE 0 END AS label, year(t.bin) IN (2020, 2021) AS is_covid_period
FROM c CROSS JOIN t LEFT JOIN w ON w.user_id = c.user_id AND w.bin = t.bin LEFT JOIN n ON n.user_id = c.user_id AND n.bin = t.bin""")
def q_panel(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("bin", timebin.floor_bin(F.col("ts"))).withColumnRenamed("user_id", "h3_index")
    cells = e.select("h3_index").distinct()
    w = e.groupBy("h3_index", "bin").agg(r6(F.avg("value")).alias("temp_mean"))
    p = panel.build(cells, w, e.where("event_type = 'error' or value > 150"), "2024-01-01", "2024-01-30")
    return p.withColumn("bin", F.date_format("bin", ISO))


# ---------------------------------------------------------------- crawl log


@query("SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) UNION ALL SELECT count(*) FROM manifest m WHERE m.record_id % 2 = 0")
def q_anti_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have no vector yet, and (second row) crawled records beside a log of the odd ones."""
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "url")
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("url"))
    a = manifest.pending(d, done).agg(F.count("*").alias("n"))
    m = table(spark, sf, "manifest").withColumnRenamed("url", "address").withColumnRenamed("record_id", "url")
    return a.unionByName(manifest.pending(m, m.where("url % 2 <> 0")).agg(F.count("*").alias("n")))


@query("""
SELECT record_id, url, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, record_id DESC) AS k FROM manifest) WHERE k = 1""")
def q_manifest_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.last_wins(table(spark, sf, "manifest"), "url", ["fetched_at", "record_id"]).select("record_id", "url", "fetched_at")


@query("SELECT url FROM (SELECT DISTINCT url FROM manifest) ORDER BY sha1('2023|' || url), url LIMIT 50")
def q_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return text.seeded_sample(table(spark, sf, "manifest").select("url").distinct(), "url", 50, "2023")


@query("SELECT record_id, sha1(url) AS key, sha1 = sha1(url) AS same FROM manifest")
def q_sha1_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "manifest").select("record_id", text.sha1_key(F.col("url")).alias("key"), (F.col("sha1") == text.sha1_key(F.col("url"))).alias("same"))


@query("SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority, count(*) AS n FROM manifest GROUP BY 1")
def q_url_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "manifest").groupBy(text.url_authority(F.col("url")).alias("authority")).agg(F.count("*").alias("n"))


TOKENS_SQL = """list_filter(string_split(regexp_replace(split_part(rtrim(split_part(lower(url), '?', 1), '/'), '/', -1), '\\.(html?|antd|aspx?)$', ''), '-'), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$'))"""


@query(f"SELECT record_id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM manifest")
def q_slug_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "manifest").select("record_id", F.array_join(text.slug_tokens(F.col("url")), " ").alias("tokens"))


def _any(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, ' {p} ')" for p in phrases) + ")"


SLUG_SQL = f"""
WITH t AS (SELECT record_id, split_part(lower(url), '?', 1) AS path, ' ' || array_to_string({TOKENS_SQL}, ' ') || ' ' AS j FROM manifest)
SELECT record_id, NOT ({" OR ".join(f"contains(path, '{x}')" for x in L.SLUG_EXCLUDE)}) AND ({_any("j", L.SAFE_PHRASES)} OR ({_any("j", [*L.VEHICLE_TOKENS, "o to"])} AND {_any("j", L.GATED_PHRASES)})) AS passes FROM t"""


@query(SLUG_SQL)
def q_slug_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "manifest").select("record_id", text.slug_passes(F.col("url")).alias("passes"))


@query("SELECT lang, count(*) AS n FROM (SELECT lower(coalesce(lang, 'und')) AS lang FROM documents UNION ALL SELECT lang FROM eval_items) GROUP BY 1")
def q_sitemap_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union of entries without removing repeats."""
    a = table(spark, sf, "documents").select(F.lower(F.coalesce("lang", F.lit("und"))).alias("lang"))
    return sitemap.union_entries([a, table(spark, sf, "eval_items").select("lang")]).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 5")
def q_last5_children(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap.last_children(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey", "k")


@query("SELECT url, batch, CASE WHEN record_id % 7 = 0 THEN 'failed' WHEN body IS NULL THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT record_id, body, batch, split_part(url, '://', 1) AS url FROM manifest) GROUP BY 1, 2, 3")
def q_crawl_counters(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("record_id") % 7 == 0, "failed").when(F.col("body").isNull(), "skipped").otherwise("ok")
    m = table(spark, sf, "manifest").select(F.substring_index("url", "://", 1).alias("url"), "batch", status.alias("status"))
    return manifest.counters(m, ["url", "batch", "status"])


# ---------------------------------------------------------------- article text


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    m = spread(table(spark, sf, "manifest").select("record_id", "title", "body"), "record_id")
    return m.select("record_id", text.nfc(F.col("title")).alias("title"), text.nfc(F.col("body")).alias("body"))


NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def re2(pattern: str, fold: bool = True) -> str:
    """A pattern in the database's dialect, which has neither Unicode word bounds nor a look ahead."""
    p = pattern.replace(r"(?:khoảng\s+)?\b", r"\b").replace("(?! tải)", r"(?:$|[^ ]| (?:$|[^tT]|[tT](?:$|[^ảẢ]|[ảẢ](?:$|[^iI]))))")
    p = p.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")
    if p.startswith(r"\b"):
        p = f"(?:^|{NOT_WORD})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + f"(?:$|{NOT_WORD})"
    return ("(?i)" if fold else "") + p.replace("'", "''")


def _test(column: str, pattern: str, fold: bool = True) -> str:
    return f"regexp_matches({column}, '{re2(pattern, fold)}')"


def _hits(words: list[str]) -> str:
    return f"list_filter({_lit(words)}, lambda w: contains(low, lower(w)))"


_KINDS = ", ".join(f"CASE WHEN {_test('t', p)} THEN '{k}' END" for k, p in L.VEHICLE_CLASSES.items())
FLAGS_SQL = f"""
WITH x AS (SELECT record_id, url, coalesce(nfc_normalize(title), '') AS ti, coalesce(nfc_normalize(body), '') AS b FROM manifest),
 a AS (SELECT record_id, url, ti || chr(10) || b AS t, b, ti || chr(10) || b[1:600] AS t6, lower(ti || chr(10) || b[1:400]) AS low FROM x),
 p AS (SELECT *, {_test("t", L.CRASH_VERB)} AS verb, {_test("t", L.VEHICLE)} AS vehicle, {_test("t6", L.AGGREGATE)} AS agg, {_test("t", L.TRANSFER)} AS moved, {_hits(L.DISTRICTS)} AS d, {_hits(L.LANDMARKS)} AS m, {_hits(L.PROVINCES)} AS o,
   list_filter([{_KINDS}], lambda k: k IS NOT NULL) AS kinds FROM a),
 s AS (SELECT *, (len(d) + len(m)) * 3 + CASE WHEN contains(low, '{L.CITY}') AND NOT moved THEN 1 ELSE 0 END AS here, len(o) * 3 AS there, len(d) + len(m) > 0 AS strong, verb AND vehicle AND NOT agg AS acc FROM p),
 v AS (SELECT *, CASE WHEN moved AND NOT strong THEN 'other_province' WHEN here > there THEN 'hanoi' WHEN there > here THEN 'other_province' ELSE 'unknown' END AS verdict,
   CASE WHEN moved AND NOT strong THEN 'medium' WHEN here = 0 AND there > 0 THEN 'high' WHEN here > 0 AND there = 0 THEN CASE WHEN strong THEN 'high' ELSE 'low' END WHEN here <> there THEN 'medium' ELSE 'low' END AS conf FROM s),
 f AS (SELECT record_id, url, length(b) AS n_chars, {_test("t", L.EXACT_TIME)} AS has_exact_time, {_test("t", L.VAGUE_TIME)} AS has_vague_time, {_test("t", L.DATE, False)} AS has_date,
   CASE WHEN {_test("t", L.LOC_PRECISE)} THEN 'precise' WHEN {_test("t", L.STREET, False)} THEN 'street' WHEN {_test("t", L.LOC_COARSE)} THEN 'coarse' ELSE 'none' END AS location_level,
   array_to_string(kinds, ';') AS vehicles, len(kinds)::INT AS n_vehicle_types, {_test("t", L.CASUALTY)} AS has_casualty, {_test("t", L.CASUALTY_NUMBER)} AS casualty_numeric, {_test("t", L.WEATHER)} AS has_weather,
   acc AND verdict = 'hanoi' AS filter_keep, acc AND (verdict = 'unknown' OR (verdict = 'hanoi' AND conf = 'low')) AS filter_needs_review, acc AS filter_is_accident, verdict AS filter_location_verdict, conf AS filter_location_confidence,
   array_to_string(list_filter([CASE WHEN NOT verb THEN '{L.NO_VERB}' END, CASE WHEN NOT vehicle THEN '{L.NO_VEHICLE}' END, CASE WHEN agg THEN '{L.IS_AGGREGATE}' END, CASE WHEN acc AND verdict <> 'hanoi' THEN '{L.AREA}' || verdict END], lambda r: r IS NOT NULL), ';') AS filter_reject_reasons,
   array_to_string(d[1:3], ';') AS hanoi_districts FROM v)"""


@query(f"""{FLAGS_SQL}, u AS ({SLUG_SQL})
SELECT record_id, filter_keep AS keep, filter_needs_review AS needs_review, filter_is_accident AS is_accident, filter_location_verdict AS location_verdict, filter_location_confidence AS location_confidence, filter_reject_reasons AS reject_reasons
FROM f JOIN u USING (record_id) WHERE u.passes""")
def q_two_tier_filter(spark: SparkSession, sf: str) -> DataFrame:
    """P1 before P3: the cheap url test first, then the text tests, all in one plan."""
    m = table(spark, sf, "manifest").where(text.slug_passes(F.col("url"))).select("record_id", "title", "body")
    m = spread(m, "record_id")
    m = text.classified(m.select("record_id", text.nfc(F.col("title")).alias("title"), text.nfc(F.col("body")).alias("body")))
    return m.select("record_id", "keep", "needs_review", "is_accident", "location_verdict", "location_confidence", F.array_join("reject_reasons", ";").alias("reject_reasons"))


@query(f"{FLAGS_SQL} SELECT record_id, {', '.join(text.FLAGS)} FROM f")
def q_feature_flags(spark: SparkSession, sf: str) -> DataFrame:
    """the sixteen flags of every article."""
    return text.analysed(_articles(spark, sf)).select("record_id", *text.FLAGS)


_HITS = lambda words: f"len(list_filter({_lit(words)}, lambda w: contains(lower(head), lower(w))))"


@query(f"""
WITH h AS (SELECT record_id, coalesce(nfc_normalize(title), '') || chr(10) || coalesce(nfc_normalize(body), '')[1:400] AS head FROM manifest),
 s AS (SELECT record_id, {_HITS(L.DISTRICTS)} * 3 + {_HITS(L.LANDMARKS)} * 3 AS score_here, {_HITS(L.PROVINCES)} * 3 AS score_there FROM h)
SELECT record_id, score_here, score_there, CASE WHEN score_here > score_there THEN 'hanoi' WHEN score_there > score_here THEN 'other_province' ELSE 'unknown' END AS verdict FROM s""")
def q_lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    """F7's weighted lists with duplicates, without the bare city name, whose context test has no SQL twin."""
    a = _articles(spark, sf).select("record_id", F.lower(text.glue(F.col("title"), F.col("body"), 400)).alias("low"))
    hits = lambda words: F.size(text.found_words(F.col("low"), words))
    s = a.select("record_id", (hits(L.DISTRICTS) * 3 + hits(L.LANDMARKS) * 3).alias("score_here"), (hits(L.PROVINCES) * 3).alias("score_there"))
    verdict = F.when(F.col("score_here") > F.col("score_there"), "hanoi").when(F.col("score_there") > F.col("score_here"), "other_province").otherwise("unknown")
    return s.withColumn("verdict", verdict)


@query("SELECT doc_id, md5(text[1:400]) AS head_400, md5(text[1:600]) AS head_600, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def q_head_truncate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.md5(text.head(F.col("text"), 400)).alias("head_400"), F.md5(text.head(F.col("text"), 600)).alias("head_600"), F.length("text").alias("n_chars"))


REASONS_SQL = """list_filter([CASE WHEN title IS NULL THEN 'no title' END, CASE WHEN body IS NULL OR length(body) < 200 THEN 'short body' END,
 CASE WHEN NOT contains(url, 'https://') THEN 'plain http' END, CASE WHEN lastmod IS NULL THEN 'no lastmod' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest({REASONS_SQL}) AS reason FROM manifest) GROUP BY 1")
def q_reject_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A12 over reasons joined by semicolons."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(c("title").isNull(), "no title"), F.when(c("body").isNull() | (F.length("body") < 200), "short body"),
        F.when(~F.contains(c("url"), F.lit("https://")), "plain http"), F.when(c("lastmod").isNull(), "no lastmod"),
    ))
    return manifest.reason_counts(table(spark, sf, "manifest").select(F.array_join(reasons, ";").alias("reject_reasons")), "reject_reasons")


_COUNTED = {
    "exact_time": "has_exact_time", "vague_only": "has_vague_time AND NOT has_exact_time", "precise": "location_level = 'precise'", "street": "location_level = 'street'", "coarse": "location_level = 'coarse'", "vehicle": "n_vehicle_types > 0",
    "casualty": "has_casualty", "casualty_number": "casualty_numeric", "weather": "has_weather", "kept": "filter_keep", "review": "filter_needs_review",
}


@query(f"""{FLAGS_SQL}, k AS (SELECT *, n_chars >= 200 AS parsed FROM f),
 m AS (SELECT count(*) AS total, count(*) FILTER (parsed) AS parsed, {", ".join(f"count(*) FILTER (parsed AND {c}) AS {n}" for n, c in _COUNTED.items())} FROM k)
SELECT *, round_even(100.0::DOUBLE * parsed / total, 0)::BIGINT || '%' AS pct_parsed, round_even(100.0::DOUBLE * kept / parsed, 0)::BIGINT || '%' AS pct_kept FROM m""")
def q_pilot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One global aggregate of conditional counts over the flags, and per cents."""
    a = text.analysed(_articles(spark, sf)).withColumn("parsed_ok", report.parsed_ok(F.col("body")))
    return report.metrics(a).select("*", text.pct(F.col("parsed"), F.col("total")).alias("pct_parsed"), text.pct(F.col("kept"), F.col("parsed")).alias("pct_kept"))


@query("""
WITH m AS (SELECT record_id, coalesce(title, '') AS ti, body FROM manifest WHERE body IS NOT NULL),
 t AS (SELECT record_id, ti, regexp_replace(regexp_replace(ti || chr(10) || body, '[ \t\x0b\f\r]+', ' ', 'g'), '\\s*\n\\s*', chr(10), 'g') AS t FROM m)
SELECT record_id, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS n_chars, trim(regexp_replace(ti, '\\s+', ' ', 'g')) AS title, '2024-05-01' AS date FROM t""")
def q_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """S15 over pages made of the manifest's fields, between a menu and a footer."""
    c = F.coalesce("title", F.lit(""))
    html = F.concat(
        F.lit("<html><head><title>"), c, F.lit("</title><meta property='article:published_time' content='2024-05-01'><script>var x = 1;</script></head><body><nav>Menu <a href='/'>x</a></nav><p>"),
        F.replace("body", F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p><footer>&copy; x</footer></body></html>"),
    )
    m = table(spark, sf, "manifest").where("body is not null").withColumn("html", html).withColumn("meta", text.page_meta(F.col("html")))
    return m.select("record_id", F.length(text.html_text(F.col("html"))).alias("n_chars"), "meta.title", "meta.date")


@query("""
WITH t AS (SELECT md5(text) AS h, min(doc_id) AS representative, count(*) AS n_copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT representative, n_copies, sources FROM t WHERE n_copies > 1""")
def q_exact_dup_merge(spark: SparkSession, sf: str) -> DataFrame:
    """J15 (exact), A18: copies of one text merged to one row with all its sources."""
    return manifest.merge_copies(table(spark, sf, "documents"), "text", "doc_id", "source")


# ---------------------------------------------------------------- evaluation


LABELS_SQL = "SELECT l_orderkey % 100 AS score, l_quantity > 25 AS predicted, l_extendedprice > 40000 AS actual FROM lineitem"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 100).alias("score"), (F.col("l_quantity") > 25).alias("predicted"), (F.col("l_extendedprice") > 40000).alias("actual"))


@query(f"""
WITH l AS ({LABELS_SQL}), c AS (SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn,
 count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM l), n AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c),
 k AS (SELECT *, (tp + tn) / n AS agree, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n * n) AS chance FROM n)
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((agree - chance) / (1 - chance), 6) AS kappa FROM k""")
def q_label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    c = evaluate.confusion(_labels(spark, sf), "predicted", "actual")
    return c.select("tp", "fp", "fn", "tn", *[r6(x).alias(x) for x in ("precision", "recall", "f1", "kappa")])


@query(f"""
WITH l AS ({LABELS_SQL}), b AS (SELECT score, sum(actual::INT) AS p, count(*) AS n FROM l GROUP BY 1),
 r AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM b WINDOW w AS (ORDER BY score DESC))
SELECT score, tp::BIGINT AS tp, (seen - tp)::BIGINT AS fp, round(tp / seen::DOUBLE, 6) AS precision, round(tp / (SELECT sum(p) FROM b)::DOUBLE, 6) AS recall FROM r""")
def q_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.pr_curve(_labels(spark, sf), "score", "actual").withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


@query(f"""
WITH l AS ({LABELS_SQL}), b AS (SELECT score, sum(actual::INT) AS p, count(*) AS n FROM l GROUP BY 1),
 r AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS seen, (SELECT sum(p) FROM b)::DOUBLE AS t FROM b WINDOW w AS (ORDER BY score DESC)),
 s AS (SELECT tp / seen::DOUBLE AS pr, tp / t - coalesce(lag(tp / t) OVER (ORDER BY score DESC), 0) AS d FROM r)
SELECT round(sum(pr * d), 6) AS average_precision FROM s""")
def q_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.average_precision(_labels(spark, sf), "score", "actual").select(r6("average_precision").alias("average_precision"))


@query()
def q_hex_assign(spark: SparkSession, sf: str) -> DataFrame:
    """The grid's cell of each centre, its own centre and exact area."""
    from ..functions import hexgrid

    c = table(spark, sf, "cells").where("centroid_lat between 19 and 24 and centroid_lon between 102 and 110 and resolution between 7 and 9")
    c = c.select(F.lower(F.trim("h3_index")).alias("h3_index"), F.when(F.col("resolution") == 7, hexgrid.cell_at(F.col("centroid_lat"), F.col("centroid_lon"), 7)).otherwise(hexgrid.cell_at(F.col("centroid_lat"), F.col("centroid_lon"), 8)).alias("cell")).distinct()
    c = c.withColumn("d", hexgrid.cell(F.col("cell")))
    return c.select("h3_index", "cell", "d.resolution", r6("d.centroid_lat").alias("lat"), r6("d.centroid_lon").alias("lon"), r6("d.area_km2").alias("area_km2"))


# ---------------------------------------------------------------- contracts


@query("WITH l AS (SELECT l_partkey AS p_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1) SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, qty FROM part JOIN l USING (p_partkey)")
def q_oneone_merge(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum("l_quantity"), 2).alias("qty"))
    return contracts.one_to_one(table(spark, sf, "part"), f, "p_partkey")


@query("SELECT s AS source, 'left' AS side FROM (SELECT DISTINCT source AS s FROM documents EXCEPT SELECT source FROM mix_targets) UNION ALL SELECT source, 'right' FROM (SELECT source FROM mix_targets EXCEPT SELECT source FROM documents)")
def q_keyset_equality(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.key_difference(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "source")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_dup_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT lower(trim(h3_index)) AS h3_index, count(*) AS n_rows FROM cells GROUP BY 1 HAVING count(*) > 1")
def q_cell_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.duplicate_keys(table(spark, sf, "cells").select(F.lower(F.trim("h3_index")).alias("h3_index")), ["h3_index"])


@query("SELECT count(*) - count(district) AS district, count(*) - count(ward) AS ward, count(*) - count(centroid_lat) AS centroid_lat, count(*) - count(population) AS population FROM cells")
def q_qa_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.null_counts(table(spark, sf, "cells"), ["district", "ward", "centroid_lat", "population"])


@query("SELECT resolution, count(population) / count(*)::DOUBLE AS coverage, count(*) AS n_rows FROM cells GROUP BY 1")
def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.coverage(table(spark, sf, "cells"), "population", "resolution").select("resolution", "coverage", "n_rows")


# ---------------------------------------------------------------- map features


@query("SELECT l_orderkey AS node, count(DISTINCT l_suppkey) AS n_ways FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def q_incidence_ge3(spark: SparkSession, sf: str) -> DataFrame:
    ways = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.array("l_orderkey").alias("refs"))
    return roads.intersections(ways)


WAY_KIND = {"R": "primary_link", "A": "secondary", "N": "residential"}


@query("SELECT l_suppkey AS id, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 3) AS road_length_primary, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 3) AS road_length_secondary, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 3) AS road_length_residential, bool_or(l_returnflag IN ('R', 'A')) AS has_major_road FROM lineitem GROUP BY 1")
def q_class_pivot_sum(spark: SparkSession, sf: str) -> DataFrame:
    h = F.create_map(*[F.lit(x) for kv in WAY_KIND.items() for x in kv])[F.col("l_returnflag")]
    li = table(spark, sf, "lineitem").withColumn("highway", h)
    lengths = roads.lengths_by_class(li.select(F.col("l_suppkey").alias("id"), "highway", F.col("l_quantity").cast("double").alias("length")), "id")
    return lengths.select("id", *[F.round(f"road_length_{k}", 3).alias(f"road_length_{k}") for k in ("primary", "secondary", "residential")], "has_major_road")


ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _line_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as ways whose references are parts, parts as nodes; every eleventh part has no place."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("s"))
    ways = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("s")).alias("s")).select("id", F.col("s.l_partkey").alias("refs"))
    k = F.col("p_partkey")
    nodes = table(spark, sf, "part").where(k % 11 != 0).select(k.alias("id"), (k % 97 * 0.25).alias("lon"), (k % 89 * 0.5).alias("lat"))
    return ways, nodes


_PTS_SQL = f"""
r AS (SELECT l_orderkey AS id, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS pos FROM lineitem),
 p AS (SELECT r.id, r.pos, r.node, n.p_partkey % 97 * 0.25::DOUBLE AS lon, n.p_partkey % 89 * 0.5::DOUBLE AS lat FROM r LEFT JOIN part n ON n.p_partkey = r.node AND n.p_partkey % 11 <> 0)"""


@query(f"""
WITH {_PTS_SQL}, g AS (SELECT id, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS "by", row_number() OVER w AS seq FROM p WHERE lon IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, seq::INT AS seq, ax, ay, bx, "by" FROM g WHERE bx IS NOT NULL""")
def q_ordered_gather(spark: SparkSession, sf: str) -> DataFrame:
    ways, nodes = _line_nodes(spark, sf)
    return roads.segments(roads.way_points(ways, nodes))


@query(f"WITH {_PTS_SQL} SELECT id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) FILTER (lon IS NULL) AS n_missing FROM p GROUP BY 1")
def q_way_centroid(spark: SparkSession, sf: str) -> DataFrame:
    ways, nodes = _line_nodes(spark, sf)
    return roads.way_centres(roads.way_points(ways, nodes)).withColumn("lon", r6("lon")).withColumn("lat", r6("lat"))


@query(f"""
WITH {_PTS_SQL}, g AS (SELECT id, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS "by", row_number() OVER w AS seq FROM p WHERE lon IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY pos)),
 s AS (SELECT *, sqrt(pow(bx - ax, 2) + pow("by" - ay, 2)) AS len FROM g WHERE bx IS NOT NULL), c AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY seq) AS aft FROM s),
 h AS (SELECT id AS request, seq, ax, ay, bx, "by", CASE WHEN len > 0 THEN (id % 40 + 0.5 - (aft - len)) / len ELSE 0 END AS t FROM c WHERE id % 40 + 0.5 BETWEEN aft - len AND aft)
SELECT request, round(arg_min(ax + t * (bx - ax), seq), 6) AS x, round(arg_min(ay + t * ("by" - ay), seq), 6) AS y FROM h GROUP BY 1""")
def q_km_marker(spark: SparkSession, sf: str) -> DataFrame:
    """The point a given length along each way."""
    ways, nodes = _line_nodes(spark, sf)
    segs = roads.segments(roads.way_points(ways, nodes)).withColumnRenamed("id", "road")
    asked = ways.select(F.col("id").alias("request"), F.col("id").alias("road"), (F.col("id") % 40 + 0.5).alias("metres"))
    return geocode.at_marker(asked, segs).select("request", r6("x").alias("x"), r6("y").alias("y"))


@query("""
WITH s AS (SELECT 's' || s_suppkey % 40 AS k, (s_suppkey % 53 * 10)::DOUBLE AS ax, (s_suppkey % 47 * 10)::DOUBLE AS ay, (s_suppkey % 53 * 10 + s_suppkey % 9 * 30 - 120)::DOUBLE AS bx, (s_suppkey % 47 * 10 + s_suppkey % 7 * 40 - 120)::DOUBLE AS "by" FROM supplier),
 r AS (SELECT p_partkey AS request, 's' || p_partkey % 40 AS ka, 's' || p_partkey * 7 % 40 AS kb FROM part WHERE p_partkey % 40 <> p_partkey * 7 % 40),
 j AS (SELECT request, a.ax, a.ay, a.bx, a."by", b.ax AS cx, b.ay AS cy, b.bx AS dx, b."by" AS dy FROM r JOIN s a ON a.k = ka JOIN s b ON b.k = kb),
 d AS (SELECT *, (bx - ax) * (dy - cy) - ("by" - ay) * (dx - cx) AS den FROM j), t AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den AS t, ((cx - ax) * ("by" - ay) - (cy - ay) * (bx - ax)) / den AS u FROM d WHERE den <> 0)
SELECT request, round(x, 6) AS x FROM (SELECT request, min(ax + t * (bx - ax)) AS x FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY 1)""")
def q_street_crossing(spark: SparkSession, sf: str) -> DataFrame:
    """Westernmost crossing of two named streets, each of several segments."""
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    name = lambda c: F.concat(F.lit("s"), (c % 40).cast("string"))
    d = lambda c: c.cast("double")
    segs = table(spark, sf, "supplier").select(name(k).alias("name"), d(k % 53 * 10).alias("ax"), d(k % 47 * 10).alias("ay"), d(k % 53 * 10 + k % 9 * 30 - 120).alias("bx"), d(k % 47 * 10 + k % 7 * 40 - 120).alias("by"))
    asked = table(spark, sf, "part").where("p_partkey % 40 <> p_partkey * 7 % 40").select(p.alias("request"), name(p).alias("street_a"), name(p * 7).alias("street_b"))
    return geocode.crossings(asked, segs, 100.0).select("request", r6("x").alias("x"))


@query("""
WITH a AS (SELECT p_partkey AS id, p_partkey % 200 * 1.0 AS x0, p_partkey % 200 + p_size % 7 * 1.0 AS x1, p_partkey % 150 * 1.0 AS y0, p_partkey % 150 + p_size % 5 * 1.0 AS y1 FROM part),
 b AS (SELECT s_suppkey AS sid, s_suppkey % 190 * 1.0 AS x0, s_suppkey % 190 + 3.0 AS x1, s_suppkey % 140 * 1.0 AS y0, s_suppkey % 140 + 4.0 AS y1 FROM supplier)
SELECT id, sid FROM a JOIN b ON a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0""")
def q_range_join_bbox(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes meet in grid tiles first, then the four inclusive comparisons."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    box = lambda x0, x1, y0, y1: F.struct((x0 * 1.0).alias("x0"), (x1 * 1.0).alias("x1"), (y0 * 1.0).alias("y0"), (y1 * 1.0).alias("y1"))
    a = table(spark, sf, "part").select(k.alias("id"), box(k % 200, k % 200 + F.col("p_size") % 7, k % 150, k % 150 + F.col("p_size") % 5).alias("a"))
    b = table(spark, sf, "supplier").select(s.alias("sid"), box(s % 190, s % 190 + 3, s % 140, s % 140 + 4).alias("b"))
    return roads.boxes_join(a, b, "a", "b", 8.0).select("id", "sid")


HEX = [(4, 0), (2, 3), (-2, 3), (-4, 0), (-2, -3), (2, -3), (4, 0)]


def _hexes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    cx, cy = k % 5 * 7, F.floor(k / 5) * 6
    return table(spark, sf, "nation").select(k.cast("string").alias("h3_index"), F.array(*[F.array((cx + x).cast("double"), (cy + y).cast("double")) for x, y in HEX]).alias("ring"))


_HALF_PLANES = " AND ".join(f"({bx - ax} * (y - (cy + {ay})) - ({by - ay}) * (x - (cx + {ax})) >= 0)" for (ax, ay), (bx, by) in zip(HEX, HEX[1:]))
_HEX_SQL = "h AS (SELECT n_nationkey::VARCHAR AS h3_index, n_nationkey % 5 * 7 AS cx, n_nationkey // 5 * 6 AS cy FROM nation)"


@query(f"WITH {_HEX_SQL}, p AS (SELECT c_custkey AS id, c_custkey % 37 - 4 AS x, c_custkey % 31 - 3 AS y FROM customer) SELECT id, h3_index FROM p JOIN h ON {_HALF_PLANES}")
def q_point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """Integer points, so that many lie on edges and corners and count in every cell that touches them."""
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), (k % 37 - 4).cast("double").alias("x"), (k % 31 - 3).cast("double").alias("y"))
    return roads.points_in_cells(p, _hexes(spark, sf), 8.0).select("id", "h3_index")


def _clip_sql() -> str:
    lo, hi, out = ["0.0"], ["1.0"], []
    for (px, py), (qx, qy) in zip(HEX, HEX[1:]):
        nx, ny = -(qy - py), qx - px
        den, num = f"({nx} * dx + {ny} * dy)", f"({nx} * (ax - (cx + {px})) + {ny} * (ay - (cy + {py})))"
        lo.append(f"CASE WHEN {den} > 0 THEN -{num} / {den} ELSE 0.0 END")
        hi.append(f"CASE WHEN {den} < 0 THEN -{num} / {den} ELSE 1.0 END")
        out.append(f"({den} = 0 AND {num} < 0)")
    return f"""WITH {_HEX_SQL}, s AS (SELECT s_suppkey AS id, (s_suppkey % 41 - 5)::DOUBLE AS ax, (s_suppkey % 29 - 3)::DOUBLE AS ay, (s_suppkey % 13 - 6)::DOUBLE AS dx, (s_suppkey % 17 - 8)::DOUBLE AS dy FROM supplier),
 l AS (SELECT id, h3_index, CASE WHEN {" OR ".join(out)} THEN 0 ELSE greatest(0, least({", ".join(hi)}) - greatest({", ".join(lo)})) * sqrt(dx * dx + dy * dy) END AS length FROM s, h)
SELECT id, h3_index, round(length, 6) AS length FROM l WHERE length > 1e-9"""


@query(_clip_sql())
def q_line_clip_length(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    d = lambda c: c.cast("double")
    s = table(spark, sf, "supplier").select(k.alias("id"), F.lit(1).alias("seq"), d(k % 41 - 5).alias("ax"), d(k % 29 - 3).alias("ay"), d(k % 41 - 5 + k % 13 - 6).alias("bx"), d(k % 29 - 3 + k % 17 - 8).alias("by"))
    cut = roads.lengths_in_cells(s, _hexes(spark, sf), 8.0).where("length > 1e-9")
    return cut.select("id", "h3_index", r6("length").alias("length"))


@query(f"""WITH {_HEX_SQL}, p AS (SELECT p_partkey % 40 - 4 AS x, p_partkey % 33 - 3 AS y, CASE WHEN p_size % 9 <> 0 THEN p_retailprice END AS value FROM part),
 z AS (SELECT h3_index, sum(value) AS v FROM p JOIN h ON {_HALF_PLANES} GROUP BY 1) SELECT h.h3_index, round(coalesce(v, 0), 4) AS population FROM h LEFT JOIN z USING (h3_index)""")
def q_zonal_sum(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    px = table(spark, sf, "part").select((k % 40 - 4).cast("double").alias("lon"), (k % 33 - 3).cast("double").alias("lat"), F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("value"))
    return population.zonal_sum(px, _hexes(spark, sf), 8.0).withColumn("population", r6("population", 4))


_POI = "CASE WHEN k % 5 = 0 THEN 'n_schools' WHEN k % 5 = 1 THEN 'n_hospitals' WHEN k % 5 IN (2, 3) THEN 'n_commercial_poi' END"


@query(f"""WITH {_HEX_SQL}, q AS (SELECT p_partkey AS k, p_partkey % 40 - 4 AS x, p_partkey % 33 - 3 AS y FROM part),
 w AS (SELECT s_suppkey AS k, (a.x + b.x) / 2.0 AS x, (a.y + b.y) / 2.0 AS y FROM supplier JOIN q a ON a.k = s_suppkey JOIN q b ON b.k = s_suppkey + 7),
 p AS (SELECT {_POI} AS c, x, y FROM q UNION ALL SELECT {_POI}, x, y FROM w), z AS (SELECT h3_index, c, count(*) AS n FROM p JOIN h ON c IS NOT NULL AND {_HALF_PLANES} GROUP BY 1, 2)
SELECT h3_index, {", ".join(f"coalesce(max(n) FILTER (c = '{c}'), 0) AS {c}" for c in ("n_schools", "n_hospitals", "n_commercial_poi"))} FROM h LEFT JOIN z USING (h3_index) GROUP BY 1""")
def q_poi_pivot_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as nodes and suppliers as ways of two of them, counted by category in every cell."""

    def tags(k: Column) -> Column:
        both = F.create_map(F.lit("amenity"), F.when(k % 5 == 0, "school").when(k % 5 == 1, "hospital"), F.lit("shop"), F.when((k % 5).isin(2, 3), "yes"))
        return F.map_filter(both, lambda _, v: v.isNotNull())

    k, s = F.col("p_partkey"), F.col("s_suppkey")
    nodes = table(spark, sf, "part").select(k.alias("id"), (k % 40 - 4).cast("double").alias("lon"), (k % 33 - 3).cast("double").alias("lat"), tags(k).alias("tags"))
    ways = table(spark, sf, "supplier").select(s.alias("id"), F.array(s, s + 7).alias("refs"), tags(s).alias("tags"))
    return population.poi_counts(nodes, ways, _hexes(spark, sf), 8.0)


@query("SELECT id, count(*) AS n, round(sum(sqrt(dx * dx + dy * dy)), 6) AS length FROM (SELECT DISTINCT s_nationkey AS id, (s_suppkey % 5) AS dx, (s_suppkey % 7) AS dy FROM supplier) GROUP BY 1")
def q_retraced(spark: SparkSession, sf: str) -> DataFrame:
    """A line that goes the same way again, or back, counts once."""
    k = F.col("s_suppkey")
    d = lambda c: c.cast("double")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), (k % 2 == 0).alias("back"), d(k % 5).alias("x"), d(k % 7).alias("y"))
    end = lambda c, there: F.when(F.col("back") == there, 0.0).otherwise(F.col(c))
    segs = roads.once(s.select("id", end("x", False).alias("ax"), end("y", False).alias("ay"), end("x", True).alias("bx"), end("y", True).alias("by")))
    return segs.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))), 6).alias("length"))


def _utm_sql() -> str:
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    e = 2 * n**0.5 / (1 + n)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    sinh, cosh = (lambda x: f"((exp({x}) - exp(-({x}))) / 2)"), (lambda x: f"((exp({x}) + exp(-({x}))) / 2)")
    east = " + ".join([f"{k!r}::DOUBLE * cos({2 * j} * xi) * {sinh(f'{2 * j} * eta')}" for j, k in enumerate(al, 1)])
    north = " + ".join([f"{k!r}::DOUBLE * sin({2 * j} * xi) * {cosh(f'{2 * j} * eta')}" for j, k in enumerate(al, 1)])
    psi = f"(atanh(sin(radians(y))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(y))))"
    return f"""WITH c AS (SELECT lower(trim(h3_index)) AS h3_index, min(centroid_lat) AS y, min(centroid_lon) AS x FROM cells WHERE centroid_lat BETWEEN 19 AND 24 AND centroid_lon BETWEEN 102 AND 110 GROUP BY 1),
 t AS (SELECT h3_index, {sinh(psi)} AS t, radians(x - 105.0) AS dl FROM c), v AS (SELECT h3_index, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
SELECT h3_index, round(500000.0::DOUBLE + {a!r}::DOUBLE * (eta + {east}), 3) AS easting, round({a!r}::DOUBLE * (xi + {north}), 3) AS northing FROM v"""


@query(_utm_sql())
def q_utm_project(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "cells").where("centroid_lat between 19 and 24 and centroid_lon between 102 and 110")
    c = c.groupBy(F.lower(F.trim("h3_index")).alias("h3_index")).agg(F.min("centroid_lat").alias("y"), F.min("centroid_lon").alias("x"))
    u = geo.utm(F.col("x"), F.col("y"))
    return c.select("h3_index", F.round(u["easting"], 3).alias("easting"), F.round(u["northing"], 3).alias("northing"))


@query("SELECT o_orderkey, round_even(o_totalprice::DOUBLE / 7 * 1000, 0) / 1000 AS per_day, round_even(o_totalprice::DOUBLE * 1000, 0) / 1000 AS total FROM orders")
def q_round3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", geo.round3(F.col("o_totalprice") / 7).alias("per_day"), geo.round3(F.col("o_totalprice")).alias("total"))


@query("SELECT p_size AS resolution, max((p_retailprice - p_size) * 0.65::DOUBLE) AS extent_x, max(p_partkey % 50 * 0.65::DOUBLE) AS extent_y FROM part GROUP BY 1")
def q_extent_max(spark: SparkSession, sf: str) -> DataFrame:
    box = F.struct(F.col("p_size").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.col("p_retailprice").alias("x1"), (F.col("p_partkey") % 50).cast("double").alias("y1"))
    return render.extents(table(spark, sf, "part").select(F.col("p_size").alias("resolution"), box.alias("box")))


@query("SELECT p_partkey, k % 4 AS col, k // 4 AS row FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) WHERE k < 12")
def q_contact_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve, a top-k, on a sheet of four columns."""
    return render.sheet_places(table(spark, sf, "part"), "p_partkey")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'secondary' WHEN '5-LOW' THEN 'residential' END AS road_class FROM orders")
def q_map_lookup(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("1-URGENT", "primary_link", "2-HIGH", "secondary", "5-LOW", "residential", "3-MEDIUM", "service")])
    return table(spark, sf, "orders").select("o_orderkey", roads.road_class(F.try_element_at(kind, F.col("o_orderpriority"))).alias("road_class"))


@query("SELECT user_id::VARCHAR AS h3_index, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, value AS temperature_2m, -value AS precipitation, value + 1 AS visibility, value * 2 AS wind_speed_10m, value / 2 AS relative_humidity_2m FROM events")
def q_json_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of parallel arrays, made of each user's events as JSON text, read and taken apart."""
    factor = {"temperature_2m": F.col("value"), "precipitation": -F.col("value"), "visibility": F.col("value") + 1, "wind_speed_10m": F.col("value") * 2, "relative_humidity_2m": F.col("value") / 2}
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("h3_index"), F.struct(F.date_format("ts", ISO).alias("time"), *[c.alias(f) for f, c in factor.items()]).alias("e"))
    e = e.groupBy("h3_index").agg(F.collect_list("e").alias("e"))
    hourly = F.struct(*[F.col(f"e.{f}").alias(f) for f in ("time", *factor)])
    payload = F.to_json(F.struct(hourly.alias("hourly")))
    p = e.select("h3_index", F.from_json(payload, weather.PAYLOAD).alias("p")).select("h3_index", "p.hourly")
    return weather.decode_payload(p).withColumn("ts", F.date_format("ts", ISO))


@query("SELECT resolution, count(DISTINCT lower(trim(h3_index))) AS n_cells FROM cells GROUP BY 1")
def q_cells_per_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A3, U4: distinct cells by resolution."""
    c = table(spark, sf, "cells").select("resolution", F.lower(F.trim("h3_index")).alias("h"))
    return contracts.distinct_per_group(c, "resolution", "h").withColumnRenamed("n", "n_cells")
