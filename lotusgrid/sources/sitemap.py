"""Sitemaps and robots rules over stored documents ``(url, body)``."""

from __future__ import annotations

import gzip
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where sitemaps conventionally are.
CONVENTIONAL = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml"]
_LOCAL = "*[local-name()='{}']"


def text_of(content: Column) -> Column:
    """Text of a body: gzip is unpacked, what only looks like it is taken as it is; undecodable bytes are replaced."""

    @F.pandas_udf("binary")
    def plain(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> bytes:
            if b[:2] != b"\x1f\x8b":
                return b
            try:
                return gzip.decompress(b)
            except (OSError, EOFError, zlib.error):
                return b

        return s.map(one, na_action="ignore")

    return F.make_valid_utf8(plain(content).cast("string"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(domain, sitemap, pos) named by robots texts ``(domain, body)``."""
    lines = robots.select("domain", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    found = F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)", 1)
    return lines.select("domain", found.alias("sitemap"), "pos").where("sitemap <> ''")


def discover(robots: DataFrame, stored: DataFrame) -> DataFrame:
    """(domain, sitemap): those that robots names, else the first conventional path whose body looks like XML."""
    named = robots_sitemaps(robots).select("domain", "sitemap")
    rest = robots.select("domain").distinct().join(named.select("domain").distinct(), "domain", "left_anti")
    guess = rest.select("domain", F.posexplode(F.array(*map(F.lit, CONVENTIONAL))).alias("rank", "at")).withColumn("url", F.concat(F.lit("https://"), "domain", "at"))
    hit = guess.join(stored.where(F.contains(F.substring("body", 1, 200), F.lit("<"))).select("url"), "url")
    first = Window.partitionBy("domain").orderBy("rank")
    hit = hit.withColumn("k", F.row_number().over(first)).where("k = 1").select("domain", F.col("url").alias("sitemap"))
    return named.unionByName(hit)


def entries(docs: DataFrame) -> DataFrame:
    """(source, pos, loc, lastmod) of url sets; null bodies and other documents give nothing."""
    unit = F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?url\b[^>]*>(.*?)</(?:\w+:)?url>"), 1)
    u = docs.select(F.col("url").alias("source"), F.posexplode(unit).alias("pos", "u"))
    one = lambda tag: F.trim(F.regexp_extract("u", rf"(?s)<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}>", 1))
    loc = F.replace(one("loc"), F.lit("&amp;"), F.lit("&"))
    return u.select("source", "pos", loc.alias("loc"), F.nullif(one("lastmod"), F.lit("")).alias("lastmod")).where("loc <> ''")


def children(docs: DataFrame, last: int = 5) -> DataFrame:
    """(source, child): the last children of sitemap indexes, in document order; all of them when there are fewer."""
    locs = F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?sitemap\b[^>]*>.*?<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</(?:\w+:)?loc>"), 1)
    return docs.select(F.col("url").alias("source"), F.explode(tail(locs, last)).alias("child"))


def tail(a: Column, n: int) -> Column:
    """The last n elements; all when there are fewer."""
    return F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), F.lit(n))


def crawl(stored: DataFrame, roots: DataFrame, depth: int = 2, last: int = 5) -> DataFrame:
    """Entries reachable from root sitemaps ``(url)`` through at most ``depth`` levels of indexes."""
    level, found = roots.select("url"), []
    for d in range(depth + 1):
        docs = stored.join(level, "url", "left_semi")
        found.append(entries(docs))
        if d < depth:
            level = children(docs, last).select(F.col("child").alias("url")).distinct()
    return union_entries(found)


def union_entries(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def last_children(df: DataFrame, parent: str, order: list[str], n: int = 5) -> DataFrame:
    """The last n rows of each parent, numbered from the end."""
    w = Window.partitionBy(parent).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def rule_groups(robots: DataFrame) -> DataFrame:
    """(domain, agent, kind, path) of robots texts: consecutive user-agent lines share the rules that follow."""
    lines = robots.select("domain", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    lines = lines.select("domain", "pos", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("k"), F.trim(F.regexp_extract("line", r"^[^:#]*:\s*([^#]*)", 1)).alias("v"))
    lines = lines.where(F.col("k").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("domain").orderBy("pos")
    opens = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    agents = lines.where("k = 'user-agent'").select("domain", "group", F.lower("v").alias("agent"))
    rules = lines.where("k <> 'user-agent'").select("domain", "group", F.col("k").alias("kind"), F.col("v").alias("path"))
    return agents.join(rules, ["domain", "group"], "left").select("domain", "agent", "kind", "path")


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Urls ``(domain, url)`` that robots texts allow.

    The groups that name the agent (without its version) decide, the ones of ``*`` only
    where none does; the longest matching rule wins, allow on ties; no text, no group and
    an empty rule allow all. ``*`` in a path stands for anything, a ``$`` behind it for the end.
    """
    name = agent.lower().split("/")[0].strip()
    groups = rule_groups(robots).withColumn("own", (F.col("agent") != "*") & F.contains(F.lit(name), F.col("agent")))
    groups = groups.where("own or agent = '*'")
    best = groups.groupBy("domain").agg(F.bool_or("own").alias("named"))
    rules = groups.join(best, "domain").where("own = named and path <> ''").select("domain", "kind", "path").distinct()
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([/?][^#]*)?", 1)
    p = urls.withColumn("_path", F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))
    quoted = F.concat(F.lit("\\Q"), F.replace("path", F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    rx = F.concat(F.lit("^"), F.when(F.endswith("path", F.lit("$")), F.concat(F.replace(quoted, F.lit("$\\E"), F.lit("\\E")), F.lit("$"))).otherwise(quoted))
    hit = p.join(rules.withColumn("_rx", rx), "domain").where(F.rlike("_path", F.col("_rx")))
    worst = hit.groupBy("domain", "url").agg(F.max_by("kind", F.struct(F.length("path"), F.when(F.col("kind") == "allow", 1).otherwise(0))).alias("kind"))
    return urls.join(worst.where("kind = 'disallow'"), ["domain", "url"], "left_anti")
