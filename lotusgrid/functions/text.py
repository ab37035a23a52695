"""Functions over urls and article text: slug filter, place scoring, crash report test, feature flags.

All are native expressions; only NFC needs Python and is applied once (``nfc``).
Java patterns get the flags that make them agree with Unicode-aware matching. What is
used more than once (list hits, pattern tests) becomes a column of its own before it is
used, so that no pattern runs twice over a text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L

FOLD, EXACT = "(?iuU)", "(?U)"


def nfc(text: Column) -> Column:
    """Canonical composition; null becomes ""."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore").fillna("")

    return run(text)


def has(text: Column, pattern: str, fold: bool = True) -> Column:
    return text.rlike((FOLD if fold else EXACT) + pattern)


def sha1_key(url: Column) -> Column:
    return F.sha1(url)


def url_authority(url: Column) -> Column:
    """Host with port and user, as written; "" when there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def slug_tokens(url: Column) -> Column:
    """Words of the last path part, without file ending and numbers."""
    path = F.rtrim(F.substring_index(F.lower(url), "?", 1), F.lit("/"))
    slug = F.regexp_replace(F.substring_index(path, "/", -1), r"\.(html?|antd|aspx?)$", "")
    return F.filter(F.split(slug, "-"), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))


def _any_phrase(joined: Column, phrases: list[str]) -> Column:
    return joined.rlike(" (?:" + "|".join(map(re.escape, phrases)) + ") ")


def slug_passes(url: Column) -> Column:
    """Whether a url looks like a report of one crash. Null urls do not pass."""
    path = F.substring_index(F.lower(url), "?", 1)
    excluded = path.rlike("|".join(map(re.escape, L.SLUG_EXCLUDE)))
    joined = F.concat(F.lit(" "), F.array_join(slug_tokens(url), " "), F.lit(" "))
    vehicle = _any_phrase(joined, [*L.VEHICLE_TOKENS, "o to"])
    return F.coalesce(~excluded & (_any_phrase(joined, L.SAFE_PHRASES) | (vehicle & _any_phrase(joined, L.GATED_PHRASES))), F.lit(False))


def found_words(low: Column, words: list[str]) -> Column:
    """Words of a list that a text in lower case holds, in list order, duplicates kept. ``low`` should be a column, not an expression: it is read once a word."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words]))


def glue(title: Column, body: Column, head: int | None = None) -> Column:
    b = F.coalesce(body, F.lit(""))
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.substring(b, 1, head) if head else b)


def head(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def located(df: DataFrame, title: str = "title", body: str = "body", head_chars: int = 400) -> DataFrame:
    """The table with verdict, confidence, places and scores (F7); title and body in NFC.

    Lists are looked up in the title and the first ``head_chars`` characters, the transfer
    to a hospital of the city in the whole text.
    """
    t, b = F.col(title), F.col(body)
    df = df.withColumn("_low", F.lower(glue(t, b, head_chars))).withColumn("transfer_context", has(glue(t, b), L.TRANSFER))
    df = df.withColumns({"hanoi_districts": found_words(F.col("_low"), L.DISTRICTS), "_marks": found_words(F.col("_low"), L.LANDMARKS), "other_provinces": found_words(F.col("_low"), L.PROVINCES)})
    moved = F.col("transfer_context")
    here = (F.size("hanoi_districts") + F.size("_marks")) * 3 + (F.contains("_low", F.lit(L.CITY)) & ~moved).cast("int")
    strong = (F.size("hanoi_districts") > 0) | (F.size("_marks") > 0)
    df = df.withColumns({"score_here": here, "score_there": F.size("other_provinces") * 3, "_strong": strong})
    h, o, strong = F.col("score_here"), F.col("score_there"), F.col("_strong")
    away = moved & ~strong
    verdict = F.when(away | (h < o), "other_province").when(h > o, "hanoi").otherwise("unknown")
    one_sided = F.when((h == 0) & (o > 0), "high").when((h > 0) & (o == 0), F.when(strong, "high").otherwise("low"))
    confidence = F.when(away, "medium").otherwise(F.coalesce(one_sided, F.when(h != o, "medium").otherwise("low")))
    df = df.withColumns({"location_verdict": verdict, "location_confidence": confidence, "hanoi_landmarks": F.slice("_marks", 1, 3)})
    return df.drop("_low", "_marks", "_strong")


def reported(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """The table with the tests whether a text reports one crash, and why not (F8); title and body in NFC."""
    t, b = F.col(title), F.col(body)
    text = glue(t, b)
    df = df.withColumns({"has_crash_verb": has(text, L.CRASH_VERB), "has_vehicle": has(text, L.VEHICLE), "has_outcome": has(text, L.OUTCOME), "looks_aggregate": has(glue(t, b, 600), L.AGGREGATE)})
    verb, vehicle, agg = (F.col(c) for c in ("has_crash_verb", "has_vehicle", "looks_aggregate"))
    reasons = F.array_compact(F.array(F.when(~verb, L.NO_VERB), F.when(~vehicle, L.NO_VEHICLE), F.when(agg, L.IS_AGGREGATE)))
    return df.withColumns({"is_accident": verb & vehicle & ~agg, "reject_reasons": reasons})


def classified(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """The table with both tests, keep, needs_review and all reject reasons."""
    df = located(reported(df, title, body), title, body)
    acc, verdict = F.col("is_accident"), F.col("location_verdict")
    outside = F.when(acc & (verdict != "hanoi"), F.array(F.concat(F.lit(L.AREA), verdict))).otherwise(F.array().cast("array<string>"))
    return df.withColumns({
        "keep": acc & (verdict == "hanoi"),
        "needs_review": acc & ((verdict == "unknown") | ((verdict == "hanoi") & (F.col("location_confidence") == "low"))),
        "reject_reasons": F.concat("reject_reasons", outside),
    })


#: The sixteen flags of an article, in order.
FLAGS = [
    "has_exact_time", "has_vague_time", "has_date", "location_level", "vehicles", "n_vehicle_types", "has_casualty", "casualty_numeric", "has_weather",
    "filter_keep", "filter_needs_review", "filter_is_accident", "filter_location_verdict", "filter_location_confidence", "filter_reject_reasons", "hanoi_districts",
]


def analysed(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """The table with the flags ``FLAGS`` of its articles (F10); title and body in NFC."""
    names = df.columns
    text = glue(F.col(title), F.col(body))
    kinds = F.array_compact(F.array(*[F.when(has(text, p), k) for k, p in L.VEHICLE_CLASSES.items()]))
    level = F.when(has(text, L.LOC_PRECISE), "precise").when(has(text, L.STREET, False), "street").when(has(text, L.LOC_COARSE), "coarse").otherwise("none")
    df = classified(df, title, body).withColumns({
        "has_exact_time": has(text, L.EXACT_TIME), "has_vague_time": has(text, L.VAGUE_TIME), "has_date": has(text, L.DATE, False), "location_level": level, "_kinds": kinds,
        "has_casualty": has(text, L.CASUALTY), "casualty_numeric": has(text, L.CASUALTY_NUMBER), "has_weather": has(text, L.WEATHER),
    })
    df = df.withColumns({"vehicles": F.array_join("_kinds", ";"), "n_vehicle_types": F.size("_kinds"), "filter_reject_reasons": F.array_join("reject_reasons", ";"), "hanoi_districts": F.array_join(F.slice("hanoi_districts", 1, 3), ";")})
    renamed = {"keep": "filter_keep", "needs_review": "filter_needs_review", "is_accident": "filter_is_accident", "location_verdict": "filter_location_verdict", "location_confidence": "filter_location_confidence"}
    return df.withColumnsRenamed(renamed).select(*names, *FLAGS)


#: Parts of a page that hold no text of its own.
_APART = "script|style|noscript|template|nav|header|footer|aside|form|table|figure|button"


def html_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles, menus, tables, comments and tags removed, entities of markup resolved, blank lines dropped."""
    t = F.regexp_replace(html, rf"(?is)<!--.*?-->|<({_APART})\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|h[1-6]|tr|section|article|header|footer|title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def page_meta(html: Column) -> Column:
    """Struct (title, date) of a page: the title for sharing, else the title; the stated time of publication. "" where there is none."""
    attr = lambda names: F.coalesce(*[F.nullif(F.regexp_extract(html, rx.replace("NAME", n), 1), F.lit("")) for n in names for rx in (r"(?is)<meta\b[^>]*?(?:property|name|itemprop)\s*=\s*[\"']NAME[\"'][^>]*?\bcontent\s*=\s*[\"']([^\"']*)", r"(?is)<meta\b[^>]*?\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*?(?:property|name|itemprop)\s*=\s*[\"']NAME[\"']")])
    title = F.coalesce(attr(["og:title", "twitter:title"]), F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    date = F.coalesce(attr(["article:published_time", "datePublished", "pubdate", "date"]), F.regexp_extract(html, r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']*)", 1))
    flat = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.struct(flat(title).alias("title"), flat(date).alias("date"))


def pct(n: Column, total: Column) -> Column:
    """Whole per cent, half to even, "n/a" for a total of zero."""
    return F.when(total == 0, F.lit("n/a")).otherwise(F.concat(F.bround(F.lit(100.0) * n / total, 0).cast("long").cast("string"), F.lit("%")))


def seeded_sample(df, key: str, n: int, seed: str):  # noqa: ANN001, ANN201
    """The n rows of least sha1(seed, key): stable under re-runs and partitioning. Ties by key."""
    rank = F.sha1(F.concat(F.lit(seed + "|"), F.col(key)))
    return df.orderBy(rank, F.col(key)).limit(n)
