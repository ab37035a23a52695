"""Timestamps of mixed notations and zones as instants (problem 3).

``parse`` reads a notation into wall-clock seconds and, where the value has one, its
offset. Values without offset are wall-clock time of their source's zone, which
``estimate_zones`` gives: local times are aligned with ingestion times and with the
offsets that other values of the source state; each offset history of the public zone
tables is charged a violation for every value that would lie after its ingestion or
contradict a stated offset, and the history of fewest violations wins, of equals the
one that leaves the least delay. A source may change its history: its span is cut
where two histories together save violations. A declared zone is evidence: it stands
unless another history saves a given share of the values. Then wall-clock time is
converted; times that the zone skips or passes twice fix no instant.

Values are first summed by source, day and quarter of an hour of lead over ingestion,
which is bounded by the calendar; only these sums meet the histories, so a source may
hold any share of the rows.

Defined results (null): null or empty values, no time of day, impossible dates or
times, unknown notations, no zone at all, skipped and doubled wall-clock times.
Results do not depend on the session's zone.
"""

from __future__ import annotations

import datetime
import re
import zoneinfo
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in hours.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 1, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "ICT": 7, "JST": 9,
    "AEST": 10, "AEDT": 11, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_ZONE = r"(?P<zone>Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{3,4}|\(?(?:GMT|UTC)\s?[+-]\d{1,2}(?::?\d{2})?\)?)?"
_CLOCK = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?(?:\s?(?P<half>AM|PM|SA|CH|am|pm|a\.m\.|p\.m\.))?"
_DAY = r"(?:(?:Thứ\s\S+|Chủ\s[Nn]hật|[A-Z][a-z]{2,8}),?\s+)?(?:ngày\s+)?"
_FIGURES = r"(?P<p>\d{1,2})[/.\-](?P<q>\d{1,2})[/.\-](?P<y>\d{4})"
NOTATIONS = [
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})[-/](?P<mo>\d{{1,2}})[-/](?P<d>\d{{1,2}})(?:[T ]|,\s){_CLOCK}\s?{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:\.\d+)?{_ZONE}",
        rf"{_DAY}{_FIGURES}(?:,?\s+|\s-\s){_CLOCK}\s?{_ZONE}",
        rf"{_CLOCK},?\s+{_DAY}{_FIGURES}\s?{_ZONE}",
        rf"(?P<h>\d{{1,2}})\sgiờ(?:\s(?P<mi>\d{{1,2}})(?:\sphút)?)?,?\s(?:ngày\s)?(?P<d>\d{{1,2}})\stháng\s(?P<mo>\d{{1,2}})(?:,)?\snăm\s(?P<y>\d{{4}})\s?{_ZONE}",
        rf"{_DAY}(?P<d>\d{{1,2}})\s(?P<name>[A-Z][a-z]{{2,8}})\s(?P<y>\d{{4}}),?\s{_CLOCK}\s?{_ZONE}",
        rf"{_DAY}(?P<name>[A-Z][a-z]{{2,8}})\s(?P<d>\d{{1,2}}),\s(?P<y>\d{{4}}),?\s{_CLOCK}\s?{_ZONE}",
        rf"[A-Z][a-z]{{2}}\s(?P<name>[A-Z][a-z]{{2}})\s+(?P<d>\d{{1,2}})\s{_CLOCK}\s{_ZONE}\s?(?P<y>\d{{4}})",
    )
]
_EPOCH = re.compile(r"\d{9,10}|\d{13}|\d{16}")
_DAY_0 = datetime.date(1970, 1, 1).toordinal()


def _offset(zone: str | None) -> int | None:
    """Seconds east of UTC; None when none is given; ValueError when unknown."""
    if not zone:
        return None
    z = zone.strip("()").replace(" ", "")
    if z in ABBREVIATIONS:
        return ABBREVIATIONS[z] * 3600
    m = re.fullmatch(r"(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?", z)
    if not m:
        raise ValueError(zone)
    s = int(m[2]) * 3600 + int(m[3] or 0) * 60
    if s > 15 * 3600:
        raise ValueError(zone)
    return -s if m[1] == "-" else s


def parse(value: str | None, date_order: str = "dmy") -> tuple[int, int | None] | None:
    """(wall-clock seconds since 1970, offset in seconds or None) of a notation, or None."""
    if not value:
        return None
    v = " ".join(value.split())
    if _EPOCH.fullmatch(v):
        return int(v) // {9: 1, 10: 1, 13: 1000, 16: 1_000_000}[len(v)], 0
    for rx in NOTATIONS:
        m = rx.fullmatch(v)
        if not m:
            continue
        g = m.groupdict()
        try:
            if g.get("name"):
                month, day = _MONTHS[g["name"][:3].lower()], int(g["d"])
            elif g.get("mo"):
                month, day = int(g["mo"]), int(g["d"])
            else:
                day, month = (int(g["q"]), int(g["p"])) if date_order == "mdy" else (int(g["p"]), int(g["q"]))
            h, mi, s = int(g["h"]), int(g["mi"] or 0), int(g.get("s") or 0)
            if half := (g.get("half") or "").replace(".", "").upper():
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + (12 if half in ("PM", "CH") else 0)
            if h > 23 or mi > 59 or s > 59:
                return None
            days = datetime.date(int(g["y"]), month, day).toordinal() - _DAY_0
            return days * 86400 + h * 3600 + mi * 60 + s, _offset(g.get("zone"))
        except (ValueError, KeyError):
            return None
    return None


def parsed(value: Column, date_order: Column) -> Column:
    """Struct (wall long, off int) of a value; wall is null where the value fixes no time. A task remembers the values that it has read."""
    memo: dict[tuple, tuple] = {}

    @F.pandas_udf("wall long, off int")
    def run(v: pd.Series, o: pd.Series) -> pd.DataFrame:
        if len(memo) > 200_000:
            memo.clear()
        rows = []
        for k in zip(v, o):
            r = memo.get(k)
            if r is None:
                r = memo[k] = parse(k[0], k[1] if isinstance(k[1], str) else "dmy") or (None, None)
            rows.append(r)
        return pd.DataFrame({"wall": pd.array([r[0] for r in rows], "Int64"), "off": pd.array([r[1] for r in rows], "Int32")})

    return run(value, date_order)


def zone_instant(wall: Column, zone: Column) -> Column:
    """Epoch seconds of a wall-clock time (seconds) in an IANA zone; null when skipped or doubled there."""
    local = F.timestamp_seconds(wall)
    u = F.to_utc_timestamp(local, zone)
    sec = F.unix_seconds(u)
    back = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone))
    doubled = F.lit(False)
    for d in (1800, 3600, 7200):
        doubled = doubled | (back(sec + d) == wall) | (back(sec - d) == wall)
    return F.when((back(sec) == wall) & ~doubled, sec)


def utc_text(sec: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of epoch seconds, whatever the session's zone."""
    day, rest = F.floor(sec / 86400), F.pmod(sec, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("int").cast("string"), 2, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))


#: Years whose values are evidence of a zone.
FIRST_YEAR, LAST_YEAR = 1990, 2037
#: Leads over ingestion, in quarters of an hour, that some offset but not every one allows.
LEAST_LEAD, MOST_LEAD = -56, 60


@lru_cache(maxsize=1)
def histories() -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(zone, days, offsets): each different offset history once, under its first name.

    ``offsets`` are quarters of an hour, each from its day (since 1970, at noon) on.
    """
    first, last = datetime.date(FIRST_YEAR, 1, 1).toordinal(), datetime.date(LAST_YEAR, 12, 31).toordinal()
    noon = lambda d: datetime.datetime.combine(datetime.date.fromordinal(d), datetime.time(12))
    weeks = [noon(d) for d in range(first, last + 1, 7)]
    known: dict[tuple, str] = {}
    for name in sorted(zoneinfo.available_timezones()):
        if "/" not in name or name.startswith("Etc/"):
            continue
        z = zoneinfo.ZoneInfo(name)
        at = lambda t: round(z.utcoffset(t).total_seconds() / 900)  # noqa: E731, B023
        seen = list(map(at, weeks))
        steps = [(first - _DAY_0, seen[0])]
        for k in np.flatnonzero(np.diff(seen)).tolist():
            lo, hi = first + 7 * k, first + 7 * k + 7
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(noon(mid)) == seen[k] else (lo, mid)
            steps.append((hi - _DAY_0, seen[k + 1]))
        known.setdefault(tuple(steps), name)
    return [(name, np.array([s[0] for s in steps]), np.array([s[1] for s in steps])) for steps, name in known.items()]


def _same_history(zone: str | None, all_: list[tuple[str, np.ndarray, np.ndarray]], day: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which histories (rows of ``off``, by ``day``) agree with a zone on all days."""
    try:
        z = zoneinfo.ZoneInfo(zone or "-")
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return np.zeros(len(all_), bool)
    days, back = np.unique(day, return_inverse=True)
    own = np.array([round(z.utcoffset(datetime.datetime.combine(datetime.date.fromordinal(int(d) + _DAY_0), datetime.time(12))).total_seconds() / 900) for d in days])[back]
    return (off == own).all(axis=1)


def fit_histories(sums: pd.DataFrame, all_: list[tuple[str, np.ndarray, np.ndarray]], declared: str | None, trust: float, least: int, prefer: list[str]) -> list[tuple[int, int, str, int, int]]:
    """(first day, day after the last, zone, violations, n) of one source's spans, from its sums (day, stated, q, n, slack)."""
    s = sums.sort_values("day", kind="stable")
    day, stated, q, n, slack = (s[c].to_numpy() for c in ("day", "stated", "q", "n", "slack"))
    months, month = np.unique(day // 30, return_inverse=True)
    bad, delay = np.zeros((len(all_), len(months))), np.zeros((len(all_), len(months)))
    off = np.zeros((len(all_), len(day)), np.int16)
    for h, (_, days, offsets) in enumerate(all_):
        k = np.searchsorted(days, day, side="right") - 1
        o = offsets[k]
        off[h] = o
        changing = (k > 0) & (days[k] == day) | (np.append(days, 1 << 40)[k + 1] == day + 1)
        wrong = np.where(stated, q != o, o < q) & ~changing
        bad[h] = np.bincount(month, np.where(wrong, n, 0), len(months))
        delay[h] = np.bincount(month, np.where(stated | wrong, 0, slack + o * 900.0 * n), len(months))
    total, locals_ = np.bincount(month, n, len(months)), np.bincount(month, np.where(stated, 0, n), len(months))
    bad, delay, total, locals_ = (np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1) for x in (bad, delay, total, locals_))

    def best(a: int, e: int) -> tuple[str, int]:
        on = (month >= a) & (month < e)
        b, d = bad[:, e] - bad[:, a], delay[:, e] - delay[:, a]
        own = _same_history(declared, all_, day[on], off[:, on])
        if own.any() and b[own].min() - b.min() <= max(3, trust * (total[e] - total[a])):
            return str(declared), int(b[own].min())
        fits = np.flatnonzero(b == b.min())
        near = fits[d[fits] <= d[fits].min() + 1800.0 * max(1.0, locals_[e] - locals_[a])]
        told = [(d[near][same].min(), k, z) for k, z in enumerate(prefer) if (same := _same_history(z, all_, day[on], off[:, on])[near]).any()]
        if told:
            return min(told)[2], int(b.min())
        return min((d[h], all_[h][0]) for h in fits)[1], int(b.min())

    def spans(a: int, e: int) -> list[tuple[int, int]]:
        whole = (bad[:, e] - bad[:, a]).min()
        if e - a < 2 or whole < least:
            return [(a, e)]
        parts = [(bad[:, c] - bad[:, a]).min() + (bad[:, e] - bad[:, c]).min() for c in range(a + 1, e)]
        c = int(np.argmin(parts))
        if whole - parts[c] < max(least, trust * (total[e] - total[a])):
            return [(a, e)]
        return spans(a, a + 1 + c) + spans(a + 1 + c, e)

    out, cuts = [], spans(0, len(months))
    for k, (a, e) in enumerate(cuts):
        zone, wrong = best(a, e)
        since = -(1 << 31) if k == 0 else int(months[a]) * 30
        until = (1 << 31) if k + 1 == len(cuts) else int(months[e]) * 30
        if out and out[-1][2] == zone:
            since, wrong = out[-1][0], wrong + out[-1][3]
            out[-1] = (since, until, zone, wrong, int(total[e] - total[a]) + out[-1][4])
        else:
            out.append((since, until, zone, wrong, int(total[e] - total[a])))
    return out


def estimate_zones(rows: DataFrame, source: str, wall: str, off: str, ingested: str, declared: str | None = None, trust: float = 0.2, least: int = 20, prefer: list[str] | None = None) -> DataFrame:
    """(source, since, until, zone, violations, n): the offset history that fits each source best, by spans of wall-clock days.

    ``wall`` and ``off`` come from ``parsed``; ``ingested`` is in epoch seconds.
    ``declared`` names the column of a declared zone (the least one of a source counts):
    it stands unless another history has fewer violations by more than ``trust`` of the
    values and more than three. A span is cut where that saves as large a share, and ``least`` violations.
    Histories of ``prefer`` win against others that leave less delay by under half an
    hour a value.
    """
    known = F.lit(None).cast("string") if declared is None else F.col(declared)
    r = rows.select(F.col(source).alias("source"), F.col(wall).alias("wall"), F.col(off).alias("off"), F.col(ingested).alias("seen"), known.alias("declared"))
    r = r.where("source is not null and wall is not null").withColumn("day", F.floor(F.col("wall") / 86400).cast("int"))
    edge = lambda y, m, d: datetime.date(y, m, d).toordinal() - _DAY_0
    r = r.where(F.col("day").between(edge(FIRST_YEAR, 1, 2), edge(LAST_YEAR, 12, 30)))
    # An offset of zero may be UTC of a machine: it neither supports nor contradicts a zone.
    lead = F.greatest(F.lit(LEAST_LEAD), F.least(F.lit(MOST_LEAD), F.ceil((F.col("wall") - F.col("seen")) / 900)))
    r = r.where("off is null and seen is not null or off <> 0 or declared is not null").withColumn("stated", F.col("off").isNotNull())
    r = r.withColumn("q", F.when(F.col("off").isNull(), lead).otherwise(F.rint(F.col("off") / 900)).cast("int"))
    silent = F.coalesce(F.col("off") == 0, F.col("seen").isNull())
    r = r.withColumn("n", F.when(silent, 0).otherwise(1)).withColumn("q", F.when(silent, F.when(F.col("stated"), 0).otherwise(LEAST_LEAD)).otherwise(F.col("q")))
    sums = r.groupBy("source", "day", "stated", "q").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("stated"), F.coalesce(F.col("seen") - F.col("wall"), F.lit(0)))).alias("slack"), F.min("declared").alias("declared"))
    return sums.groupBy("source").applyInPandas(_fitter(histories(), trust, least, list(prefer or [])), f"source {dict(r.dtypes)['source']}, since int, until int, zone string, violations long, n long")


def _fitter(all_: list, trust: float, least: int, prefer: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(s: pd.DataFrame) -> pd.DataFrame:
        told = s["declared"].dropna()
        got = fit_histories(s.fillna({"slack": 0}), all_, min(told) if len(told) else None, trust, least, prefer)
        cut = [(s["source"].iloc[0], max(a, -(1 << 31)), min(e, (1 << 31) - 1), z, v, n) for a, e, z, v, n in got]
        return pd.DataFrame(cut, columns=["source", "since", "until", "zone", "violations", "n"])

    return fit


def with_zones(rows: DataFrame, zones: DataFrame, source: str, wall: str) -> DataFrame:
    """Rows with the ``zone`` of their source at their wall-clock day."""
    z = zones.select(F.col("source").alias("_source"), "since", "until", "zone")
    day = F.floor(F.col(wall) / 86400)
    return rows.join(z, (F.col(source) == F.col("_source")) & (day >= F.col("since")) & (day < F.col("until")), "left").drop("_source", "since", "until")


def instants(wall: Column, off: Column, zone: Column) -> Column:
    """Epoch seconds: by the stated offset, else by the zone."""
    return F.when(off.isNotNull(), wall - off).otherwise(zone_instant(wall, zone))
