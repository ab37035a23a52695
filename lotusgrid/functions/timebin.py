"""Six-hour bins of local wall-clock time."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_bin(ts: Column, hours: int = 6) -> Column:
    """The start of a wall-clock time's bin; ``ts`` without zone."""
    return F.window(ts, f"{hours} hours")["start"]


def local_wall(ts: Column, zone: str) -> Column:
    """Wall-clock time, without zone, of an instant; independent of the session's zone."""
    sec = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.unix_seconds(ts)), zone))
    return F.to_timestamp_ntz(F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(sec / 86400).cast("int")).cast("string"), F.lit(" 00:00:00"))) + F.make_dt_interval(secs=F.pmod(sec, F.lit(86400)).cast("decimal(18,6)"))


def iso(bin_start: Column, offset: str = "+07:00") -> Column:
    """ISO 8601 text of a bin of a zone with a fixed offset."""
    return F.concat(F.date_format(bin_start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def expected_bins(first: datetime.date, last: datetime.date, hours: int = 6) -> int:
    """Bins from the first to the last day, both whole."""
    return ((last - first).days + 1) * (24 // hours)


def is_covid_period(ts: Column) -> Column:
    return F.year(ts).isin(2020, 2021)


# First hours of the bins that vague words for times of day fall into.
VAGUE_BINS = {"rạng sáng": 0, "nửa đêm": 0, "khuya": 0, "sáng sớm": 6, "sáng": 6, "giữa trưa": 12, "trưa": 12, "chiều": 12, "chiều tối": 18, "tối": 18, "đêm": 18}


def vague_bin(phrase: Column) -> Column:
    """Start hour of the bin of a vague time of day; null when unknown."""
    pairs = [x for k, v in VAGUE_BINS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(phrase)))
