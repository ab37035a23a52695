import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lotusgrid.operators import times


@pytest.mark.parametrize(
    "value,order,want",
    [
        ("2022-07-14T04:00:20+01:00", "dmy", "2022-07-14 04:00:20 +3600"),
        ("2020-08-18T14:26:26Z", "dmy", "2020-08-18 14:26:26 +0"),
        ("2022-12-29T08:32:22.426Z", "dmy", "2022-12-29 08:32:22 +0"),
        ("2025-02-11 23:28:06.063389+0700", "dmy", "2025-02-11 23:28:06 +25200"),
        ("20220614T174732Z", "dmy", "2022-06-14 17:47:32 +0"),
        ("20241127T120000+0700", "dmy", "2024-11-27 12:00:00 +25200"),
        ("21:36 04.11.2024", "dmy", "2024-11-04 21:36:00 None"),
        ("21:36 04.11.2024", "mdy", "2024-04-11 21:36:00 None"),
        ("Thứ Hai, 29/03/2021, 16:02 (GMT+7)", "dmy", "2021-03-29 16:02:00 +25200"),
        ("Chủ Nhật, ngày 03/14/2021 - 01:37:31", "mdy", "2021-03-14 01:37:31 None"),
        ("15/6/2023 12:44 SA", "dmy", "2023-06-15 00:44:00 None"),
        ("15/6/2023 12:44 CH", "dmy", "2023-06-15 12:44:00 None"),
        ("19/3/2021 5:06 PM", "dmy", "2021-03-19 17:06:00 None"),
        ("16-6-2020 17h15", "dmy", "2020-06-16 17:15:00 None"),
        ("10 giờ 28 phút, ngày 28 tháng 5 năm 2025", "mdy", "2025-05-28 10:28:00 None"),
        ("Thu, 21 Oct 2021 08:09:22 +0700", "dmy", "2021-10-21 08:09:22 +25200"),
        ("August 16, 2023 3:03 PM ICT", "dmy", "2023-08-16 15:03:00 +25200"),
        ("November 3, 2019 12:07 AM EDT", "mdy", "2019-11-03 00:07:00 -14400"),
        ("13 May 2019, 13:21", "dmy", "2019-05-13 13:21:00 None"),
        ("Sun Feb 14 03:02:49 2021", "dmy", "2021-02-14 03:02:49 None"),
        (" 2021-01-02  03:04 ", "dmy", "2021-01-02 03:04:00 None"),
        ("1601519746", "dmy", "2020-10-01 02:35:46 +0"),
        ("1682319948605", "dmy", "2023-04-24 07:05:48 +0"),
    ],
)
def test_notations(value, order, want):
    wall, off = times.parse(value, order)
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=wall)
    assert f"{at} {'None' if off is None else f'{off:+d}'}" == want


@pytest.mark.parametrize("value", [None, "", "hôm qua", "2023-04-09", "27/09/2022", "2022-02-30 22:55", "31/04/2022 10:00", "12/31/2022 10:00", "2022-01-01 24:10", "13:00 PM 1/1/2020", "18:00", "n/a", "1/1/2020 13:00 CH", "x" * 10000])
def test_values_that_fix_no_time(value):
    assert times.parse(value, "dmy") is None


def test_column_reading_equals_parse(spark):
    values = [None, "", "x", "2022-02-30T10:00:00Z", "2022-02-28T24:00:00Z", "2022-02-28T23:60:00", "2022-02-28 23:59", "2022-02-28T23:59:58", "2022-02-28T23:59:58,123+0530", "2022-02-28T23:59-09:30", "2022-02-28T23:59:01+15:30", "2022-02-28T23:59:01-1445",
              "2022-02-28T23:59:01.5Z", "0000-01-01T00:00", "1969-12-31T23:59:59Z", "999999999", "1601519746", "1682319948605", "1682319948605123", "12345", "20240301T060000+0700", " 2021-01-02 03:04 ", "2022-12-31T00:00:00 +07:00", "15/6/2023 12:44 SA", "2022-02-28T23:59+7", "2022-02-28T23:59+07", "١٦٠١٥١٩٧٤٦"]
    df = spark.createDataFrame([(k, v, o) for k, v in enumerate(values * 2) for o in ("dmy", None)], "k int, v string, o string")
    for r in df.select("k", "v", times.parsed(F.col("v"), F.col("o")).alias("t")).collect():
        want = times.parse(r.v) if r.v else None
        assert ((r.t.wall, r.t.off) if r.t.wall is not None else None) == want, r.v


def _instant(wall: datetime.datetime, zone: str):
    z = ZoneInfo(zone)
    a, b = (wall.replace(tzinfo=z, fold=f) for f in (0, 1))
    ok = a.utcoffset() == b.utcoffset() and a.astimezone(ZoneInfo("UTC")).astimezone(z).replace(tzinfo=None) == wall
    return int(a.timestamp()) if ok else None


def test_zone_instant_against_brute_force(spark):
    rows = []
    for zone in ("America/New_York", "Europe/London", "Australia/Sydney", "Asia/Ho_Chi_Minh", "Australia/Lord_Howe"):
        for day in (datetime.datetime(2021, 3, 14), datetime.datetime(2021, 11, 7), datetime.datetime(2022, 3, 27), datetime.datetime(2022, 10, 30), datetime.datetime(2021, 4, 4), datetime.datetime(2021, 10, 3)):
            rows += [(zone, day + datetime.timedelta(minutes=15 * k)) for k in range(24)]
    data = [(z, int((w - datetime.datetime(1970, 1, 1)).total_seconds())) for z, w in rows]
    df = spark.createDataFrame(data, "tz string, wall long")
    for session in ("UTC", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", session)
        got = {(r.tz, r.wall): (r.s, r.u) for r in df.select("tz", "wall", times.zone_instant(F.col("wall"), F.col("tz")).alias("s"), times.utc_text(times.zone_instant(F.col("wall"), F.col("tz"))).alias("u")).collect()}
        for (z, w), k in zip(rows, data):
            want = _instant(w, z)
            assert got[k][0] == want, (z, w)
            assert got[k][1] == (datetime.datetime.fromtimestamp(want, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if want is not None else None)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _logged(source, zone, first, n, days, offs=()):
    """Values of a source: written shortly before they were fetched, some with their offset."""
    rows = []
    for k in range(n):
        seen = datetime.datetime(*first, tzinfo=ZoneInfo("UTC")) + datetime.timedelta(days=days * k, minutes=37 * k)
        local = (seen - datetime.timedelta(minutes=5 + k)).astimezone(ZoneInfo(zone))
        off = int(local.utcoffset().total_seconds()) if k in offs else None
        rows.append((source, int((local.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)).total_seconds()), off, int(seen.timestamp()), "x"))
    return rows


LOG = "source string, wall long, off int, seen long, zone string"


def _offset(zone, day):
    return ZoneInfo(zone).utcoffset(datetime.datetime(1970, 1, 1) + datetime.timedelta(days=day, hours=12))


def test_zone_estimate_among_all_histories(spark):
    zones = {"a": "America/New_York", "b": "Asia/Ho_Chi_Minh", "c": "Australia/Sydney", "d": "Europe/London", "e": "Asia/Kathmandu"}
    rows = [r for s, z in zones.items() for r in _logged(s, z, (2021, 1, 1), 120, 3)]
    rows += [(None, 1, None, 2, "x"), ("a", None, None, 2, "x"), ("z", 5, None, None, "x"), ("y", 1_600_000_000, None, None, "x")]
    df = spark.createDataFrame(rows, LOG)
    got = {r.source: r for r in times.estimate_zones(df, "source", "wall", "off", "seen").collect()}
    assert set(got) == set(zones)
    for s, z in zones.items():
        assert got[s].violations == 0 and all(_offset(got[s].zone, d) == _offset(z, d) for d in range(18640, 18990, 10)), (s, got[s].zone)
    assert times.estimate_zones(df.limit(0), "source", "wall", "off", "seen").count() == 0


def test_declaration_is_evidence_and_a_history_may_change(spark):
    rows = [(*r[:4], "Asia/Ho_Chi_Minh") for r in _logged("wrong", "America/New_York", (2021, 1, 1), 100, 4, range(0, 100, 3))]
    rows += [(*r[:4], "Europe/Paris") for r in _logged("right", "Europe/Paris", (2021, 1, 1), 100, 4)]
    rows += [(*r[:4], "No/Where") for r in _logged("odd", "Asia/Tokyo", (2021, 1, 1), 100, 4, range(0, 100, 5))]
    rows += [(*r[:4], None) for r in _logged("moved", "Asia/Ho_Chi_Minh", (2020, 1, 1), 150, 3, range(0, 150, 2)) + _logged("moved", "Australia/Sydney", (2021, 6, 1), 150, 3, range(0, 150, 2))]
    zones = times.estimate_zones(spark.createDataFrame(rows, LOG), "source", "wall", "off", "seen", "zone")
    got = {}
    for r in zones.orderBy("source", "since").collect():
        got.setdefault(r.source, []).append(r)
    assert [r.zone for r in got["right"]] == ["Europe/Paris"] and got["right"][0].violations == 0
    assert len(got["wrong"]) == 1 and _offset(got["wrong"][0].zone, 18800) == _offset("America/New_York", 18800)
    assert len(got["odd"]) == 1 and _offset(got["odd"][0].zone, 18800) == _offset("Asia/Tokyo", 18800)
    first, second = got["moved"]
    assert first.until == second.since and abs(first.until - 18779) <= 60
    assert _offset(first.zone, 18500) == _offset("Asia/Ho_Chi_Minh", 18500) and all(_offset(second.zone, d) == _offset("Australia/Sydney", d) for d in (18800, 19000))
    joined = times.with_zones(spark.createDataFrame([("moved", 18500 * 86400), ("moved", 18900 * 86400), ("none", 0), (None, None)], "source string, wall long"), zones, "source", "wall").collect()
    assert sorted((r.wall or -1, r.zone) for r in joined if r.zone) == [(18500 * 86400, first.zone), (18900 * 86400, second.zone)] and len(joined) == 4


def test_found_query_covers_only_fixed_instants(spark, sf):
    import __spark_entry__ as entry

    got = entry.queries()["p3_found"](spark, sf).toPandas()
    assert len(got) and not got.duplicated(["tab", "row_id"]).any()
    assert got.utc.str.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ").all()


def test_weather_bins_unite_all_notations(spark, tmp_path):
    from lotusgrid.plans import reference

    same = ["2024-03-01T06:00:00+07:00", "2024-02-29T23:00:00Z", "2024-03-01 08:00:00+09:00", "01/03/2024 06:00", "20240301T060000+0700", "2024-03-01T06:00", "1709247600", "1709247600000"]
    rows = [(k, "c", b, float(k), 1.0, float(k), float(k), 50.0) for k, b in enumerate([*same, None, "n/a", "2024-03-01", "06:00"])]
    names = "reading_id long, h3_index string, time_bin string, temp_mean double, precipitation_sum double, visibility_min double, wind_speed_max double, humidity_mean double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/weather.parquet")
    (r,) = reference.q_weather_bins(spark, str(tmp_path)).collect()
    assert (r.h3_index, r.time_bin, r.n_rows, r.temp_mean, r.precipitation_sum, r.visibility_min, r.wind_speed_max) == ("c", same[0], 8, 3.5, 8.0, 0.0, 7.0)
