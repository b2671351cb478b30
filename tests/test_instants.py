import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from chronolens.functions.instants import known_zones, utc_micros
from chronolens.operators.timestamps import SETTING, field_rows, new_dictionary, normalise, rewritten

UTC = dt.timezone.utc


def us(*parts, zone=UTC, fold=0):
    moment = dt.datetime(*parts, tzinfo=zone, fold=fold)
    return round((moment - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


BERLIN = ZoneInfo("Europe/Berlin")
CASES = [
    ("2025-10-12T20:35:08.120Z", us(2025, 10, 12, 20, 35, 8, 120000)),
    (" 2025-10-12t20:35:08z  ", us(2025, 10, 12, 20, 35, 8)),
    ("2025-10-12 20:35:08", us(2025, 10, 12, 20, 35, 8)),
    ("2025-10-12T20:35:08", us(2025, 10, 12, 20, 35, 8, zone=BERLIN)),
    ("2025-10-12T20:35:08.5", us(2025, 10, 12, 20, 35, 8, 500000, zone=BERLIN)),
    ("2025-10-26T02:30:00", us(2025, 10, 26, 2, 30, zone=BERLIN, fold=0)),
    ("2025-10-12 20:35:08.903-0700", us(2025, 10, 13, 3, 35, 8, 903000)),
    ("2025-10-12T20:35:08+05:45[Asia/Kathmandu]", us(2025, 10, 12, 14, 50, 8)),
    ("2025-10-12T20:35:08.123456789Z", us(2025, 10, 12, 20, 35, 8, 123456)),
    ("27.09.2025 18:52:51", us(2025, 9, 27, 18, 52, 51, zone=BERLIN)),
    ("03/08/2026 01:23:33 PM", us(2026, 3, 8, 13, 23, 33, zone=BERLIN)),
    ("03/08/2026 12:23:33 AM", us(2026, 3, 8, 0, 23, 33, zone=BERLIN)),
    ("Fri, 01 May 2026 02:14:01 +0200", us(2026, 5, 1, 0, 14, 1)),
    ("2025-10-12 20:35:08 GMT", us(2025, 10, 12, 20, 35, 8)),
    ("20250925_155454_090654", us(2025, 9, 25, 15, 54, 54, 90654)),
    ("1758958870", 1758958870000000),
    ("1758815251796", 1758815251796000),
    ("1758895228128391", 1758895228128391),
    ("0000-00-00 00:00:00", None), ("2025-02-30 10:00:00", None), ("13/13/2025 10:00:00 AM", None), ("None", None), ("", None), ("unknown", None), (None, None), ("x" * 50_000, None),
]


def test_forms(spark):
    rows = [(raw, want) for raw, want in CASES]
    df = spark.createDataFrame(rows, "raw string, want long")
    got = df.select("raw", "want", utc_micros(F.col("raw"), F.lit("Europe/Berlin"), known_zones(spark)).alias("got")).collect()
    for r in got:
        assert r.got == r.want, r.raw and r.raw[:60]


def test_unknown_zone(spark):
    df = spark.createDataFrame([("2025-10-12T20:35:08",), ("2025-10-12 20:35:08",), (None,)], "raw string")
    for zone in (None, "Mars/Base", ""):
        got = df.select(utc_micros(F.col("raw"), F.lit(zone).cast("string"), known_zones(spark))).collect()
        assert [r[0] is None for r in got] == [True, False, True]


@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_session_zone_plays_no_part(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        test_forms(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dictionary_is_extended_not_rebuilt(spark):
    devices = spark.createDataFrame([("d", "Europe/Berlin"), ("d", "Europe/Berlin"), ("e", None)], "device_name string, time_zone string")
    shape = "k string, t string, device_name string, raw string, zone string"
    one = spark.createDataFrame([("a", "2025-10-12T20:35:08", "d", "x", "y"), ("a", "2025-10-12T20:35:08", "d", "x", "y"), ("b", "2025-10-12T20:35:08", None, "x", "y"), ("c", None, "d", "x", "y")], shape)
    two = spark.createDataFrame([("d", "2025-10-12T20:35:08", "d", "x", "y"), ("e", "1758958870", "e", "x", "y"), ("f", "2025-10-12T20:35:08.000000+00:00", "d", "x", "y")], shape)
    dictionary = new_dictionary(spark)
    batches = [field_rows(x, devices, "t", "k", "t") for x in (one, two)]
    assert normalise(batches, dictionary).count() == 6
    table = dictionary.read()
    assert table.count() == table.select("raw", "zone").distinct().count() == 4
    found = {tuple(r) for r in rewritten(batches, new_dictionary(spark)).collect()}
    berlin = us(2025, 10, 12, 20, 35, 8, zone=BERLIN)
    assert found == {("t", "a", "t", berlin), ("t", "d", "t", berlin), ("t", "e", "t", 1758958870000000)}


def test_empty(spark):
    devices = spark.createDataFrame([], "device_name string, time_zone string")
    empty = spark.createDataFrame([], "k string, t string, device_name string")
    assert rewritten([field_rows(empty, devices, "t", "k", "t")], new_dictionary(spark)).count() == 0


def test_a_dictionary_outlives_its_run(spark, tmp_path):
    devices = spark.createDataFrame([("d", "Europe/Berlin")], "device_name string, time_zone string")
    rows = lambda *raw: field_rows(spark.createDataFrame([(r, r, "d") for r in raw], "k string, t string, device_name string"), devices, "t", "k", "t")
    spark.conf.set(SETTING, str(tmp_path / "instants"))
    try:
        first = rows("2025-10-12T20:35:08", "1758958870")
        assert normalise([first], new_dictionary(spark)).count() == 2
        files = sorted(p.name for p in (tmp_path / "instants").glob("*.parquet"))
        again = normalise([first, rows("1758958870", "1758958871")], new_dictionary(spark))
        assert again.count() == 4 and again.where("utc_us IS NULL").count() == 0
        assert new_dictionary(spark).read().count() == 3
        assert set(files) <= {p.name for p in (tmp_path / "instants").glob("*.parquet")}
    finally:
        spark.conf.unset(SETTING)
