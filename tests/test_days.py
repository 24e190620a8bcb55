"""Calendar days against Python's own calendar."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from lexiloom.functions import days as D


def test_days_of_the_calendar(spark):
    cases = {"2024-02-29": True, "2023-02-29": False, "2024-2-9": False, "2024-13-01": False, "": False, "2024-01-01\n": False, " 2024-01-01": False, None: False}
    rows = spark.createDataFrame([(c,) for c in cases], "day string")
    assert {r.day: r.ok for r in rows.select("day", D.is_day(F.col("day")).alias("ok")).collect()} == cases


def test_lengths_of_windows(spark):
    cases = [("12-20", "01-05", True, 17), ("01-01", "12-31", True, 365), ("02-29", "03-01", True, None), ("05-05", "05-05", True, 1), ("05-05", "05-04", True, 365), ("2024-02-28", "2024-03-01", False, 3), ("2024-03-02", "2024-03-01", False, 0), ("2024-03-05", "2024-03-01", False, -3), (None, "2024-03-01", False, None)]
    rows = spark.createDataFrame(cases, "a string, b string, yearly boolean, want int")
    assert [r.got for r in rows.select("want", D.window_days(F.col("a"), F.col("b"), F.col("yearly")).alias("got")).collect()] == [c[3] for c in cases]


def test_day_in_zones(spark):
    zones = ["Asia/Tokyo", "America/New_York", "Pacific/Kiritimati", "Nowhere/None", None]
    first = datetime(2024, 3, 9, 0, 30, tzinfo=ZoneInfo("UTC"))
    rows = [(i, z, int((first + timedelta(hours=i)).timestamp())) for i in range(60) for z in zones]
    df = spark.createDataFrame(rows, "i int, zone string, s long").withColumn("day", D.day_in(F.col("zone"), F.timestamp_seconds("s")))
    known = lambda z: ZoneInfo(z if z in zones[:3] else "UTC")
    want = {(i, z): str((first + timedelta(hours=i)).astimezone(known(z)).date()) for i in range(60) for z in zones}
    assert {(r.i, r.zone): r.day for r in df.collect()} == want
