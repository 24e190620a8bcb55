"""Calendar days as text (yyyy-MM-dd), windows of days, and the day of a time in a zone."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the year, not a leap year, in which the days of yearly windows (MM-dd) are counted.
PLAIN_YEAR = "2023-"


def is_day(day: Column) -> Column:
    """Whether a text is a day of the calendar; null: false."""
    return F.coalesce(day.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & day.try_cast("date").isNotNull(), F.lit(False))


def window_days(first: Column, last: Column, yearly: Column) -> Column:
    """Days of a window, null if an end is no day (of any year: 02-29 is none); yearly windows may pass the year's end, dated ones that end before they start have none or fewer."""
    at = lambda c: F.when(yearly, F.concat(F.lit(PLAIN_YEAR), c)).otherwise(c)
    date = lambda c: F.when(is_day(at(c)), at(c).try_cast("date"))
    span = F.datediff(date(last), date(first)) + 1
    return F.when(yearly & (span <= 0), span + 365).otherwise(span)


def day_in(zone: Column, time: Column) -> Column:
    """The day of a timestamp in a time zone; that in UTC where the zone is null or unknown."""
    known = F.when(zone.isin(*sorted(available_timezones())), zone).otherwise("UTC")
    return F.date_format(F.convert_timezone(None, known, time.cast("timestamp_ntz")), "yyyy-MM-dd")
