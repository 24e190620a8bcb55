"""The search log: daily counts by application, query, locale and country, derived from raw events."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.tables import read_table

KEYS = ["day", "app_id", "query", "locale", "country"]


def event_keys() -> list[Column]:
    """The keys of a search, from an event row; the user is the account, with two applications."""
    by = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % n + 1).cast("int"))
    return [
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.col("user_id") * 10 + F.col("event_id") % 2).alias("app_id"),
        F.concat_ws(" ", "event_type", (F.get_json_object("props", "$.k").cast("int") % 4).cast("string")).alias("query"),
        by(3, ["en", "fr", "de"]).alias("locale"),
        by(5, ["XX", "US", "FR", "DE", "GB"]).alias("country"),
    ]


def query_daily(events: DataFrame) -> DataFrame:
    """day, app_id, query, locale, country, searches, misses. A null id, time or value counts as any other key or as no miss."""
    rows = events.select(*event_keys(), (F.col("value") < 20).alias("miss"))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("searches"), F.count_if("miss").alias("misses"))


def load(spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The log of a table of events, of all days or of a window's; days are compared as times, so that the scan can skip row groups."""
    events = read_table(spark, sf_dir, "events")
    time = lambda day: F.lit(day).cast(events.schema["ts"].dataType)
    if first:
        events = events.filter(F.col("ts") >= time(first))
    if last:
        events = events.filter(F.col("ts") < time((date.fromisoformat(last) + timedelta(days=1)).isoformat()))
    return query_daily(events)


def account() -> Column:
    """The account that owns an application."""
    return F.floor(F.col("app_id") / 10)
