"""Counters as streams: each micro-batch adds its sums to a table under its own number.

A batch that is run again replaces what it wrote, so counts are exact after any
failure. No state is kept in the stream, so events may come as late as they
like: the day an event belongs to is in its key, and a late one adds to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.operators import analytics as A
from lexiloom.sources.search_log import KEYS, event_keys

#: Shares of a limit, in hundredths, at which an account is told.
THRESHOLDS = (80, 100)


def event_stream(spark: SparkSession, directory: str, files: str, schema: StructType, per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a directory whose names fit the pattern, as they arrive, at most so many a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(directory)


def put(batch: DataFrame, number: int, out: str) -> None:
    """Write a batch's rows under its number; the same batch again replaces them."""
    batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)


def run(events: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Hand all that has arrived to `each`, batch by batch."""
    events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def run_once(events: DataFrame, out: str, checkpoint: str) -> None:
    """Count the searches that have arrived by the keys of the search log."""

    def save(batch: DataFrame, number: int) -> None:
        put(batch.select(*event_keys(), (F.col("value") < 20).alias("miss")).groupBy(*KEYS).agg(F.count("*").alias("searches"), F.count_if("miss").alias("misses")), number, out)

    run(events, checkpoint, save)


def current(spark: SparkSession, out: str, keys: list[str] = KEYS, sums: tuple[str, ...] = ("searches", "misses")) -> DataFrame:
    """The counts of each key over all batches."""
    return spark.read.parquet(out).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def compacted(spark: SparkSession, out: str, to: str, keys: list[str] = KEYS, sums: tuple[str, ...] = ("searches", "misses")) -> None:
    """The counts of all batches as one batch of another table, numbered as the last of them."""
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    if last is not None:
        put(current(spark, out, keys, sums), last, to)


def meter(events: DataFrame, account: Column, period: Column, amount: Column, limit: int, out: str, checkpoint: str) -> None:
    """Usage by account and month, and an alert for each share of the limit that a batch's sums cross.

    An alert's id is made of what it tells, so it is the same when a batch is run again.
    """

    def save(batch: DataFrame, number: int) -> None:
        added = batch.groupBy(account.alias("account"), period.alias("period")).agg(F.sum(amount).cast("long").alias("count"))
        put(added, number, f"{out}/usage")
        usage = batch.sparkSession.read.parquet(f"{out}/usage")
        now = usage.filter(F.col("batch") == number).select("account", "period", F.col("count").alias("added"))
        before = usage.filter(F.col("batch") < number).join(now.select("account", "period"), ["account", "period"], "left_semi").groupBy("account", "period").agg(F.sum("count").alias("before"))
        rows = now.join(before, ["account", "period"], "left").fillna(0, ["before"]).withColumn("percent", F.explode(F.array(*map(F.lit, THRESHOLDS))))
        at = F.ceil(F.lit(limit) * F.col("percent") / 100)
        crossed = rows.filter((F.col("before") < at) & (F.col("before") + F.col("added") >= at))
        put(crossed.select(F.substring(F.sha2(F.concat_ws("|", "account", "period", "percent"), 256), 1, 16).alias("id"), "account", "period", "percent"), number, f"{out}/alerts")

    run(events, checkpoint, save)


def count_reports(raw: DataFrame, out: str, checkpoint: str) -> None:
    """Clients' sampled reports, counted by their weights; texts that are no report are kept aside, and never fail the stream."""

    def save(batch: DataFrame, number: int) -> None:
        good, refused = A.reports(batch)
        put(A.report_counts(good), number, f"{out}/counts")
        put(refused, number, f"{out}/refused")

    run(raw, checkpoint, save)
