"""The usage meter with keyed state: what accounts have used in a period stands in the stream's state store, so no batch reads the history again.

Accounts share state by buckets of a hash, as a call into Python for each account
and batch costs milliseconds: a batch writes the buckets that it touches anew.

A period's state goes by a timer some time after the period's end, when its final
count is told. State, timers and input offsets are one checkpoint, and a batch
that is run again replaces what it wrote: counts and alerts are exact after any
failure. Events of an account in one batch are summed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lexiloom.streaming.counters import THRESHOLDS, put, run

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of accounts (and one of rows without an account): calls of a batch are as many a period, however many accounts there are.
BUCKETS = 256
OUTPUT = "account long, period string, kind string, percent int, count long"


class Meter(StatefulProcessor):
    """Of each period and bucket of accounts the counts so far; a row for each share of the limit that a batch crosses, and the counts at the period's end.

    A bucket's accounts and counts are two arrays in ascending order of accounts, so a batch is added to all of them at once.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "accounts binary, counts binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        accounts, at = np.unique(batch["account"].to_numpy(np.int64), return_inverse=True)
        added = np.zeros(len(accounts), np.int64)
        np.add.at(added, at, batch["amount"].to_numpy(np.int64))
        held, counts = self._held()
        if not len(held):
            self.handle.registerTimer(int(batch["ends"].max()))
        place = np.searchsorted(held, accounts)
        known = np.zeros(len(accounts), bool)
        known[place < len(held)] = held[place[place < len(held)]] == accounts[place < len(held)]
        before = np.zeros(len(accounts), np.int64)
        before[known] = counts[place[known]]
        count = before + added
        counts[place[known]] = count[known]
        held, counts = np.insert(held, place[~known], accounts[~known]), np.insert(counts, place[~known], count[~known])
        self.used.update((held.tobytes(), counts.tobytes()))
        yield self._rows(key, "usage", None, accounts, count)
        for p in THRESHOLDS:
            mark = -(-self.limit * p // 100)
            if (crossed := (before < mark) & (mark <= count)).any():
                yield self._rows(key, "alert", p, accounts[crossed], count[crossed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.used.exists():
            held, counts = self._held()
            self.used.clear()
            yield self._rows(key, "final", None, held, counts)

    def close(self) -> None:
        pass

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        accounts, counts = self.used.get() if self.used.exists() else (b"", b"")
        return np.frombuffer(accounts, np.int64), np.frombuffer(counts, np.int64).copy()

    @staticmethod
    def _rows(key, kind: str, percent: int | None, accounts: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        named = accounts if key[1] >= 0 else None
        return pd.DataFrame({"account": pd.array(named if named is not None else [None] * len(accounts), "Int64"), "period": key[0], "kind": kind, "percent": pd.array([percent] * len(accounts), "Int32"), "count": counts})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's events as one row an account and period, a bounded number of rows at a time."""
    for batch in batches:
        sums = pa.table(batch.columns, names=batch.schema.names).group_by(["account", "period"]).aggregate([("amount", "sum"), ("ends", "max"), ("at", "max")])
        yield from sums.select(["account", "period", "amount_sum", "ends_max", "at_max"]).rename_columns(["account", "period", "amount", "ends", "at"]).combine_chunks().to_batches()


def metered(events: DataFrame, account: Column, at: Column, period: Column, ends: Column, amount: Column, limit: int, late: str) -> DataFrame:
    """account, period, kind (usage, alert or final), percent, count: a stream.

    at: an event's time; ends: its period's end; late: how long after the end events of a period still count.
    """
    rows = events.select(account.cast("long").alias("account"), period.alias("period"), amount.cast("long").alias("amount"), F.unix_millis(ends).alias("ends"), at.alias("at"))
    summed = rows.mapInArrow(_summed, rows.schema).withWatermark("at", late)
    bucket = F.when(F.col("account").isNull(), -1).otherwise(F.pmod(F.xxhash64("account"), F.lit(BUCKETS))).cast("int")
    dealt = summed.withColumns({"bucket": bucket, "account": F.coalesce("account", F.lit(0))})
    return dealt.groupBy("period", "bucket").transformWithStateInPandas(Meter(limit), OUTPUT, "append", "EventTime")


def meter(events: DataFrame, account: Column, at: Column, period: Column, ends: Column, amount: Column, limit: int, late: str, out: str, checkpoint: str) -> None:
    """Put what metered() gives under `out` for all that has arrived; the state store is set for this stream alone."""
    conf = events.sparkSession.conf
    old = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        run(metered(events, account, at, period, ends, amount, limit, late), checkpoint, lambda batch, number: put(batch, number, out))
    finally:
        conf.set(_PROVIDER, old) if old else conf.unset(_PROVIDER)
