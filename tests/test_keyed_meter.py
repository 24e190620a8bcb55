"""The meter with keyed state: sums and alerts of all events, ends of periods, and a restart in mid-batch."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexiloom.streaming import counters, keyed_meter

SCHEMA = "a int, at timestamp, n int"


def feed(spark, folder, rows):
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def read(spark, out):
    return sorted((r.kind, r.account, r.period, r.percent or 0, r["count"]) for r in spark.read.parquet(f"{out}/rows").collect())


def run(spark, out, late="1 day", per_batch=1):
    stream = counters.event_stream(spark, f"{out}/in", "*.parquet", spark.read.parquet(f"{out}/in").schema, per_batch)
    at = F.col("at")
    keyed_meter.meter(stream, F.col("a"), at, F.date_format(at, "yyyy-MM"), F.add_months(F.trunc(at, "month"), 1).cast("timestamp"), F.col("n"), 10, late, f"{out}/rows", f"{out}/check")


def test_state_gives_alerts_once_and_ends_periods(spark, tmp_path):
    out = f"file://{tmp_path}"
    day = lambda m, d: datetime(2024, m, d, 12)
    feed(spark, f"{out}/in", [(1, day(1, 2), 3), (1, day(1, 5), 2), (2, day(1, 9), 9), (1, day(1, 20), 5)])
    run(spark, out)
    assert read(spark, out) == [("alert", 1, "2024-01", 80, 10), ("alert", 1, "2024-01", 100, 10), ("alert", 2, "2024-01", 80, 9), ("usage", 1, "2024-01", 0, 3), ("usage", 1, "2024-01", 0, 5), ("usage", 1, "2024-01", 0, 10), ("usage", 2, "2024-01", 0, 9)]
    # a later run goes on from the state, and ends January when the time has passed it
    feed(spark, f"{out}/in", [(2, day(1, 30), 3), (1, day(2, 20), 1), (1, day(2, 21), 1)])
    run(spark, out)
    rows = read(spark, out)
    assert ("alert", 2, "2024-01", 100, 12) in rows and sum(r[0] == "alert" for r in rows) == 4
    assert [r for r in rows if r[0] == "final"] == [("final", 1, "2024-01", 0, 10), ("final", 2, "2024-01", 0, 12)]


def test_a_restart_in_mid_batch_changes_nothing(spark, tmp_path, monkeypatch):
    rows = [(k % 3, datetime(2024, 1, 1 + k % 28), 1 + k % 4) for k in range(12)]
    results = []
    for name, fails in (("a", False), ("b", True)):
        out = f"file://{tmp_path}/{name}"
        feed(spark, f"{out}/in", rows)
        if fails:
            whole = counters.put

            def half(batch, number, to):
                whole(batch.limit(1), number, to)  # some rows are written, then the batch fails
                if number == 2:
                    raise OSError("lost")
                whole(batch, number, to)

            monkeypatch.setattr(keyed_meter, "put", half)
            with pytest.raises(Exception, match="lost"):
                run(spark, out, per_batch=4)
            monkeypatch.undo()
        run(spark, out, per_batch=4)
        totals = {}
        for kind, account, _, _, count in read(spark, out):
            if kind == "usage":
                totals[account] = max(count, totals.get(account, 0))
        results.append((totals, [r for r in read(spark, out) if r[0] == "alert"]))
    want = {a: sum(n for k, _, n in rows if k == a) for a in range(3)}
    assert results[0][0] == results[1][0] == want
    assert [r[:4] for r in results[0][1]] == [r[:4] for r in results[1][1]] and len(results[0][1]) == 6
