"""What the findings of round 3 named, each on tables made for it."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import duckdb

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import curation as C
from lexiloom.operators import editorial as D
from lexiloom.plans import catalog
from lexiloom.streaming import counters, keyed_meter


def same_as_sql(spark, folder, name, **tables):
    """Whether a query gives what its SQL gives over these tables (lists of SQL values with the columns' names and types)."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT PARQUET)")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    found = db.execute(catalog.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    plain = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    return want and Counter(tuple(map(plain, r)) for r in df.collect()) == want


def made(spark, df):
    """The physical plan of a query."""
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark, run):
    """What run() gives, and the rows that its stages hand to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda found: [found.apply(i) for i in range(found.size())])(store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none))}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = stages()
    result = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return result, sum(n for k, n in stages().items() if k not in before)


def test_f5_a_customer_without_orders_has_the_counts_of_the_sql(spark, tmp_path):
    customer = "SELECT i AS c_custkey, CAST(i % 25 AS INT) AS c_nationkey FROM range(4) t(i)"
    orders = "SELECT i AS o_orderkey, i % 3 AS o_custkey, CASE i % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' END AS o_orderstatus FROM range(9) t(i)"
    assert same_as_sql(spark, tmp_path, "child_counts_by_status", customer=customer, orders=orders)


def test_f2_prefixes_are_split_without_broadcasts(spark):
    df = spark.range(400).selectExpr("concat(char(97 + id % 7), char(97 + id % 5), id) AS q", "id % 9 + 1 AS bytes")
    want = Counter()
    sizes = {r.q: r.bytes for r in df.collect()}
    for r in C.split_keys(df, 60).collect():
        want[r.shard_key] += sizes[r.q]
    got = C.split_prefixes(df, 60)
    assert {r.shard_key: r.bytes for r in got.collect()} == want and sum(r.entries for r in got.collect()) == 400
    assert all("Broadcast" not in made(spark, f(df, 60)) for f in (C.split_keys, C.split_prefixes))


def test_f3_texts_meet_a_triggers_items_once(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    entry = lambda k: (f"e{k:03d}", rng.choice([["*"], ["FR"], ["US", "DE"]]), rng.choice([[], ["FR"]]), rng.sample(words, rng.choice([1, 1, 2, 3])), [(rng.randrange(40), rng.choice([0.5, 0.7, 0.9])) for _ in range(2)], k + 1)
    entries = spark.createDataFrame([entry(k) for k in range(240)], "id string, regions array<string>, except_regions array<string>, triggers array<string>, items array<struct<id:long,weight:double>>, place int").withColumn("window", F.lit(None).cast("struct<from:string,to:string,recurs:string>"))
    texts = spark.createDataFrame([(i, rng.choice(["FR", "US", None]), "2024-01-08", rng.sample(words, 1 + i % 3)) for i in range(400)], "query_id long, region string, day string, toks array<string>")
    hits = texts.withColumn("trigger", F.explode("toks")).join(entries.withColumn("trigger", F.explode("triggers")), "trigger").filter(D.in_scope(F.col("region"), F.col("day")))
    want = D._items(hits.withColumn("quality", F.lit(1.0)), 4).collect()
    got, rows = shuffled(spark, lambda: D.matched_in_text(texts, entries).collect())
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(want) > 1000
    assert rows < hits.count() / 2


@pytest.mark.parametrize("name", ["rejudged_runs", "trap_and_ceiling", "rank_with_folding"])
def test_f4_f6_f8_queries_and_answers_of_a_label_are_not_paired(spark, tmp_path, name):
    embeddings = "SELECT i AS vec_id, [CAST(sin(i * j) AS FLOAT) for j in range(1, 65)] AS embedding, CAST(i % 2 AS INT) AS label FROM range(6000) t(i)"
    same, rows = shuffled(spark, lambda: same_as_sql(spark, tmp_path, name, embeddings=embeddings))
    assert same and rows < 40_000


class Kept:
    """A state store of one value, and the timers that were set."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_f1_a_call_adds_a_batch_to_all_accounts_of_a_bucket():
    meter, kept = keyed_meter.Meter(10), Kept()
    meter.init(kept)
    add = lambda bucket, *rows: pd.concat(meter.handleInputRows(("2024", bucket), iter([pd.DataFrame(rows, columns=["account", "amount"]).assign(ends=7)]), None))
    told = lambda df: sorted((r.kind, r.account, None if pd.isna(r.percent) else r.percent, r["count"]) for _, r in df.iterrows())
    big = (1 << 60) + 1
    assert told(add(3, (big, 8), (-5, 1), (big, 1))) == [("alert", big, 80, 9), ("usage", -5, None, 1), ("usage", big, None, 9)]
    assert told(add(3, (9, 10), (big, 1))) == [("alert", 9, 80, 10), ("alert", 9, 100, 10), ("alert", big, 100, 10), ("usage", 9, None, 10), ("usage", big, None, 10)]
    assert kept.timers == [7]
    assert told(pd.concat(meter.handleExpiredTimer(("2024", 3), None, None))) == [("final", -5, None, 1), ("final", 9, None, 10), ("final", big, None, 10)]
    assert kept.value is None and add(-1, (0, 8))["account"].isna().all()  # rows without an account


def test_f14_a_batch_has_a_file_for_each_task(spark, tmp_path, monkeypatch):
    taken = []
    whole = counters.event_stream
    monkeypatch.setattr(counters, "event_stream", lambda *a: taken.append((len(list(Path(a[1].removeprefix("file://")).glob("*.parquet"))), a[4])) or whole(*a))
    events = "SELECT i AS event_id, i % 7 AS user_id, CASE i % 2 WHEN 0 THEN 'view' ELSE 'click' END AS event_type FROM range(500) t(i)"
    assert same_as_sql(spark, tmp_path, "stream_client_reports", events=events)
    tasks = spark.sparkContext.defaultParallelism
    assert taken == [(4 * tasks, tasks)]


def test_f11_a_text_is_cut_into_tokens_once(spark, tmp_path):
    conversations = "SELECT i AS conv_id, 1 AS turn, 'user' AS role, 'It''s number ' || i || ', and so on' AS text FROM range(50) t(i)"
    assert same_as_sql(spark, tmp_path, "text_windows", conversations=conversations)
    plan = catalog.queries()["text_windows"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
