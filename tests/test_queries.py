"""Every registered query with SQL gives what DuckDB gives for it on the same tables; the stream equals the batch."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from lexiloom.plans import catalog
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SMALL)
    cursor = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(cursor.columns)
    at = [cursor.columns.index(c) for c in df.columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == want


def test_stream_equals_batch(spark):
    rows = lambda name: Counter(tuple(r) for r in catalog.queries()[name](spark, SMALL).select("day", "app_id", "query", "locale", "country", "searches", "misses").collect())
    assert rows("stream_query_daily") == rows("query_daily_rollup")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_normalized_text_is_whole(spark):
    from lexiloom.functions.text import normalize

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.normalized for r in catalog.queries()["normalized_text"](spark, SMALL).collect()}
    assert got == {i: normalize(t, 1 << 30) for i, t in texts.items()} and max(len(t or "") for t in got.values()) > 64
