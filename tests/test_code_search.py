"""Search over codes against a search over the vectors themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import code_search as CS


def plainly(rows, queries, k):
    out = []
    for q, v in queries:
        dots = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out += [(q, i, place, -d) for place, (d, i) in enumerate(dots[:k], 1)]
    return out


@pytest.mark.parametrize(("k", "shard"), [(1, 40), (5, 1 << 20), (400, 97)])
def test_codes_find_what_vectors_do(spark, monkeypatch, k, shard):
    monkeypatch.setattr(CS, "SHARD_ROWS", shard)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 12)) * rng.choice([0.01, 1, 50], size=(300, 1)))]
    rows += [(300, [0.0] * 12), (301, rows[5][1]), (302, rows[5][1]), (303, [1e-30] * 12)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.filter("id % 10 = 1 or id >= 300").withColumnRenamed("id", "query_id")
    got = [(r.query_id, r.id, r.place, r.dot) for r in CS.nearest(asked, df, k).orderBy("query_id", "place").collect()]
    want = plainly(rows, sorted((i, v) for i, v in rows if i % 10 == 1 or i >= 300), k)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_few_rows_are_left_and_bounds_hold(spark):
    """Vectors around a few centres: signs and 8-bit numbers rule nearly all rows out."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 64))
    vectors = centres[rng.integers(20, size=2000)] + 0.2 * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<float>")
    codes = CS.coded(df)
    found = CS.candidates(codes.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), codes, 5).collect()
    assert len(found) < 40 * 60 and max(r.read for r in found) < 300
    exact = vectors.astype(np.float32).astype(float)
    assert all(r.low <= exact[r.query_id] @ exact[r.id] <= r.high for r in found)


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 1.0]), (6, []), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = CS.nearest(df.withColumnRenamed("id", "query_id"), df, 3).select("query_id", "id", "dot", "place").collect()
    assert sorted(map(tuple, got)) == [(1, 5, 4.0, 1), (5, 1, 4.0, 1)]
    empty = df.limit(0)
    assert CS.nearest(empty.withColumnRenamed("id", "query_id"), df, 3).count() == 0
    assert CS.nearest(df.filter(F.col("id") == 1).withColumnRenamed("id", "query_id"), empty, 3).count() == 0


def test_f9_queries_meet_a_shard_as_blocks(monkeypatch):
    """Where signs rule nothing out, a block of queries is one product of matrices; bounds hold at any scale."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(4000, 64)) * rng.choice([1e-30, 1.0, 1e20], size=(4000, 1))
    scale = np.abs(v).max(axis=1) / 127
    numbers = np.floor(v / scale[:, None] + 0.5)
    length = lambda x: np.sqrt((x / 1e10) ** 2 @ np.ones(64)) * 1e10
    signs = ["".join("1" if x >= 0 else "0" for x in row) for row in v]
    rows = pd.DataFrame({"id": range(4000), "signs": signs, "numbers": list(numbers.astype(np.int8)), "scale": scale, "length": length(v), "slack": length(v - numbers * scale[:, None])})
    taken = []
    bounds = CS._Codes.bounds
    monkeypatch.setattr(CS._Codes, "bounds", lambda self, at, q, k, dots=None: taken.append(len(at) if dots is None else 0) or bounds(self, at, q, k, dots))
    asked = CS._Codes(rows.iloc[::50])
    met = list(CS._Codes(rows).found(asked, 10))
    assert len(met) == 80 and max(taken) <= 10 * CS.FIRST
    for at, use, low, high, _ in met:
        dots = np.delete(v @ v[50 * at], 50 * at)
        assert set(np.delete(np.arange(4000), 50 * at)[np.argsort(-dots)[:10]]) <= set(use)
        assert (low <= v[use] @ v[50 * at]).all() and (v[use] @ v[50 * at] <= high).all()
