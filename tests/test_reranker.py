"""The reranker's fit over all queries, five folds at once, against fits of one set in memory."""

from __future__ import annotations

import numpy as np
import pytest

from lexiloom.operators import evals as E


@pytest.fixture(scope="module")
def listed(spark):
    rng = np.random.default_rng(0)
    rows = []
    for q in range(150):
        x = rng.standard_normal((rng.integers(1, 9), 2)) * [1.0, 50.0] + [3.0, -20.0]
        score = 2 * x[:, 0] - 0.03 * x[:, 1] + 0.3 * rng.standard_normal(len(x))
        best = np.zeros(len(x)) if q % 25 == 3 else (score >= np.sort(score)[-1 - (q % 2 and len(x) > 2)]).astype(float)
        rows += [(q, i, float(a), float(b), 7.0, bool(r)) for i, ((a, b), r) in enumerate(zip(x, best, strict=True))]
    return spark.createDataFrame(rows, "query_id long, id int, a double, b double, flat double, relevant boolean").repartition(5)


def test_each_fold_equals_a_fit_in_memory(spark, listed):
    got = E.fit_reranker(listed, ["a", "b", "flat"], epochs=30)
    table = listed.withColumn("fold", E.folds(E.F.col("query_id"))).toPandas()
    table = table[table.groupby("query_id")["relevant"].transform("any")]
    assert len(got) == 5
    for fold, weights in enumerate(got):
        rest = table[table["fold"] != fold]
        want = E.softmax_fit(rest["query_id"].to_numpy(), rest["relevant"].to_numpy(float), rest[["a", "b", "flat"]].to_numpy(), 30, 0.05, 1e-3)
        assert np.allclose([weights[f] for f in ("a", "b", "flat")], want, rtol=1e-9, atol=1e-12)
    judged = E.held_out(listed, got).collect()
    own = listed.withColumn("fold", E.folds(E.F.col("query_id"))).toPandas()
    want = {}
    for (q, fold), rows in own.groupby(["query_id", "fold"]):
        ranked = rows.assign(s=sum(rows[f] * w for f, w in got[fold].items())).sort_values(["s", "id"], ascending=[False, True])["relevant"].to_list()
        want[q] = (fold, ranked.index(True) + 1 if True in ranked else 0)
    assert {r.query_id: (r.fold, r.first) for r in judged} == want


def test_nothing_to_learn_from(spark, listed):
    assert E.fit_reranker(listed.filter("query_id < 0"), ["a"], epochs=3) == [{"a": 0.0}] * 5
    assert E.fit_reranker(listed.filter("not relevant"), ["a"], epochs=3) == [{"a": 0.0}] * 5
