"""Variants ranked side by side equal runs of their own."""

from __future__ import annotations

from lexiloom.operators import evals as E
from lexiloom.plans import evaluation as plan
from tests.conftest import SMALL


def test_variants_equal_separate_runs(spark):
    rows = E.kept(plan.candidates(spark, SMALL), "candidates")
    got = {(r.variant, r.half): tuple(r)[2:] for r in E.ablations(rows, plan.variants(), "half").collect()}
    assert {v for v, _ in got} == set(plan.variants()) and len(set(got.values())) > 3
    for name, order in plan.variants().items():
        alone = rows.withColumn("place", E.F.row_number().over(E.Window.partitionBy("query_id").orderBy(*order)))
        firsts = E.first_relevant(alone).withColumn("half", E.F.when(E.F.col("query_id") % 100 == 0, "even").otherwise("odd"))
        assert tuple(E.recall_mrr(firsts).first()) == got[name, None]
        for r in E.recall_mrr(firsts, "half").collect():
            assert tuple(r)[1:] == got[name, r.half]
