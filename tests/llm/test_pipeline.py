"""The pipeline's stages, one after another, against what each promises."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
from lexiloom.llm import simhash
from tests.conftest import SMALL


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL).cache()
        assert kept.columns == docs.columns and kept.schema == docs.schema
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    groups = simhash.near_duplicates(kept).groupBy("component_id").count().filter("count > 1")
    assert groups.count() == 0
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert packed.filter("offset + length > 2048").count() == 0


def test_stages_take_awkward_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    rows = spark.createDataFrame([(None, None, None, None, None), (-1, None, "en", "s", 0), (-2, "", None, None, None), (-3, "12 34", "en", None, 3)], docs.schema)
    kept = docs.unionByName(rows)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL)
    assert kept.count() > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SMALL)
    assert nothing.count() == 0


def test_near_duplicate_stage_equals_brute_force(spark):
    """The stage keeps exactly the smallest id of each group of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, on sf0.01."""
    docs = spark.read.parquet(f"{SMALL.removesuffix('0.001')}0.01/documents.parquet")
    sets = {}
    for row in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), row.text or ""))
        sets[row.doc_id] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1 if words else 0))}
    holders, root = defaultdict(list), {i: i for i in sets}
    for i, own in sets.items():
        for shingle in own or {()}:
            holders[shingle].append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    common = Counter(pair for ids in holders.values() for pair in combinations(ids, 2))
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            root[max(top(a), top(b))] = min(top(a), top(b))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({top(i) for i in sets})
