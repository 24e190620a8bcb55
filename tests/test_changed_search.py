"""Records and own catalogs over search results, against plain versions that treat every query."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import changed_search as X
from lexiloom.operators import editorial as C
from lexiloom.operators import locale_search as S

RECORD = "id string, kind string, status string, window struct<from:string,to:string,recurs:string>, regions array<string>, except_regions array<string>, locales array<string>, triggers map<string,array<string>>, items array<struct<id:long,weight:double>>, context map<string,string>, outranks array<long>, featured boolean"
DAY, REGIONS = "2024-01-08", ["DE", "FR", "US"]


def records(rng, n=40):
    rows = []
    for i in range(n):
        words = [rng.choice(["snow", "snow day", "cup", "cup final", "goal", "carnival", "tea", "tea time"]) for _ in range(rng.randrange(1, 3))]
        regions = rng.choice([["*"], ["FR"], ["FR", "DE"], ["US"]])
        kind = rng.choice(["regional", "meme", "general"])
        window = rng.choice([None, None, ("2024-01-01", "2024-01-31", None), ("2024-01-09", "2024-01-31", None)])
        items = [(rng.randrange(30), rng.choice([0.4, 0.7, 0.9])) for _ in range(2)]
        rows.append((f"r{i:02d}", kind, "approved", window, regions, ["DE"] if regions == ["*"] and i % 3 == 0 else [], ["en"], {"en": sorted(set(words))}, items, {}, [rng.randrange(30) for _ in range(15)], False))
    return rows


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    entries = C.compiled(spark.createDataFrame(records(rng), RECORD), "en", "2024-01-01", "2024-02-01", spark.range(30).select(F.col("id").alias("item"))).cache()
    texts = ["snow", "sno", "snow d", "cup", "cup fin", "goal", "goa", "carn", "tea", "tea ti", "te", "other", "words", "snow day", "tea time"]
    asked = [(k, q, rng.random() < 0.5, rng.choice([None, "FR", "DE", "US"]), DAY) for k, q in enumerate(texts * 3)]
    results = [(k, p + 1, item) for k, *_ in asked if k % 7 for p, item in enumerate(rng.sample(range(30), rng.randrange(0, 12)))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return entries, frame(asked, "query_id long, q string, typing boolean, region string, day string"), frame(results, "query_id long, place long, item long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def holds(e, region, day, forced=False):
    if forced:
        return True
    inside = "*" in e.regions or region in e.regions
    return inside and region not in (e.except_regions or []) and (e.window is None or e.window["from"] <= day <= e.window["to"])


def applied(entries, found, q, typing, region, day, limit, forced=False):
    """The results of one query (a list of items) with the records of these entries."""
    hits = []
    for e in sorted(entries, key=lambda e: e.place):
        if not holds(e, region, day, forced):
            continue
        best = max((1.0 if t == q else 0.6 + 0.4 * len(q) / len(t) if typing and len(q) >= 3 and 2 * len(q) >= len(t) and t.startswith(q) else 0.0 for t in e.triggers), default=0)
        if best:
            hits += [(int(round(i.weight * best, 9) * 1000 + 0.5) / 1000, e.place, at, i.id) for at, i in enumerate(e["items"])]
    first, score = {}, {}
    for s, place, at, item in hits:
        score[item] = max(score.get(item, 0), s)
        first[item] = min(first.get(item, (place, at)), (place, at))
    matches = sorted(score, key=lambda i: (-score[i], first[i]))[:4]
    lead = []
    if found and region is not None:
        strong = [(-e["items"][0].weight, e.place, e["items"][0].id) for e in entries if e.kind == "regional" and q in e.triggers and found[0] in (e.outranks or []) and holds(e, region, day, forced) and e["items"][0].id != found[0]]
        lead = [min(strong)[2]] if strong else []
    return list(dict.fromkeys(lead + found[:1] + matches + found[1:]))[:limit]


def plain_world(world):
    entries, asked, results = (df.collect() for df in world)
    found = {q.query_id: [] for q in asked}
    for r in sorted(results):
        found[r.query_id].append(r.item)
    return entries, asked, found


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        out.setdefault(r.query_id, []).append(r.item)
    return out


@pytest.mark.parametrize("limit", [3, 24])
def test_records_touch_what_they_can_and_no_more(world, limit):
    entries, asked, results = world
    es, qs, found = plain_world(world)
    got = listed(X.with_records(results, asked, entries, limit))
    want = {q.query_id: applied(es, found[q.query_id], q.q, q.typing, q.region, q.day, limit) for q in qs}
    assert got == {k: v for k, v in want.items() if v}
    # and the same as applying records to all queries
    tops = results.filter("place = 1").select("query_id", "item")
    every = C.applied(results, C.matched(asked, entries), C.regional_leads(asked, entries, tops), limit)
    assert rows(X.with_records(results, asked, entries, limit)) == rows(every)
    assert 0 < X.touched(asked, entries).count() < asked.count()
    assert rows(X.with_records(results, asked, entries.limit(0), limit).select("query_id", "place", "item")) == rows(results.filter(F.col("place") <= limit))


def test_gate_names_changed_tops_and_missed_triggers(world):
    entries, asked, results = world
    es, qs, found = plain_world(world)
    strongest = {t: e["items"][0].id for e in es for t in e.triggers}
    wanted = [(q.query_id, strongest[q.q] if q.query_id > 4 else 1000) for q in qs if q.q in strongest and q.query_id % 2]
    got = rows(X.gate(results, asked, entries, results.sparkSession.createDataFrame(wanted, "query_id long, item long")))
    want = []
    for q in qs:
        before, after = found[q.query_id][:1], applied(es, found[q.query_id], q.q, q.typing, None, q.day, 10, forced=True)
        if q.query_id in dict(wanted):
            want += [(q.query_id, "trigger not among the first")] if dict(wanted)[q.query_id] not in after[:3] else []
        elif before != after[:1]:
            want.append((q.query_id, "top result changed"))
    assert got == sorted(want, key=str) and {p for _, p in want} == {"top result changed", "trigger not among the first"}


def test_regional_gate_checks_each_entry_alone(world):
    entries, asked, results = world
    es, qs, found = plain_world(world)
    inside, outside = C.probe_regions(REGIONS)
    got = rows(X.regional_gate(results, asked, entries, inside, outside))
    want = []
    for e in (e for e in es if e.kind == "regional"):
        world_ = "*" in e.regions
        covered = sorted(set(REGIONS) - set(e.except_regions)) if world_ else e.regions
        others = sorted(set(REGIONS) & set(e.except_regions)) if world_ else sorted(set(REGIONS) - set(e.regions))
        for q in qs:
            before, trigger = found[q.query_id][:10], q.q in e.triggers
            now = lambda region: applied([e], before, q.q, q.typing, region, q.day, 10)  # noqa: E731, B023
            touches = any(t == q.q or (len(q.q) >= 3 and 2 * len(q.q) >= len(t) and t.startswith(q.q)) for t in e.triggers)
            if not touches:
                assert now(covered[0]) == before
                continue
            if trigger:
                if not before or before[0] not in (e.outranks or []):
                    want.append((e.id, q.query_id, covered[0], "no longer leads", False))
                elif now(covered[0])[:2] != [e["items"][0].id, before[0]]:
                    want.append((e.id, q.query_id, covered[0], "doesn't lead the old top result", True))
                if others and now(others[0])[:1] != before[:1]:
                    want.append((e.id, q.query_id, others[0], "top changed out of scope", True))
            elif now(covered[0])[:1] != before[:1]:
                want.append((e.id, q.query_id, covered[0], "top result changed", True))
    assert got == sorted(want, key=str) and len({w[3] for w in want}) == 2


def test_own_pack_and_its_results_come_first(spark):
    own = spark.createDataFrame([(-1, "party_parrot", ["Happy Bird", "bird", ""]), (-2, "ship_it", None), (-3, None, ["squid"]), (-4, "bird", ["bird"])], "item long, shortcode string, aliases array<string>")
    pack = X.own_pack(own)
    assert rows(pack.select("item", "phrase", "field_ix", "weight")) == sorted([(-1, "party parrot", 0, 1.0), (-1, "happy bird", 3, 0.8), (-1, "bird", 3, 0.8), (-2, "ship it", 0, 1.0), (-3, "squid", 3, 0.8), (-4, "bird", 0, 1.0)], key=str)
    index = S.pack_index([spark.createDataFrame([(k, p, 0, 1.0) for k, p in enumerate(["bird", "ship", "tea"])], "item long, phrase string, field_ix int, weight double")])
    asks = spark.createDataFrame([(1, "bird "), (2, "tea "), (3, "ship "), (4, "squid "), (5, "zzz ")], "query_id long, q string").select("*", F.lit("en").alias("locale"), F.lit(1).cast("long").alias("preferred"), F.lit(1).cast("long").alias("searched"))
    popularity = spark.range(3).select(F.col("id").alias("item"), F.lit(1).alias("popularity"))
    words = spark.createDataFrame([], "locale string, token string")
    assert listed(X.own_first(asks, index, pack, popularity, words, 3)) == {1: [-4, -1, 0], 2: [2], 3: [-2, 1], 4: [-3]}
    assert listed(X.own_first(asks, index, pack.limit(0), popularity, words, 3)) == {1: [0], 2: [2], 3: [1]}
    three = S.pack_index([index.select("item", "phrase", "field_ix", "weight"), pack])
    found = S.search(X.seen_by_all(asks, 1), three, popularity, words, 3)[0]
    assert listed(found) == {1: [0, -4, -1], 2: [2], 3: [1, -2], 4: [-3]}
