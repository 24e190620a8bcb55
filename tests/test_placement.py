"""Placing phrases against judging them one after another in plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import placement as P
from lexiloom.plans import placement as plan
from tests.conftest import SMALL


def one_by_one(entries, keep, drop_over):
    """{(locale, item, phrase): (owners, dropped)} and the lists {(locale, item, field_ix): phrases}. entries: (locale, item, ord, field_ix, idx, phrase)."""
    lists, owners = defaultdict(list), defaultdict(list)
    for locale, item, order, field, _, phrase in sorted(entries, key=lambda e: (e[0], e[2], e[3], e[4])):
        lists[locale, item, field].append(phrase)
        owners[locale, phrase].append((order, item, field))
    lost = {}
    for (locale, phrase), having in owners.items():
        if len(having) <= keep:
            continue
        strongest = sorted(having, key=lambda h: (h[2], lists[locale, h[1], h[2]].index(phrase), h[0]))
        for _, item, field in sorted(strongest[keep:]):
            lists[locale, item, field].remove(phrase)
            lost[locale, item, phrase] = (len(having), len(having) > drop_over)
            if len(having) <= drop_over:
                lists[locale, item, 2].append(phrase)
    return lost, lists


@pytest.mark.parametrize("seed", range(4))
def test_fixed_point_equals_one_by_one(spark, seed):
    """Few owners may keep a phrase, so that most verdicts hang on earlier ones."""
    rng = random.Random(seed)
    entries = []
    for item in range(60):
        words = rng.sample([f"w{i}" for i in range(30)], rng.randint(0, 12))
        cuts = sorted(rng.choices(range(len(words) + 1), k=2))
        for field, part in enumerate((words[: cuts[0]], words[cuts[0] : cuts[1]], words[cuts[1] :])):
            entries += [("ab"[item % 2], item, 100 - item, field, i, w) for i, w in enumerate(part)]
    rows = spark.createDataFrame(entries, "locale string, item long, ord long, field_ix int, idx int, phrase string")
    got = {(r.locale, r.item, r.phrase): (r.owners, r.dropped) for r in P.capped(rows, 3, 8).collect()}
    want, _ = one_by_one(entries, 3, 8)
    naive = {(r.locale, r.item, r.phrase) for r in rows.withColumn("n", F.row_number().over(P.Window.partitionBy("locale", "phrase").orderBy("field_ix", "idx", "ord"))).filter("n > 3").collect()}
    assert got == want and set(want) != naive


def test_validated_phrases_equal_one_by_one(spark):
    phrases, indexed, edits, low = plan.inputs(spark, SMALL)
    key = lambda df: {(r.locale, r.item, r.phrase) for r in df.collect()}
    held, listed = key(indexed), key(low)
    actions = {(r.locale, r.item, r.phrase): r.action for r in edits.collect()}
    seen, start, entries, length, orders = set(), {}, [], Counter(), {}
    for r in sorted(phrases.collect(), key=lambda r: (r.locale, r.item, tuple(r.pos))):
        k = (r.locale, r.item, r.phrase)
        if k in seen or k in held:
            continue
        seen.add(k)
        orders[r.item] = r.ord
        action = actions.get(k) or actions.get(("*", r.item, r.phrase))
        field, why = r.field, ""
        if action:
            field, why = ("low", "edited") if action == "low" else (None, "removed")
        elif r.phrase.endswith("-3"):
            field, why = None, "blocked"
        elif r.phrase.endswith("7"):
            field, why = "low", "demoted"
        elif k in listed and not r.manual:
            field, why = "low", "low_confidence"
        start[k] = (field, why)
        if field:
            at = (r.locale, r.item, P.LISTS.index(field))
            entries.append((r.locale, r.item, r.ord, at[2], length[at], r.phrase))
            length[at] += 1
    lost, lists = one_by_one(entries, P.KEEP_OWNERS, P.DROP_OVER)
    places = {(locale, item, p): (P.LISTS[f], i) for (locale, item, f), own in lists.items() for i, p in enumerate(own)}
    want = {}
    for k, (field, why) in start.items():
        owners, dropped = lost.get(k, (None, None))
        more = "" if owners is None else "collision_dropped" if dropped else "collision_demoted" if field != "low" else ""
        want[k] = (*places.get(k, (None, None)), ",".join(x for x in (why, more) if x), owners)
    rows = P.validated(phrases, indexed, edits, low, plan.verdict()).collect()
    got = {(r.locale, r.item, r.phrase): (r.field, r.place, r.reasons, r.owners) for r in rows}
    assert len(rows) == len(got) and got == want
    assert {r for v in want.values() for r in v[2].split(",")} >= {"removed", "edited", "blocked", "demoted", "low_confidence", "collision_dropped", "collision_demoted"}


def test_nothing_to_place(spark):
    phrases, indexed, edits, low = plan.inputs(spark, SMALL)
    assert P.validated(phrases.limit(0), indexed, edits, low, plan.verdict()).isEmpty()


def test_f7_decided_phrases_leave_the_rounds(spark):
    """A phrase's rows are dealt a few times, however long the chain of verdicts that turn one another."""
    from tests.test_findings_r03 import shuffled

    inputs = plan.inputs(spark, SMALL.replace("0.001", "0.01"))
    rows, dealt = shuffled(spark, lambda: P.validated(*inputs, plan.verdict()).count())
    assert dealt < 5 * rows
