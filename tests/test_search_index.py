"""The stored index, the misspelling keys and the search over them, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import lexical as L
from lexiloom.operators import locale_search as S
from lexiloom.operators import word_index as W
from lexiloom.plans import locale_search as P
from tests.conftest import SMALL


def test_deletions(spark):
    def plain(word, k):
        found = {word}
        for _ in range(k):
            found |= {w[:i] + w[i + 1 :] for w in found for i in range(len(w))}
        return found

    rows = [(w, k) for w in ("", "a", "ab", "abc", "aabb", "letters", "🦊é🦊") for k in range(3)]
    got = spark.createDataFrame(rows, "w string, k int").select("w", "k", L.deletions(F.col("w"), F.col("k")).alias("d")).collect()
    assert all(set(r.d) == plain(r.w, r.k) and len(r.d) == len(set(r.d)) for r in got)


def test_misspellings_equal_all_pairs_and_stay_near(spark):
    rng = random.Random(5)
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
    vocab = sorted({word("abc", 1, 10) for _ in range(250)})
    asked = sorted({word("abc", 1, 11) for _ in range(120)})
    frame = lambda words, name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    got = {(r.qtoken, r.token, r.edits) for r in L.fuzzy_candidates(frame(asked, "qtoken"), frame(vocab, "token")).collect()}
    budget = lambda q: 0 if len(q) < 4 else 1 if len(q) < 8 else 2
    alike = lambda q, t: q[0] == t[0] or (len(t) > 1 and len(q) > 1 and q[0] == t[1] and q[1] == t[0])
    assert got == {(q, t, d) for q in asked for t in vocab if alike(q, t) and 0 < (d := T.osa(q, t)) <= budget(q)}
    # pairs a query stay as few when the vocabulary grows tenfold
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (2_000, 20_000):
        words = sorted({word(letters, 8, 12) for _ in range(n)})
        typed = [w[:3] + w[4:] for w in words[: n // 20 : n // 2000]]
        pairs = L.misspelling_pairs(frame(typed, "qtoken"), L.misspelling_keys(frame(words, "token"))).count()
        assert len(typed) <= pairs < 1.2 * len(typed)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def asked(spark):
    return P.queries_of(spark, SMALL).filter("query_id % 3 < 2")


def test_stored_index_answers_as_the_given_one(spark, tmp_path, asked, monkeypatch):
    popularity, function_words = P.popularity(spark, SMALL), P.function_words(spark)
    want = S.search(asked, P.packs(spark, SMALL), popularity, function_words, 8)
    monkeypatch.setattr(W, "BLOCK", 7)  # many blocks a word and a kind
    path = f"file://{tmp_path}/index"
    index = W.stored(P.packs(spark, SMALL), path, 4)
    assert index.vocabulary.filter("blocks > 3").count() and index.postings.filter("block > 2").count()
    for found in (index, W.opened(spark, path)):
        got = S.search(asked, found, popularity, function_words, 8)
        assert [rows(g) for g in got] == [rows(w) for w in want]
    plan = index.postings.join(spark.range(9).select(F.col("id").cast("string").alias("token")), "token")
    plan.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        plan.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1  # the queries' side alone
    for name in W.KEYS:  # a later session knows the folder only
        spark.sql(f"DROP TABLE {W._table(path, name)}")
    again = W.opened(spark, path)
    assert all(rows(getattr(again, name)) == rows(getattr(index, name)) for name in ("postings", "heads", "items"))


@pytest.mark.parametrize("depth", [1, 4])
def test_items_out_of_reach_change_nothing(spark, asked, depth, monkeypatch):
    """Fetching only reachable items gives what fetching all of them gives, whatever the size of the list."""
    monkeypatch.setattr(S, "DEPTH", depth)
    index = W.prepared(P.packs(spark, SMALL))
    popularity, function_words = P.popularity(spark, SMALL), P.function_words(spark)
    fetched = []
    reachable = S.reachable
    monkeypatch.setattr(S, "reachable", lambda *a: fetched.append((reachable(*a).count(), a[0].agg(F.sum("items").alias("n")).first().n)) or reachable(*a))
    some = [rows(S.search(asked, index, popularity, function_words, n)[0]) for n in (1, 5)]
    assert all(few < every for few, every in fetched)
    monkeypatch.setattr(S, "reachable", lambda found, words, size: W.in_blocks(found, W.blocks(F.col("items"))).join(words.members, [*W.KIND, "block"]).select(*S.QUERY, "item").distinct())
    assert some == [rows(S.search(asked, index, popularity, function_words, n)[0]) for n in (1, 5)]


def test_light_words_are_never_expanded(spark):
    """A frequent word beside a rare one: phrases that hold the frequent one alone can't cover a third of the query."""
    items = [(i, f"face {i}", 2, 0.85, 1, 2) for i in range(400)] + [(900, "face melting", 2, 0.85, 1, 2)]
    index = spark.createDataFrame(items, "item long, phrase string, field_ix int, weight double, mask long, n_tokens int")
    ask = spark.createDataFrame([(1, "melting face ", "en", 1, 1)], "query_id long, q string, locale string, preferred long, searched long")
    words = W.prepared(index)
    both = ask.select("query_id", F.split(F.trim("q"), " ").alias("toks"), F.lit(False).alias("open"), "locale", "preferred", "searched", F.lit(0).alias("turn"))
    found = S.scored(S.asked_tokens(both, P.function_words(spark)), words).collect()
    assert [r.phrase for r in found] == ["face melting"]
    empty = S.search(ask.limit(0), index, spark.createDataFrame([], "item long, popularity int"), P.function_words(spark))
    assert [x.count() for x in empty] == [0, 0]
    nothing = S.search(ask, index.limit(0), spark.createDataFrame([], "item long, popularity int"), P.function_words(spark))
    assert nothing[0].count() == 0 and [tuple(r) for r in nothing[1].collect()] == [(1, 2, 0.0, 0.0)]


def test_f10_items_of_the_same_phrases_are_met_where_they_are_placed(spark):
    """Forty times the items, all of the same phrases: no more rows to score, and the results of a search over each item."""
    from tests.test_findings_r03 import shuffled

    index = P.packs(spark, SMALL)
    copies = index.withColumn("item", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda c: F.col("item") + 1000 * c)))
    many = P.popularity(spark, SMALL).withColumn("item", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda c: F.col("item") + 1000 * c))).withColumn("popularity", F.when(F.col("item") % 7 > 0, F.col("popularity") + F.col("item") % 3))
    few = P.queries_of(spark, SMALL).filter("query_id < 25")
    words = W.prepared(copies)
    assert words.items.count() < index.count() and words.alike.count() == copies.select("item").distinct().count()
    (got, known), dealt = shuffled(spark, lambda: [rows(x) for x in S.search(few, words, many, P.function_words(spark), 8)])
    assert dealt < 2 * copies.count()
    each = W.WordIndex(**{**vars(words), **_apart(copies)})
    assert [got, known] == [rows(x) for x in S.search(few, each, many, P.function_words(spark), 8)] and len(got) > 50


def _apart(index):
    """The tables of an index whose items all stand for themselves."""
    items = index.select("item", *W.KIND, "n_tokens").withColumn("copies", F.lit(1).cast("long"))
    members, posts, vocab = W._tables(items)
    return {"postings": W._dealt(posts, vocab), "members": members, "items": items, "alike": items.select("item", F.col("item").alias("member")).distinct(), "vocabulary": vocab, "heads": W.heads(vocab), "misspellings": L.misspelling_keys(vocab)}
