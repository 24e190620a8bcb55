"""Operators of the search and analytics library on literal cases with known answers, and against plain versions."""

from __future__ import annotations

import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import analytics as A
from lexiloom.operators import curation as C
from lexiloom.operators import evals as E
from lexiloom.operators import fusion as R
from lexiloom.operators import lexical as L
from lexiloom.operators import locale_search as S
from lexiloom.operators import upserts as U
from lexiloom.operators import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_trend_score_and_windows(spark):
    cases = {(10, 0): 2.43, (70, 0): 11.0, (70, 280): 1.0, (7, 280): 0.18}
    rows = spark.createDataFrame([(*k,) for k in cases], "a long, b long").select("a", "b", A.trend_score(F.col("a"), F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in rows} == cases
    assert A.trend_windows("2026-10-15") == {"recent": ("2026-10-08", "2026-10-14"), "baseline": ("2026-09-10", "2026-10-07"), "history": ["2026-10-08", "2026-10-01", "2026-09-24", "2026-09-17"]}


def test_yearly_window_wraps(spark):
    days = spark.createDataFrame([("2024-12-31",), ("2025-01-01",), ("2025-01-03",)], "d string").withColumn("on", U.active_on(F.to_date("d"), "12-26", "01-02")).orderBy("d").collect()
    assert [r.on for r in days] == [True, True, False]


def test_edit_budget_and_swaps(spark):
    assert [value(spark, T.max_edits(F.lit("x" * n))) for n in (3, 4, 7, 8)] == [0, 1, 1, 2]
    assert (T.osa("halo", "hlao"), T.osa("ca", "abc"), T.osa("", "ab")) == (1, 3, 2)


def test_privacy_rules_in_order(spark):
    cases = {"write to jane@doe.org": "email", "see www.site and a@b.cc": "email", "see https://x": "url", "jane doe gmail com": "email", "look at site com": "url", "call 555 12 34": "phone", "zip 12345": "number", "jane1987": "code", "x" * 31: "long-token", "smiling cat": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.privacy_reason(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases


def test_normalize():
    cases = {
        "Crème  BRÛLÉE!": "creme brulee", "don't": "dont", "don`t": "dont", "don\u2019t": "dont", "don\u2018t": "don t", "o\u02bcclock": "o\u02bcclock", "C++ +1": "c +1", "straße 🦊 ﬁn": "strasse fin", None: None,
        "\u0645\u064e\u0631\u0652\u062d\u064e\u0628\u0627": "\u0645\u0631\u062d\u0628\u0627", "\u0645\u0640\u0640\u0631": "\u0645\u0631", "\u05e9\u05c1\u05b8\u05dc\u05d5\u05b9\u05dd": "\u05e9\u05dc\u05d5\u05dd",
        "1\ufe0f\u20e3 go": "1 go", "doğum günü İIı": "dogum gunu iii", "पिज़्ज़ा": "पिज\u093c्ज\u093cा", "が\u304b\u3099": "がが", "한국": "한국", "🇫🇷 paris": "paris", "ё": "е",
    }
    assert {t: T.normalize(t) for t in cases} == cases
    assert T.normalize("a" * 63 + " b") == "a" * 63 and T.normalize("𝔸" * 70) == "a" * 64 and T.normalize("𐐨" * 70) == "𐐨" * 32


def test_embedding_text():
    assert [T.embedding_text(t) for t in ("  Crème\tBRÛLÉE! 🦊\ufeff", None)] == ["crème brûlée! 🦊", None]
    assert T.embedding_text("🦊" * 40) == "🦊" * 32 and T.embedding_text("a" + "🦊" * 40) == "a" + "🦊" * 31


def test_blocked_phrases(spark):
    rows = spark.createDataFrame([("such a bad word",), ("badly worded",), ("bad-word",)], "t string")
    assert [r.r for r in rows.select(T.privacy_reason(F.col("t"), ["bad word"]).alias("r")).collect()] == ["blocked", None, "blocked"]


def test_fuzzy_equals_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(150)})
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(40)})
    got = L.fuzzy_candidates(spark.createDataFrame([(w,) for w in asked], "qtoken string"), spark.createDataFrame([(w,) for w in words], "token string"))
    budget = lambda t: 0 if len(t) < 4 else 1 if len(t) < 8 else 2
    alike = lambda a, w: a[0] == w[0] or a[:2] == w[1::-1]
    want = {(a, w, T.osa(a, w)) for a in asked for w in words if alike(a, w) and 0 < T.osa(a, w) <= budget(a)}
    assert {(r.qtoken, r.token, r.edits) for r in got.collect()} == want


def test_prefix_quality(spark):
    vocab = spark.createDataFrame([("happyday",), ("happ",), ("other",)], "token string")
    asked = spark.createDataFrame([("happ",), ("oth",)], "qtoken string")
    got = {(r.qtoken, r.token): r.quality for r in L.prefix_candidates(asked, vocab).collect()}
    assert got == {("happ", "happyday"): pytest.approx((0.6 + 0.35 * 4 / 8) * 0.5), ("oth", "other"): pytest.approx(0.6 + 0.35 * 3 / 5)}


def test_search_by_locale(spark):
    """Unspaced runs split into words, function words match themselves only, own exact matches stand above other locales', digits stay."""
    assert S.segments("abcdxyzab", frozenset(["ab", "abc", "xyz"])) == ["abc", "d", "xyz", "ab"] and S.segments("q", frozenset()) == ["q"]
    rows = lambda data: spark.createDataFrame(data, "item int, phrase string, field_ix int, weight double")
    index = S.pack_index([rows([(1, "foot", 0, 1.0), (2, "ball of fire", 0, 1.0), (4, "offer", 2, 0.85), (5, "happy", 2, 0.85)]), rows([(3, "foot", 3, 0.8), (6, "生日快乐", 2, 0.85), (6, "快乐", 3, 0.8)])])
    asked = [(1, "foot", "fr", 2, 3), (2, "ball of", "en", 1, 1), (3, "hapy ", "en", 1, 3), (4, "很快乐", "fr", 2, 3), (5, "foot", "en", 1, 1), (6, "hap", "en", 1, 3), (7, "", "en", 1, 3)]
    queries = spark.createDataFrame(asked, "query_id int, q string, locale string, preferred long, searched long")
    popular = spark.createDataFrame([(i, i) for i in range(1, 7)], "item int, popularity int")
    results, known = S.search(queries, index, popular, spark.createDataFrame([("en", "of")], "locale string, token string"), 3)
    got = {}
    for r in sorted(results.collect(), key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append(r.item)
    assert got == {1: [3, 1], 2: [2], 3: [5], 4: [6], 5: [1], 6: [5]}
    assert {r.query_id for r in known.collect()} == {1, 2, 3, 4, 5, 6} and S.limited(None) == 24 and S.limited(99) == 50


def test_interleaving_and_layers(spark):
    a, b = (spark.createDataFrame(rows, "query_id int, id int, place int, score double") for rows in ([(1, 7, 1, 0.9), (1, 8, 2, 0.5), (1, 9, 3, 0.2)], [(1, 5, 1, 0.8), (2, 6, 1, 0.7)]))
    assert [r.id for r in R.interleaved(a, b).filter("query_id = 1").orderBy("place").collect()] == [7, 5, 8, 9]
    assert sorted((r.query_id, r.id) for r in R.first_answer(a, b).collect()) == [(1, 7), (1, 8), (1, 9), (2, 6)]
    entries = spark.createDataFrame([(1, "x", 1, 10), (1, "x", 2, 11), (2, "y", 1, 10), (2, "y", 2, 12)], "entry_ix int, entry string, pos int, id int")
    assert [(r.id, r.entry) for r in R.shelf(entries, 3).orderBy("place").collect()] == [(10, "x"), (11, "x"), (12, "y")]


def test_fake_results_and_aliases_within_a_budget(spark):
    from lexiloom.operators import shards as H
    from lexiloom.sources import catalogs as K

    queries = spark.createDataFrame([("cat",), ("",), ("dog é",)], "q string")
    first, again = (sorted(map(tuple, H.fake_results(q, 5, 8).collect())) for q in (queries, queries.repartition(3)))
    assert first == again and len(first) == 15 and H._hash("a") == 0xE40C292C
    rows = spark.createDataFrame([("en", i, f"item {i}", [f"alias {i} {j}" for j in range(16)]) for i in range(50)], "locale string, item int, head string, aliases array<string>")
    whole, cut = (K.fitted_aliases(rows, b).first() for b in (1 << 20, 900))
    assert whole.aliases == 16 and 0 < cut.aliases < 16 and cut.bytes <= 900


def test_reranker_fit():
    import numpy as np

    rng = np.random.default_rng(0)
    query, x = np.repeat(np.arange(200), 10), rng.standard_normal((2000, 3))
    truth = x @ np.array([2.0, -1.0, 0.0])
    relevant = (truth == np.repeat(truth.reshape(-1, 10).max(axis=1), 10)).astype(float)
    w = E.softmax_fit(query, relevant, x, 400, 0.05, 1e-3)
    found = (x @ w).reshape(-1, 10).argmax(axis=1) == truth.reshape(-1, 10).argmax(axis=1)
    assert found.mean() > 0.95 and abs(w[2]) < 0.2 * abs(w[0])


def test_readers_refuse_bad_input(spark, tmp_path):
    import json

    from lexiloom.sources import catalogs as K

    def file(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"file://{tmp_path}/{name}"

    assert [(r.q, r.n) for r in K.query_log(spark, file("a.jsonl", '{"q":"cat","n":2}\n\n{"q":"dog","n":1,"locale":"en"}\n')).collect()] == [("cat", 2.0), ("dog", 1.0)]
    for text, said in (('{"q":"cat","n":2}\nnope\n', "number 2: not json"), ('{"q":"cat","n":0}', "count not positive"), ('{"q":" ","n":1}', "empty query")):
        with pytest.raises(K.BadInput, match=said):
            K.query_log(spark, file("b.jsonl", text))
    row = {"glyph": "x", "item": "i1", "group": 0, "version": 1, "skins": 0, "label": "cat face", "shortcode": "cat", "keyword": "pet|animal", "alias": "", "typo": "", "low": "meow"}
    pack = {"format": K.PACK_FORMAT, "formatVersion": 1, "locale": "en", "part": "core", "groups": ["animals"], "popularity": [7], "rows": [row]}
    rows = K.read_packs(spark, file("p.json", json.dumps(pack)))
    assert [(r.grp, r.popularity) for r in rows.collect()] == [("animals", 7)]
    weights = dict(zip(L.FIELDS, L.FIELDS.values(), strict=True))
    assert sorted((r.phrase, r.field_ix) for r in K.exploded(rows, weights).collect()) == [("animal", 2), ("cat", 1), ("cat face", 0), ("meow", 5), ("pet", 2)]
    for change, said in (({"format": "other"}, "wrong format"), ({"formatVersion": 2}, "unknown version"), ({"popularity": [1, 2]}, "popularity of other length")):
        with pytest.raises(K.BadInput, match=said):
            K.read_packs(spark, file("q.json", json.dumps(pack | change)))
    known = spark.createDataFrame([("a",), ("b",)], "key string")
    assert K.overlay(spark, file("o.json", '{"key":"a","desc":"x"}'), known, "desc string").count() == 1
    for text, said in (('{"key":"c","desc":"x"}', "unknown key"), ('{"key":"a"}\n{"key":"a"}', "duplicated key")):
        with pytest.raises(K.BadInput, match=said):
            K.overlay(spark, file("o.json", text), known, "desc string")
    good = '{"id":"q1","q":"x","answers":["a"],"forbid":["b"]}'
    assert K.eval_queries(spark, file("e.jsonl", good)).count() == 1
    for text, said in ((good + "\n" + good, "id twice"), ('{"id":"q1","q":"x","answers":[]}', "no answers"), ('{"id":"q1","q":"x","answers":["a"],"forbid":["a"]}', "answer forbidden")):
        with pytest.raises(K.BadInput, match=said):
            K.eval_queries(spark, file("e.jsonl", text))
    ids = K.id_ranges(spark.createDataFrame([("see a-006 to a-008, b-12 and a-007",)], "text string"))
    assert sorted(r.id for r in ids.collect()) == ["a-006", "a-007", "a-008", "b-12"]
    listed = K.exclusions(K.lines(spark, file("x.txt", "# list\n[war]\nBomb # loud\n\n[hate]\nslur word\n")))
    assert sorted((r.phrase, r.category) for r in listed.collect()) == [("bomb", "war"), ("slur word", "hate")]
    assert [tuple(r) for r in K.owners_csv(spark, file("c.csv", 'alias,owners\n"a ""b"", c","1F600 1F601"\n')).collect()] == [('a "b", c', ["1F600", "1F601"])]
    with pytest.raises(K.BadInput, match="unknown key"):
        K.merged_batches(spark.createDataFrame([("z", 1, "r")], "key string, part int, record string"), known)


def test_base_catalog_and_stale_versions(spark):
    from lexiloom.sources import catalogs as K

    items = spark.createDataFrame([("1F600-FE0F", 1, "face", "grin"), ("200D", 2, "component", "zwj")], "item string, ord int, group string, label string")
    codes = [spark.createDataFrame([("1F600-FE0F", c)], "item string, code string") for c in ("smile", "grin")]
    words = spark.createDataFrame([("1F600", ["happy"])], "key string, words array<string>")
    got = K.base_catalog(items, codes, words, [F.col("item"), F.regexp_replace("item", "-FE0F", "")]).collect()
    assert [tuple(r) for r in got] == [("1F600-FE0F", 1, "grin", ["smile", "grin"], ["happy"])]
    stored = spark.createDataFrame([("v1", 10), ("v1", 90), ("v2", 10), ("v3", 10)], "version string, uploaded long")
    assert [r.version for r in K.stale_versions(stored, "v3", F.lit(100), 50).collect()] == ["v2"]


def test_glyph_functions(spark):
    from lexiloom.functions import glyphs as G

    rows = spark.createDataFrame([("👍️", "dark"), ("🧑\u200d🤝\u200d🧑", "light"), ("👍", "none"), (None, "dark")], "g string, t string").select(G.with_tone("g", "t").alias("x")).collect()
    assert [r.x for r in rows] == ["👍🏿", "🧑🏻\u200d🤝\u200d🧑🏻", "👍", None]
    got = spark.createDataFrame([("go 👩\u200d💻 🇫🇷 1\ufe0f\u20e3!",)], "t string").select(G.clusters("t").alias("x")).first().x
    assert got == ["👩\u200d💻", "🇫🇷", "1\ufe0f\u20e3"]
    labels = ['```json\n{"caption": " a cat ", "keywords": ["cat", 3, ""], "emoji": ["🐱"]}\n```', "no json", '{"caption": 3, "keywords": "x"}', None]
    parsed = spark.createDataFrame([(x,) for x in labels], "t string").select(G.parsed_label("t").alias("p")).select("p.*").collect()
    assert [tuple(r) for r in parsed] == [("a cat", ["cat"], ["🐱"]), ("", [], []), ("", [], []), ("", [], [])]
    cases = spark.createDataFrame([("ru", "privet"), ("ru", "привет"), ("en", "hello"), ("zh", "123")], "l string, q string").select(G.is_romanized(F.col("l"), F.col("q")).alias("x")).collect()
    assert [r.x for r in cases] == [True, False, False, False]
    typed = spark.createDataFrame([("hello :smi",), ("a:b",), ("(:",), ("x :done:",)], "t string").select(G.autocomplete(F.col("t")).alias("a"), G.finished_shortcode(F.col("t")).alias("f")).collect()
    assert [(r.a, r.f) for r in typed] == [("smi", None), (None, None), ("", None), (None, "done")]
    parts = spark.createDataFrame([("nice work, see 2.14.0 and go home 🎉 bye",)], "t string").select(G.clauses(F.col("t")).alias("c")).first().c
    assert parts == ["nice work, see 2.14.0 and go home 🎉 bye", "nice work", "see 2.14.0", "go home"]
    named = spark.createDataFrame([("flags",), ("new",)], "k string").select(G.looked_up(F.col("k"), {"flags": "Flags"}).alias("x")).collect()
    assert [r.x for r in named] == ["Flags", "new"]


def test_stream_batches_replace_themselves(spark, tmp_path):
    """Files out of order and a batch run twice give the counts of all events once; alerts come once a threshold."""
    from lexiloom.streaming import counters

    out = f"file://{tmp_path}"
    rows = [(1, "2024-01", 3), (1, "2024-01", 2), (2, "2024-01", 9), (1, "2024-02", 4), (1, "2024-01", 5)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "a int, p string, n int").coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = counters.event_stream(spark, f"{out}/in", "*.parquet", spark.read.parquet(f"{out}/in").schema, 1)
    counters.meter(stream, F.col("a"), F.col("p"), F.col("n"), 10, out, f"{out}/check")
    usage = spark.read.parquet(f"{out}/usage")
    again = usage.filter("batch = 1").drop("batch").collect()
    counters.put(spark.createDataFrame(again, usage.drop("batch").schema), 1, f"{out}/usage")
    totals = {(r.account, r.period): r["count"] for r in counters.current(spark, f"{out}/usage", ["account", "period"], ("count",)).collect()}
    assert totals == {(1, "2024-01"): 10, (2, "2024-01"): 9, (1, "2024-02"): 4}
    alerts = spark.read.parquet(f"{out}/alerts").collect()
    assert sorted((r.account, r.period, r.percent) for r in alerts) == [(1, "2024-01", 80), (1, "2024-01", 100), (2, "2024-01", 80)] and len({r.id for r in alerts}) == 3
    counters.compacted(spark, f"{out}/usage", f"{out}/compact", ["account", "period"], ("count",))
    assert {(r.account, r.period): r["count"] for r in spark.read.parquet(f"{out}/compact").collect()} == totals


def test_fusion_values(spark):
    a = spark.createDataFrame([(1, 7, 1, 0.9), (1, 8, 2, 0.5)], "query_id long, id long, place long, score double")
    b = spark.createDataFrame([(1, 7, 1, 0.8)], "query_id long, id long, place long, score double")
    top = R.reciprocal(a, b, pin=0.95).filter("place = 1").first()
    assert (top.id, top.fused) == (7, pytest.approx(2 / 61, abs=1e-9))
    family = spark.createDataFrame([(7, 1), (8, 2)], "id long, family int")
    kept = {r.id: r.score for r in R.evidence(R.lists(("a", 0.5, False, a)), family).collect()}
    assert kept == {7: pytest.approx(0.5), 8: pytest.approx(0.45)}


def test_collision_verdicts(spark):
    for n, want in ((9, {"keep": 8, "demote": 1}), (21, {"keep": 8, "drop": 13})):
        owned = spark.createDataFrame([("a", i, float(i)) for i in range(n)], "alias string, owner int, strength double")
        assert {r.verdict: r["count"] for r in C.collisions(owned, "alias", "owner", "strength").groupBy("verdict").count().collect()} == want


def test_nearest_rank(spark):
    df = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "v int")
    assert E.nearest_rank(df, "v", [0.5, 1.0]).first().asDict() == {"p50": 3, "p100": 4}


def test_threshold_crossed_once(spark):
    usage = spark.createDataFrame([(1, "2024-01", 75), (1, "2024-02", 10), (1, "2024-03", 5)], "acc int, at string, count long")
    assert [(r.at, r.percent, r.total) for r in A.threshold_crossings(usage, "acc", "at", 100).collect()] == [("2024-02", 80, 85)]


def split_plainly(entries, budget):
    """Key by key from the first letters on: move the fewest largest groups out, then look at those."""
    left, found = [(w[0], {q: n for q, n in entries.items() if q[0] == w[0]}) for w in {q[0]: q for q in entries}.values()], {}
    while left:
        key, held = left.pop()
        groups = {}
        for q, n in held.items():
            if q != key:
                groups.setdefault(q[: len(key) + 1], {})[q] = n
        full = len(quote(key, safe="!~*'()")) + 12 > 200
        for child in sorted(groups, key=lambda k: (-sum(groups[k].values()), k.encode("utf-16-be"))):
            if sum(held.values()) <= budget or full:
                break
            left.append((child, groups[child]))
            held = {q: n for q, n in held.items() if q not in groups[child]}
        found |= dict.fromkeys(held, key)
    return found


def test_prefix_split_moves_the_fewest(spark):
    rng = random.Random(3)
    words = {f"{a}{b}{i}" for a in "abc" for b in "xyz" for i in range(40)} | {"a", "ax", "x" * 300, "x" * 299 + "y", "é" * 40, "é" * 39, "é" * 38 + "ab"}
    words |= {"".join(rng.choice("ab 𠀀𠀁\uff5e") for _ in range(rng.randrange(1, 9))) for _ in range(400)}
    for budget in (4, 60, 100, 1000, 1 << 40):
        entries = {w: rng.randrange(1, 9) for w in words}
        df = spark.createDataFrame([*entries.items()], "q string, bytes long")
        got = {r.q: r.shard_key for r in C.split_keys(df, budget).collect()}
        assert got == split_plainly(entries, budget)
        keys = spark.createDataFrame([(k,) for k in set(got.values())], "shard_key string")
        assert {r.q: r.shard_key for r in C.longest_prefix(df.select("q"), keys).collect()} == got  # where a look-up goes
        assert {r.shard_key: r.bytes for r in C.split_prefixes(df, budget).collect()} == {k: sum(n for q, n in entries.items() if got[q] == k) for k in set(got.values())}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<float>")
    unit = {r.id: r.u for r in rows.select("id", V.normalized(F.col("v")).alias("u")).collect()}
    assert unit == {1: pytest.approx([0.6, 0.8]), 2: [0.0, 0.0], 3: [1.0, 0.0]}
    got = V.top(V.scores(rows.filter("id = 3").withColumnRenamed("id", "query_id"), rows, 1), 1).collect()
    assert [(r.query_id, r.id, r.dot) for r in got] == [(3, 1, 3.0)]


def test_replace_days_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, n int")
    for _ in range(2):
        U.replace_days(df, f"file://{tmp_path}/t")
    U.replace_days(df.filter("n = 2").withColumn("n", F.lit(5)), f"file://{tmp_path}/t")
    assert sorted((str(r.day), r.n) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [("2024-01-01", 1), ("2024-01-02", 5)]
