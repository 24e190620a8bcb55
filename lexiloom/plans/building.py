"""Queries of building catalogs and precomputed answers, of ids and labels, and of reports and costs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import glyphs as G
from lexiloom.functions import text as T
from lexiloom.operators import analytics as A
from lexiloom.operators import curation as C
from lexiloom.operators import shards as H
from lexiloom.plans.search_analytics import QD
from lexiloom.plans.search_ranking import split_sql
from lexiloom.sources import catalogs as K
from lexiloom.sources import search_log
from lexiloom.sources.tables import read_table as table
from lexiloom.sources.tables import scratch

#: Ids with their family by ratings, family in lists, and whether they are a country's flag.
FAMILIES = [
    ("1F468-200D-2695-FE0F", "1F9D1-200D-2695", "1F9D1-200D-2695", False), ("1F6B5-200D-2640-FE0F", "1F6B5", "1F6B5", False), ("1F926-1F3FD-200D-2642-FE0F", "1F926", "1F926-1F3FD", False),
    ("1F3C3-200D-2640-FE0F-200D-27A1-FE0F", "1F3C3-200D-2640-200D-27A1", "1F3C3", False), ("1F44D-1F3FB", "1F44D", "1F44D-1F3FB", False), ("2764-FE0F", "2764", "2764", False),
    ("1F469-200D-1F4BB", "1F9D1-200D-1F4BB", "1F9D1-200D-1F4BB", False), ("1F1EB-1F1F7", "1F1EB-1F1F7", "1F1EB-1F1F7", True), ("1F3F4-E0067-E0062-E007F", "1F3F4-E0067-E0062-E007F", "1F3F4-E0067-E0062-E007F", True),
]
#: Language tags with their pack locale and region.
TAGS = [("en-US", "en", "US"), ("pt_BR", "pt", "BR"), ("in", "id", None), ("zh-Hant-TW", "zh", "TW"), ("xx-YY", None, "YY"), ("TR", "tr", None)]
MOODS, PRICES = ["happy", "sad"], {"read": 1e-7, "request": 3e-7, "embedding": 2e-7, "image": 1e-5}
BLOCKED = ["click 3"]


def picked(values, n):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


def values_sql(rows) -> str:
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"
    return ", ".join(f"({i}, {', '.join(map(show, r))})" for i, r in enumerate(rows))


def glyph_ids(s, d):
    k = F.col("p_partkey")
    letter = lambda n: F.decode(F.unhex(F.concat(F.lit("F09F"), F.hex(0x98 + F.floor(n / 64)), F.hex(0x80 + n % 64))), "UTF-8")
    glyph = F.concat(letter(k % 60), F.when(k % 3 == 0, "️").when(k % 3 == 1, "\U0001f3fd").otherwise(""))
    return table(s, d, "part").select("p_partkey", G.id_of(glyph).alias("id"), G.base_id(G.id_of(glyph)).alias("base"))


def families(s, d):
    ids = table(s, d, "part").select("p_partkey", picked([f[0] for f in FAMILIES], F.col("p_partkey")).alias("id"))
    return ids.select("p_partkey", G.rating_family(F.col("id")).alias("rating_family"), G.list_family(F.col("id")).alias("list_family"), G.is_country_flag(F.col("id")).alias("flag"))


def tags(s, d):
    own = picked([t[0] for t in TAGS], F.col("c_custkey"))
    next_ = picked([t[0] for t in TAGS], F.col("c_custkey") + 1)
    return table(s, d, "customer").select("c_custkey", G.pack_locale(own).alias("locale"), G.region_of(own).alias("region"), F.concat_ws(",", G.user_locales(F.array(own, next_))).alias("locales"), G.resolved_region(F.when(F.col("c_custkey") % 3 == 0, "device").when(F.col("c_custkey") % 3 == 1, ""), G.region_of(own)).alias("resolved"))


def keywords(s, d):
    said = table(s, d, "conversations").filter("role = 'user'")
    words = T.tokens(T.ascii_normalized(F.col("text"), 1 << 30))
    typed = F.concat("role", F.lit(" :"), F.left("text", F.lit(3)))
    return said.select("conv_id", "turn", F.concat_ws(",", G.caption_keywords(words)).alias("keywords"), G.autocomplete(F.regexp_replace(typed, r"[\s:]$", "x")).isNotNull().alias("typing"), G.finished_shortcode(F.concat(F.lit("(:a"), "turn", F.lit(":"))).alias("code"), G.truncated(F.col("text"), 5).alias("start"))


def alias_order(s, d):
    lists = table(s, d, "part").groupBy("p_name").agg(*[F.array_sort(F.collect_set(F.when(F.col("p_size") % 7 == i, F.col("p_brand")))).alias(c) for i, c in enumerate(("top", *C.ALIAS_CATEGORIES))])
    listed = C.ordered_aliases({c: F.col(c) for c in ("top", *C.ALIAS_CATEGORIES)})
    core, rest = C.core_and_rest(listed, 4)
    return lists.select("p_name", F.concat_ws(",", core).alias("core"), F.concat_ws(",", rest).alias("rest"))


def alias_rows(s, d):
    part = table(s, d, "part")
    return part.select(F.lit("en").alias("locale"), F.col("p_brand").alias("item"), F.col("p_name").alias("phrase"), F.concat(F.lit("f"), F.col("p_size") % 4).alias("field"), (F.col("p_size") % 4).alias("field_ix"), F.col("p_partkey").alias("pos"))


def placed(s, d):
    part = table(s, d, "part")
    key = [F.lit("en").alias("locale"), F.col("p_brand").alias("item"), F.col("p_name").alias("phrase")]
    verdicts = part.groupBy(*key).agg(F.when(F.min("p_size") < 3, "remove").when(F.min("p_size") < 6, "low").alias("action")).filter("action is not null")
    return C.placed_aliases(alias_rows(s, d), verdicts, part.filter("p_size = 50").select(*key))


def unmatched(s, d):
    edits = table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "*").otherwise("fr").alias("locale"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 40).alias("item"), F.lit("red ring").alias("phrase"))
    return C.unmatched_edits(alias_rows(s, d), edits)


def popularity(s, d):
    items = table(s, d, "part").select(F.format_string("%04d-200D-%s", F.col("p_partkey") % 500, picked(["2640", "2642", "1F4BB"], F.col("p_partkey"))).alias("item")).distinct()
    ratings = table(s, d, "part").filter("p_size > 25").groupBy(F.format_string("%04d-200D-%s", F.col("p_partkey") % 500, picked(["2640", "2642", "1F4BB"], F.col("p_partkey"))).alias("item")).agg(F.max("p_size").alias("rating"))
    return C.family_popularity(items, ratings, G.rating_family)


def embedded(s, d):
    lists = table(s, d, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_type")).alias("tags"), F.array_sort(F.collect_set("p_brand")).alias("aliases"), F.min("p_type").alias("description"))
    return lists.select("p_name", C.documents(F.col("p_name"), F.when(F.col("description") < "L", F.col("description")).otherwise(""), F.col("tags"), F.col("aliases")).alias("document"))


def used(s, d):
    lists = table(s, d, "part").groupBy(F.col("p_brand").alias("item")).agg(*[F.array_sort(F.collect_set(F.when(F.col("p_size") % 3 == i, F.col("p_name")))).alias(f"u{i}") for i in range(3)])
    uses = F.array(*[F.struct(F.lit(f"kind{i}").alias("kind"), F.slice(f"u{i}", 1, 3).alias("phrases")) for i in range(3)])
    return C.usage_texts(lists.select("item", uses.alias("uses")))


def mined(s, d):
    queries = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).select("query_id", F.col("p_name").alias("q"))
    found = table(s, d, "part").join(queries, F.col("p_name") == F.col("q")).select("query_id", F.col("p_partkey").alias("item"), (F.col("p_size") / 50).alias("score"))
    return C.mined(queries, found, F.col("score") < 0.9)


def listed(s, d):
    part = table(s, d, "part")
    results = part.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("item"), F.col("p_partkey").alias("place"))
    own = part.filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("item"))
    locales = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("en"), "p_name")).otherwise(F.create_map(F.lit("en"), "p_name", F.lit("fr"), "p_type"))
    return C.suggestions(results, own, part.select(F.col("p_partkey").alias("item"), locales.alias("labels")), "fr")


def mapped(s, d):
    results = table(s, d, "part").select(F.col("p_size").alias("query_id"), F.concat(F.format_string("%x", F.col("p_partkey")), F.lit("-fe0f")).alias("item"), F.col("p_partkey").alias("place"))
    other = table(s, d, "part").filter("p_size > 20").select(F.format_string("%X", F.col("p_partkey")).alias("key"), F.col("p_name").alias("entry"))
    return C.mapped(results, other)


def import_reports(s, d):
    parts = table(s, d, "part").groupBy(F.col("p_size").alias("batch"), "p_type").count().groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "count"))).alias("counts"))
    return C.merged_reports(parts)


def labels_map(s, d):
    rows = table(s, d, "part").select(F.col("p_brand").alias("item"), F.concat(F.lit("l"), F.col("p_size") % 3).alias("locale"), F.col("p_name").alias("label"), F.col("p_partkey").alias("pack"))
    return K.labels_by_locale(rows).select("item", F.concat_ws(",", F.map_values("labels")).alias("labels"))


def named(s, d):
    phrases = table(s, d, "part").select(F.col("p_name").alias("phrase"), F.col("p_partkey").alias("item"), (F.col("p_size") % 3).alias("field_ix"))
    asked = table(s, d, "part").select(F.col("p_size").alias("query_id"), F.col("p_name").alias("q")).groupBy("query_id").agg(F.min("q").alias("q"))
    return C.shortcodes(asked, phrases)


def shown_picks(s, d):
    pair = lambda df, a, b: df.select(F.col(a).alias("query_id"), F.col(b).alias("item"))
    return C.picks_among(pair(table(s, d, "lineitem").filter("l_returnflag = 'R'"), "l_orderkey", "l_suppkey"), pair(table(s, d, "lineitem").filter("l_quantity > 25"), "l_orderkey", "l_suppkey"))


def sheet(s, d):
    k = F.col("p_partkey")
    rows = table(s, d, "part").select(k.alias("row"), F.format_string("u+%x%s", k % 300 + 0x1F300, F.when(k % 2 == 0, " fe0f").otherwise("")).alias("code"), F.when(k % 9 == 0, "n/a").otherwise(F.format_string("%d.%d", F.col("p_size"), k % 1000)).alias("rating"))
    return C.sheet_ratings(rows)


def zones(s, d):
    entries = table(s, d, "nation").select(F.array(F.col("n_regionkey").cast("string")).alias("regions"), F.array(F.when(F.col("n_nationkey") == 3, "4").otherwise("0")).alias("except_regions")).filter("regions[0] < '3'")
    return C.zones_of(entries, table(s, d, "region").select(F.concat(F.lit("Zone/"), "r_name").alias("zone"), F.col("r_regionkey").cast("string").alias("region")))


def log(s, d):
    return search_log.load(s, d)


def shard_candidates(s, d):
    return H.candidates(log(s, d), search_log.account(), "2024-01-05", "2024-01-25", BLOCKED)


def merged_log(s, d):
    rows = log(s, d).select(F.concat(F.upper("query"), F.lit("!")).alias("q"), F.col("searches").cast("double").alias("n"), "locale")
    return H.merged_log(rows, BLOCKED, 5).select("q", "n", F.concat_ws(",", "locales").alias("locales"))


def made_up(s, d):
    part = table(s, d, "part")
    names = part.groupBy("p_name").agg((F.min("p_partkey") + 1).alias("rank")).select(F.col("p_name").alias("q"), "rank")
    return H.with_pinned(H.bootstrap(names, MOODS, part.select(F.split("p_name", " ")[1].alias("q")).distinct()), part.select(F.lower("p_brand").alias("q")).distinct())


def names_of(s, d):
    return table(s, d, "part").groupBy(F.col("p_name").alias("q")).agg(F.count("*").alias("n"))


def results_of(s, d):
    part = table(s, d, "part").select(F.col("p_name").alias("q"), F.col("p_partkey").alias("item"), (F.col("p_size") / 50).alias("score"))
    return part.withColumn("place", F.row_number().over(C.Window.partitionBy("q").orderBy(F.desc("score"), "item")))


def built(s, d):
    """Short names are sure; those of a large first part are stored already; the others are answered by their parts."""
    names, ranked = names_of(s, d), results_of(s, d)
    sure = names.filter("length(q) < 8")
    stored = H.compact(ranked.join(names.filter("n % 2 = 0"), "q", "left_semi").filter("place <= 2"))
    return H.build(names, sure, stored, lambda new: ranked.join(new, "q", "left_semi").filter("place <= 5").select("q", "place", "item", "score"), 3000)


def built_summary(s, d):
    return built(s, d).select("shard_key", "q", F.size("answer").alias("n"), F.aggregate("answer", F.lit(0).cast("long"), lambda a, x: a + x["s"]).alias("units"))


def looked_up(s, d):
    rows = built(s, d).select("shard_key", "q", F.size("answer").alias("answer"))
    live = rows.filter("length(q) % 2 = 0").withColumn("answer", F.lit(-1))
    return H.looked_up(names_of(s, d), live, rows)


def drawn(s, d):
    return H.fake_results(names_of(s, d), 1000)


def files(s, d):
    bodies = table(s, d, "part").groupBy("p_brand").agg(F.concat_ws("\n", F.array_sort(F.collect_list("p_name"))).alias("body"))
    return K.content_files(bodies, "p_brand", "body").select("p_brand", "file", "bytes")


def listed_files(s, d):
    bodies = table(s, d, "part").groupBy("p_brand").agg(F.concat_ws("\n", F.array_sort(F.collect_list("p_name"))).alias("body"))
    return K.manifest(bodies.select(F.col("p_brand").alias("file"), "body")).select("file", "bytes", "sha256", (F.col("gzip") > 0).alias("packed"))


def stale(s, d):
    stored = table(s, d, "events").select(F.col("event_id").cast("string").alias("file"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("uploaded"))
    used_ = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("file"))
    return K.stale_files(stored, used_, F.lit(1706000000), 86400)


def merged_parts(s, d):
    part = table(s, d, "part")
    return K.merged_batches(part.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("part"), F.col("p_brand").alias("record")), part.select(F.col("p_name").alias("key")))


def vector_file(s, d):
    path = scratch(s, "vector-file")
    K.write_vectors(table(s, d, "embeddings"), path, "vec_id", "embedding")
    back = K.read_vectors(s, path)
    both = back.join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    error = F.array_max(F.zip_with("v", "embedding", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    ones = F.bit_count(F.conv(F.hex(F.substring("signs", 1, 4)), 16, 10).cast("long"))
    return both.select("id", (error < 0.004).alias("near"), F.length("signs").alias("sign_bytes"), ones.cast("long").alias("ones"))


def fitted(s, d):
    part = table(s, d, "part")
    rows = part.groupBy((F.col("p_size") % 3).cast("string").alias("locale"), F.col("p_name").alias("item")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    return K.fitted_aliases(rows.withColumn("head", F.col("item")), 600)


def weighted(s, d):
    points = table(s, d, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, 10.0).otherwise(1.0).alias("w"))
    return A.weighted_counts(points, "event_type", "w", 5, 3)


def client_reports(s, d):
    e = table(s, d, "events")
    report = F.format_string('{"v":%d,"sample":%s,"counts":{"%s":%d,"all":1},"picks":[["%s"]]}', F.when(F.col("event_id") % 9 == 0, 2).otherwise(1), F.when(F.col("event_id") % 7 == 0, "7").when(F.col("event_id") % 2 == 0, "0.5").otherwise("0.1"), F.col("event_type"), F.col("user_id") % 5, F.when(F.col("event_id") % 11 == 0, "?").otherwise("1F600"))
    good, refused = A.reports(e.select(report.alias("report")))
    return A.report_counts(good).unionByName(refused.agg(F.lit("refused").alias("event"), F.count("*").cast("double").alias("n")))


def roles(s, d):
    accounts = table(s, d, "customer").select(F.col("c_custkey").alias("account_id"), "c_name")
    members = table(s, d, "orders").select(F.col("o_custkey").alias("account_id"), (F.col("o_orderkey") % 5).alias("member_id"), F.col("o_orderstatus").alias("role")).groupBy("account_id", "member_id").agg(F.min("role").alias("role"))
    return A.with_role(accounts, members, F.lit(2))


def hooked(s, d):
    apps = table(s, d, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("app_id"))
    hooks = table(s, d, "lineitem").select(F.col("l_orderkey").alias("app_id"), F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("revoked_at"))
    return A.apps_with_hooks(apps, hooks)


#: Shares of the cost model, each as a condition on an event.
SHARES = {"device": "value >= 20", "shard": "user_id % 2 = 0", "cache": "user_id % 10 = 0", "reactions": "event_type = 'click'", "images": "event_type = 'purchase'"}
GRID = [(a, b) for a in (0.8, 0.9) for b in (0.0, 0.5)]


def cost(s, d):
    """The costs of the events' own shares, of each share halved and half as much again, and of a grid of two of them."""
    base = table(s, d, "events").agg(*[F.avg(F.expr(c).cast("double")).alias(k) for k, c in SHARES.items()])
    cases = F.explode(F.array(*[F.struct(F.lit(c["case"]).alias("case"), *[F.least(F.lit(1.0), F.col(k) * c[k]).alias(k) for k in SHARES]) for c in A.sensitivity(dict.fromkeys(SHARES, 1.0), 0.5, most=None)]))
    grid = F.explode(F.array(*[F.struct(F.lit("grid").alias("case"), F.lit(a).alias("device"), F.lit(b).alias("shard"), "cache", "reactions", "images") for a, b in GRID]))
    rows = base.select(cases.alias("c")).select("c.*").unionByName(base.select(grid.alias("c")).select("c.*"))
    return A.layered_cost(rows, PRICES).select("case", "device", "shard", "cost")


def cost_sql() -> str:
    cases = [{"case": "base"}] + [{"case": k + sign, k: f} for k in SHARES for sign, f in (("-", 0.5), ("+", 1.5))]
    listed_ = [f"SELECT '{c['case']}' AS \"case\", " + ", ".join(f"least(1e0, {k} * {c.get(k, 1.0)}e0) AS {k}" for k in SHARES) + " FROM b" for c in cases] + [f"SELECT 'grid', {x}e0, {y}e0, cache, reactions, images FROM b" for x, y in GRID]
    shares = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {k}" for k, c in SHARES.items())
    return f'WITH b AS (SELECT {shares} FROM events) SELECT "case", device, shard, round(round((1 - device) * 0.1e0, 6) + round((1 - device) * (1 - shard) * 0.3e0, 6) + round((1 - device) * (1 - shard) * (1 - cache) * 0.2e0, 6) + round(reactions * 0.2e0, 6) + round(images * 10e0, 6), 6) AS cost FROM ({" UNION ALL ".join(listed_)})'


BUILD = f"""WITH n AS (SELECT p_name AS q, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p_name AS q, p_partkey AS item, CAST(floor(p_size / 50e0 * 1000 + 0.5e0) AS BIGINT) AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS place FROM part),
 b AS (SELECT n.q, list({{'item': item, 's': s}} ORDER BY place) AS answer FROM n JOIN r ON r.q = n.q AND place <= CASE WHEN n % 2 = 0 THEN 2 ELSE 5 END WHERE length(n.q) >= 8 GROUP BY 1),
 z AS (SELECT q, length('{{"q":"' || q || '","answer":[' || array_to_string(list_transform(answer, lambda x: '{{"item":' || x.item || ',"s":' || x.s || '}}'), ',') || ']}}') AS bytes, answer FROM b),
 {split_sql(3000)}, built AS (SELECT shard_key, q, answer FROM z JOIN dealt USING (q))"""
FINE = f"WITH {QD}"

QUERIES = {
    "glyph_ids": (glyph_ids, "SELECT p_partkey, printf('%X', 128512 + p_partkey % 60) || CASE WHEN p_partkey % 3 = 1 THEN '-1F3FD' ELSE '' END AS id, printf('%X', 128512 + p_partkey % 60) AS base FROM part"),
    "glyph_families": (families, f"SELECT p_partkey, rating_family, list_family, flag FROM part JOIN (VALUES {values_sql(FAMILIES)}) v(i, id, rating_family, list_family, flag) ON i = p_partkey % {len(FAMILIES)}"),
    "locale_tags": (tags, f"WITH v(i, tag, locale, region) AS (VALUES {values_sql(TAGS)}) SELECT c_custkey, a.locale, a.region, array_to_string(list_filter([a.locale, CASE WHEN b.locale IS DISTINCT FROM a.locale THEN b.locale END, CASE WHEN 'en' IN (coalesce(a.locale, ''), coalesce(b.locale, '')) THEN NULL ELSE 'en' END], lambda x: x IS NOT NULL), ',') AS locales, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE a.region END AS resolved FROM customer JOIN v a ON a.i = c_custkey % 6 JOIN v b ON b.i = (c_custkey + 1) % 6"),
    "caption_keywords": (keywords, f"SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_filter(list_distinct(w), lambda x: length(x) >= 3 AND NOT list_contains({G.FILLER!r}, x)), lambda x: printf('%09d', list_position(w, x)) || x))[1:6], lambda x: x[10:]), ',') AS keywords, NOT regexp_matches(left(text, 2), '[\\s:]') AS typing, 'a' || turn AS code, left(text, 5) AS start FROM (SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9+]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations WHERE role = 'user')"),
    "alias_order": (alias_order, "WITH g AS (SELECT p_name, list_concat(coalesce(list_sort(list(DISTINCT p_brand) FILTER (WHERE p_size % 7 = 0)), [])[1:3], flatten([" + ", ".join(f"coalesce(list_sort(list(DISTINCT p_brand) FILTER (WHERE p_size % 7 = {i})), [])" for i in range(1, 6)) + "])) AS l FROM part GROUP BY 1), o AS (SELECT p_name, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM g) SELECT p_name, array_to_string(l[1:4], ',') AS core, array_to_string(l[5:], ',') AS rest FROM o"),
    "alias_placement": (placed, "WITH p AS (SELECT p_brand AS item, p_name AS phrase, min(p_size) AS low, max(p_size) AS top, first('f' || p_size % 4 ORDER BY p_size % 4, p_partkey) AS field FROM part GROUP BY 1, 2) SELECT 'en' AS locale, item, phrase, CASE WHEN low BETWEEN 3 AND 5 OR (low >= 3 AND top = 50) THEN 'low' ELSE field END AS field, CASE WHEN low < 3 THEN 'removed' WHEN low < 6 OR top = 50 THEN 'low' ELSE 'kept' END AS outcome FROM p"),
    "unmatched_edits": (unmatched, "SELECT * FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE 'fr' END AS locale, 'Brand#' || s_suppkey % 40 AS item, 'red ring' AS phrase FROM supplier) WHERE locale = 'fr' OR item NOT IN (SELECT p_brand FROM part WHERE p_name = 'red ring')"),
    "family_popularity": (popularity, "WITH i AS (SELECT printf('%04d', p_partkey % 500) AS a, ['2640', '2642', '1F4BB'][1 + p_partkey % 3] AS b, p_size FROM part), g AS (SELECT a, b, max(p_size) FILTER (WHERE p_size > 25) AS r FROM i GROUP BY 1, 2) SELECT a || '-200D-' || b AS item, CASE WHEN r IS NOT NULL OR b = '1F4BB' THEN r ELSE max(CASE WHEN b <> '1F4BB' THEN r END) OVER (PARTITION BY a) END AS rating FROM g"),
    "embedding_documents": (embedded, "SELECT p_name, p_name || CASE WHEN min(p_type) < 'L' THEN '. ' || min(p_type) ELSE '' END || '. ' || array_to_string(list_concat(list_sort(list(DISTINCT p_type)), list_sort(list(DISTINCT p_brand))[1:40]), ', ') AS document FROM part GROUP BY 1"),
    "usage_texts": (used, "SELECT p_brand AS item, 'kind' || p_size % 3 AS kind, array_to_string(list_sort(list(DISTINCT p_name))[1:3], ', ') AS text FROM part GROUP BY 1, 2"),
    "alias_mining": (mined, "SELECT first(p_partkey ORDER BY p_size DESC, p_partkey) AS item, p_name AS phrase FROM part WHERE p_size / 50e0 < 0.9e0 GROUP BY p_name"),
    "suggestion_list": (listed, "SELECT CAST(p_size AS INT) AS query_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place, p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS label FROM part WHERE p_brand <> 'Brand#1' QUALIFY place <= 8"),
    "catalog_mapping": (mapped, "SELECT p_size AS query_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place, p_name AS entry FROM part WHERE p_size > 20"),
    "import_reports": (import_reports, "SELECT p_type AS reason, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1"),
    "labels_by_locale": (labels_map, "SELECT item, string_agg(label, ',' ORDER BY locale) AS labels FROM (SELECT p_brand AS item, 'l' || p_size % 3 AS locale, first(p_name ORDER BY p_partkey DESC) AS label FROM part GROUP BY 1, 2) GROUP BY 1"),
    "shortcode_lookup": (named, "WITH q AS (SELECT p_size AS query_id, min(p_name) AS q FROM part GROUP BY 1) SELECT query_id, first(p_partkey ORDER BY p_size % 3 DESC, p_partkey) AS item FROM q JOIN part ON p_name = q WHERE p_size % 3 < 2 GROUP BY 1"),
    "picks_among_candidates": (shown_picks, "SELECT l_orderkey AS query_id, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 25"),
    "sheet_ratings": (sheet, "SELECT printf('%X', 127744 + p_partkey % 300) AS key, first(round(CAST(p_size || '.' || p_partkey % 1000 AS DOUBLE), 3) ORDER BY p_partkey DESC) AS rating FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1"),
    "entry_zones": (zones, "SELECT 'Zone/' || r_name AS zone, CAST(r_regionkey AS VARCHAR) AS region FROM region WHERE r_regionkey < 3 OR (r_regionkey = 4 AND (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) < 3)"),
    "shard_candidates": (shard_candidates, FINE + " SELECT locale, query AS q, CAST(sum(searches) AS BIGINT) AS n FROM query_daily WHERE day BETWEEN '2024-01-05' AND '2024-01-25' AND query <> 'click 3' GROUP BY 1, 2 HAVING count(DISTINCT app_id // 10) >= 3 AND sum(searches) >= 10"),
    "query_log_merge": (merged_log, FINE + " SELECT query AS q, CAST(sum(searches) AS DOUBLE) AS n, array_to_string(list_sort(list(DISTINCT locale)), ',') AS locales FROM query_daily WHERE query <> 'click 3' GROUP BY 1 HAVING sum(searches) >= 5"),
    "bootstrap_queries": (made_up, "WITH u AS (SELECT p_name AS q, CAST(1 + floor(100 / (min(p_partkey) + 1)) AS BIGINT) AS n FROM part GROUP BY 1 UNION ALL SELECT DISTINCT m || ' ' || split_part(p_name, ' ', 2), 1 FROM part, (SELECT unnest(['happy', 'sad']) AS m) UNION ALL SELECT DISTINCT lower(p_brand), 1000000000 FROM part) SELECT q, max(n) AS n FROM u GROUP BY 1"),
    "embedding_budget": (lambda s, d: H.budgeted(names_of(s, d).withColumn("locale", F.left("q", F.lit(1))), 20), "SELECT p_name AS q, CAST(count(*) AS BIGINT) AS n, left(p_name, 1) AS locale FROM part GROUP BY p_name ORDER BY n DESC, locale, q LIMIT 20"),
    "shard_build": (built_summary, BUILD + " SELECT shard_key, q, CAST(len(answer) AS INT) AS n, CAST(list_sum(list_transform(answer, lambda x: x.s)) AS BIGINT) AS units FROM built"),
    "shard_lookup": (looked_up, BUILD + " SELECT n.q, CASE WHEN b.q IS NULL THEN NULL WHEN length(n.q) % 2 = 0 THEN -1 ELSE CAST(len(answer) AS INT) END AS answer, CASE WHEN b.q IS NULL THEN NULL WHEN length(n.q) % 2 = 0 THEN 0 ELSE 1 END AS layer FROM n LEFT JOIN built b USING (q)"),
    "stored_answers": (lambda s, d: H.expanded(H.compact(results_of(s, d).filter("place <= 5"))), "SELECT * FROM (SELECT p_name AS q, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS INT) AS place, p_partkey AS item, floor(p_size / 50e0 * 1000 + 0.5e0) / 1000 AS score FROM part) WHERE place <= 5"),
    "fake_resolver": (drawn, None),
    "content_files": (files, "SELECT p_brand, left(sha256(body), 16) || '.json' AS file, CAST(strlen(body) AS BIGINT) AS bytes FROM (SELECT p_brand, string_agg(p_name, chr(10) ORDER BY p_name) AS body FROM part GROUP BY 1)"),
    "file_manifest": (listed_files, "SELECT p_brand AS file, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256, true AS packed FROM (SELECT p_brand, string_agg(p_name, chr(10) ORDER BY p_name) AS body FROM part GROUP BY 1)"),
    "stale_files": (stale, "SELECT CAST(event_id AS VARCHAR) AS file FROM events WHERE event_id NOT IN (SELECT p_partkey FROM part) AND floor(epoch(ts)) < 1706000000 - 86400"),
    "merged_batches": (merged_parts, "SELECT p_name AS key, first(p_brand ORDER BY p_partkey DESC) AS record FROM part GROUP BY 1"),
    "vector_file": (vector_file, "SELECT vec_id AS id, true AS near, CAST(len(embedding) // 8 AS INT) AS sign_bytes, CAST(len(list_filter(embedding[1:32], lambda x: x >= 0)) AS BIGINT) AS ones FROM embeddings"),
    "pack_fitting": (fitted, None),
    "weighted_counts": (weighted, "SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN 10e0 ELSE 1e0 END) AS n FROM events GROUP BY 1 HAVING n >= 5 ORDER BY n DESC, event_type LIMIT 3"),
    "client_reports": (
        client_reports,
        "WITH e AS (SELECT *, event_id % 9 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS good, CASE WHEN event_id % 2 = 0 THEN 2e0 ELSE 10e0 END AS w FROM events) SELECT event_type AS event, round(sum(w * (user_id % 5)), 6) AS n FROM e WHERE good GROUP BY 1 UNION ALL SELECT 'all', round(sum(w), 6) FROM e WHERE good UNION ALL SELECT 'refused', CAST(count(*) AS DOUBLE) FROM e WHERE NOT good",
    ),
    "legacy_locales": (lambda s, d: table(s, d, "documents").select("doc_id", A.legacy_locale(F.when(F.col("doc_id") % 3 == 0, "und").otherwise(F.col("lang"))).alias("locale")), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS locale FROM documents"),
    "member_roles": (roles, "SELECT c_custkey AS account_id, c_name, role FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS role FROM orders WHERE o_orderkey % 5 = 2 GROUP BY 1) ON o_custkey = c_custkey"),
    "apps_with_hooks": (hooked, "SELECT DISTINCT o_custkey AS account_id, o_orderkey AS app_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "layered_cost": (cost, cost_sql()),
}
