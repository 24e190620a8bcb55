"""Queries of editorial records, with their SQL. A record is made of each part; the days are in January 2024."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import editorial as C
from lexiloom.sources.tables import read_table as table

FIRST, LAST, DAY, EXCLUDED, REGIONS = "2024-01-05", "2024-01-20", "2024-01-08", ["rod", "old gear"], ["DE", "FR", "GB", "US"]


def columns():
    return F.col("p_partkey"), F.col("p_size")


def records(s, d):
    k, size = columns()
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    kind = F.element_at(F.array(*map(F.lit, C.KINDS)), (k % 5 + 1).cast("int"))
    day = F.format_string("2024-01-%02d", 1 + size % 28)
    window = lambda first, last, recurs: F.struct(first.alias("from"), last.alias("to"), F.lit(recurs).alias("recurs"))
    season = F.when(size % 2 == 0, window(F.lit("11-20"), F.lit("01-10"), "yearly")).otherwise(window(F.lit("03-01"), F.when(size % 7 == 0, "07-01").otherwise("04-10"), "yearly"))
    when = F.when(kind == "seasonal", season).when(kind == "event", window(day, F.date_format(F.date_add(F.to_date(day), 10), "yyyy-MM-dd"), None))
    items = F.array(*[F.struct(i.alias("id"), w.alias("weight")) for i, w in ((k + 1, F.lit(0.4)), (k, 0.5 + size / 100.0))])
    return table(s, d, "part").select(
        F.format_string("r%09d", k).alias("id"), kind.alias("kind"), F.when(k % 4 == 0, "draft").otherwise("approved").alias("status"), when.alias("window"),
        F.when(k % 3 == 0, F.array(F.lit("*"))).when(k % 3 == 1, F.array(F.lit("FR"), F.lit("DE"))).otherwise(F.array(F.lit("US"))).alias("regions"),
        F.when((k % 3 == 0) & (size % 5 == 0), F.array(F.lit("US"))).otherwise(F.array().cast("array<string>")).alias("except_regions"),
        F.when(k % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("en"))).alias("locales"),
        F.when(k % 2 == 0, F.create_map(F.lit("en"), F.array("p_name"), F.lit("fr"), F.array(F.concat_ws(" ", b, a)))).otherwise(F.create_map(F.lit("en"), F.array("p_name"))).alias("triggers"),
        items.alias("items"), F.create_map(F.lit("en"), "p_type").alias("context"), F.array(k + 2).alias("outranks"), (size > 40).alias("featured"),
    )


def known(s, d):
    k, _ = columns()
    return table(s, d, "part").select(k.alias("item"))


def entries(s, d):
    return C.compiled(records(s, d), "en", FIRST, LAST, known(s, d))


def asked(s, d):
    names = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    n = F.col("query_id") % 3
    q = F.when(n == 0, F.left("p_name", F.greatest(F.length("p_name") - 3, F.lit(1)))).otherwise(F.col("p_name"))
    return names.select("query_id", q.alias("q"), (F.col("query_id") % 2 == 0).alias("typing"), F.when(n == 1, "fr").when(n == 2, "US").alias("region"), F.lit(DAY).alias("day"))


def results(s, d):
    """The five smallest parts of a query's name."""
    k, _ = columns()
    names = table(s, d, "part").select("p_name", k.alias("item"))
    ids = names.groupBy("p_name").agg(F.min("item").alias("query_id"))
    placed = names.withColumn("place", C.rank(C.Window.partitionBy("p_name").orderBy("item"))).filter("place <= 5")
    return placed.join(ids, "p_name").select("query_id", "place", "item")


def with_records(s, d):
    found, own = results(s, d), entries(s, d)
    tops = found.filter("place = 1").select("query_id", "item")
    return C.applied(found, C.matched(asked(s, d), own), C.regional_leads(asked(s, d), own, tops), 8)


def texts(s, d):
    k, _ = columns()
    part = table(s, d, "part").select(F.floor(k / 20).alias("query_id"), k.alias("k"), "p_name").filter("k % 10 = 3")
    rows = part.groupBy("query_id").agg(F.concat_ws(" and ", F.array_sort(F.collect_list(F.struct("k", "p_name")))["p_name"]).alias("text"))
    return rows.select("query_id", F.lit("FR").alias("region"), F.lit(DAY).alias("day"), "text", T.tokens(F.col("text")).alias("toks"))


def banned(s, d):
    phrases = s.createDataFrame([(p, "x") for p in EXCLUDED], "phrase string, category string")
    return C.excluded_phrases(texts(s, d).select(F.col("query_id").alias("text_id"), "text"), phrases)


def dated(s, d):
    sources = table(s, d, "nation").select(F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 3 > 0, F.format_string("%02d-%02d", 1 + F.col("n_nationkey") % 12, 1 + F.col("n_nationkey"))).alias("month_day"), F.when(F.col("n_nationkey") % 3 == 0, F.format_string("2024-01-%02d", 1 + F.col("n_nationkey"))).alias("date"), (1 + F.col("n_nationkey") % 20).alias("days"), F.lit(5).alias("lead"))
    return C.occurrences(sources, FIRST, "2025-03-01")


def owners(s, d):
    return C.trigger_owners(records(s, d))


def free_triggers(s, d):
    strong = C.trigger_owners(records(s, d).filter("items[1].weight >= 0.985"))  # records of the largest parts only
    return C.without_taken(records(s, d).filter("status = 'draft'"), strong).select("id", "locale", F.concat_ws("|", "triggers").alias("triggers"))


def live_and_deployed(s, d):
    rows = records(s, d)
    return C.merged_live(rows.filter("status = 'approved'").select("id", "kind", "featured"), rows.withColumn("featured", F.lit(None).cast("boolean")).select("id", "kind", "featured"))


def conflicts(s, d):
    rows = records(s, d).select("id", "kind", "featured")
    exported = rows.withColumn("featured", F.col("featured") & (F.substring("id", -1, 1) != "5"))
    new, taken = C.imported(rows.filter("kind <> 'meme'"), exported)
    return new.select("id", F.lit("new").alias("what")).unionByName(taken.select("id", F.lit("conflict").alias("what")))


def probes(s, d):
    inside, outside = C.probe_regions(REGIONS)
    return records(s, d).select("id", inside.alias("inside"), outside.alias("outside"))


def gated(s, d):
    after = with_records(s, d).select("query_id", "place", "item")
    wanted = C.matched(asked(s, d), entries(s, d), 1).select("query_id", "item")
    return C.gate(results(s, d), after, wanted, 1)


def effects(s, d):
    return C.preview(results(s, d), with_records(s, d)).select("query_id", F.concat_ws(",", "was").alias("was"), F.concat_ws(",", "now").alias("now"), "changed")


def drafts(s, d):
    k, _ = columns()
    hints = table(s, d, "part").select(F.col("p_brand").alias("draft"), (k * 2).alias("item"), F.col("p_size").cast("long").alias("place"))
    hits = table(s, d, "part").select(F.col("p_brand").alias("draft"), k.alias("item"), k.alias("place"))
    return C.draft_items(hints, hits, known(s, d), 40)


REC = """rec AS (SELECT p_partkey AS k, p_size AS size, p_name, p_type, printf('r%09d', p_partkey) AS id, ['seasonal', 'event', 'regional', 'meme', 'general'][1 + p_partkey % 5] AS kind, 1 + p_partkey % 5 AS ko, CASE WHEN p_partkey % 4 = 0 THEN 'draft' ELSE 'approved' END AS status,
 CASE p_partkey % 3 WHEN 0 THEN ['*'] WHEN 1 THEN ['FR', 'DE'] ELSE ['US'] END AS regions, CASE WHEN p_partkey % 3 = 0 AND p_size % 5 = 0 THEN ['US'] ELSE [] END AS exc, printf('2024-01-%02d', 1 + p_size % 28) AS d1, CAST(CAST(printf('2024-01-%02d', 1 + p_size % 28) AS DATE) + 10 AS VARCHAR) AS d2, p_size > 40 AS feat, (SELECT max(p_partkey) FROM part) AS top FROM part),
 live AS (SELECT *, CASE WHEN k + 1 <= top THEN 2 ELSE 1 END AS n_items, row_number() OVER (ORDER BY ko, id) AS place FROM rec WHERE status = 'approved' AND CASE kind WHEN 'seasonal' THEN size % 2 = 0 WHEN 'event' THEN d1 <= '2024-01-20' AND d2 >= '2024-01-05' ELSE true END),
 ent AS (SELECT * FROM live WHERE CASE kind WHEN 'event' THEN '2024-01-08' BETWEEN d1 AND d2 ELSE true END),
 items AS (SELECT id, place AS ep, 0 AS nr, k AS item, 0.5e0 + size / 100e0 AS w FROM ent UNION ALL SELECT id, place, 1, k + 1, 0.4e0 FROM ent WHERE k + 1 <= top),
 ask AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN left(p_name, greatest(length(p_name) - 3, 1)) ELSE p_name END AS q, query_id % 2 = 0 AS typing, CASE query_id % 3 WHEN 1 THEN 'FR' WHEN 2 THEN 'US' END AS region FROM (SELECT p_name, min(p_partkey) AS query_id FROM part GROUP BY 1)),
 hit AS (SELECT query_id, e.id, e.place AS ep, e.p_name AS match, CASE WHEN e.p_name = q THEN 1e0 ELSE 0.6e0 + 0.4e0 * length(q) / length(e.p_name) END AS quality FROM ask JOIN ent e ON e.p_name = q OR (typing AND length(q) >= 3 AND 2 * length(q) >= length(e.p_name) AND starts_with(e.p_name, q)) WHERE (list_contains(regions, '*') OR coalesce(list_contains(regions, region), false)) AND NOT coalesce(list_contains(exc, region), false)),
 sc AS (SELECT query_id, item, h.id AS entry, match, ep, nr, floor(round(w * quality, 9) * 1000 + 0.5e0) / 1000 AS score FROM hit h JOIN items USING (id, ep)),
 one AS (SELECT query_id, item, max(score) AS score, first(entry ORDER BY score DESC, ep, nr) AS entry, first(match ORDER BY score DESC, ep, nr) AS match, min(ep * 10 + nr) AS born FROM sc GROUP BY 1, 2),
 mat AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, born) AS place, item, score, entry, match FROM one QUALIFY place <= 4),
 base AS (SELECT min(p_partkey) OVER (PARTITION BY p_name) AS query_id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS place, p_partkey AS item FROM part QUALIFY place <= 5),
 lead AS (SELECT query_id, first(e.k ORDER BY 0.5e0 + size / 100e0 DESC, e.place) AS item FROM ask JOIN ent e ON e.p_name = q AND kind = 'regional' AND e.k + 2 = query_id WHERE region IS NOT NULL AND (list_contains(regions, '*') OR list_contains(regions, region)) AND NOT list_contains(exc, region) GROUP BY 1),
 tier AS (SELECT query_id, item, 0 AS tier, 1 AS was FROM lead UNION ALL SELECT query_id, item, CASE WHEN place = 1 THEN 1 ELSE 3 END, place FROM base UNION ALL SELECT query_id, item, 2, place FROM mat),
 app AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, was, item) AS place, item, tier FROM (SELECT query_id, item, tier, was FROM tier QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY tier, was) = 1) QUALIFY place <= 8)"""
WITH = f"WITH {REC} "

QUERIES = {
    "culture_compile": (lambda s, d: entries(s, d).select("id", "kind", "context", "featured", F.size("items").alias("n_items"), "place"), WITH + "SELECT id, kind, p_type AS context, feat AND kind IN ('seasonal', 'event') AS featured, CAST(n_items AS INT) AS n_items, place FROM live"),
    "culture_match": (lambda s, d: C.matched(asked(s, d), entries(s, d)), WITH + "SELECT * FROM mat"),
    "culture_match_text": (
        lambda s, d: C.matched_in_text(texts(s, d), entries(s, d)),
        WITH + ", tx AS (SELECT p_partkey // 20 AS query_id, ' ' || string_agg(p_name, ' and ' ORDER BY p_partkey) || ' ' AS t FROM part WHERE p_partkey % 10 = 3 GROUP BY 1), s2 AS (SELECT query_id, item, i.id AS entry, e.p_name AS match, floor(round(w, 9) * 1000 + 0.5e0) / 1000 AS score, ep, nr FROM tx JOIN ent e ON contains(t, ' ' || e.p_name || ' ') AND (list_contains(regions, '*') OR list_contains(regions, 'FR')) AND NOT list_contains(exc, 'FR') JOIN items i ON i.id = e.id), o2 AS (SELECT query_id, item, max(score) AS score, first(entry ORDER BY score DESC, ep, nr) AS entry, first(match ORDER BY score DESC, ep, nr) AS match, min(ep * 10 + nr) AS born FROM s2 GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, born) AS place, item, score, entry, match FROM o2 QUALIFY place <= 4",
    ),
    "culture_apply": (with_records, WITH + "SELECT * FROM app"),
    "record_problems": (
        lambda s, d: C.problems(records(s, d), known(s, d), EXCLUDED),
        WITH + "SELECT id, 'warning' AS level, 'unapproved' AS message FROM rec WHERE status <> 'approved' UNION ALL SELECT id, 'error', 'unknown item' FROM rec WHERE k = top UNION ALL SELECT id, 'error', 'window too long' FROM rec WHERE kind = 'seasonal' AND size % 2 = 1 AND size % 7 = 0 UNION ALL SELECT id, 'error', 'excluded phrase' FROM rec WHERE contains(' ' || p_name || ' ', ' rod ') OR p_name = 'old gear' OR (k % 2 = 0 AND p_name = 'gear old')",
    ),
    "excluded_phrases": (banned, "WITH tx AS (SELECT p_partkey // 20 AS text_id, ' ' || string_agg(p_name, ' and ' ORDER BY p_partkey) || ' ' AS t FROM part WHERE p_partkey % 10 = 3 GROUP BY 1) SELECT text_id, phrase, 'x' AS category FROM tx, (SELECT unnest(['rod', 'old gear']) AS phrase) WHERE contains(t, ' ' || phrase || ' ')"),
    "culture_occurrences": (
        dated,
        "WITH n AS (SELECT n_name AS source, n_nationkey AS k, 1 + n_nationkey % 20 AS days FROM nation), st AS (SELECT source, days, CAST(printf('2024-01-%02d', 1 + k) AS DATE) AS d FROM n WHERE k % 3 = 0 UNION ALL SELECT source, days, CAST(printf('%d-%02d-%02d', y, 1 + k % 12, 1 + k) AS DATE) FROM n, (SELECT unnest([2023, 2024, 2025, 2026]) AS y) WHERE k % 3 > 0) SELECT source, CAST(d AS VARCHAR) AS \"from\", CAST(d + CAST(days - 1 AS INT) AS VARCHAR) AS \"to\", CAST(d - 5 AS VARCHAR) AS shows FROM st WHERE d + CAST(days - 1 AS INT) >= DATE '2024-01-05' AND d - 5 <= DATE '2025-03-01'",
    ),
    "trigger_owners": (owners, WITH + ", t AS (SELECT id, 'en' AS locale, p_name AS trigger, status FROM rec UNION ALL SELECT id, 'fr', split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), status FROM rec WHERE k % 2 = 0) SELECT locale, trigger, min(id) AS owner FROM t WHERE status = 'approved' GROUP BY 1, 2"),
    "free_triggers": (free_triggers, WITH + ", t AS (SELECT id, 'en' AS locale, p_name AS trigger, status, size FROM rec UNION ALL SELECT id, 'fr', split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), status, size FROM rec WHERE k % 2 = 0) SELECT id, locale, trigger AS triggers FROM t WHERE status = 'draft' AND (locale, trigger) NOT IN (SELECT (locale, trigger) FROM t WHERE status = 'approved' AND size >= 49)"),
    "merge_live_entries": (live_and_deployed, WITH + "SELECT id, kind, CASE WHEN status = 'approved' THEN feat END AS featured FROM rec"),
    "import_conflicts": (conflicts, WITH + "SELECT id, 'new' AS what FROM rec WHERE kind = 'meme' UNION ALL SELECT id, 'conflict' FROM rec WHERE kind <> 'meme' AND feat AND id LIKE '%5'"),
    "probe_regions": (probes, WITH + "SELECT id, CASE k % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' ELSE 'US' END AS inside, CASE WHEN k % 3 = 0 THEN CASE WHEN size % 5 = 0 THEN 'US' END WHEN k % 3 = 1 THEN 'GB' ELSE 'DE' END AS outside FROM rec"),
    "culture_gate": (
        gated,
        WITH + ", tr AS (SELECT query_id, item FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, born) <= 1) SELECT b.query_id, 'top result changed' AS problem FROM base b JOIN app a USING (query_id) WHERE b.place = 1 AND a.place = 1 AND a.item <> b.item AND query_id NOT IN (SELECT query_id FROM tr) UNION ALL SELECT DISTINCT query_id, 'trigger not among the first' FROM tr t WHERE NOT EXISTS (SELECT 1 FROM app a WHERE a.query_id = t.query_id AND a.item = t.item AND a.place <= 1)",
    ),
    "record_preview": (effects, WITH + ", w AS (SELECT query_id, string_agg(item, ',' ORDER BY place) AS was FROM base WHERE place <= 5 GROUP BY 1), n AS (SELECT query_id, string_agg(item, ',' ORDER BY place) AS now FROM app WHERE place <= 5 GROUP BY 1) SELECT query_id, was, now, was <> now AS changed FROM w JOIN n USING (query_id)"),
    "draft_candidates": (drafts, "WITH u AS (SELECT p_brand AS draft, p_partkey * 2 AS item, 0 AS tier, p_size AS place FROM part UNION ALL SELECT p_brand, p_partkey, 1, p_partkey FROM part), o AS (SELECT draft, item, min(tier * 1000000000 + place) AS born FROM u WHERE item IN (SELECT p_partkey FROM part) GROUP BY 1, 2) SELECT draft, row_number() OVER (PARTITION BY draft ORDER BY born, item) AS place, item FROM o QUALIFY place <= 40"),
}
