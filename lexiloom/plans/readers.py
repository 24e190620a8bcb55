"""Queries of the readers: tables written in a format of text files, and read again with its checks; and queries of days."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import days as D
from lexiloom.sources import catalogs as K
from lexiloom.sources.tables import read_table as table
from lexiloom.sources.tables import scratch


def stored(df, kind: str, **options) -> str:
    path = scratch(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return path


def key(letter: str):
    return F.concat(F.lit(letter), F.col("p_partkey"))


def log(s, d):
    q = F.concat_ws(" ", "event_type", "user_id")
    rows = table(s, d, "events").groupBy(q.alias("q"), F.when(F.col("user_id") % 2 == 0, "en").alias("locale")).agg(F.count("*").alias("n"))
    return K.query_log(s, stored(rows, "json"))


def overlay(s, d):
    part = table(s, d, "part")
    return K.overlay(s, stored(part.select(key("p").alias("key"), F.col("p_name").alias("description")), "json"), part.select(key("p").alias("key")), "description string")


def evaluation_set(s, d):
    rows = table(s, d, "part").select(key("q").alias("id"), F.col("p_name").alias("q"), F.lit("en").alias("locale"), F.col("p_brand").alias("cat"), F.array(key("a"), key("b")).alias("answers"), F.when(F.col("p_size") > 25, F.array(key("c"))).alias("forbid"))
    return K.eval_queries(s, stored(rows, "json")).select("id", "q", "locale", "cat", F.concat_ws(" ", "answers").alias("answers"), F.concat_ws(" ", "forbid").alias("forbid"))


def owners(s, d):
    rows = table(s, d, "part").select(F.concat(F.lit('"'), "p_name", F.lit('", '), "p_partkey").alias("alias"), F.concat_ws("  ", key("a"), F.when(F.col("p_size") > 25, key("b"))).alias("owners"))
    return K.owners_csv(s, stored(rows, "csv", header=True, escape='"')).select("alias", F.concat_ws(",", "owners").alias("owners"))


def ranges(s, d):
    k = F.col("p_partkey")
    text = F.format_string("see p-%06d to p-%06d, and p-%06d.", k, k + 2, 7 * k)
    return K.id_ranges(table(s, d, "part").filter(k % 5 == 0).select(text.alias("text")))


def exclusion_list(s, d):
    """A head a brand, with comments and blank lines, over as many files as there are tasks."""
    part = table(s, d, "part")
    heads = part.select("p_brand", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("["), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("]")).alias("value")).distinct()
    rows = heads.unionByName(part.select("p_brand", F.col("p_partkey").alias("at"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey"), F.lit(" # "), F.col("p_type")).alias("value")))
    text = rows.repartition("p_brand").sortWithinPartitions("p_brand", "at").select(F.concat(F.when(F.col("at") % 9 == 0, "\n# more\n").otherwise(""), "value").alias("value"))
    return K.exclusions(K.lines(s, stored(text, "text")))


def packs(s, d):
    """A pack for each hundred parts."""
    k = F.col("p_partkey")
    row = F.struct(F.lit("x").alias("glyph"), k.cast("string").alias("item"), (k % 2).alias("group"), F.lit(1.0).alias("version"), F.lit(0).alias("skins"), F.col("p_name").alias("label"))
    each = table(s, d, "part").groupBy(F.floor(k / 100).alias("pack")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    whole = each.select(F.lit(K.PACK_FORMAT).alias("format"), F.lit(1).alias("formatVersion"), F.lit("en").alias("locale"), F.col("pack").cast("string").alias("part"), F.array(F.lit("even"), F.lit("odd")).alias("groups"), F.transform("rows", lambda r: r["item"].cast("int") % 7).alias("popularity"), "rows")
    return K.read_packs(s, stored(whole, "json")).select("part", "item", "label", "grp", F.col("popularity").cast("long").alias("popularity"))


def base(s, d):
    part, k = table(s, d, "part"), F.col("p_partkey")
    items = part.select(k.alias("item"), k.alias("ord"), F.when(F.col("p_size") == 50, "component").otherwise("part").alias("group"), F.col("p_name").alias("label"), "p_type", "p_brand")
    codes = [part.filter(k % n == 0).select(k.alias("item"), F.col(c).alias("code")) for n, c in ((3, "p_brand"), (2, "p_type"))]
    words = lambda c, test: part.filter(test).select(F.col(c).alias("key"), F.array(F.lower(c), c).alias("words")).distinct()
    annotations = words("p_type", F.length("p_type") % 2 == 0).unionByName(words("p_brand", F.col("p_brand") > "Brand#2"))
    rows = K.base_catalog(items, codes, annotations, [F.col("p_type"), F.col("p_brand")])
    return rows.select("item", "ord", "label", F.concat_ws(",", "shortcodes").alias("shortcodes"), F.concat_ws(",", "keywords").alias("keywords"))


#: Time zones of the users, one of them unknown.
ZONES = ["Asia/Tokyo", "America/New_York", "Europe/Berlin", "Nowhere/None"]


def zone_days(s, d):
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("user_id") % 5).cast("int"))
    return table(s, d, "events").groupBy(F.coalesce(zone, F.lit("none")).alias("zone"), D.day_in(zone, F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


def window_lengths(s, d):
    k = F.col("p_partkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    ends = [F.concat(F.when(k % 2 == 0, F.lit("")).otherwise("2024-"), two(k % m), F.lit("-"), two(k % n)) for m, n in ((13, 32), (14, 30))]
    return table(s, d, "part").select(k, *[D.is_day(e).alias(name) for e, name in zip(ends, ("first_is_day", "last_is_day"), strict=True)], D.window_days(*ends, k % 2 == 0).alias("days"))


DAY = "regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast({0} AS date) IS NOT NULL"
QUERIES = {
    "query_log_read": (log, "SELECT event_type || ' ' || user_id AS q, CAST(count(*) AS DOUBLE) AS n, CASE WHEN user_id % 2 = 0 THEN 'en' END AS locale FROM events GROUP BY ALL"),
    "overlay_read": (overlay, "SELECT 'p' || p_partkey AS key, p_name AS description FROM part"),
    "evaluation_set_read": (evaluation_set, "SELECT 'q' || p_partkey AS id, p_name AS q, 'en' AS locale, p_brand AS cat, 'a' || p_partkey || ' b' || p_partkey AS answers, CASE WHEN p_size > 25 THEN 'c' || p_partkey ELSE '' END AS forbid FROM part"),
    "owners_csv_read": (owners, "SELECT '\"' || p_name || '\", ' || p_partkey AS alias, 'a' || p_partkey || CASE WHEN p_size > 25 THEN ',b' || p_partkey ELSE '' END AS owners FROM part"),
    "id_ranges_read": (ranges, "SELECT DISTINCT printf('p-%06d', unnest([p_partkey, p_partkey + 1, p_partkey + 2, 7 * p_partkey])) AS id FROM part WHERE p_partkey % 5 = 0"),
    "exclusions_read": (exclusion_list, "SELECT lower(p_name || ' ' || p_partkey) AS phrase, replace(p_brand, '#', '-') AS category FROM part"),
    "packs_read": (packs, "SELECT CAST(p_partkey // 100 AS VARCHAR) AS part, CAST(p_partkey AS VARCHAR) AS item, p_name AS label, CASE p_partkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS grp, p_partkey % 7 AS popularity FROM part"),
    "base_catalog_read": (
        base,
        "SELECT p_partkey AS item, p_partkey AS ord, p_name AS label, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_type END) AS shortcodes, CASE WHEN length(p_type) % 2 = 0 THEN lower(p_type) || ',' || p_type WHEN p_brand > 'Brand#2' THEN lower(p_brand) || ',' || p_brand ELSE '' END AS keywords FROM part WHERE p_size IS DISTINCT FROM 50",
    ),
    "zone_days": (
        zone_days,
        "SELECT coalesce(zone, 'none') AS zone, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE CASE WHEN zone IN ('Asia/Tokyo', 'America/New_York', 'Europe/Berlin') THEN zone ELSE 'UTC' END, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT ts, ['Asia/Tokyo', 'America/New_York', 'Europe/Berlin', 'Nowhere/None'][user_id % 5 + 1] AS zone FROM events) GROUP BY 1, 2",
    ),
    "window_lengths": (
        window_lengths,
        f"WITH w AS (SELECT p_partkey, printf('%02d-%02d', p_partkey % 13, p_partkey % 32) AS f, printf('%02d-%02d', p_partkey % 14, p_partkey % 30) AS l FROM part), e AS (SELECT p_partkey, p_partkey % 2 = 0 AS yearly, CASE WHEN p_partkey % 2 = 0 THEN f ELSE '2024-' || f END AS f, CASE WHEN p_partkey % 2 = 0 THEN l ELSE '2024-' || l END AS l FROM w), c AS (SELECT *, date_diff('day', try_cast(CASE WHEN yearly THEN '2023-' ELSE '' END || f AS date), try_cast(CASE WHEN yearly THEN '2023-' ELSE '' END || l AS date)) + 1 AS span FROM e) SELECT p_partkey, {DAY.format('f')} AS first_is_day, {DAY.format('l')} AS last_is_day, CAST(CASE WHEN yearly AND span <= 0 THEN span + 365 ELSE span END AS INT) AS days FROM c",
    ),
}
