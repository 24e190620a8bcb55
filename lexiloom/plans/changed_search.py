"""Queries of searches under a change, with their SQL: records and own catalogs over the real results of the lexical search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import changed_search as X
from lexiloom.operators import editorial as C
from lexiloom.operators import locale_search as S
from lexiloom.plans import editorial as E
from lexiloom.plans import locale_search as P
from lexiloom.sources.tables import read_table as table

NAMED = 10_000_000


def asked(s, d):
    """The search's queries as records see them; one in three has a region."""
    q = P.queries_of(s, d)
    n = F.col("query_id") % 3
    return q.select("query_id", F.trim("q").alias("q"), (~F.col("q").rlike(r"\s$")).alias("typing"), F.when(n == 1, "FR").when(n == 2, "US").alias("region"), F.lit(E.DAY).alias("day"))


def search_with_records(s, d):
    found = P.found(s, d)[0].select("query_id", "place", "item")
    return X.with_records(found, asked(s, d), E.entries(s, d), 8)


def triggers(s, d):
    """A search for each trigger of the records, and the strongest item of the record that owns it; ids beyond those of the other queries."""
    ids = P.queries_of(s, d).select("query_id").join(table(s, d, "part").select(F.col("p_partkey").alias("query_id"), "p_name"), "query_id")
    own = C.trigger_owners(E.records(s, d)).filter("locale = 'en'").select(F.col("trigger").alias("p_name"), F.col("owner").alias("id"))
    strongest = E.entries(s, d).select("id", F.get("items", F.lit(0))["id"].alias("item"))
    return ids.join(own, "p_name").join(strongest, "id").select((F.col("query_id") + NAMED).alias("query_id"), F.col("p_name").alias("q"), "item")


def gate_queries(s, d):
    """The protected queries and the triggers' own (a closing space: nothing is completed), as the search takes them."""
    named = P.masks(triggers(s, d).select("query_id", F.concat("q", F.lit(" ")).alias("q")))
    return P.queries_of(s, d).unionByName(named)


def record_gate(s, d):
    rows = gate_queries(s, d)
    found = S.search(rows, P.packs(s, d), P.popularity(s, d), P.function_words(s), X.GATE_LIMIT)[0].select("query_id", "place", "item")
    seen = rows.select("query_id", F.trim("q").alias("q"), F.lit(False).alias("typing"), F.lit(E.DAY).alias("day"))
    return X.gate(found, seen, E.entries(s, d), triggers(s, d).select("query_id", "item"))


def regional_gate(s, d):
    found = P.found(s, d)[0].select("query_id", "place", "item")
    inside, outside = C.probe_regions(E.REGIONS)
    entries = E.entries(s, d).withColumn("outranks", F.array(F.get("items", F.lit(0))["id"] - 1))
    return X.regional_gate(found, asked(s, d), entries, inside, outside)


def own_catalog(s, d):
    """An app's catalog: a tenth of the parts under ids of its own, two names each."""
    part = table(s, d, "part").filter("p_partkey % 10 = 0")
    return X.own_pack(part.select((-1 - F.col("p_partkey")).alias("item"), F.translate("p_name", " ", "_").alias("shortcode"), F.array(F.lower("p_type"), F.concat(F.split("p_name", " ")[1], F.lit(" own"))).alias("aliases")))


def search_own_catalog(s, d):
    return X.own_first(P.queries_of(s, d), P.packs(s, d), own_catalog(s, d), P.popularity(s, d), P.function_words(s), 8)


def search_own_pack(s, d):
    """The own pack as a third one of the index, counted for all."""
    part = table(s, d, "part")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    english = P.L.phrases(part, "p_partkey", {"name": "p_name", "keyword": "p_type", "alias": "p_brand"})
    french = P.L.phrases(part.select("p_partkey", F.concat_ws(" ", second, first).alias("name"), first.alias("alias")), "p_partkey", {"name": "name", "alias": "alias"})
    index = S.pack_index([english, french, own_catalog(s, d)])
    popularity = P.popularity(s, d).unionByName(own_catalog(s, d).select("item", F.lit(0).alias("popularity")).distinct())
    return S.search(X.seen_by_all(P.queries_of(s, d), 2), index, popularity, P.function_words(s), 8)[0]


OWN = f"""oraw AS (SELECT -1 - p_partkey AS item, unnest([0, 3, 3]) AS f, unnest([1.0e0, 0.8e0, 0.8e0]) AS w, unnest([p_name, lower(p_type), split_part(p_name, ' ', 2) || ' own']) AS t FROM part WHERE p_partkey % 10 = 0),
 onorm AS (SELECT item, f, w, {P.NORM.format(x="t")} AS phrase FROM oraw)"""
#: ASK and BASE of the editorial SQL, over the search's own queries and results.
ENTRIES = E.REC[: E.REC.index(" ask AS (")]
HITS = E.REC[E.REC.index(" hit AS (") : E.REC.index(" base AS (")]
TIERS = E.REC[E.REC.index(" tier AS (") :]
ASK = "ask AS (SELECT query_id, trim(q) AS q, NOT regexp_matches(q, '\\s$') AS typing, CASE query_id % 3 WHEN 1 THEN 'FR' WHEN 2 THEN 'US' END AS region FROM qs)"
LEAD = """lead AS (SELECT ask.query_id, first(e.k ORDER BY 0.5e0 + size / 100e0 DESC, e.place) AS item FROM ask JOIN ent e ON e.p_name = q AND kind = 'regional' JOIN base b ON b.query_id = ask.query_id AND b.place = 1 AND b.item = e.k + 2 WHERE region IS NOT NULL AND (list_contains(regions, '*') OR list_contains(regions, region)) AND NOT list_contains(exc, region) GROUP BY 1)"""
APPLIED = f"{P.FULL}, {ENTRIES} {ASK}, {HITS} base AS (SELECT query_id, place, item FROM res), {LEAD}, {TIERS}"


def renamed(sql: str, names: set[str]) -> str:
    """The SQL with these tables under other names."""
    return re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", r"o_\1", sql)


SEARCHED = f"{P.chain('0', 8)}, {P.merged(8)}"
OWN_NAMES = set(re.findall(r"\b(\w+) AS \((?:SELECT|/)", SEARCHED)) | {"posts", "vocab", "pop", "t0"}
OWN_SEARCH = f"""{OWN}, o_phr AS (SELECT item, phrase, min(f) AS field_ix, max(w) AS weight, CAST(1 AS BIGINT) AS mask, len(string_split(phrase, ' ')) AS n_tokens FROM onorm WHERE phrase <> '' GROUP BY 1, 2),
 o_posts AS (SELECT *, unnest(string_split(phrase, ' ')) AS token FROM o_phr), o_vocab AS (SELECT token, bit_or(mask) AS mask, ln(1 + (SELECT count(DISTINCT item) FROM o_posts) / count(DISTINCT item)) AS idf FROM o_posts GROUP BY token),
 o_pop AS (SELECT DISTINCT item, 0 AS popularity FROM o_phr), o_t0 AS (SELECT query_id, locale, CAST(1 AS BIGINT) AS preferred, CAST(1 AS BIGINT) AS searched, open, toks FROM t0), {renamed(SEARCHED, OWN_NAMES)}"""
THREE_PACKS = P.PACKS.replace("phr AS (", OWN + ", phr AS (").replace("FROM raw WHERE", "FROM (SELECT item, p, f, w, phrase FROM raw UNION ALL SELECT item, 2, f, w, phrase FROM onorm) WHERE").replace("pop AS (SELECT p_partkey AS item, p_size AS popularity FROM part)", "pop AS (SELECT p_partkey AS item, p_size AS popularity FROM part UNION ALL SELECT DISTINCT item, 0 FROM onorm)")
THREE_ASKED = P.ASKED.replace("ELSE 2 END AS BIGINT) AS preferred", "ELSE 2 END AS BIGINT) | 4 AS preferred").replace("ELSE 3 END AS BIGINT) AS searched", "ELSE 3 END AS BIGINT) | 4 AS searched")

QUERIES = {
    "search_with_records": (search_with_records, APPLIED + " SELECT * FROM app"),
    "record_gate_search": (record_gate, None),
    "regional_gate_search": (regional_gate, None),
    "search_own_catalog": (
        search_own_catalog,
        f"{P.FULL}, {OWN_SEARCH}, both_ AS (SELECT query_id, item, 0 AS tier, place AS was FROM o_res UNION ALL SELECT query_id, item, 1, place FROM res) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, was) AS place, item FROM both_ QUALIFY place <= 8",
    ),
    "search_own_pack": (search_own_pack, f"WITH {THREE_PACKS}, {THREE_ASKED}, {SEARCHED} SELECT query_id, place, item, score, phrase, CAST(field_ix AS INT) AS field_ix FROM res"),
}
