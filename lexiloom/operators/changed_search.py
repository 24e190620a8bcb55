"""Searches under a change: editors' records on top of results, an app's own catalog beside the packs, and the checks a change must pass.

A record can only touch queries that hit a text of its triggers. Those are found
by an equi-join and ranked again; the results of all others pass as they are, so
a change costs what it touches, not another search of everything.

Results are query_id, place, item of a search; queries are query_id, q
(normalised), typing, region, day; entries come from editorial.compiled().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import ascii_normalized
from lexiloom.operators import editorial as E
from lexiloom.operators import fusion as R
from lexiloom.operators import lexical as L
from lexiloom.operators import locale_search as S
from lexiloom.operators.word_index import WordIndex
from lexiloom.sources.tables import kept

#: Places that a record's strongest item must reach for its triggers, and results that the checks look at.
TOP_N, GATE_LIMIT = 3, 10


def touched(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """The queries whose text can hit a trigger."""
    return queries.join(E.begun(entries).select("q").distinct(), "q", "left_semi")


def with_records(results: DataFrame, queries: DataFrame, entries: DataFrame, limit: int = 24) -> DataFrame:
    """query_id, place, item, tier (as in editorial.applied()): results with the items of the records that queries hit."""
    again = kept(touched(queries, entries), "touched")
    ids = again.select("query_id")
    same = results.join(ids, "query_id", "left_anti").filter(F.col("place") <= limit)
    same = same.select("query_id", F.col("place").cast("long").alias("place"), "item", F.when(F.col("place") == 1, 1).otherwise(3).alias("tier"))
    old = results.join(ids, "query_id", "left_semi").select("query_id", "place", "item")
    leads = E.regional_leads(again, entries, old.filter("place = 1").select("query_id", "item"))
    new = E.applied(old, E.matched(again, entries), leads, limit)
    return same.unionByName(new.withColumn("place", F.col("place").cast("long")))


def everywhere(entries: DataFrame) -> DataFrame:
    """The entries as if they held on every day and in every region."""
    none = F.array().cast("array<string>")
    return entries.withColumn("window", F.lit(None).cast(entries.schema["window"].dataType)).withColumn("regions", F.array(F.lit("*"))).withColumn("except_regions", none)


def _tops(results: DataFrame, name: str) -> DataFrame:
    return results.filter("place = 1").select("query_id", F.col("item").alias(name))


def gate(results: DataFrame, queries: DataFrame, entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, problem of records that hold everywhere: top results that change, or come up where there was none, and triggers whose item isn't among the first.

    wanted: query_id, item: searches of the triggers with the strongest item of their record; the other queries are those to protect.
    """
    asked = queries.withColumn("region", F.lit(None).cast("string"))
    after = with_records(results, asked, everywhere(entries), GATE_LIMIT)
    both = _tops(results, "was").join(_tops(after, "now"), "query_id", "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    moved = both.join(wanted.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("top result changed").alias("problem"))
    shown = after.filter(F.col("place") <= TOP_N).select("query_id", "item")
    unseen = wanted.join(shown, ["query_id", "item"], "left_anti").select("query_id", F.lit("trigger not among the first").alias("problem"))
    return moved.unionByName(unseen.distinct())


def regional_gate(results: DataFrame, queries: DataFrame, entries: DataFrame, inside: Column, outside: Column) -> DataFrame:
    """entry, query_id, region, problem, blocking: each regional entry, alone and in its real scope, against the searches of all queries that it can touch.

    Inside its scope its strongest item leads its triggers' old top result, and no other query's top result changes;
    outside, none does. inside, outside: a region that the entry holds in, and one that it doesn't (null: none).
    An entry whose top result is none that it outranks doesn't lead any more, which doesn't block.
    """
    own = entries.filter("kind = 'regional'").withColumn("inside", inside).withColumn("outside", outside)
    texts = E.begun(own).groupBy("id", "q").agg(F.max((F.col("trigger") == F.col("q")).cast("int")).alias("whole"), F.first("inside").alias("inside"), F.first("outside").alias("outside"))
    met = queries.select("query_id", "q", "typing", "day").join(texts, "q")
    asks = met.select(F.col("id").alias("only"), F.col("query_id").alias("asked"), "q", "typing", "day", "whole", F.explode(F.array(F.struct(F.lit(True).alias("in_scope"), F.col("inside").alias("region")), F.struct(F.lit(False).alias("in_scope"), F.col("outside").alias("region")))).alias("p"))
    probes = kept(asks.select("only", "asked", "q", "typing", "day", "whole", "p.*").filter("region IS NOT NULL").withColumn("query_id", F.concat_ws("|", "only", F.col("asked").cast("string"), "in_scope")), "probes")
    before = probes.select("query_id", "asked").join(results.select(F.col("query_id").alias("asked"), "place", "item").filter(F.col("place") <= GATE_LIMIT), "asked").select("query_id", "place", "item")
    after = with_records(before, probes, own, GATE_LIMIT)
    at = lambda n, name: after.filter(F.col("place") == n).select("query_id", F.col("item").alias(name))
    rows = probes.join(_tops(before, "was"), "query_id", "left").join(at(1, "first"), "query_id", "left").join(at(2, "second"), "query_id", "left")
    rows = rows.join(own.select(F.col("id").alias("only"), "outranks", F.get("items", F.lit(0))["id"].alias("strong")), "only")
    trigger = F.col("in_scope") & (F.col("whole") == 1)
    leads = F.coalesce(F.array_contains("outranks", F.col("was")), F.lit(False))
    changed = ~F.col("was").eqNullSafe(F.col("first"))
    problem = (
        F.when(trigger & ~leads, "no longer leads")
        .when(trigger & ~(F.col("first").eqNullSafe(F.col("strong")) & F.col("second").eqNullSafe(F.col("was"))), "doesn't lead the old top result")
        .when(~F.col("in_scope") & (F.col("whole") == 1) & changed, "top changed out of scope")
        .when(F.col("in_scope") & (F.col("whole") == 0) & changed, "top result changed")
    )
    found = rows.withColumn("problem", problem).filter("problem IS NOT NULL")
    return found.select(F.col("only").alias("entry"), F.col("asked").alias("query_id"), "region", "problem", (F.col("problem") != "no longer leads").alias("blocking"))


def own_pack(catalog: DataFrame) -> DataFrame:
    """item, phrase, field_ix, weight of an app's own catalog (item, shortcode, aliases): an item is named by its shortcode's words."""
    named = catalog.select("item", F.array(F.struct(F.lit("name").alias("field"), F.col("shortcode").alias("phrase"))).alias("own"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("alias").alias("field"), a.alias("phrase"))).alias("more"))
    rows = named.select("item", F.explode(F.concat("own", "more")).alias("p")).select("item", "p.field", ascii_normalized(F.col("p.phrase")).alias("phrase")).filter("phrase <> ''")
    index = F.create_map(*[x for i, f in enumerate(L.FIELDS) if f in ("name", "alias") for x in (F.lit(f), F.struct(F.lit(i).alias("ix"), F.lit(L.FIELDS[f]).alias("w")))])
    return rows.select("item", "phrase", index[F.col("field")].alias("f")).groupBy("item", "phrase").agg(F.min_by("f", "f.ix").alias("f")).select("item", "phrase", F.col("f.ix").alias("field_ix"), F.col("f.w").alias("weight"))


def seen_by_all(queries: DataFrame, pack: int) -> DataFrame:
    """The queries with a pack (its number in the index) preferred and searched by each: an own catalog belongs to no locale."""
    return queries.withColumn("preferred", F.col("preferred").bitwiseOR(F.lit(1 << pack))).withColumn("searched", F.col("searched").bitwiseOR(F.lit(1 << pack)))


def own_first(queries: DataFrame, index: DataFrame | WordIndex, own: DataFrame, popularity: DataFrame, function_words: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, place, item: results of an app's own pack (own_pack()), searched for itself, then those of the index, cut to the limit."""
    size = S.limited(limit)
    alone = queries.withColumn("preferred", F.lit(1).cast("long")).withColumn("searched", F.lit(1).cast("long"))
    ids = lambda results: results.select("query_id", F.col("item").alias("id"), "place")
    mine = S.search(alone, S.pack_index([own]), own.select("item", F.lit(0).alias("popularity")).distinct(), function_words, size)[0]
    base = S.search(queries, index, popularity, function_words, size)[0]
    return R.custom_first(ids(mine), ids(base), size).select("query_id", "place", F.col("id").alias("item"))
