"""Curating a catalog's phrases: collisions, placement, overlays, popularity, moderation, and prefix shards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.analytics import rank
from lexiloom.sources.tables import kept

#: Owners of an alias that are kept; more are demoted, and beyond DROP_OVER left out.
KEEP_OWNERS, DROP_OVER = 8, 20


def collisions(owned: DataFrame, alias: str, owner: str, strength: str) -> DataFrame:
    """alias, owner, verdict: the strongest owners keep an alias, the others are demoted, or dropped where there are too many."""
    counts = owned.groupBy(alias).agg(F.count("*").alias("owners"))
    place = rank(Window.partitionBy(alias).orderBy(F.desc(strength), owner))
    verdict = F.when(F.col("place") <= KEEP_OWNERS, "keep").when(F.col("owners") > DROP_OVER, "drop").otherwise("demote")
    return owned.withColumn("place", place).join(counts, alias).select(alias, owner, "owners", verdict.alias("verdict"))


def first_placement(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def overlay(over: Column, base: Column) -> Column:
    """The overlay's phrases, then those of the base that it lacks."""
    return F.concat(over, F.array_except(base, over))


def midpoint_percentile(df: DataFrame, value: str, by: str) -> DataFrame:
    """Percentile rank of a value among its group's: those below and half the equal ones, in hundredths, one at least.

    Values are counted first, so that ranks run over distinct values.
    """
    counts = df.groupBy(by, value).agg(F.count("*").alias("equal"))
    upto = F.sum("equal").over(Window.partitionBy(by).orderBy(value))
    n = F.sum("equal").over(Window.partitionBy(by))
    ranked = counts.select(by, value, F.greatest(F.lit(1), F.floor(100 * (upto - F.col("equal") / 2) / n + 0.5)).cast("long").alias("percentile"))
    return df.join(ranked, [by, value])


def moderated(phrases: DataFrame, text: str, block: list[str], demote: list[str], allowed: list[str]) -> DataFrame:
    """phrases with verdict: block or demote by the listed words and phrases that stand in the text, as whole words, once the allowed phrases are taken out; else ok."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"\s+", " "), F.lit(" "))
    for phrase in allowed:
        padded = F.replace(padded, F.lit(f" {phrase} "), F.lit("  "))
    words = F.split(padded, " ")

    def hit(listed: list[str]) -> Column:
        single, several = [p for p in listed if " " not in p], [p for p in listed if " " in p]
        tests = [F.arrays_overlap(words, F.array(*map(F.lit, single)))] if single else []
        return reduce(lambda x, y: x | y, tests + [F.contains(padded, F.lit(f" {p} ")) for p in several], F.lit(False))

    return phrases.withColumn("verdict", F.when(hit(block), "block").when(hit(demote), "demote").otherwise("ok"))


def curated(phrases: DataFrame, edits: DataFrame) -> DataFrame:
    """phrases (locale, item, phrase) with the action of the first edit (by `pos`) of their locale or of `*` that fits, else `keep`."""
    keys = ["item", "phrase"]
    own = edits.select("locale", *keys, F.struct("pos", "action").alias("e")).groupBy("locale", *keys).agg(F.min("e").alias("own"))
    every = own.filter("locale = '*'").select(*keys, F.col("own").alias("every"))
    both = phrases.join(own, ["locale", *keys], "left").join(every, keys, "left")
    return both.withColumn("action", F.coalesce(F.least("own", "every")["action"], F.lit("keep"))).drop("own", "every")


def longest_prefix(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """q with the longest key that it begins with, by an equi-join on its prefixes."""
    heads = asked.select("q", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda n: F.left(F.col("q"), n))).alias("shard_key"))
    met = heads.join(keys.select("shard_key").distinct(), "shard_key")
    best = met.groupBy("q").agg(F.max_by("shard_key", F.length("shard_key")).alias("shard_key"))
    return asked.select("q").distinct().join(best, "q", "left")


#: Letters that a key's file name holds as they are, the most letters of an encoded key, and what the name has besides.
UNENCODED, MAX_ENCODED_KEY, NAME_REST = r"[^A-Za-z0-9_.!~*'()-]", 200, 12


def encoded_length(key: Column) -> Column:
    """Letters of a key in a file name, where all but a few letters take three for each byte."""
    odd = F.regexp_replace(key, UNENCODED, "")
    return 3 * F.octet_length(key) - 2 * F.octet_length(odd)


def split_keys(entries: DataFrame, budget: int) -> DataFrame:
    """q, shard_key: the key whose shard each entry goes to. entries: q (distinct, not empty), bytes.

    There is a key for each first letter. From a key whose entries are over the
    budget, the fewest largest groups by next letter move out to keys of their
    own, until the rest keeps to it; and so on with those. A key that can't get
    longer (a single entry, or the limit of file names) stays over the budget.

    A group that is over the budget always moves, so a key is over it only if all
    its beginnings are: sums by prefix, taken at once, tell every split, and no
    level waits for the one above. Siblings, one a letter, share a window.
    """
    heads = _heads(entries)
    keys = _keys(_held(heads), budget)
    return heads.select("q", "shard_key").join(keys.select("shard_key").hint("merge"), "shard_key").groupBy("q").agg(F.max_by("shard_key", F.length("shard_key")).alias("shard_key"))


def split_prefixes(entries: DataFrame, budget: int) -> DataFrame:
    """shard_key, entries, bytes: the shards that split_keys() deals the entries to.

    A key's beginnings that part from their parent are keys too, so a shard holds
    what begins with its key, less what begins with its longer keys; no entry is
    met with its key.
    """
    keys = kept(_keys(_held(_heads(entries)), budget), "keys")
    away = keys.groupBy("parent").agg(F.sum("n").alias("n_away"), F.sum("held").alias("held_away")).withColumnRenamed("parent", "shard_key")
    rest = keys.join(away.hint("merge"), "shard_key", "left").fillna(0, ["n_away", "held_away"])
    return rest.select("shard_key", (F.col("n") - F.col("n_away")).alias("entries"), (F.col("held") - F.col("held_away")).alias("bytes")).filter("entries > 0")


def _longer(key: Column) -> Column:
    """The key that a key is longer than by a letter."""
    return F.left(key, F.length(key) - 1)


def _heads(entries: DataFrame) -> DataFrame:
    """q, bytes, shard_key: each entry by all its beginnings that a file name has room for."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("q")), lambda n: F.left(F.col("q"), n))
    open_ = F.filter(prefixes, lambda k: (F.length(k) == 1) | (encoded_length(_longer(k)) + NAME_REST <= MAX_ENCODED_KEY))
    return entries.filter("q <> ''").select("q", "bytes", F.explode(open_).alias("shard_key"))


def _held(heads: DataFrame) -> DataFrame:
    """shard_key, held, n: the bytes and the number of entries of each beginning, written once."""
    return kept(heads.groupBy("shard_key").agg(F.sum("bytes").alias("held"), F.count("*").alias("n")), "held")


def _keys(held: DataFrame, budget: int) -> DataFrame:
    """shard_key, parent (null for a first letter), held, n: the beginnings that get a shard.

    Joins here are merged, never broadcast: the size of a compressed file says little of the rows that come of it.
    """
    parents = held.filter(F.col("held") > budget).select(F.col("shard_key").alias("parent"), F.col("held").alias("whole"))
    children = held.filter(F.length("shard_key") > 1).withColumn("parent", _longer(F.col("shard_key"))).join(parents.hint("merge"), "parent")
    largest = Window.partitionBy("parent").orderBy(F.desc("held"), F.encode("shard_key", "UTF-16BE")).rowsBetween(Window.unboundedPreceding, -1)
    moved = children.withColumn("gone", F.coalesce(F.sum("held").over(largest), F.lit(0))).filter(F.col("whole") - F.col("gone") > budget)
    return held.filter(F.length("shard_key") == 1).select("shard_key", F.lit(None).cast("string").alias("parent"), "held", "n").unionByName(moved.select("shard_key", "parent", "held", "n"))


#: The order of alias categories, how many may lead, and documents for embedding.
ALIAS_CATEGORIES = ("synonym", "slang", "pop_culture", "dev", "intent")
MOST_TOP, DOCUMENT_ALIASES = 3, 40


def ordered_aliases(record: dict[str, Column]) -> Column:
    """An item's aliases: its few leading ones, then the categories in order, each once. record: columns by category and `top`."""
    none = F.array().cast("array<string>")
    listed = F.flatten(F.array(*[F.coalesce(record[c], none) for c in ALIAS_CATEGORIES if c in record]))
    return F.array_distinct(F.concat(F.slice(F.coalesce(record["top"], none), 1, MOST_TOP), listed))


def core_and_rest(aliases: Column, n: int) -> tuple[Column, Column]:
    """The first n aliases, for a core pack, and the others."""
    return F.slice(aliases, 1, n), F.slice(aliases, n + 1, 1 << 20)


def placed_aliases(aliases: DataFrame, verdicts: DataFrame, low: DataFrame) -> DataFrame:
    """item, phrase, field, outcome: each alias once an item and locale, in its first field; removed, demoted to `low` or kept.

    aliases: locale, item, phrase, field, field_ix, pos; verdicts: locale, item, phrase, action (remove or low); low: locale, item, phrase (listed as low).
    """
    first = first_placement(aliases.select("locale", "item", "phrase", "field", "field_ix", "pos"), ["locale", "item", "phrase"], ["field_ix", "pos"])
    keys = ["locale", "item", "phrase"]
    rows = first.join(verdicts.select(*keys, "action"), keys, "left").join(low.select(*keys, F.lit(True).alias("listed")).distinct(), keys, "left")
    outcome = F.when(F.col("action") == "remove", "removed").when((F.col("action") == "low") | F.col("listed"), "low").otherwise("kept")
    return rows.select(*keys, F.when(outcome == "low", "low").otherwise(F.col("field")).alias("field"), outcome.alias("outcome"))


def unmatched_edits(phrases: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that fit no phrase of their locale, or of any for `*`."""
    own = edits.filter("locale <> '*'").join(phrases, ["locale", "item", "phrase"], "left_anti")
    every = edits.filter("locale = '*'").join(phrases.select("item", "phrase").distinct(), ["item", "phrase"], "left_anti")
    return own.unionByName(every)


def family_popularity(items: DataFrame, ratings: DataFrame, family: Callable[[Column], Column]) -> DataFrame:
    """item, rating: an item's own rating, or the best of its family, null without any. items: item; ratings: item, rating."""
    best = ratings.groupBy(family(F.col("item")).alias("family")).agg(F.max("rating").alias("best"))
    own = items.select("item", family(F.col("item")).alias("family")).join(ratings, "item", "left").join(best, "family", "left")
    return own.select("item", F.coalesce("rating", "best").alias("rating"))


def documents(title: Column, description: Column, tags: Column, aliases: Column) -> Column:
    """The text of an item that is embedded: title, then description, distinct tags and the first aliases."""
    rest = F.array_join(F.array_distinct(F.concat(tags, F.slice(aliases, 1, DOCUMENT_ALIASES))), ", ")
    return F.concat_ws(". ", title, F.when(description != "", description), F.when(rest != "", rest))


def usage_texts(rows: DataFrame) -> DataFrame:
    """item, kind, text: one text for each kind of use (struct of kind and phrases) that has phrases. rows: item, uses."""
    return rows.select("item", F.explode("uses").alias("u")).filter(F.size("u.phrases") > 0).select("item", "u.kind", F.array_join("u.phrases", ", ").alias("text"))


def mined(queries: DataFrame, candidates: DataFrame, gate: Column) -> DataFrame:
    """item, phrase: aliases to append: unsure queries' (query_id, q) candidates (query_id, item, score and what the gate reads) that pass a gate, the best of a query."""
    passed = candidates.filter(gate)
    best = passed.groupBy("query_id").agg(F.min_by("item", F.struct(-F.col("score"), "item")).alias("item"))
    return best.join(queries, "query_id").select("item", F.col("q").alias("phrase")).distinct()


def suggestions(results: DataFrame, own: DataFrame, labels: DataFrame, locale: str, limit: int = 8) -> DataFrame:
    """query_id, place, item, label: results without repeated items and a tenant's own (item), with a label in the locale, in English or any."""
    rows = results.join(own.select("item"), "item", "left_anti").groupBy("query_id", "item").agg(F.min("place").alias("was")).join(labels, "item", "left")
    label = F.coalesce(F.element_at("labels", locale), F.element_at("labels", "en"), F.get(F.map_values("labels"), F.lit(0)), F.lit(""))
    placed = rows.withColumn("place", rank(Window.partitionBy("query_id").orderBy("was", "item"))).filter(F.col("place") <= limit)
    return placed.select("query_id", "place", "item", label.alias("label"))


def mapped(results: DataFrame, other: DataFrame) -> DataFrame:
    """query_id, place, entry: results as entries of another catalog (key, entry), met by code points without variation selectors."""
    bare = lambda c: F.regexp_replace(F.upper(c), "-FE0F", "")
    met = results.withColumn("key", bare(F.col("item"))).join(other.select(bare(F.col("key")).alias("key"), "entry"), "key")
    return met.withColumn("place", rank(Window.partitionBy("query_id").orderBy("place", "entry"))).select("query_id", "place", "entry")


def merged_reports(parts: DataFrame) -> DataFrame:
    """reason, n: the counts of batches' reports (batch, counts: map of reason to number)."""
    return parts.select(F.explode("counts").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def shortcodes(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, item: the item whose name or shortcode is a query's code (query_id, q), a shortcode before a name."""
    hits = asked.join(phrases.filter("field_ix < 2").select(F.col("phrase").alias("q"), "item", "field_ix"), "q")
    return hits.groupBy("query_id").agg(F.min_by("item", F.struct(-F.col("field_ix"), "item")).alias("item"))


def picks_among(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The picks (query_id, item) that were candidates, each once."""
    return picks.join(candidates, ["query_id", "item"], "left_semi").distinct()


def sheet_ratings(rows: DataFrame) -> DataFrame:
    """key, rating of a sheet's rows (row, code, rating as text): code points without variation selectors; three decimals; the last row of a key counts."""
    key = F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace("code", r"(?i)U\+", "")), r"\s+", "-"), "-FE0F", "")
    good = rows.withColumn("key", key).withColumn("value", F.try_to_number("rating", F.lit("999D999999"))).filter("value is not null and key <> ''")
    return good.groupBy("key").agg(F.round(F.max_by(F.col("value").cast("double"), "row"), 3).alias("rating"))


def zones_of(entries: DataFrame, zones: DataFrame) -> DataFrame:
    """zone, region: the time zones of the regions that entries name."""
    named = entries.select(F.explode(F.concat("regions", "except_regions")).alias("region")).distinct()
    return zones.join(named, "region", "left_semi").select("zone", "region")


def write_report(df: DataFrame, path: str) -> None:
    """A report, a small table, as one CSV file with a head."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
