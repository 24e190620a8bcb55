"""Placing a catalog's phrases: each in one list of its item, judged by edits, moderation and low lists, then capped by its owners.

A phrase that too many items share stays with its strongest owners: those that
list it highest. What an owner loses moves its later phrases up, which can turn
the verdict on them, so phrases are judged in the order in which the catalog first
names them. Here all are judged at once, again and again, with the losses of the
round before, until nothing moves: a verdict hangs only on phrases with an earlier
turn, so the fixed point is the one that judging them in turn gives, and the
rounds are as many as the longest chain of verdicts that turn one another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.analytics import rank
from lexiloom.operators.curation import DROP_OVER, KEEP_OWNERS, first_placement
from lexiloom.sources.tables import kept

#: An item's lists, in the order of their strength.
LISTS = ("alias", "typo", "low")


def placed(phrases: DataFrame, indexed: DataFrame, edits: DataFrame, low: DataFrame, verdict: Column) -> DataFrame:
    """phrases that an item doesn't hold already, each at its first place, with field (a list, or null) and reason (null: as asked).

    phrases: locale, item, ord (the item's place in the catalog), pos (order of
    placement), phrase, field, manual (an editor's, never of low confidence).
    indexed and low: locale, item, phrase. edits: as curated() takes them, actions
    remove and low. verdict: block, demote or ok, of the column phrase.
    """
    keys = ["locale", "item", "phrase"]
    # An item's marks are tens, as its phrases are: they meet it as arrays, so that its phrases are dealt once, by item.
    marks = lambda df, name, *more: df.groupBy("item").agg(F.collect_list(F.struct("locale", "phrase", *more)).alias(name))
    fits = lambda m: (m["locale"] == F.col("locale")) & (m["phrase"] == F.col("phrase"))
    has = lambda name: F.coalesce(F.exists(name, fits), F.lit(False))
    new = phrases.filter("phrase <> ''").join(marks(indexed, "held"), "item", "left").filter(~has("held"))
    first = first_placement(new.select(*keys, "ord", "pos", "field", "manual"), keys, ["pos"])
    known = first.join(marks(low, "lows"), "item", "left").join(marks(edits, "edits", "pos", "action"), "item", "left")
    own = F.filter("edits", lambda e: fits(e) | ((e["locale"] == "*") & (e["phrase"] == F.col("phrase"))))
    action = F.array_min(F.transform(own, lambda e: F.struct(e["pos"], e["action"])))["action"]
    judged = known.select("*", action.alias("action"), has("lows").alias("listed"), verdict.alias("verdict"))
    unsure = ~F.col("manual") & F.col("listed")
    reason = F.when(F.col("action") == "remove", "removed").when(F.col("action") == "low", "edited").when(F.col("verdict") == "block", "blocked").when(F.col("verdict") == "demote", "demoted").when(unsure, "low_confidence")
    field = F.when(reason.isNull(), F.col("field")).when(reason.isin("edited", "demoted", "low_confidence"), "low")
    return judged.select(*keys, "ord", "pos", field.alias("field"), reason.alias("reason"))


def capped(rows: DataFrame, keep: int = KEEP_OWNERS, drop_over: int = DROP_OVER) -> DataFrame:
    """locale, item, phrase, owners, dropped, turn: the entries of lists that lose their phrase to stronger owners.

    rows: locale, item, ord, field_ix (its list), idx (its place there, from 0), phrase; a phrase once an item.
    """
    by_phrase = Window.partitionBy("locale", "phrase")
    owned = rows.withColumn("owners", F.count("*").over(by_phrase)).withColumn("turn", F.min(F.struct("ord", "field_ix", "idx")).over(by_phrase)).filter(F.col("owners") > keep)
    # At first every phrase before it in its list may yet be lost.
    open_ = owned.withColumn("at", F.col("idx")).withColumn("maybe", F.col("idx")).withColumn("free", F.lit(keep))
    members = ["idx", "phrase", "owners", "turn", "at", "free"]
    nth = lambda end, n: F.max(F.when(F.col(f"n_{end}") == n, F.col(end))).over(by_phrase)
    decided = []
    while True:
        ends = open_.withColumn("best", F.struct("field_ix", (F.col("at") - F.col("maybe")).alias("at"), "ord", "item")).withColumn("worst", F.struct("field_ix", "at", "ord", "item"))
        ends = ends.withColumn("n_best", rank(by_phrase.orderBy("best"))).withColumn("n_worst", rank(by_phrase.orderBy("worst")))
        ends = ends.withColumn("last", nth("worst", F.col("free"))).withColumn("next", nth("best", F.col("free") + 1))
        stays = F.col("next").isNull() | (F.col("worst") < F.col("next"))
        lost = F.when(stays, False).when((F.col("free") == 0) | (F.col("best") > F.col("last")), True)
        judged = ends.withColumn("lost", lost).withColumn("free", F.col("free") - F.count_if(~F.col("lost")).over(by_phrase).cast("int"))
        state = kept(judged.filter("lost IS NULL OR lost").select("locale", "item", "ord", "field_ix", *members, "lost"), "verdicts")
        decided.append(state.filter("lost").select("locale", "item", "phrase", "owners", (F.col("owners") > drop_over).alias("dropped"), "turn"))
        if state.filter("lost IS NULL").isEmpty():
            return reduce(DataFrame.unionByName, decided)
        # An item's contested phrases in one list are a record's field: tens, not a group that grows.
        rest = F.when(F.col("lost").isNull(), F.struct("phrase", "owners", "at", "free"))
        lists = state.groupBy("locale", "item", "ord", "field_ix").agg(F.collect_list(F.struct("idx", "turn", F.col("lost").isNotNull().alias("lost"), rest.alias("rest"))).alias("all"))
        before = lambda lost: F.size(F.filter("all", lambda x: (x["lost"] == lost) & (x["idx"] < F.col("m.idx")) & (x["turn"] < F.col("m.turn"))))
        each = lists.withColumn("m", F.explode(F.filter("all", lambda x: ~x["lost"])))
        open_ = each.select("locale", "item", "ord", "field_ix", "m.idx", "m.turn", "m.rest.phrase", "m.rest.owners", "m.rest.free", (F.col("m.rest.at") - before(True)).alias("at"), before(False).alias("maybe"))


def validated(phrases: DataFrame, indexed: DataFrame, edits: DataFrame, low: DataFrame, verdict: Column) -> DataFrame:
    """locale, item, phrase, field, place (in its list, from 0; both null if the phrase is in none), reasons, owners (null: not capped).

    placed(), then capped() within each locale. What is demoted goes to the end of
    the low list, in the order of turns.
    """
    keys = ["locale", "item", "phrase"]
    in_list = Window.partitionBy("locale", "item", "field")
    numbered = placed(phrases, indexed, edits, low, verdict).withColumn("idx", rank(in_list.orderBy("pos", "phrase")) - 1)
    start = kept(numbered, "placed")
    index = F.array_position(F.array(*map(F.lit, LISTS)), F.col("field")) - 1
    lost = capped(start.filter("field is not null").select(*keys, "ord", index.cast("int").alias("field_ix"), "idx"))
    losses = lost.groupBy("locale", "item").agg(F.map_from_entries(F.collect_list(F.struct("phrase", F.struct("owners", "dropped", "turn")))).alias("losses"))
    rows = start.drop("ord", "idx").join(losses, ["locale", "item"], "left").withColumn("loss", F.element_at("losses", F.col("phrase"))).select("*", "loss.*").drop("losses", "loss")
    why = F.concat_ws(",", "reason", F.when(F.col("dropped"), "collision_dropped").when(~F.col("dropped") & (F.col("field") != "low"), "collision_demoted"))
    field = F.when(F.col("dropped").isNull(), F.col("field")).when(~F.col("dropped"), "low")
    rows = rows.withColumn("reasons", why).withColumn("field", field)
    place = F.when(F.col("field").isNotNull(), rank(in_list.orderBy(F.col("turn").isNotNull(), "turn", "pos", "phrase")) - 1)
    return rows.select(*keys, "field", place.cast("int").alias("place"), "reasons", "owners")
