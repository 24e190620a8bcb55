"""Fusing and reranking ranked lists (query_id, id, place, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.analytics import rank

#: The constant of reciprocal ranks, of evidence, and the weights of the linear reranker's eight features.
RRF_K, EVIDENCE_K, FLOOR, PIN = 60, 8, 0.35, 0.9
RERANK_WEIGHTS = (-0.334, 1.59, 1.899, 0.3387, 10.67, -7.255, 1.838, 3.632)
MISSING_BELOW = 0.02


#: The alias band and least confidence of the weighted fusion, the weights of reactions and photos, their floors and scales.
ALIAS_BAND, ALIAS_SURE = 0.1, 0.6
REACTION_WEIGHTS = {"textEmoji": 1.0, "intent": 1.0, "prior": 0.5, "alias": 0.6, "neighbours": 0.3, "closeNeighbours": 0.5}
PHOTO_WEIGHTS = {"proposed": 1.0, "keyword": 0.5, "caption": 0.5}
REACTION_SCALE, CLOSE, PHOTO_FLOOR, KEYWORD_LEAST = 2.0, 0.58, 0.46, 0.5


def lists(*named: tuple[str, float, bool, DataFrame]) -> DataFrame:
    """The lists one under another: (name, weight, whether a result's own score counts too, rows)."""
    parts = [df.select("query_id", "id", "place", "score", F.lit(i).alias("list_ix"), F.lit(name).alias("source"), F.lit(float(weight)).alias("weight"), F.lit(by_score).alias("by_score")) for i, (name, weight, by_score, df) in enumerate(named)]
    return reduce(DataFrame.unionByName, parts)


def placed(df: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    out = df.withColumn("place", rank(Window.partitionBy("query_id").orderBy(*order)))
    return out if limit is None else out.filter(F.col("place") <= limit)


def reciprocal(alias: DataFrame, semantic: DataFrame, k: int = RRF_K, limit: int = 10, alias_weight: float = 1.0, semantic_weight: float = 1.0, pin: float = PIN, floor: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """query_id, id, fused, place: weighted reciprocal ranks of two lists.

    Alias results of at least `pin` stand first in their order (without a fused
    score); those of at least `floor` come before the rest. weights: query_id,
    alias_weight, semantic_weight and floor, where they differ by query.
    """
    a, b = (df.select("query_id", "id", F.col("score").alias(f"{n}_score"), F.col("place").alias(f"{n}_place")) for n, df in (("a", alias), ("b", semantic)))
    both = a.join(b, ["query_id", "id"], "full")
    if weights is None:
        both = both.select("*", F.lit(alias_weight).alias("alias_weight"), F.lit(semantic_weight).alias("semantic_weight"), F.lit(floor).cast("double").alias("floor"))
    else:
        both = both.join(weights.select("query_id", "alias_weight", "semantic_weight", "floor"), "query_id")
    share = lambda n, w: F.coalesce(F.col(w) / (k + F.col(f"{n}_place")), F.lit(0.0))
    tier = F.when(F.col("a_score") >= pin, 0).when(F.col("a_score") >= F.col("floor"), 1).otherwise(2)
    fused = F.when(F.col("a_score") >= pin, None).otherwise(F.round(share("a", "alias_weight") + share("b", "semantic_weight"), 9))
    out = both.select("query_id", "id", fused.alias("fused"), tier.alias("tier"), "a_place", "b_place")
    order = (F.col("tier"), F.when(F.col("tier") == 0, F.col("a_place")), F.desc("fused"), F.col("a_place").asc_nulls_last(), F.col("b_place").asc_nulls_last())
    return placed(out, *order, limit=limit).select("query_id", "id", "fused", "place")


def fuse(alias: DataFrame, semantic: DataFrame, semantic_confidence: DataFrame, learned: bool = True, limit: int = 10) -> DataFrame:
    """query_id, id, place: the learned ranking, or reciprocal ranks weighted by how sure each list is."""
    if learned:
        return rerank(alias, semantic, semantic_confidence, limit=limit).select("query_id", "id", "place")
    sure = alias.groupBy("query_id").agg(F.max("score").alias("c")).join(semantic_confidence, "query_id")
    weights = sure.select("query_id", (0.4 + F.col("c")).alias("alias_weight"), (0.4 + 0.6 * F.col("confidence")).alias("semantic_weight"), F.when(F.col("c") >= ALIAS_SURE, F.col("c") - ALIAS_BAND).alias("floor"))
    return reciprocal(alias, semantic, limit=limit, weights=weights).select("query_id", "id", "place")


def evidence(rows: DataFrame, family: DataFrame, k: int = EVIDENCE_K, floor: float = FLOOR, scale: float = 1.0, limit: int = 10, exempt: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, source, place: summed evidence of lists(), the best of each family.

    Evidence of `scale` is score 1. Less than `floor` goes, but for the exempt
    (query_id, id). family: id, family. source is that of the largest
    contribution; ties go to the list and place an id was met in first.
    """
    part = F.col("weight") * (k + 1) / (k + F.col("place")) * F.when(F.col("by_score"), F.col("score")).otherwise(1.0)
    sums = rows.withColumn("part", part).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("total"), F.min_by("source", F.struct(-F.col("part"), "list_ix")).alias("source"), F.min(F.struct("list_ix", "place")).alias("born"))
    if exempt is not None:
        sums = sums.join(exempt.select("query_id", "id").distinct().withColumn("free", F.lit(True)), ["query_id", "id"], "left")
    else:
        sums = sums.withColumn("free", F.lit(None).cast("boolean"))
    kept = sums.filter((F.col("total") >= floor) | F.col("free")).join(family, "id")
    order = (F.desc("total"), F.col("born"))
    first = kept.withColumn("n", rank(Window.partitionBy("query_id", "family").orderBy(*order))).filter("n = 1")
    score = F.floor(F.least(F.lit(1.0), F.col("total") / scale) * 1000 + 0.5) / 1000
    return placed(first.withColumn("score", score), *order, limit=limit).select("query_id", "id", "score", "source", "place")


def reactions(evidence_lists: dict[str, DataFrame], family: DataFrame, close: float = CLOSE, limit: int = 10) -> DataFrame:
    """evidence() for chat reactions. evidence_lists: by the names of REACTION_WEIGHTS; neighbours that are close count again, ids of the prior skip the floor."""
    found = dict(evidence_lists)
    if "neighbours" in found:
        near = found["neighbours"].filter(F.col("score") >= close)
        found["closeNeighbours"] = placed(near.withColumnRenamed("place", "was"), F.col("was")).drop("was")
    named = [(name, weight, name == "alias", found[name]) for name, weight in REACTION_WEIGHTS.items() if name in found]
    return evidence(lists(*named), family, scale=REACTION_SCALE, limit=limit, exempt=found.get("prior"))


def photos(proposed: DataFrame, keyword: DataFrame, caption: DataFrame, family: DataFrame, limit: int = 10) -> DataFrame:
    """evidence() for photos: a model's proposals, alias hits of its keywords that are good enough, and neighbours of the caption."""
    named = [("proposed", PHOTO_WEIGHTS["proposed"], False, proposed), ("keyword", PHOTO_WEIGHTS["keyword"], True, keyword.filter(F.col("score") >= KEYWORD_LEAST)), ("caption", PHOTO_WEIGHTS["caption"], False, caption)]
    return evidence(lists(*named), family, floor=PHOTO_FLOOR, scale=sum(PHOTO_WEIGHTS.values()), limit=limit)


def level_and_gap(semantic: DataFrame, low: float, high: float, least_gap: float, most_gap: float) -> DataFrame:
    """query_id, confidence: the larger of how high the best score is and how far it lies above ranks two to five, each scaled to 0..1."""
    sums = semantic.groupBy("query_id").agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("top"), F.avg(F.when(F.col("place").between(2, 5), F.col("score"))).alias("rest"))
    unit = lambda x, a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    gap = F.coalesce(F.col("top") - F.col("rest"), F.lit(0.0))
    return sums.select("query_id", F.round(F.greatest(unit(F.col("top"), low, high), unit(gap, least_gap, most_gap)), 6).alias("confidence"))


def rerank(alias: DataFrame, semantic: DataFrame, semantic_confidence: DataFrame, weights=RERANK_WEIGHTS, limit: int = 10, slang: DataFrame | None = None) -> DataFrame:
    """query_id, id, learned, pinned, place: strong alias results stay on top, the rest go by a linear score of eight features.

    slang: query_id, id of number_slang(), which stay on top where no alias result is strong.
    """
    confidence = alias.groupBy("query_id").agg(F.max("score").alias("alias_conf"))
    ends = semantic.groupBy("query_id").agg(F.max("score").alias("best"), F.min("score").alias("lowest"))
    a, s = (df.select("query_id", "id", F.col("score").alias(f"{n}_score"), F.col("place").alias(f"{n}_place")) for n, df in (("a", alias), ("s", semantic)))
    both = a.join(s, ["query_id", "id"], "full").join(confidence, "query_id", "left").join(ends, "query_id", "left").join(semantic_confidence, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    in_a, score = F.col("a_score").isNotNull(), F.coalesce("s_score", F.col("lowest") - MISSING_BELOW, F.lit(0.0))
    features = (in_a.cast("double"), zero("a_score"), F.when(in_a, 1 / F.col("a_place")).otherwise(0.0), F.when(in_a, F.col("a_score") / F.col("alias_conf")).otherwise(0.0), score, zero("best") - score, zero("a_score") * zero("alias_conf"), score * zero("confidence"))
    learned = sum((x * w for x, w in zip(features[1:], weights[1:], strict=True)), features[0] * weights[0])
    out = both.select("query_id", "id", F.round(learned, 6).alias("learned"), (zero("a_score") >= PIN).alias("pinned"), "a_place", "s_place")
    if slang is not None:
        weak = F.max(F.col("pinned").cast("int")).over(Window.partitionBy("query_id")) == 0
        marked = out.join(slang.select("query_id", "id", F.lit(True).alias("digits")), ["query_id", "id"], "left")
        out = marked.withColumn("pinned", F.col("pinned") | (weak & F.coalesce("digits", F.lit(False)))).drop("digits")
    return placed(out, F.desc("pinned"), F.when(F.col("pinned"), F.col("a_place")), F.desc("learned"), F.col("a_place").asc_nulls_last(), F.col("s_place").asc_nulls_last(), limit=limit).drop("a_place", "s_place")


def number_slang(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, id: the sure first result of a query of digits only, whose phrase is the whole query in a curated field.

    queries: query_id, q (normalised); results: query_id, id, place, score, phrase, field_ix.
    """
    top = results.filter((F.col("place") == 1) & (F.col("score") >= ALIAS_SURE) & (F.col("field_ix") < 4))
    asked = queries.filter(F.col("q").rlike("^[0-9]+( [0-9]+)*$"))
    return top.join(asked, "query_id").filter("phrase = q").select("query_id", "id")


def first_answer(*layers: DataFrame) -> DataFrame:
    """The rows of the first layer that answers a query (query_id, ...)."""
    found, answered = None, None
    for rows in layers:
        own = rows if answered is None else rows.join(answered, "query_id", "left_anti")
        ids = rows.select("query_id").distinct()
        answered = ids if answered is None else answered.unionByName(ids).distinct()
        found = own if found is None else found.unionByName(own)
    return found


def interleaved(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id, id, place: the lists' results in turn, the first list's before the second's at each place."""
    both = first.select("query_id", "id", F.col("place").alias("was"), F.lit(0).alias("list_ix")).unionByName(second.select("query_id", "id", F.col("place").alias("was"), F.lit(1).alias("list_ix")))
    return placed(both, F.col("was"), F.col("list_ix")).select("query_id", "id", "place")


def shelf(entries: DataFrame, limit: int = 8) -> DataFrame:
    """id, entry, place: each entry's first item, then each entry's second, and so on; an item once. entries: entry_ix, entry, pos, id."""
    first = entries.groupBy("id").agg(F.min(F.struct("pos", "entry_ix", "entry")).alias("r"))
    order = Window.partitionBy(F.lit(0)).orderBy("r.pos", "r.entry_ix", "id")
    top = first.orderBy("r.pos", "r.entry_ix", "id").limit(limit)  # the window then numbers a shelf only
    return top.select("id", "r.entry", rank(order).alias("place"))


def demoted(rows: DataFrame, unsupported: Column) -> DataFrame:
    """Rows that lack support go behind the others, in their order."""
    return placed(rows.withColumn("late", unsupported).withColumnRenamed("place", "was"), F.col("late"), F.col("was")).drop("was")


def custom_first(custom: DataFrame, rows: DataFrame, limit: int = 10) -> DataFrame:
    """A tenant's own results before all others."""
    both = custom.select("query_id", "id", F.col("place").alias("was"), F.lit(0).alias("tier")).unionByName(rows.select("query_id", "id", F.col("place").alias("was"), F.lit(1).alias("tier")))
    return placed(both, F.col("tier"), F.col("was"), F.col("id"), limit=limit)


def inserted(rows: DataFrame, editorial: DataFrame, limit: int = 10) -> DataFrame:
    """Editorial ids stand right after the top result (or before it, where they lead); each id once, at its first place.

    editorial: query_id, id, lead, pos.
    """
    ours = editorial.select("query_id", "id", F.when(F.col("lead"), 0).otherwise(2).alias("tier"), F.col("pos").alias("was"))
    base = rows.select("query_id", "id", F.when(F.col("place") == 1, 1).otherwise(3).alias("tier"), F.col("place").alias("was"))
    first = ours.unionByName(base).groupBy("query_id", "id").agg(F.min(F.struct("tier", "was")).alias("r")).select("query_id", "id", "r.tier", "r.was")
    return placed(first, F.col("tier"), F.col("was"), F.col("id"), limit=limit).drop("was")
