"""Evaluation of ranked lists (query_id, place, relevant)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept


def first_relevant(rows: DataFrame) -> DataFrame:
    """query_id, first: the place of the first relevant result, 0 if there is none."""
    return rows.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("relevant"), F.col("place"))), F.lit(0)).alias("first"))


def recall_mrr(judged: DataFrame, *by: str) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank at 10, in all or by columns."""
    at = lambda k: F.round(F.avg(F.col("first").between(1, k).cast("double")), 6).alias(f"r{k}")
    mrr = F.round(F.avg(F.when(F.col("first").between(1, 10), 1 / F.col("first")).otherwise(0.0)), 6).alias("mrr")
    return judged.groupBy(*by).agg(F.count("*").alias("n"), at(1), at(5), at(10), mrr)


def ablations(rows: DataFrame, orders: dict[str, list[Column]], *by: str) -> DataFrame:
    """variant, the columns `by` (null: over all) and the metrics of recall_mrr(), for each variant's order of the same results.

    rows: query_id, relevant, the columns `by` of a query, and what the orders read.
    Results meet once: all variants rank them in windows over one partitioning, and
    one aggregation gives the first relevant place of each.
    """
    ranked = rows.select("query_id", "relevant", *by, *[F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias(f"place_{i}") for i, order in enumerate(orders.values())])
    best = [F.struct(F.lit(name).alias("variant"), F.coalesce(F.min(F.when(F.col("relevant"), F.col(f"place_{i}"))), F.lit(0)).alias("first")) for i, name in enumerate(orders)]
    firsts = ranked.groupBy("query_id", *by).agg(F.array(*best).alias("v")).select(*by, F.explode("v").alias("v")).select(*by, "v.*")
    sets = [[F.col("variant"), *map(F.col, by)], [F.col("variant")]] if by else [[F.col("variant")]]
    at = lambda k: F.round(F.avg(F.col("first").between(1, k).cast("double")), 6).alias(f"r{k}")
    mrr = F.round(F.avg(F.when(F.col("first").between(1, 10), 1 / F.col("first")).otherwise(0.0)), 6).alias("mrr")
    return firsts.groupingSets(sets, "variant", *by).agg(F.count("*").alias("n"), at(1), at(5), at(10), mrr)


def macro(summary: DataFrame, columns: list[str]) -> DataFrame:
    return summary.agg(F.count("*").alias("groups"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def precision(rows: DataFrame, k: int) -> DataFrame:
    """query_id, p1, pk, hit: whether the first is relevant, the share of k, and whether any of k is."""
    good = (F.col("relevant") & (F.col("place") <= k)).cast("int")
    one = F.max((F.col("relevant") & (F.col("place") == 1)).cast("int")).alias("p1")
    return rows.groupBy("query_id").agg(one, F.round(F.sum(good) / k, 6).alias("pk"), F.max(good).alias("hit"))


def nearest_rank(df: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """The value at index floor(share * n) of the sorted values, the last at most: exact.

    Rows are counted by group and value before anything is sorted; the counts are
    sorted into ranges of group and value, so that a group with most of the rows
    is spread over tasks, and running sums over ranges (a row each) and within
    them give each value its ranks.
    """
    keys = [F.col(c) for c in by]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranged = kept(counts.repartitionByRange(*keys, F.col(value)).withColumn("range", F.spark_partition_id()), "values")
    sums = ranged.groupBy(*by, "range").agg(F.sum("n").alias("here"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = sums.withColumn("ahead", F.sum("here").over(whole.orderBy("range")) - F.col("here")).withColumn("total", F.sum("here").over(whole)).drop("here")
    matching = [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "range")]
    rows = ranged.alias("v").join(ahead.alias("s"), reduce(lambda x, y: x & y, matching)).select("v.*", "s.ahead", "s.total")
    last = F.col("ahead") + F.sum("n").over(Window.partitionBy(*by, "range").orderBy(value))
    placed = rows.withColumn("last", last)
    at = lambda p: F.least(F.col("total"), F.floor(F.lit(p) * F.col("total")) + 1)
    inside = lambda p: (F.col("last") >= at(p)) & (F.col("last") - F.col("n") < at(p))
    return placed.groupBy(*by).agg(*[F.max(F.when(inside(p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares])


def calibrated(judged: DataFrame, value: str, hit: str) -> DataFrame:
    """floor and ceiling, in hundredths: the quartile of the misses' values and the median of the hits', at least 0.05 apart; 1 and 1.05 without hits."""
    cents = lambda x: F.floor(F.round(x, 9) * 100 + 0.5) / 100
    found = nearest_rank(judged.select(F.col(hit).alias("hit"), value), value, [0.25, 0.5], "hit")
    one = found.agg(F.max(F.when(F.col("hit"), F.col("p50"))).alias("top"), F.max(F.when(~F.col("hit"), F.col("p25"))).alias("low"))
    ceiling = F.when(F.col("top").isNull(), 1.05).otherwise(cents(F.col("top")))
    low = F.coalesce(cents(F.col("low")), ceiling - 0.15)
    return one.select(F.when(F.col("top").isNull(), 1.0).otherwise(cents(F.least(low, ceiling - 0.05))).alias("floor"), ceiling.alias("ceiling"))


def forbidden(rows: DataFrame, banned: Column, k: int = 3) -> DataFrame:
    """query_id, forbid: whether a banned result stands among the first k."""
    return rows.groupBy("query_id").agg(F.max(banned & (F.col("place") <= k)).alias("forbid"))


def ceilings(answers: DataFrame, k: int = 4) -> DataFrame:
    """query_id, ceiling: the best precision at k that so many answers (query_id, answer) allow."""
    return answers.groupBy("query_id").agg((F.least(F.lit(k), F.count_distinct("answer")) / k).alias("ceiling"))


def class_ceilings(queries: DataFrame, answers: DataFrame, by: str, k: int = 4) -> DataFrame:
    """ceilings() where a query (query_id, by) has the answers (answer, by) of its class: they are counted by class, not by query."""
    sizes = answers.groupBy(by).agg((F.least(F.lit(k), F.count_distinct("answer")) / k).alias("ceiling"))
    return queries.join(sizes, by).select("query_id", "ceiling")


def class_answers(rows: DataFrame, queries: DataFrame, answers: DataFrame, by: str, fold: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """query_id, answer: of the answers (answer, by) of a query's class (query_id, by), one for each key that a result (query_id, id) folds to.

    rank_of() needs no others, and the pairs of all queries and answers of a class, which grow with its square, are never made.
    """
    keys = rows.select("query_id", fold(F.col("id")).alias("key")).distinct().join(queries.select("query_id", by).distinct(), "query_id")
    held = answers.groupBy(by, fold(F.col("answer")).alias("key")).agg(F.min("answer").alias("answer"))
    return keys.join(held, [by, "key"]).select("query_id", "answer")


def rank_of(rows: DataFrame, answers: DataFrame, fold: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """query_id, rank of the first acceptable id, 0 without one; fold maps both sides first. rows: query_id, place, id; answers: query_id, answer."""
    wanted = answers.select("query_id", fold(F.col("answer")).alias("key")).distinct()
    met = rows.withColumn("key", fold(F.col("id"))).join(wanted, ["query_id", "key"], "left_semi")
    return rows.select("query_id").distinct().join(met.groupBy("query_id").agg(F.min("place").alias("rank")), "query_id", "left").fillna(0, ["rank"])


def with_totals(judged: DataFrame, by: str) -> DataFrame:
    """recall_mrr() by a column, in all (null) and as the mean over its values (`macro` is true)."""
    own = recall_mrr(judged, by)
    every = recall_mrr(judged).select(F.lit(None).cast(own.schema[by].dataType).alias(by), *own.columns[1:])
    mean = own.agg(F.lit(None).cast(own.schema[by].dataType).alias(by), F.sum("n").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in own.columns[2:]])
    return own.unionByName(every).withColumn("macro", F.lit(False)).unionByName(mean.withColumn("macro", F.lit(True)))


def four_modes(alias: DataFrame, semantic: DataFrame, fused: DataFrame, gate: DataFrame) -> DataFrame:
    """mode, query_id, id, place: the lists of the alias, semantic and fused modes, and `gated`: fused where the gate (query_id, semantic) asks for it, else alias."""
    named = lambda df, mode: df.select(F.lit(mode).alias("mode"), "query_id", "id", "place")
    asked = gate.filter("semantic").select("query_id")
    gated = named(fused.join(asked, "query_id", "left_semi"), "gated").unionByName(named(alias.join(asked, "query_id", "left_anti"), "gated"))
    return reduce(DataFrame.unionByName, [named(alias, "alias"), named(semantic, "semantic"), named(fused, "fused"), gated])


def gate_share(gate: DataFrame) -> DataFrame:
    """queries and the share that asks for the semantic tier."""
    return gate.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("semantic").cast("double")), 6).alias("share"))


def fidelity(shown: DataFrame, model: DataFrame, k: int = 10) -> DataFrame:
    """queries and share: how much of what is shown among the first k (query_id, id, place) stands in the model's own first k."""
    a, b = (df.filter(F.col("place") <= k).select("query_id", "id") for df in (shown, model))
    hits = a.join(b.withColumn("own", F.lit(1)), ["query_id", "id"], "left").groupBy("query_id").agg((F.count("own") / k).alias("share"))
    return hits.agg(F.count("*").alias("queries"), F.round(F.avg("share"), 6).alias("share"))


def noise(rows: DataFrame, odd: Column, k: int = 5) -> DataFrame:
    """queries and share of them with an odd result among the first k."""
    one = rows.groupBy("query_id").agg(F.max((odd & (F.col("place") <= k)).cast("double")).alias("hit"))
    return one.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("share"))


def severity(first: Column) -> Column:
    """How bad a rank is: none at all is worst."""
    return F.when(first == 0, 1 << 30).otherwise(F.coalesce(first, F.lit(0)))


def worst_misses(judged: DataFrame, other: DataFrame, k: int = 5, limit: int = 10) -> DataFrame:
    """query_id, first, other: queries without a relevant result among the first k, worst first, then by how bad another run (query_id, first) is."""
    missed = judged.filter((F.col("first") == 0) | (F.col("first") > k)).join(other.select("query_id", F.col("first").alias("other")), "query_id", "left")
    return missed.orderBy(F.desc(severity(F.col("first"))), F.desc(severity(F.col("other"))), "query_id").limit(limit).select("query_id", "first", "other")


def rejudged(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """run, query_id, rank: stored lists (run, query_id, place, id) by today's answers."""
    keyed = runs.select(F.struct("run", "query_id").alias("query_id"), "place", "id")
    wanted = runs.select("run", "query_id").distinct().join(answers, "query_id").select(F.struct("run", "query_id").alias("query_id"), "answer")
    return rank_of(keyed, wanted).select("query_id.*", "rank")


def failure(mode: str) -> Column:
    """The kind of a failure by the first rule that holds, null for a hit.

    Columns: rank (in the mode's list), folded (the rank with variants folded),
    alias_rank, semantic_rank, fused_rank, gate, disputed, pictures, romanized,
    unspaced, capped, matched (the best phrase), q (normalised), unknown and n_tokens.
    """
    hit = lambda c: F.coalesce(F.col(c).between(1, 5), F.lit(False))
    rules = F.when(hit("rank"), None).when(F.col("pictures"), "emoji-in-query").when(hit("folded"), "gendered-label").when(F.col("disputed"), "disputed-label")
    if mode == "gated":
        rules = rules.when(~F.col("gate") & hit("fused_rank"), "gate-skipped")
    if mode != "alias":
        rules = rules.when(hit("alias_rank"), "fusion-dropped-alias").when(hit("semantic_rank"), "fusion-dropped-semantic")
    rules = rules.when(F.col("romanized"), "romanized").when(F.col("unspaced"), "unsegmented-script").when(F.col("capped"), "collision-capped")
    rules = rules.when(F.col("matched").isNull(), "no-match").when(F.col("unknown") > 0, "unknown-word").when(F.col("matched") == F.col("q"), "exact-phrase-other-item")
    return rules.when(F.col("n_tokens") >= 2, "phrase-partial").otherwise("word-sense")


def chunk_of(number: Column, total: Column, size: int) -> Column:
    """The chunk, from 0, of row `number` (from 0) when `total` rows are cut into ceil(total / size) chunks of near-equal length."""
    return F.floor(number / F.ceil(total / F.ceil(total / size)))


def integrity(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose output is missing, repeated or unexpected, and what is wrong."""
    counts = actual.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("wanted", F.lit(True)).join(counts, key, "full")
    wrong = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicated")
    return both.select(key, wrong.alias("problem")).filter("problem is not null")


def fit_reranker(rows: DataFrame, features: list[str], k: int = 5, epochs: int = 400, rate: float = 0.05, decay: float = 1e-3) -> list[dict[str, float]]:
    """For each of k folds, weights learned from all queries of the other folds: a listwise softmax over each query's results (query_id, relevant, features), by Adam on standardised features.

    All k are fitted in one pass an epoch. A query's results, a list of the search's
    limit, are laid into blocks of numbers that are written once; a task hands the
    driver one row of k sums a feature, so what it gathers grows with tasks alone.
    Queries without a relevant result take no part.
    """
    each = rows.groupBy("query_id").agg(F.collect_list(F.struct(F.col("relevant").cast("double").alias("relevant"), *[F.col(f).cast("double").alias(f) for f in features])).alias("r"), F.max(F.col("relevant").cast("int")).alias("any")).filter("any = 1")
    flat = lambda c: F.transform("r", lambda x: x[c])
    lists = each.select(folds(F.col("query_id"), k).alias("fold"), flat("relevant").alias("relevant"), *[flat(f).alias(f"x{i}") for i, f in enumerate(features)])
    d = len(features)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                table = np.stack([np.concatenate(batch[c].to_list()) for c in ("relevant", *[f"x{i}" for i in range(d)])]).astype(np.float64)
                size = batch["relevant"].map(len).to_numpy(np.int32)
                yield pd.DataFrame({"values": [table.tobytes()], "sizes": [size.tobytes()], "folds": [batch["fold"].to_numpy(np.int32).tobytes()]})

    blocks = kept(lists.mapInPandas(packed, "values binary, sizes binary, folds binary"), "reranker")

    def opened(block: tuple) -> tuple[np.ndarray, ...]:
        table = np.frombuffer(block.values).reshape(d + 1, -1)
        size, fold = np.frombuffer(block.sizes, np.int32), np.frombuffer(block.folds, np.int32)
        return table[0], table[1:].T, size, np.arange(k)[None, :] != fold[:, None]

    def summed(of: Callable[..., np.ndarray]) -> np.ndarray:
        """Sums over all blocks, exact to the last place and so in any order, of arrays that a block gives."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [of(*opened(block)) for batch in batches for block in batch.itertuples()]
            if parts:
                yield pd.DataFrame({"s": [np.sum(parts, axis=0).ravel().tolist()]})

        tasks = [r.s for r in blocks.mapInPandas(run, "s array<double>").collect()]
        return np.array([math.fsum(column) for column in zip(*tasks, strict=True)])

    def totals(relevant: np.ndarray, x: np.ndarray, size: np.ndarray, learns: np.ndarray) -> np.ndarray:
        mine = np.repeat(learns, size, axis=0).astype(float)
        return np.vstack([learns.sum(axis=0, keepdims=True), mine.sum(axis=0, keepdims=True), x.T @ mine])

    sums = summed(totals)
    if not len(sums):
        return [dict.fromkeys(features, 0.0) for _ in range(k)]
    n_queries, n_rows, *total = sums.reshape(d + 2, k)
    mean = np.array(total) / np.maximum(n_rows, 1)
    square = summed(lambda relevant, x, size, learns: np.einsum("rik,rk->ik", (x[:, :, None] - mean[None]) ** 2, np.repeat(learns, size, axis=0).astype(float))).reshape(d, k)
    spread = np.sqrt(square / np.maximum(n_rows, 1))
    spread[spread <= 0] = 1.0
    w, m, v = (np.zeros((d, k)) for _ in range(3))
    for t in range(1, epochs + 1):
        own = w / spread

        def slopes(relevant: np.ndarray, x: np.ndarray, size: np.ndarray, learns: np.ndarray, own: np.ndarray = own) -> np.ndarray:
            # A query's shares and wants both sum to one, so any middle serves; one fold's mean keeps the numbers small.
            heads, x = np.cumsum(size) - size, x - mean[:, 0]
            s = x @ own
            p = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), size, axis=0))
            p /= np.repeat(np.add.reduceat(p, heads), size, axis=0)
            want = relevant / np.repeat(np.add.reduceat(relevant, heads), size)
            return x.T @ ((p - want[:, None]) * np.repeat(learns, size, axis=0))

        slope = summed(slopes).reshape(d, k) / spread / np.maximum(n_queries, 1) + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return [dict(zip(features, column.tolist(), strict=True)) for column in (w / spread).T]


def held_out(rows: DataFrame, weights: list[dict[str, float]]) -> DataFrame:
    """fold, query_id, first: each query ranked by the weights that its fold had no part in."""
    fold = folds(F.col("query_id"), len(weights))
    learned = F.coalesce(*[F.when(F.col("fold") == j, sum((F.col(f) * w for f, w in own.items()), F.lit(0.0))) for j, own in enumerate(weights)])
    placed = rows.withColumn("fold", fold).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(learned), "id")))
    return first_relevant(placed).withColumn("fold", fold)


def softmax_fit(query: np.ndarray, relevant: np.ndarray, x: np.ndarray, epochs: int, rate: float, decay: float) -> np.ndarray:
    """Weights in the features' own units that give relevant results the most of their query's softmax: the fit of one set that fits in memory."""
    order = np.argsort(query, kind="stable")
    query, relevant, x = query[order], relevant[order], x[order]
    heads = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    n = np.diff(np.append(heads, len(query)))
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / spread
    want = relevant / np.repeat(np.maximum(np.add.reduceat(relevant, heads), 1e-12), n)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, epochs + 1):
        s = z @ w
        p = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), n))
        p /= np.repeat(np.add.reduceat(p, heads), n)
        slope = z.T @ (p - want) / len(heads) + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w / spread


def folds(key: Column, k: int = 5) -> Column:
    """The fold of a query for cross-validation."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(k)).cast("int")


def regressions(now: DataFrame, before: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Keys whose value fell by more than the tolerance."""
    both = now.select(key, F.col(value).alias("now")).join(before.select(key, F.col(value).alias("before")), key)
    return both.filter(F.col("before") - F.col("now") > tolerance)


def pivoted(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column with a total."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values], F.count("*").alias("n_all"))


def miss_type(first: Column, listed: Column, n_results: Column) -> Column:
    """The kind of a failure, by the first rule that holds."""
    return F.when(first == 1, "right").when(first.between(2, 5), "ranked-low").when(first > 5, "ranked-deep").when(n_results == 0, "no-results").when(listed == 0, "not-listed").otherwise("missed")
