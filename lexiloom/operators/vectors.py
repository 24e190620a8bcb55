"""Exact vector search and vector columns. Vectors are arrays of floats; sums are in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.analytics import rank

#: Rows of a shard, and queries that meet it at a time (a matrix of 32 MB).
SHARD_ROWS, BLOCK = 65_536, 64


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def truncated(v: Column, dims: int) -> Column:
    return normalized(F.slice(v, 1, dims))


def quantized(v: Column) -> Column:
    """scale and q: 8-bit whole numbers of a vector, and what they are multiplied by."""
    scale = F.array_max(F.transform(doubles(v), F.abs)) / 127
    return F.struct(scale.alias("scale"), F.transform(doubles(v), lambda x: F.floor(x / F.when(scale == 0, 1.0).otherwise(scale) + 0.5).cast("int")).alias("q"))


def dequantized(c: Column) -> Column:
    return F.transform(c["q"], lambda x: x * c["scale"])


def sign_bits(v: Column) -> Column:
    """A string of 1 (not negative) and 0."""
    return F.concat_ws("", F.transform(v, lambda x: F.when(x >= 0, "1").otherwise("0")))


def scores(queries: DataFrame, rows: DataFrame, k: int | None = None, per: str | None = None) -> DataFrame:
    """query_id, id, dot for each query (query_id, v) and its k best rows (id, v).

    per: a column of rows; instead of k rows each query gets its best dot for every
    value of it, as query_id, the column and dot. The query's own id is left out.

    Rows are dealt to shards by a hash of their id, and every query is sent to every
    shard. A task holds its shard as a matrix while the queries pass by in batches,
    and hands on k rows (or one a value) a query.
    """
    shards = 1 + rows.count() // SHARD_ROWS
    by = F.col(per).cast("long") if per else F.lit(0).cast("long")
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", by.alias("per"), doubles(F.col("v")).alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.lit(0).cast("long").alias("per"), doubles(F.col("v")).alias("v"))
    dealt = held.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("kind")
    name = per or "id"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        shard = None
        for batch in batches:
            if len(own := batch[batch["kind"] == 0]):
                kept.append(own)
            wanted = batch[batch["kind"] == 1]
            if not kept or not len(wanted):
                continue
            if shard is None:
                shard = _Shard(pd.concat(kept))
            ids, vectors = wanted["id"].to_numpy(), np.stack(wanted["v"].to_list())
            for at in range(0, len(ids), BLOCK):
                found = shard.per_value if per else shard.best
                yield pd.DataFrame(found(ids[at : at + BLOCK], vectors[at : at + BLOCK], k), columns=["query_id", name, "dot"])

    return dealt.mapInPandas(run, f"query_id long, {name} long, dot double")


class _Shard:
    """The rows of one task as a matrix."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("per", kind="stable")
        self.ids, self.per = rows["id"].to_numpy(), rows["per"].to_numpy()
        self.matrix = np.stack(rows["v"].to_list()).T
        self.heads = np.flatnonzero(np.diff(self.per, prepend=self.per[0] - 1))

    def dots(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        dots = vectors @ self.matrix
        dots[ids[:, None] == self.ids] = -np.inf
        return dots

    def best(self, ids: np.ndarray, vectors: np.ndarray, k: int | None) -> list[tuple]:
        found = []
        for query, row in zip(ids, self.dots(ids, vectors), strict=True):
            use = np.flatnonzero(row >= np.partition(row, -k)[-k]) if k is not None and k < len(row) else np.arange(len(row))
            use = use[row[use] > -np.inf]
            found += [(query, self.ids[i], row[i]) for i in use[np.lexsort((self.ids[use], -row[use]))[:k]]]
        return found

    def per_value(self, ids: np.ndarray, vectors: np.ndarray, _: int | None) -> list[tuple]:
        most = np.maximum.reduceat(self.dots(ids, vectors), self.heads, axis=1)
        return [(q, v, d) for q, row in zip(ids, most, strict=True) for v, d in zip(self.per[self.heads], row, strict=True) if d > -np.inf]


def top(found: DataFrame, k: int, value: str = "dot") -> DataFrame:
    """The k best of each query, with their place; ties go to the smaller id."""
    return found.withColumn("place", rank(Window.partitionBy("query_id").orderBy(F.desc(value), "id"))).filter(F.col("place") <= k)


def best_per(found: DataFrame, per: str) -> DataFrame:
    """query_id, per, dot: the best over all shards, of scores() with per."""
    return found.groupBy("query_id", per).agg(F.max("dot").alias("dot"))


def centered(best: DataFrame, value: str = "dot") -> DataFrame:
    """best (a row a query and item) with the value less its query's mean over items."""
    return best.withColumn("centered", F.col(value) - F.avg(value).over(Window.partitionBy("query_id")))


def means(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, mean: each query's mean dot over the other rows, by the rows' sum: one row, whatever their number."""
    sums = rows.select(F.posexplode(doubles(F.col("v"))).alias("at", "x"), F.col("id")).groupBy("at").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = sums.agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"), F.max("n").alias("n"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = queries.select("query_id", doubles(F.col("v")).alias("v")).join(F.broadcast(total))
    own = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("own"))
    q = q.join(own, "query_id", "left")
    less = F.when(F.col("own") == 1, 1).otherwise(0)
    return q.select("query_id", ((dot(F.col("v"), F.col("s.x")) - less * dot(F.col("v"), F.col("v"))) / (F.col("n") - less)).alias("mean"))


def pair_dots(pairs: DataFrame, queries: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """pairs (query_id, id) with the dot of their vectors."""
    both = pairs.join(queries.select("query_id", doubles(F.col("v")).alias("qv")), "query_id").join(rows.select("id", doubles(F.col("v")).alias("rv")), "id")
    return both.withColumn(name, F.aggregate(F.zip_with("qv", "rv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).drop("qv", "rv")


def two_tier(text: DataFrame, glyph: DataFrame, n_text: int = 32, n_glyph: int = 8) -> DataFrame:
    """query_id, id, tier: the best by text, then the best by glyph that aren't among them."""
    a = top(text, n_text).select("query_id", "id", F.lit("text").alias("tier"))
    b = top(glyph.join(a.select("query_id", "id"), ["query_id", "id"], "left_anti"), n_glyph).select("query_id", "id", F.lit("glyph").alias("tier"))
    return a.unionByName(b)


def degenerate(rows: DataFrame, dims: int = 24, owners: int = 4) -> DataFrame:
    """key and how many ids share it: vectors whose first components agree to three decimals."""
    key = F.concat_ws(",", F.transform(F.slice(doubles(F.col("v")), 1, dims), lambda x: F.format_string("%.3f", F.floor(x * 1000 + 0.5) / 1000)))
    return rows.groupBy(key.alias("key")).agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= owners)
