"""Exact vector search over codes: sign bits first, then 8-bit numbers, the vectors themselves for what is left.

A row is stored as its signs, its 8-bit numbers with their scale, its length and
the length of what the numbers leave out: an eighth of the doubles. Both codes
bound a dot from above. Parts of unlike sign only lower it, so it is at most |v|
times the length of the query's parts of like sign, which a product of matrices
adds up for a block of queries. And the dot of
the numbers is off by |q| times the row's slack and the query's slack times the
length of the row's numbers at most. The k best lower bounds met so far prove
which rows can still be among the k; only theirs are computed further, so the
answer is that of a search over the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators import vectors as V
from lexiloom.operators.analytics import rank
from lexiloom.sources.tables import kept

#: Rows of a shard, and times k: rows of most like signs, whose lower bounds are met first.
SHARD_ROWS, FIRST = 262_144, 8
#: Rows of a shard at least, where it is made for a task that could run at once.
LEAST_ROWS = 16_384
#: Room for rounding in a bound, as a share of both lengths.
ROUNDING = 1e-9
#: Numbers of a block's matrix (queries times rows), and the share of rows from which all numbers of a block are multiplied at once.
CELLS, MANY = 1 << 23, 1 / 16


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def coded(rows: DataFrame) -> DataFrame:
    """id, signs, numbers, scale, length, slack of rows (id, v). Rows without a vector, or with null or non-finite parts, go."""
    v = V.doubles(F.col("v"))
    fine = F.col("v").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    c = rows.filter(fine & (F.size("v") > 0)).select("id", v.alias("v")).withColumn("c", V.quantized(F.col("v")))
    left_out = F.zip_with("v", V.dequantized(F.col("c")), lambda x, y: x - y)
    return c.select("id", V.sign_bits(F.col("v")).alias("signs"), F.transform("c.q", lambda x: x.cast("tinyint")).alias("numbers"), F.col("c.scale").alias("scale"), _length(F.col("v")).alias("length"), _length(left_out).alias("slack"))


class _Codes:
    """Coded rows of one task as arrays."""

    def __init__(self, rows: pd.DataFrame):
        self.ids = rows["id"].to_numpy()
        self.signs = np.frombuffer("".join(rows["signs"]).encode(), np.uint8).reshape(len(rows), -1).astype(np.float32) * 2 - 97
        self.numbers = np.stack(rows["numbers"].to_list()).astype(np.float32 if self.signs.shape[1] <= 1024 else float)  # sums of products stay exact
        self.scale, self.length, self.slack = (rows[c].to_numpy(float) for c in ("scale", "length", "slack"))

    def bounds(self, at: np.ndarray, q: _Codes, k: int, dots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the dots of rows with query k, by the 8-bit numbers (dots: their products, if known)."""
        dots = (self.numbers[at] @ q.numbers[k] if dots is None else dots[at]).astype(float)
        middle = dots * self.scale[at] * q.scale[k]
        off = q.length[k] * self.slack[at] + q.slack[k] * (self.length[at] + self.slack[at]) + ROUNDING * q.length[k] * self.length[at]
        return middle - off, middle + off

    def found(self, q: _Codes, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each query its number, the rows that can be among its `most` best, their bounds, and how many rows' numbers were read."""
        size = max(1, CELLS // len(self.ids))
        for first in range(0, len(q.ids), size):
            block = slice(first, first + size)
            parts = (np.abs(q.numbers[block].astype(float)) + 0.5) ** 2  # at least the squares of the query's parts, in units of its scale
            total = parts.sum(axis=1)
            # single precision: what it can be off by is added
            like = ((parts * q.signs[block]).astype(np.float32) @ self.signs.T + total[:, None].astype(np.float32)) / 2
            like += (total * (parts.shape[1] + 2) * 2.4e-7).astype(np.float32)[:, None]
            upper = np.sqrt(np.maximum(like, 0), out=like) * (self.length * (1 + 1e-6))
            left, firsts = [], []
            for row, k in zip(upper, range(first, first + len(parts)), strict=True):
                row *= q.scale[k]
                row += ROUNDING * q.length[k] * self.length
                row[self.ids == q.ids[k]] = -np.inf
                best = np.argpartition(row, -FIRST * most)[-FIRST * most :] if FIRST * most < len(row) else np.arange(len(row))
                best = best[row[best] > -np.inf]
                least = np.partition(self.bounds(best, q, k)[0], -most)[-most] if len(best) >= most else -np.inf
                firsts.append(least)
                left.append(np.flatnonzero((row >= least) & (row > -np.inf)))
            dense = sum(map(len, left)) > MANY * len(left) * len(self.ids)
            dots = q.numbers[block] @ self.numbers.T if dense else [None] * len(left)
            for i, (use, least) in enumerate(zip(left, firsts, strict=True)):
                low, high = self.bounds(use, q, first + i, dots[i])
                if len(use) >= most:
                    least = max(least, np.partition(low, -most)[-most])
                near = high >= least
                yield first + i, use[near], low[near], high[near], len(use)


def candidates(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, id, low, high, read: rows of coded() that a shard can't rule out for a query (coded(), by query_id); read: the shard's rows whose numbers were needed.

    Rows are dealt to shards by a hash of their id, and every query passes by every shard, as in vectors.scores().
    """
    count = rows.count()
    shards = max(1 + count // SHARD_ROWS, min(rows.sparkSession.sparkContext.defaultParallelism, count // LEAST_ROWS))
    columns = ["signs", "numbers", "scale", "length", "slack"]
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", *columns)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), *columns)
    dealt = held.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        shard = None
        for batch in batches:
            if len(own := batch[batch["kind"] == 0]):
                waiting.append(own)
            wanted = batch[batch["kind"] == 1]
            if not waiting or not len(wanted):
                continue
            if shard is None:
                shard = _Codes(pd.concat(waiting))
            q = _Codes(wanted)
            for at, use, low, high, read in shard.found(q, k):
                yield pd.DataFrame({"query_id": q.ids[at], "id": shard.ids[use], "low": low, "high": high, "read": read})

    return dealt.mapInPandas(run, "query_id long, id long, low double, high double, read long")


def nearest(queries: DataFrame, rows: DataFrame, k: int, codes: DataFrame | None = None) -> DataFrame:
    """query_id, id, dot, place: the k rows (id, v) of largest dot with each query (query_id, v), itself left out; ties go to the smaller id.

    codes: coded(rows), where they are stored.
    """
    asked = kept(coded(queries.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id"), "query-codes")
    found = kept(candidates(asked, kept(coded(rows), "codes") if codes is None else codes, k), "code-candidates")
    last = rank(Window.partitionBy("query_id").orderBy(F.desc("low")))
    least = found.withColumn("n", last).filter(F.col("n") == k).select("query_id", F.col("low").alias("least"))
    left = found.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query_id", "id")
    return V.top(V.pair_dots(left, queries, rows, "dot"), k)
