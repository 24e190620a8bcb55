"""Approximate nearest neighbours by collision counting over single projections.

The vectors, scaled to length one, are dealt to shards by a hash of their id.
Each shard keeps, for each of `projections` random directions, its vectors
sorted by their projection on it. A query's window in every array is centred on
the query's own projection and grows by virtual rehashing: the radius is
multiplied, and only the newly covered ends are counted. Vectors that fell in
at least a threshold of the windows are verified by their exact cosine. A
query is done in a shard when k verified vectors lie within the radius that its
windows stand for, or all vectors were verified. The shards' verified best are
merged by a window over each query's few rows.

Every query is sent to every shard. A task receives a shard's vectors first,
builds its arrays once and lets the queries pass by in Arrow batches, so it holds
no more than a shard and a batch. Where queries are very many, a shard stands in
several tasks of at most `PASSING` queries each.

Vectors are scaled by their largest component before they are squared, so huge
and tiny components keep their direction.

Defined results: vectors that are null, empty, zero, or have null or non-finite
components take no part, neither as queries nor as candidates, and so do rows
with a null id and vectors of another length than most (the largest count, then
the larger length); repeated ids are candidates of their own; ties go to the
smaller id; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import written

PROJECTIONS = 48
#: The share of the windows that a vector must fall in to be verified.
THRESHOLD = 0.6
#: Half the first window, in standard deviations of a projection's values, and its growth.
START, GROWTH = 0.4, 1.3
#: Windows are wider by this than a vector at the radius needs to meet the threshold half the time, so that most meet it.
MARGIN = 1.2
#: Vectors of a shard, and queries that pass by one task.
SHARD_ROWS, PASSING = 16_384, 65_536
SEED = 20_011


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the vectors that take part, in double precision."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def directions(dims: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, projections))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over a power of two near their largest component, which is exact, and the norms of these."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    if (tame := (largest > 1e-100) & (largest < 1e100)).all():
        small = vectors
    else:
        small = np.where(tame, vectors, np.ldexp(vectors, -np.frexp(largest)[1]))
    return small, np.sqrt(np.einsum("ij,ij->i", small, small))


class Shard:
    """Sorted projection arrays over some unit vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.vectors, self.norms = scaled(vectors)
        self.unit = self.vectors / self.norms[:, None]
        self.axes = directions(vectors.shape[1])
        values = self.unit @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(values, axis=0).T.copy()

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (cosine, id) found, best first, without the query's own id."""
        query, norm = (x[0] for x in scaled(query[None]))
        unit = query / norm
        centre, m = unit @ self.axes, len(self.sorted)
        need = int(np.ceil(THRESHOLD * m))
        count = np.zeros(len(self.ids), np.int32)
        seen = np.zeros(len(self.ids), bool)
        score = np.full(len(self.ids), -np.inf)
        low = np.array([np.searchsorted(a, c) for a, c in zip(self.sorted, centre, strict=True)])
        high, own, radius = low.copy(), self.ids == query_id, START
        others = len(self.ids) - int(own.sum())
        while True:
            half = radius
            new: list[np.ndarray] = []
            for p in range(m):
                i, j = np.searchsorted(self.sorted[p], (centre[p] - half, centre[p] + half))
                i, j = min(i, low[p]), max(j, high[p])
                new += [self.order[p, i : low[p]], self.order[p, high[p] : j]]
                low[p], high[p] = i, j
            count += np.bincount(np.concatenate(new), minlength=len(count)).astype(np.int32)
            fresh = np.flatnonzero((count >= need) & ~seen & ~own)
            seen[fresh] = True
            score[fresh] = self.vectors[fresh] @ query / (self.norms[fresh] * norm)
            done = int(seen.sum())
            if done >= min(k, others):
                kth = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
                # a projection of a difference of length d has standard deviation d: windows of this radius stand for d
                reach = radius / (0.8416 * MARGIN)  # the half width that holds THRESHOLD of a normal distribution
                if done == others or 2 - 2 * kth <= reach * reach or others == 0:
                    break
            if done == others:
                break
            radius *= GROWTH
        at = np.lexsort((self.ids, -score))[:k]
        return [(float(score[i]), int(self.ids[i])) for i in at if score[i] > -np.inf]


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest vectors by cosine, found approximately.

    is_query: a condition on vec_id.
    """
    rows = written(usable(df, id_col, vector_col), "vectors")
    shards = 1 + rows.count() // SHARD_ROWS
    passes = 1 + rows.filter(is_query).count() // PASSING
    number = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(number(shards, 1).alias("shard"), each(passes).alias("pass"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = rows.filter(is_query).select(each(shards).alias("shard"), number(passes, 2).alias("pass"), F.lit(1).alias("kind"), "vec_id", "v")
    task = F.col("shard") * passes + F.col("pass")
    dealt = candidates.union(queries).select(task.cast("int").alias("task"), "kind", "vec_id", "v").repartitionById(shards * passes, "task").sortWithinPartitions("kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        shard = None
        for batch in batches:
            kind, ids, v = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            vectors = v.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.empty((0, 0))
            if (own := kind == 0).any():
                kept.append((ids[own], vectors[own]))
            found: list[tuple[int, int, float]] = []
            if kept and not own.all():
                shard = shard or Shard(*map(np.concatenate, zip(*kept, strict=True)))
                for query_id, query in zip(ids[~own], vectors[~own], strict=True):
                    found += [(int(query_id), i, s) for s, i in shard.search(query_id, query, k)]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    local = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
