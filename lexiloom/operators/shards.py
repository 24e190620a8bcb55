"""Precomputed answers: which queries get one, building, splitting by prefix, storing, looking up and pruning."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import normalized, privacy_reason
from lexiloom.operators import analytics as A
from lexiloom.operators import curation as C

#: The count of a pinned query, most rows of a stored answer, and its scores' unit.
PINNED, MOST_ROWS, UNIT = 1_000_000_000, 63, 1000
#: The parameters of the hash and of the generator that stand in for a model in tests.
FNV_BASIS, FNV_PRIME, STEP = 0x811C9DC5, 0x01000193, 0x6D2B79F5


def fixed_points(df: DataFrame, q: str = "q") -> DataFrame:
    """The rows whose query is its own normal form."""
    return df.filter(F.col(q) == normalized()(F.col(q)))


def candidates(log: DataFrame, account: Column, first: str, last: str, blocked: list[str], limit: int | None = None) -> DataFrame:
    """locale, q, n: queries of a window that enough accounts searched, in normal form and without private text, most searched first where there is a limit."""
    found = A.k_anonymous(A.between(log, first, last), account, ["locale", "query"]).select("locale", F.col("query").alias("q"), F.col("searches").alias("n"))
    safe = fixed_points(found.filter(privacy_reason(F.col("q"), blocked).isNull()))
    return safe if limit is None else safe.orderBy(F.desc("n"), "locale", "q").limit(limit)


def merged_log(rows: DataFrame, blocked: list[str], least: float = 1.0, limit: int | None = None) -> DataFrame:
    """q, n, locales of raw logs (q, n, locale): normal forms, without private text, summed; those with enough searches."""
    safe = rows.filter(privacy_reason(F.col("q"), blocked).isNull()).withColumn("q", normalized()(F.col("q"))).filter("q <> ''")
    sums = safe.groupBy("q").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("locale")).alias("locales")).filter(F.col("n") >= least)
    return sums if limit is None else sums.orderBy(F.desc("n"), "q").limit(limit)


def bootstrap(aliases: DataFrame, moods: list[str], nouns: DataFrame) -> DataFrame:
    """q, n: made-up queries: aliases (q, rank from 1: earlier ones count more) and a noun (q) with each mood."""
    own = aliases.select("q", (1 + F.floor(100 / F.col("rank"))).cast("long").alias("n"))
    made = nouns.select(F.explode(F.array(*map(F.lit, moods))).alias("mood"), "q").select(F.concat_ws(" ", "mood", "q").alias("q"), F.lit(1).cast("long").alias("n"))
    return own.unionByName(made).groupBy("q").agg(F.max("n").alias("n"))


def with_pinned(queries: DataFrame, pinned: DataFrame) -> DataFrame:
    """q, n: queries and curated ones, which count as searched more than any."""
    return queries.unionByName(pinned.select("q", F.lit(PINNED).cast("long").alias("n"))).groupBy("q").agg(F.max("n").alias("n"))


def budgeted(new: DataFrame, most: int) -> DataFrame:
    """The most searched new queries over all locales that a run may resolve."""
    return new.orderBy(F.desc("n"), "locale", "q").limit(most)


def unresolved(queries: DataFrame, sure: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, new): queries that the dictionary isn't sure of (sure: q), with a stored answer (q, answer) or without."""
    asked = queries.join(sure.select("q"), "q", "left_anti")
    return asked.join(stored, "q"), asked.join(stored.select("q"), "q", "left_anti")


def compact(results: DataFrame) -> DataFrame:
    """q, answer: the first results (q, place, item, score) of each query as arrays of id and score in thousandths."""
    rows = results.filter(F.col("place") <= MOST_ROWS).select("q", "place", F.struct("item", F.floor(F.col("score") * UNIT + 0.5).cast("int").alias("s")).alias("r"))
    return rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "r")))["r"].alias("answer"))


def expanded(answers: DataFrame) -> DataFrame:
    """q, place, item, score of compact() rows."""
    return answers.select("q", F.posexplode("answer").alias("at", "r")).select("q", (F.col("at") + 1).alias("place"), "r.item", (F.col("r.s") / UNIT).alias("score"))


def build(queries: DataFrame, sure: DataFrame, stored: DataFrame, resolve, budget: int) -> DataFrame:
    """shard_key, q, answer: queries the dictionary is unsure of, with a stored or a new answer, dealt to prefixes within a budget of bytes.

    resolve: a function of new queries (q, ...) to results (q, place, item, score).
    """
    reused, new = unresolved(queries, sure, stored)
    answers = reused.select("q", "answer").unionByName(compact(resolve(new)))
    sizes = answers.select("q", F.octet_length(F.to_json(F.struct("q", "answer"))).cast("long").alias("bytes"))
    return C.split_keys(sizes, budget).join(answers, "q")


def looked_up(asked: DataFrame, *layers: DataFrame) -> DataFrame:
    """q, answer, layer: the answer of the first layer (shard_key, q, answer) that has the query in the shard of its longest key; null without one."""
    found = []
    for i, rows in enumerate(layers):
        at = C.longest_prefix(asked, rows.select("shard_key").distinct())
        found.append(at.join(rows, ["q", "shard_key"]).select("q", "answer", F.lit(i).alias("layer")))
    best = reduce(DataFrame.unionByName, found).groupBy("q").agg(F.min_by(F.struct("answer", "layer"), "layer").alias("r")).select("q", "r.*")
    return asked.select("q").distinct().join(best, "q", "left")


def _hash(text: str) -> int:
    h = FNV_BASIS
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h


def _draws(seed: int, n: int) -> list[float]:
    """n numbers between 0 and 1 of a 32-bit generator."""
    out = []
    for _ in range(n):
        seed = seed + STEP & 0xFFFFFFFF
        t = (seed ^ seed >> 15) * (seed | 1) & 0xFFFFFFFF
        t ^= t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
        out.append((t ^ t >> 14) / 2**32)
    return out


def fake_results(queries: DataFrame, items: int, n: int = 8) -> DataFrame:
    """q, place, item, score: results drawn by a hash of the query, the same wherever they are drawn; each item of 0 .. items - 1 once."""

    @F.pandas_udf("array<struct<item:long,score:double>>")
    def draw(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            seen: dict[int, float] = {}
            for x in _draws(_hash(text), 8 * n):
                if len(seen) < min(n, items):
                    seen.setdefault(int(x * items), 0.0)
            out.append([{"item": i, "score": round(1 - at / (n + 1), 3)} for at, i in enumerate(seen)])
        return pd.Series(out)

    rows = queries.select("q", F.posexplode(draw("q")).alias("at", "r"))
    return rows.select("q", (F.col("at") + 1).alias("place"), "r.item", "r.score")


