"""Results of writes: upserts, guarded inserts, retention, deletes, and look-ups of child rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.analytics import rank


def additive_upsert(table: DataFrame, delta: DataFrame, keys: list[str], owners: DataFrame, owner: str) -> DataFrame:
    """table with the counts of delta added; delta rows whose owner is unknown are left out."""
    known = delta.join(owners.select(owner).distinct(), owner, "left_semi")
    return table.unionByName(known).groupBy(*keys).agg(F.sum("count").alias("count"))


def last_writer_wins(rows: DataFrame, key: str, at: list[str], sticky: list[str]) -> DataFrame:
    """The latest row of each key; sticky columns keep their latest value that isn't null."""
    order = F.struct(*at)
    latest = F.max_by(F.struct(*[c for c in rows.columns if c not in (key, *sticky)]), order).alias("r")
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in sticky]
    return rows.groupBy(key).agg(latest, *kept).select(key, "r.*", *sticky)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


def quota_guarded(old: DataFrame, new: DataFrame, owner: str, order: list[str], quota: int) -> DataFrame:
    """The new rows that fit in their owner's quota beside the old ones, in order."""
    held = old.groupBy(owner).agg(F.count("*").alias("held"))
    placed = new.withColumn("place", rank(Window.partitionBy(owner).orderBy(*order)))
    return placed.join(held, owner, "left").filter(F.col("place") + F.coalesce("held", F.lit(0)) <= quota).drop("place", "held")


def replace_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Write partitions by day; a rerun replaces the days that it holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retained(log: DataFrame, plans: DataFrame, key: str, cutoffs: dict[str, str], orphans: str) -> DataFrame:
    """Rows on or after their plan's first day; rows without a plan have the orphans' one."""
    cutoff = F.lit(orphans)
    for plan, first in cutoffs.items():
        cutoff = F.when(F.col("plan") == plan, F.lit(first)).otherwise(cutoff)
    return log.join(plans.select(key, "plan"), key, "left").filter(F.col("day") >= cutoff).drop("plan")


def keep_last(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", rank(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= n).drop("place")


def without_owners(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A cascade of a delete: rows whose owner isn't gone."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """parents with columns of their latest child, or nulls. Children are reduced to one a parent before the join."""
    last = children.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")
    return parents.join(last, key, "left")


def child_counts(parents: DataFrame, children: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """parents with the number of their children, in all and by kind, and whether there are any."""
    counts = children.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()])
    names = ["n", *(f"n_{k}" for k in kinds)]
    return parents.join(counts, key, "left").fillna(0, names).withColumn("has_any", F.col("n") > 0)


def overriding(df: DataFrame, key: str, priority: list[Column]) -> DataFrame:
    """One row a key, the first by priority: a tenant's row hides the application's."""
    return keep_last(df, key, priority, 1)


def page_after(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The next rows by key after the cursor, one more than a page so that its reader sees whether more follow."""
    return df.filter(F.col(key) > cursor).orderBy(key).limit(size + 1)


def union_first(*layers: DataFrame, key: list[str]) -> DataFrame:
    """All layers' rows, the first layer's where a key is in several; with `layer`, from 0."""
    rows = None
    for k, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    value = [c for c in rows.columns if c not in (*key, "layer")]
    return rows.groupBy(*key).agg(F.min_by(F.struct("layer", *value), F.struct("layer", *value)).alias("r")).select(*key, "r.*")


def active_on(day: Column, first: str, last: str) -> Column:
    """Whether the month and day of a date lie in a yearly window, which may span the year's end."""
    md = F.date_format(day, "MM-dd")
    return md.between(first, last) if first <= last else (md >= first) | (md <= last)


def in_scope(region: Column, regions: list[str], excepted: list[str]) -> Column:
    """Whether a region is listed, or all are by `*`, and it isn't excepted."""
    return (F.lit("*" in regions) | region.isin(regions)) & ~region.isin(excepted)
