"""K-d tree sharding at distributed weighted medians, DataFrame operations only.

A cell of the tree is split along its widest metadata dimension (widths in
units of the whole table's range) where the bytes to its left reach the share
of its left leaves, until every cell holds one shard's target bytes. A split is
found by two sums: of bytes by 4096 slices of the cell's range, then, inside
the slice that holds the median, by 4096 slices of a hash of the row. Ties and
groups of equal rows are thereby divided and never land in one task; only one
row a cell, at most the number of shards, comes back to the driver.

Defined results: a null text has no bytes (size 16, crc32 0) and null metadata
lie at the low end of their dimension; repeated rows are rows of their own;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import written

SLICES = 4096
#: Added to the UTF-8 bytes of each text.
OVERHEAD = 16
#: Rows numbered by one window group.
ROWS_A_BLOCK = 50_000


@dataclass
class Level:
    """The splits of one depth, by cell; a cell is named by its first shard. Closed cells keep all rows."""

    depth: int
    dim: list[int]
    low: list[float]
    scale: list[float]
    at: list[int]
    cut: list[int]
    half: list[int]

    @staticmethod
    def of(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cell"))

    def sliced(self, rows: DataFrame) -> DataFrame:
        """rows with at, the slice of its cell that a row lies in, and tie, the row's hash at this depth."""
        at = F.floor((F.get("dims", self.of(self.dim, "int")) - self.of(self.low, "double")) * self.of(self.scale, "double"))
        return rows.withColumns({"at": F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), at)).cast("int"), "tie": F.pmod(F.xxhash64("row", F.lit(self.depth)), F.lit(SLICES)).cast("int")})

    def split(self, rows: DataFrame) -> DataFrame:
        at, cut, half = (self.of(x, "int") for x in (self.at, self.cut, self.half))
        left = (F.col("at") < at) | ((F.col("at") == at) & (F.col("tie") < cut))
        return self.sliced(rows).withColumn("cell", F.when(left, F.col("cell")).otherwise(F.col("cell") + half)).drop("at", "tie")


def _reached(sums: DataFrame, goal: dict[int, float], shards: int) -> dict[int, tuple[int, float, float]]:
    """By cell: the value of `at` where the running bytes reach the goal, the bytes before it, and its bytes."""
    run = sums.withColumn("upto", F.sum("bytes").over(Window.partitionBy("cell").orderBy("at"))).withColumn("goal", Level.of([goal.get(c, -1.0) for c in range(shards)], "double"))
    hit = run.filter((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("bytes") < F.col("goal")))
    return {r["cell"]: (r["at"], r["upto"] - r["bytes"], r["bytes"]) for r in hit.collect()}


def grow(rows: DataFrame, shards: int, n_dims: int) -> DataFrame:
    """rows (row, size, dims) with cell, the leaf of the tree that each lies in; one leaf a shard.

    Each level's cells are a written table, so that no plan holds more than one level.
    """
    ends = rows.agg(F.sum("size"), *[f(F.col("dims")[k]) for k in range(n_dims) for f in (F.min, F.max)]).first()
    at_cell = rows.withColumn("cell", F.lit(0))
    if ends[0] is None:
        return at_cell
    whole = [(ends[1 + 2 * k], ends[2 + 2 * k]) for k in range(n_dims)]
    width = [max(high - low, 1e-12) for low, high in whole]
    leaves, held, box = {0: shards}, {0: ends[0]}, {0: list(whole)}
    depth = 0
    while any(n > 1 for n in leaves.values()):
        here = Level(depth, *([0] * shards for _ in range(6)))
        here.at = [SLICES] * shards
        goal = {c: held[c] * (n // 2) / n for c, n in leaves.items() if n > 1}
        for c in goal:
            here.dim[c] = max(range(n_dims), key=lambda k: (box[c][k][1] - box[c][k][0]) / width[k])  # noqa: B023
            here.low[c], high = box[c][here.dim[c]]
            here.scale[c] = SLICES / (high - here.low[c]) if high > here.low[c] else 0.0
        opened = here.sliced(at_cell).filter(F.col("cell").isin(list(goal)))
        at = _reached(opened.groupBy("cell", "at").agg(F.sum("size").alias("bytes")), goal, shards)
        median = Level.of([at[c][0] if c in at else -1 for c in range(shards)], "int")
        ties = opened.filter(F.col("at") == median).groupBy("cell", F.col("tie").alias("at")).agg(F.sum("size").alias("bytes"))
        tie = _reached(ties, {c: goal[c] - before for c, (_, before, _) in at.items()}, shards)
        for c in goal:
            slice_, before, _ = at.get(c, (0, 0, 0))
            cut, tied, last = tie.get(c, (0, 0, 0))
            over = goal[c] - before - tied > last / 2  # the rows at the cut go to the nearer side
            half, left = leaves[c] // 2, before + tied + (last if over else 0)
            here.at[c], here.cut[c], here.half[c] = slice_, cut + over, half
            k, (low, high) = here.dim[c], box[c][here.dim[c]]
            step = (high - low) / SLICES
            box[c + half] = [*box[c]]
            box[c][k], box[c + half][k] = (low, min(high, low + step * (slice_ + 1))), (low + step * slice_, high)
            held[c + half], held[c] = held[c] - left, left
            leaves[c + half], leaves[c] = leaves[c] - half, half
        at_cell, depth = written(here.split(at_cell), "kd-level"), depth + 1
    return at_cell


def shard(df: DataFrame, dims: dict[str, Column], shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) for each row.

    dims: named numeric columns of df, the metadata dimensions. The tree is
    computed at once, over a written table of sizes and dimensions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        df.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.array(*[F.nanvl(c.cast("double"), F.lit(None)) for c in dims.values()]).alias("dims"),
        ).withColumn("row", F.struct("doc_id", "text_crc32", F.monotonically_increasing_id())),
        "shard-rows",
    )
    low = rows.agg(*[F.min(F.col("dims")[k]) for k in range(len(dims))]).first()
    rows = rows.withColumn("dims", F.array(*[F.coalesce(F.col("dims")[k], F.lit(low[k] or 0.0)) for k in range(len(dims))]))
    placed = grow(rows, shards, len(dims)).select("doc_id", "row", "size", "text_crc32", F.col("cell").alias("shard"))
    return with_slots(placed, "shard", F.xxhash64("row"), [F.col("doc_id"), F.col("row")]).select("doc_id", "size", "text_crc32", "shard", "slot")


def with_slots(df: DataFrame, group: str, spread: Column, order: list[Column]) -> DataFrame:
    """slot: a number of each row in its group, gapless from 0, without a task that sorts a whole group.

    Rows are numbered inside blocks of a hash; the blocks' counts give each block's first number.
    """
    blocks = 1 + df.count() // ROWS_A_BLOCK
    dealt = df.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(group, "block").count()
    first = counts.select(group, "block", (F.sum("count").over(Window.partitionBy(group).orderBy("block")) - F.col("count")).alias("before"))
    numbered = dealt.withColumn("in_block", F.row_number().over(Window.partitionBy(group, "block").orderBy(*order)) - 1)
    return numbered.join(first, [group, "block"]).withColumn("slot", (F.col("before") + F.col("in_block")).cast("long")).drop("block", "before", "in_block")


def document_dims(df: DataFrame) -> dict[str, Column]:
    """The metadata dimensions of the documents table; the text is read for its size alone."""
    code = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    return {"log_bytes": F.log1p(F.octet_length(F.coalesce(F.col("text"), F.lit("")))), "doc_id": F.col("doc_id"), "source": code("source", 1009), "lang": code("lang", 101)}
