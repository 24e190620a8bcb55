"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys with more than this share of the rows are joined by broadcast; at most 1 / HOT_SHARE keys can have so many.
HOT_SHARE = 0.001
#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of consecutive rows of about `limit` bytes, or one row if that is larger."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right"))
        yield batch.slice(at, max(end, at + 1) - at)
        at = max(end, at + 1)


def map_batches(df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with a function of a batch whose texts are bounded in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit):
                if (out := work(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[str | None], bool]) -> DataFrame:
    """The rows of df whose text is to be kept, with all their columns and without a shuffle."""
    at = df.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([keep(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(df, df.schema, work)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts split at ASCII white space: (bounds, codes, words).

    The words of text i are words[codes[bounds[i]:bounds[i + 1]]]; words are distinct, and
    one of them may be empty. A null text has none or the empty word.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """The keys with more than HOT_SHARE of the rows of left, a written table; at most 1 / HOT_SHARE of them."""
    total = left.count()
    return written(left.groupBy(key).count().filter(F.col("count") > total * HOT_SHARE).select(key), "hot-keys")


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left join right on one key, where right has one row a key and left may have hot keys.

    The hot keys' rows of right are broadcast; the rest is a plain shuffled join.
    left should be a written table, as it is read several times; hot, its hot
    keys, can be given where one table is joined again and again.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, key, how)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return rest.unionByName(left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, how))
