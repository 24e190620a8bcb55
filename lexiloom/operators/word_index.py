"""The stored index of a search: written once, opened by any number of searches.

Items that share a phrase under the same field, weight and packs share one row,
a kind; words lead to kinds, and kinds to items. Items of the very same kinds score
alike whatever the query, so the least of them stands for all, and a search meets
the others only where it places results. Tables are bucketed and sorted
by the key that searches join them on, so a search shuffles its queries only.
A very frequent word's kinds, and a kind's items, lie in blocks of bounded size,
and whoever looks them up asks for each block by number: no hot key meets one
task.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import md5

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import tokens
from lexiloom.operators import lexical as L
from lexiloom.operators.analytics import rank
from lexiloom.sources.tables import kept

#: What a kind is.
KIND = ["phrase", "field_ix", "weight", "mask"]
#: Rows of a block, about.
BLOCK = 65_536
#: The tables and the keys that they are bucketed and sorted by.
KEYS = {"postings": ["token", "block"], "members": ["phrase", "field_ix", "block"], "items": ["item"], "alike": ["item"], "vocabulary": ["token"], "heads": ["qtoken"], "misspellings": ["key"]}


@dataclass(frozen=True)
class WordIndex:
    """The tables of an index.

    postings: token, block, KIND, n_tokens, items; members: KIND, block, item; items: item, KIND, n_tokens, copies (items alike);
    alike: item, member: the items that an item of the other tables stands for, itself included;
    vocabulary: token, mask, idf, blocks; heads: qtoken, token, mask; misspellings: token, key.
    """

    postings: DataFrame
    members: DataFrame
    items: DataFrame
    alike: DataFrame
    vocabulary: DataFrame
    heads: DataFrame
    misspellings: DataFrame


def vocabulary(posts: DataFrame) -> DataFrame:
    """token, idf over items (copies: items that one stands for), and the mask of the packs that hold it."""
    copies = (F.col("copies") if "copies" in posts.columns else F.lit(1).cast("long")).alias("copies")
    by_item = posts.select("token", "item", "mask", copies).groupBy("token", "item").agg(F.bit_or("mask").alias("mask"), F.max("copies").alias("copies"))
    counts = by_item.groupBy("token").agg(F.sum("copies").alias("df"), F.bit_or("mask").alias("mask"))
    items = posts.select("item", copies).distinct().groupBy().agg(F.sum("copies").alias("items"))
    return counts.join(F.broadcast(items)).select("token", "mask", F.log(1 + F.col("items") / F.col("df")).alias("idf"))


def heads(vocab: DataFrame) -> DataFrame:
    """qtoken, token, mask: of each beginning the first words in order that it completes to, itself included."""
    begun = vocab.select("token", "mask", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.left(F.col("token"), n))).alias("qtoken"))
    return begun.withColumn("place", rank(Window.partitionBy("qtoken").orderBy("token"))).filter(F.col("place") <= L.MAX_PREFIX_WORDS).drop("place")


def blocks(rows: Column) -> Column:
    """How many blocks hold so many rows."""
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK)).cast("int")


def block_of(row: Column, rows: Column) -> Column:
    return F.pmod(F.xxhash64(row), blocks(rows)).cast("int")


def in_blocks(df: DataFrame, n_blocks: Column) -> DataFrame:
    """Each row once for each of so many blocks, by number."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))


def grouped(index: DataFrame, label: str = "alike-keys") -> tuple[DataFrame, DataFrame]:
    """(items, alike) of an index: the least of the items of the same kinds, with how many they are, and all of them beside it."""
    one = F.array_sort(F.collect_list(F.struct(*KIND, "n_tokens")))  # an item's phrases: tens
    keys = kept(index.groupBy("item").agg(F.sha2(F.to_json(one), 256).alias("kinds")), label)
    groups = keys.groupBy("kinds").agg(F.min("item").alias("least"), F.count("*").alias("copies"))
    alike = keys.join(groups, "kinds").select(F.col("least").alias("item"), F.col("item").alias("member"))
    return index.select("item", *KIND, "n_tokens").join(groups.select(F.col("least").alias("item"), "copies"), "item"), alike


def _tables(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, postings without blocks, vocabulary) of items with their kinds."""
    kinds = items.groupBy(*KIND, "n_tokens").agg(F.count("*").alias("items"))
    members = items.join(kinds.drop("n_tokens"), KIND).select(*KIND, block_of(F.col("item"), F.col("items")).alias("block"), "item")
    posts = kinds.withColumn("token", F.explode(F.array_distinct(tokens(F.col("phrase")))))
    sizes = posts.groupBy("token").agg(blocks(F.count("*")).alias("blocks"))
    words = vocabulary(items.select("item", "mask", "copies", F.explode(tokens(F.col("phrase"))).alias("token")))
    return members, posts, words.join(sizes, "token").select("token", "mask", "idf", "blocks")


def _dealt(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """The postings, each word's in its blocks."""
    block = F.pmod(F.xxhash64("phrase"), "blocks").cast("int")
    return posts.join(vocab.select("token", "blocks"), "token").select("token", block.alias("block"), *KIND, "n_tokens", "items")


def _at_once(spark: SparkSession, write: Callable[[str, DataFrame], DataFrame], **tables: DataFrame) -> dict[str, DataFrame]:
    """Write tables that don't need one another at the same time."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return dict(zip(tables, pool.map(inheritable_thread_target(spark)(write), *zip(*tables.items(), strict=True)), strict=True))


def stored(index: DataFrame, path: str, buckets: int | None = None) -> WordIndex:
    """Write the tables of an index (item, KIND, n_tokens) under a path, for this search and others."""
    spark = index.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(name: str, df: DataFrame) -> DataFrame:
        df.repartition(buckets, KEYS[name][0]).write.bucketBy(buckets, KEYS[name][0]).sortBy(*KEYS[name]).option("path", f"{path}/{name}").saveAsTable(table := _table(path, name))
        return spark.table(table)

    first = _at_once(spark, write, **dict(zip(("items", "alike"), grouped(index), strict=True)))
    items = first["items"]
    members, posts, vocab = _tables(items)
    first |= _at_once(spark, write, members=members, vocabulary=vocab)
    vocab = first["vocabulary"]
    rest = _at_once(spark, write, postings=_dealt(posts, vocab), heads=heads(vocab), misspellings=L.misspelling_keys(vocab))
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/about")  # last: an index without it isn't whole
    return WordIndex(**first, **rest)


def prepared(index: DataFrame) -> WordIndex:
    """The tables of an index for one search alone: only what it reads several times is written."""
    items, alike = grouped(kept(index.select("item", *KIND, "n_tokens"), "index"))
    items = kept(items, "items")
    members, posts, vocab = _tables(items)
    vocab = kept(vocab, "vocabulary")
    return WordIndex(_dealt(posts, vocab), members, items, alike, vocab, heads(vocab), L.misspelling_keys(vocab))


def _table(path: str, name: str) -> str:
    return f"word_index_{md5(path.encode()).hexdigest()}_{name}"


def opened(spark: SparkSession, path: str) -> WordIndex:
    """The index that stored() has written under this path, in this session or an earlier one."""

    buckets = spark.read.parquet(f"{path}/about").first().buckets

    def table(name: str) -> DataFrame:
        if not spark.catalog.tableExists(known := _table(path, name)):
            columns = spark.read.parquet(f"{path}/{name}").schema.toDDL()
            spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY ({KEYS[name][0]}) SORTED BY ({', '.join(KEYS[name])}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        return spark.table(known)

    return WordIndex(**{name: table(name) for name in KEYS})
