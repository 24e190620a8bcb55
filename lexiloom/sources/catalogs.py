"""Readers and writers of catalogs, logs, evaluation sets, overlays and vectors, with their checks.

A reader fails on bad input and says which: rules are counted in one pass over the
table, and a few offending rows are named.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

#: The format of a pack, its phrase columns and weights' fields, and the head of a vector file.
PACK_FORMAT, PACK_VERSION = "lexicon-pack", 1
PHRASES = ["label", "shortcode", "keyword", "alias", "typo", "low"]
PACK = "format string, formatVersion int, locale string, part string, groups array<string>, popularity array<int>, rows array<struct<glyph:string,item:string,group:int,version:double,skins:int,label:string,shortcode:string,keyword:string,alias:string,typo:string,low:string>>"
MAGIC, PACK_BYTES, CORE_ALIASES = b"VEC1", 200_000, 16
#: Fixed value: asks zlib for gzip's format with the largest window.
GZIP_WINDOW = 31
#: Most splits of text files whose first line numbers are broadcast.
SPLITS = 65_536


class BadInput(ValueError):
    """Input that breaks a rule; the message names the rule and some of the rows."""


def checked(df: DataFrame, where: list[str], **rules: Column) -> DataFrame:
    """df, if no row breaks a rule (a condition that bad rows meet, or null); otherwise BadInput with the first rows, by the columns `where`."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name.replace("_", " "))) for name, test in rules.items()]))
    bad = df.select(*where, broken.alias("broken")).filter(F.size("broken") > 0).orderBy(*where).limit(5).collect()
    if bad:
        raise BadInput("; ".join(f"{', '.join(f'{c} {r[c]}' for c in where)}: {', '.join(r['broken'])}" for r in bad))
    return df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1) and value of each line of text files; a \\r before the line's end isn't part of it.

    Files are read in splits, so a large one is read by many tasks. A line's place
    within its split comes from the order of the scan, and a split's first number
    is the running sum of the lines of the splits before it. The scan is written
    once, as a second one may cut files elsewhere when executors come and go. The
    sums have a row a split; they are broadcast up to SPLITS, and joined beyond.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    rows = kept(scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"), "value"), "lines")
    splits = rows.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = kept(splits.select("file", "begin", (before - F.col("first") + 1).alias("shift")), "splits")
    numbered = rows.join(F.broadcast(shifts) if shifts.count() <= SPLITS else shifts, ["file", "begin"])
    return numbered.select("file", (F.col("at") + F.col("shift")).alias("number"), F.regexp_replace("value", "\r$", "").alias("value"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """rows with `twice`: whether their key stands more than once. Keys are counted by themselves, so no task holds all rows of one."""
    more = rows.groupBy(F.col(key).alias("key_again")).agg(F.count("*").alias("n")).filter("n > 1").select("key_again", F.lit(True).alias("twice"))
    return rows.join(more, F.col(key) == F.col("key_again"), "left").drop("key_again").withColumn("twice", F.coalesce("twice", F.lit(False)))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """pack, locale, part, item, glyph, grp, popularity and the phrase columns: packs, a JSON object a line, checked and exploded."""
    packs = spark.read.schema(PACK).option("mode", "FAILFAST").json(path)
    wrong = {"wrong_format": F.col("format") != PACK_FORMAT, "unknown_version": F.col("formatVersion") > PACK_VERSION, "popularity_of_other_length": F.when(F.col("popularity").isNull(), False).otherwise(F.size("popularity") != F.size("rows"))}
    packs = checked(packs, ["locale", "part"], **wrong)
    rows = packs.select("locale", "part", "groups", "popularity", F.posexplode("rows").alias("at", "r"))
    return rows.select("locale", "part", "at", "r.*", F.get("groups", F.col("r.group")).alias("grp"), F.coalesce(F.get("popularity", F.col("at")), F.lit(0)).alias("popularity"))


def exploded(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """item, phrase, field_ix, weight: the `|`-joined phrases of pack rows."""
    parts = F.array(*[F.struct(F.lit(i).alias("field_ix"), F.lit(weights[f]).alias("weight"), F.split(F.coalesce(F.col(c), F.lit("")), r"\|").alias("p")) for i, (c, f) in enumerate(zip(PHRASES, weights, strict=True))])
    each = rows.select("item", F.explode(parts).alias("f")).select("item", "f.field_ix", "f.weight", F.explode("f.p").alias("phrase"))
    return each.withColumn("phrase", F.trim("phrase")).filter("phrase <> ''").select("item", "phrase", "field_ix", "weight")


def labels_by_locale(rows: DataFrame) -> DataFrame:
    """item and its map of locale to label; a later pack of a locale wins. rows: item, locale, label, pack (its number)."""
    last = rows.filter("label <> ''").groupBy("item", "locale").agg(F.max_by("label", "pack").alias("label"))
    return last.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "label")))).alias("labels"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """q, n, locale of a log of JSON lines; the first bad line is named by its number."""
    rows = lines(spark, path).filter(F.trim("value") != "").withColumn("j", F.from_json("value", "q string, n double, locale string"))
    rows = checked(rows, ["file", "number"], not_json=F.col("j").isNull() | F.col("j.q").isNull(), empty_query=F.trim("j.q") == "", count_not_positive=~(F.col("j.n") > 0))
    return rows.select("j.q", "j.n", "j.locale")


def overlay(spark: SparkSession, path: str, known: DataFrame, columns: str) -> DataFrame:
    """Rows of overlay files (JSON lines with key and columns), whose keys must be known (key) and stand once."""
    rows = spark.read.schema(f"key string, {columns}").option("mode", "FAILFAST").json(path)
    marked = rows.join(known.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    return checked(repeated(marked, "key"), ["key"], unknown_key=F.col("known").isNull(), duplicated_key=F.col("twice")).select(*rows.columns)


def base_catalog(items: DataFrame, shortcodes: list[DataFrame], annotations: DataFrame, keys: list[Column]) -> DataFrame:
    """item, ord, label, shortcodes, keywords: a catalog without components, with the shortcodes of several sets, and annotations looked up by the first key that has any.

    items: item, ord, group, label; shortcodes: item, code; annotations: key, words.
    """
    rows = items.filter(F.col("group") != "component")
    for i, codes in enumerate(shortcodes):
        rows = rows.join(codes.groupBy("item").agg(F.array_sort(F.collect_set("code")).alias(f"codes{i}")), "item", "left")
    for i, key in enumerate(keys):
        rows = rows.withColumn(f"key{i}", key).join(annotations.select(F.col("key").alias(f"key{i}"), F.col("words").alias(f"words{i}")), f"key{i}", "left")
    none = F.array().cast("array<string>")
    codes = F.array_distinct(F.flatten(F.array(*[F.coalesce(f"codes{i}", none) for i in range(len(shortcodes))])))
    return rows.select("item", "ord", "label", codes.alias("shortcodes"), F.coalesce(*[f"words{i}" for i in range(len(keys))], none).alias("keywords"))


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, q, locale, cat, answers, forbid of an evaluation set of JSON lines: ids once, answers given and not forbidden."""
    rows = lines(spark, path).filter(F.trim("value") != "").withColumn("j", F.from_json("value", "id string, q string, locale string, cat string, answers array<string>, forbid array<string>"))
    rows = repeated(rows, "j.id")
    both = F.coalesce(F.arrays_overlap("j.answers", F.coalesce("j.forbid", F.array().cast("array<string>"))), F.lit(False))
    rows = checked(rows, ["file", "number"], no_id=F.col("j.id").isNull(), id_twice=F.col("twice"), no_query=F.col("j.q").isNull(), no_answers=F.coalesce(F.size("j.answers"), F.lit(0)) == 0, answer_forbidden=both)
    return rows.select("j.*")


def owners_csv(spark: SparkSession, path: str) -> DataFrame:
    """alias and owners (array) of a review file with quoted cells, in which owners are separated by blanks."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).select("alias", F.array_remove(F.split("owners", " +"), "").alias("owners"))


def id_ranges(texts: DataFrame) -> DataFrame:
    """id: those named in text, single (`a-006`) or as ranges (`a-006 to a-011`)."""
    low, high = F.col("r")["low"], F.col("r")["high"]
    pattern = F.lit(r"\b([a-z]+-)(\d+)(?: to ([a-z]+-)(\d+))?")
    part = lambda n: F.regexp_extract_all("text", pattern, n)
    found = texts.select(F.explode(F.arrays_zip(part(1).alias("head"), part(2).alias("low"), part(4).alias("high"))).alias("r"))
    numbers = F.sequence(low.cast("int"), F.greatest(low.cast("int"), F.coalesce(F.try_to_number(high, F.lit("999999999")).cast("int"), low.cast("int"))))
    return found.select("r.head", F.length(low).alias("width"), F.explode(numbers).alias("n")).select(F.concat("head", F.expr("lpad(cast(n AS string), greatest(width, length(cast(n AS string))), '0')")).alias("id")).distinct()


def exclusions(rows: DataFrame) -> DataFrame:
    """phrase and category of a list with [category] heads and # comments. rows: file, number, value, as of lines().

    Heads are few: each holds for the numbers up to the next one, met by a join on
    the file that leaves a line its last head; a file's lines never share a task.
    """
    bare = rows.withColumn("text", F.trim(F.regexp_replace("value", "#.*$", "")))
    head = F.regexp_extract("text", r"^\[(.+)\]$", 1)
    heads = bare.filter(head != "").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("number", head.alias("category")))).alias("heads"))
    phrases = bare.filter((F.col("text") != "") & (head == "")).join(heads, "file", "left")
    last = F.try_element_at(F.filter("heads", lambda h: h["number"] < F.col("number")), F.lit(-1))
    return phrases.select(F.lower("text").alias("phrase"), last["category"].alias("category"))


def write_vectors(df: DataFrame, path: str, id_col: str = "id", vector_col: str = "v") -> None:
    """One binary file a task: a head, then a record a vector: its id, a scale, 8-bit components and the components' signs as bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.stack(batch["v"].to_list()).astype(np.float64)
            if v.shape[1] % 8:
                raise BadInput(f"{v.shape[1]} dimensions aren't whole bytes of signs")
            scale = np.abs(v).max(axis=1) / 127
            q = np.floor(v / np.where(scale == 0, 1, scale)[:, None] + 0.5).astype(np.int8)
            bits = np.packbits(v >= 0, axis=1)
            yield pd.DataFrame({"record": [MAGIC + struct.pack("<qIf", i, v.shape[1], s) + a.tobytes() + b.tobytes() for i, s, a, b in zip(batch["id"], scale, q, bits, strict=True)]})

    df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(run, "record binary").write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, v (array of float), signs (binary) of write_vectors(); a record of another length or head is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch["record"]:
                i, dims, scale = struct.unpack_from("<qIf", record, len(MAGIC))
                at = len(MAGIC) + 16
                if record[: len(MAGIC)] != MAGIC or len(record) != at + dims + dims // 8:
                    raise BadInput("not a vector record")
                out.append((i, (np.frombuffer(record, np.int8, dims, at) * np.float32(scale)).tolist(), record[at + dims :]))
            yield pd.DataFrame(out, columns=["id", "v", "signs"])

    return spark.read.parquet(path).mapInPandas(run, "id long, v array<float>, signs binary")


def fitted_aliases(rows: DataFrame, budget: int = PACK_BYTES, most: int = CORE_ALIASES) -> DataFrame:
    """locale, aliases, bytes: the most aliases an item with which a locale's pack, packed, keeps to the budget; none an item if no number does.

    rows: locale, item, head (the row without aliases), aliases (array). Each
    number of aliases is a stream of its own, sorted by Spark and packed as it
    comes, so that no task holds a pack: what one keeps is the state of a compressor.
    """
    line = F.concat("head", F.lit("|"), F.array_join(F.slice("aliases", 1, F.col("n")), "|"))
    each = rows.select("locale", "item", "head", "aliases", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("n")).select("locale", "n", "item", line.alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, packer, size = None, None, 0
        done = lambda: pd.DataFrame({"locale": [key[0]], "n": [key[1]], "bytes": [size + len(packer.flush())]})
        for batch in batches:
            for (locale, n), part in batch.groupby(["locale", "n"], sort=False):
                text = "\n".join(part["line"])
                if key == (locale, n):
                    text = "\n" + text
                else:
                    if key:
                        yield done()
                    key, packer, size = (locale, n), zlib.compressobj(9, zlib.DEFLATED, GZIP_WINDOW), 0
                size += len(packer.compress(text.encode()))
        if key:
            yield done()

    sizes = each.filter("locale is not null").repartition("locale", "n").sortWithinPartitions("locale", "n", "item", "line").mapInPandas(run, "locale string, n int, bytes long")
    own = F.struct("n", "bytes")
    best = F.coalesce(F.max(F.when(F.col("bytes") <= budget, own)), F.max(F.when(F.col("n") == 0, own)))
    return sizes.groupBy("locale").agg(best.alias("b")).select("locale", F.col("b.n").alias("aliases"), "b.bytes")


def content_files(entries: DataFrame, key: str, value: str) -> DataFrame:
    """key, file, bytes, body: each key's body under a name made of its own hash."""
    body = F.col(value)
    return entries.select(key, F.concat(F.substring(F.sha2(body, 256), 1, 16), F.lit(".json")).alias("file"), F.octet_length(body).cast("long").alias("bytes"), body.alias("body"))


def manifest(files: DataFrame) -> DataFrame:
    """file, bytes, gzip, sha256 of files (file, body): a size as is and packed, and a digest."""

    @F.pandas_udf("long")
    def packed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: len(gzip.compress(bytes(b), 9, mtime=0)))

    raw = F.col("body").cast("binary")
    return files.select("file", F.octet_length(raw).cast("long").alias("bytes"), packed(raw).alias("gzip"), F.sha2(raw, 256).alias("sha256"))


def merged_batches(parts: DataFrame, known: DataFrame) -> DataFrame:
    """key, record: the last part's record of each key. parts: key, part, record; a key that isn't known is an error."""
    marked = parts.join(known.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    return checked(marked, ["part", "key"], unknown_key=F.col("known").isNull()).groupBy("key").agg(F.max_by("record", "part").alias("record"))


def stale_files(stored: DataFrame, referenced: DataFrame, now: Column, grace: int) -> DataFrame:
    """file: stored files (file, uploaded in seconds) that nothing refers to and that are older than the grace."""
    return stored.join(referenced.select("file"), "file", "left_anti").filter(F.col("uploaded") < now - grace).select("file")


def stale_versions(stored: DataFrame, current: str, now: Column, keep: int) -> DataFrame:
    """version: other versions whose last upload lies too far back."""
    return stored.filter(F.col("version") != current).groupBy("version").agg(F.max("uploaded").alias("last")).filter(F.col("last") < now - keep).select("version")


