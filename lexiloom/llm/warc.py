"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id and payload digest, cut at
running sums of payload bytes over all of them, and sorted in each shard. An id
and digest with more bytes than a shard (repeated rows, rows without an id) are
dealt to the shards of their own stretch by URL and copy. Each task streams one
shard into gzip members, one a record, and rolls to the next file when a file's
compressed size reaches its target. Headers and digests are made anew. Files are written under a
temporary name of the attempt; the manifest of the finished attempts names
those that are then moved to their final names, so a lost or repeated task
leaves nothing in the archive. Equal input gives equal files.

A payload of at least `revisit_from` bytes that several records hold is stored
once, with the smallest id; the others are revisit records, whose blocks are
the HTTP headers with the full payload's length.

Defined results: a null payload counts as empty and a null URL as the record's
urn; rows with a null id are written as responses under id `none`, refer to
nothing and are not referred to, and are read back with a null id; of repeated
rows the first is a response, the others revisit it if long enough; further
columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh_path, join_unique, map_batches, written

#: Payload bytes of a shard, bytes that each record counts besides, and compressed bytes at which a file is full.
SHARD_BYTES, RECORD_BYTES, FILE_BYTES = 32 << 20, 200, 8 << 20
#: Most shards, as the driver holds a bound for each; larger archives have larger shards.
MAX_SHARDS = 65_536
REVISIT_FROM = 100
LEVEL = 5
#: Deterministic archives carry no clock time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record(kind: str, record_id: str, block: bytes, more: dict[str, str]) -> bytes:
    """One gzip member with a record and its headers."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE} | more
    head |= {"WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass")) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    urn = f"urn:page:{'none' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"WARC-Target-URI": _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else urn, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is None:
        return _record("response", urn, http + payload, more | {"Content-Type": "application/http;msgtype=response"})
    return _record("revisit", urn, http, more | {"Content-Type": "application/http;msgtype=response", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"})


class Roller:
    """Writes records to files of an attempt's own temporary folder; closed files are listed in `done`."""

    def __init__(self, out_dir: str, file_bytes: int):
        self.fs, self.root = fs.FileSystem.from_uri(out_dir)
        self.temp, self.file_bytes = f"_temporary/{uuid.uuid4().hex}", file_bytes
        self.fs.create_dir(f"{self.root}/{self.temp}", recursive=True)
        self.stream, self.shard, self.part, self.done = None, None, 0, []

    def add(self, shard: int, member: bytes) -> None:
        if self.shard != shard or self.stream is not None and self.size >= self.file_bytes:
            self.close()
            self.part = self.part + 1 if self.shard == shard else 0
            self.shard, self.name = shard, f"part-{shard:06d}-{self.part:04d}.warc.gz"
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.temp}/{self.name}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self._put(_record("warcinfo", f"urn:archive:{self.name}", b"format: WARC File Format 1.1\r\n", {"WARC-Filename": self.name, "Content-Type": "application/warc-fields"}))
        self.records += 1
        self._put(member)

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((f"{self.temp}/{self.name}", self.name, self.shard, self.records, self.size, self.sha.hexdigest()))
            self.stream = None


def _placed(ids: DataFrame, shard_bytes: int) -> DataFrame:
    """Each distinct key of ids (key, page_id, digest, url, bytes) with its first URL and the shards low to high that its records are dealt to.

    Keys are sorted into ranges; a key's place is the bytes of the ranges before
    its own and of the keys before it in its range.
    """
    keys = ids.groupBy("key", "page_id", "digest").agg(F.min("url").alias("first_url"), F.count("*").alias("n"), F.sum(F.col("bytes") + RECORD_BYTES).alias("weight"))
    ranged = written(keys.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "keys")
    sums = ranged.groupBy("range").agg(F.sum("weight").alias("sum"))
    ahead = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("ahead"))  # one row a range
    shard_bytes = max(shard_bytes, -(-(sums.agg(F.sum("sum")).first()[0] or 0) // MAX_SHARDS))
    within = F.sum("weight").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = ranged.join(F.broadcast(ahead), "range").withColumn("end", F.col("ahead") + within)
    low = F.floor((F.col("end") - F.col("weight")) / shard_bytes).cast("int")
    high = F.when((F.col("n") > 1) & (F.col("weight") > shard_bytes), F.floor((F.col("end") - 1) / shard_bytes).cast("int")).otherwise(low)
    return written(at.select("key", "page_id", "digest", "first_url", low.alias("low"), high.alias("high")), "places")


def _spread(url: str, copy: Column) -> Column:
    """The shard of a record whose key has several."""
    return F.col("low") + F.pmod(F.xxhash64(url) + copy, F.col("high") - F.col("low") + 1).cast("int")


def _dealt(pages: DataFrame, places: DataFrame, shard_bytes: int) -> DataFrame:
    """pages with the shard of each record and the number of copies that a row stands for."""
    starts = places.groupBy("low").agg(F.min("key").alias("key")).orderBy("key").collect()  # one row a shard
    bounds, shard = np.array([r["key"] for r in starts], "S81"), np.array([r["low"] for r in starts], np.int32)

    @F.arrow_udf("int")
    def shard_of(key: pa.Array) -> pa.Array:
        return pa.array(shard[np.searchsorted(bounds, key.to_numpy(zero_copy_only=False).astype("S81"), side="right") - 1])

    wide = written(places.filter("high > low").select("key", "low", "high"), "wide")  # at most one row a shard
    if wide.isEmpty():
        return pages.withColumn("shard", shard_of("key")).withColumn("copies", F.lit(1))
    light = pages.join(F.broadcast(wide), "key", "left_anti").withColumn("shard", shard_of("key")).withColumn("copies", F.lit(1))
    alike = pages.join(F.broadcast(wide), "key").groupBy("key", "page_id", "digest", "url", "low", "high").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / (F.octet_length("payload") + RECORD_BYTES)))
    runs = alike.withColumn("each", each).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("each")))))
    heavy = runs.withColumn("shard", _spread("url", F.col("run"))).withColumn("copies", F.least("each", F.col("n") - F.col("run") * F.col("each")).cast("int"))
    return light.unionByName(heavy.select(light.columns))


def write_archive(df: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = REVISIT_FROM, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive at once; gives its manifest: temp, file, shard, records, bytes, sha256."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    number = F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(2**63)))), 16, "0")), F.lit("0" * 17))
    pages = pages.withColumn("key", F.concat(number, "digest"))  # sorts as id and digest do, null ids first
    ids = written(pages.select("key", "page_id", "digest", "url", F.octet_length("payload").cast("long").alias("bytes")), "payloads")

    groups = ids.filter((F.col("bytes") >= revisit_from) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    repeated = written(groups.filter("n > 1").select("digest", "refers_to"), "repeated")
    places = _placed(ids, shard_bytes)
    again = join_unique(places.filter("page_id is not null"), repeated, "digest")

    # a mark goes to each shard of its key; `home` is the shard of the key's first record
    marks = again.withColumn("home", _spread("first_url", F.lit(0))).withColumn("shard", F.explode(F.sequence("low", "high")))
    marks = marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "refers_to", "home", F.lit(1).alias("copies"), "shard")
    records = _dealt(pages, places, shard_bytes).select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("int").alias("home"), "copies", "shard")
    shards = 1 + (places.agg(F.max("high")).first()[0] or 0)
    dealt = marks.unionByName(records).repartitionById(shards, "shard").sortWithinPartitions("page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, marked, stored = None, (None, None), (None, None)
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "digest", "kind", "url", "payload", "refers_to", "home", "copies", "shard"))
            for page_id, digest, kind, url, text, refers_to, at, copies, shard in zip(*map(_values, columns), strict=True):
                if kind == 0:  # a mark comes before the pages with its id and digest
                    marked, to, home = (page_id, digest), refers_to, at
                    continue
                roller = roller or Roller(out_dir, file_bytes)
                key = (page_id, digest)
                for _ in range(copies):
                    first = page_id is None or marked != key or (to == page_id and home == shard and stored != key)
                    stored = key
                    roller.add(shard, page_record(page_id, url, text.encode("utf-8", "surrogatepass"), digest, None if first else to))
        if roller is not None:
            roller.close()
            rows = list(zip(*roller.done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["temp", "file", "shard", "records", "bytes", "sha256"])

    manifest = written(dealt.mapInArrow(write, "temp string, file string, shard int, records long, bytes long, sha256 string"), "manifest")
    _commit(manifest, out_dir)
    manifest.drop("temp").write.parquet(f"{out_dir}/_manifest")
    return spark.read.parquet(f"{out_dir}/_manifest")


def _values(column: pa.Array) -> Iterator:
    return (x.as_py() for x in column)


def _commit(manifest: DataFrame, out_dir: str) -> None:
    """Move the listed files to their final names; a repeated move finds nothing left to do."""

    def move(batch: pa.RecordBatch) -> pa.RecordBatch:
        files, root = fs.FileSystem.from_uri(out_dir)
        for temp, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if files.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:
                files.move(f"{root}/{temp}", f"{root}/{file}")
            elif files.get_file_info(f"{root}/{file}").type == fs.FileType.NotFound:
                raise FileNotFoundError(f"{out_dir}/{file}")
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["moved"])

    map_batches(manifest.select("temp", "file"), "moved long", move).agg(F.sum("moved")).collect()
    files, root = fs.FileSystem.from_uri(out_dir)
    if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        files.delete_dir(f"{root}/_temporary")


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked."""
    packed = b""
    while packed or (packed := stream.read(chunk)):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not packed and not (packed := stream.read(chunk)):
                raise EOFError("a gzip member is cut short")
            parts.append(unpacker.decompress(packed))
            packed = unpacker.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; its length and block digest are tested."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(rest) != len(block) + 4 or headers.get("warc-block-digest") != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def read_archive(spark: SparkSession, out_dir: str, keep_payload: bool = True) -> DataFrame:
    """The page records of a committed archive, by its manifest.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload (null for
    revisits) if it is kept. Payload digests are computed again for responses.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    schema = pa.schema(fields if keep_payload else fields[:-1])

    def number(urn: str | None) -> int | None:
        return int(found) if urn and (found := urn.strip("<>").rpartition(":")[2]) != "none" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in members(stream):
                        headers, block = parse(member)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged payload {headers['warc-record-id']}")
                        kept = payload if headers["warc-type"] == "response" else None
                        rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, headers["warc-type"], number(headers.get("warc-refers-to")), kept)[: len(schema)])
                        held += len(payload) if keep_payload else 100
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    manifest = spark.read.parquet(f"{out_dir}/_manifest")
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(read, ddl)


def round_trip(df: DataFrame) -> DataFrame:
    """Write the pages to a fresh archive in the shared folder, and read it back."""
    out_dir = fresh_path(df.sparkSession, "warc")
    write_archive(df, out_dir)
    return read_archive(df.sparkSession, out_dir, keep_payload=False).drop("url")
