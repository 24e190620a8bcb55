"""Media columns: texts as PNG images, and perceptual hashes of the images.

A payload, padded by zero bytes to whole rows of 64, becomes an 8-bit grey
image in a binary column. Encoding writes the PNG chunks with their checksums;
rows are filtered by the simple filter with the smallest absolute sum. Decoding
tests the signature and every chunk's checksum, inflates the image data and
undoes all five filter types with numpy. The feature is a hash of the signs of
the image's low-frequency cosine coefficients against their median.

Defined results: a null payload counts as empty, one row of zeros; damaged
images raise an error that names the fault; equal payloads give equal images and
hashes; repeated rows give repeated results; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import map_batches

WIDTH = 64
LEVEL = 3
#: Cosine coefficients that the hash spans, along either axis.
LOW = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of WIDTH columns whose samples are the payload and zeros up to a full last row."""
    rows = max(1, -(-len(payload) // WIDTH))
    image = np.frombuffer(payload.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    choices = (image, sub, up)
    kind = int(np.argmin([np.abs(c.view(np.int8).astype(np.int16)).sum() for c in choices]))
    lines = np.empty((rows, WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, choices[kind]
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace, rows by columns."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, size = 8, [], None
    while at < len(data):
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        (crc,) = struct.unpack_from(">I", data, at + 8 + length)
        if zlib.crc32(body, zlib.crc32(kind)) != crc:
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            *size, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not an 8-bit grey image without interlace")
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + length
    if size is None:
        raise ValueError("no header")
    width, rows = size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the row filters: runs of none, sub and up at once, average and Paeth along their rows."""
    image = lines.copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind = int(kinds[i])
        if kind == 1:
            np.cumsum(lines[i:j], axis=1, dtype=np.uint8, out=image[i:j])
        elif kind == 2:
            if i:
                image[i] += image[i - 1]
            np.cumsum(image[i:j], axis=0, dtype=np.uint8, out=image[i:j])
        elif kind in (3, 4):
            for r in range(i, j):
                above = image[r - 1].astype(int) if r else np.zeros(lines.shape[1], int)
                left = corner = 0
                for c, x in enumerate(lines[r].tolist()):
                    b = int(above[c])
                    if kind == 3:
                        guess = (left + b) // 2
                    else:
                        p = left + b - corner
                        guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                    left, corner = (x + guess) & 255, b
                    image[r, c] = left
        elif kind:
            raise ValueError(f"filter type {kind} is unknown")
    return image


def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(LOW), np.arange(n) + 0.5))


_kept_cosines = lru_cache(maxsize=512)(_cosines)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which low-frequency cosine coefficients lie above their median, the constant one left out of it."""
    rows, columns = image.shape
    across = image.astype(np.float64) @ _kept_cosines(columns).T
    low = ((_kept_cosines if rows <= 4096 else _cosines)(rows) @ across).ravel()
    low = np.round(low / image.size, 9)
    return f"{int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), 'big'):016x}"


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, a binary column of PNG images of the texts' UTF-8 bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(encode_png, raw)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, n_bytes long, media binary", work)


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """doc_id and n_bytes with digests of the images in a binary column and of the payloads read back from them."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for media in batch.column(2).to_pylist():
            image = decode_png(media)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(df.select("doc_id", "n_bytes", media_col), schema, work)
