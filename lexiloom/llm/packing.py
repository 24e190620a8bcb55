"""Best-fit packing of token pieces by patterns from non-negative least squares.

Spark tokenizes, counts the pieces of each length and ranks them; the driver
sees only the histogram of at most `capacity` lengths. Over it, patterns of up
to three lengths that fill a sequence are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded, and what
remains is packed best fit decreasing, also into the patterns' gaps. The plan is
a table of runs: the pieces of a length with ranks from..to go to consecutive
sequences at one offset. Its size depends on the capacity, not on the corpus.

Defined results: a null text counts as empty and is one piece of the single id
0; longer documents alone are cut; repeated rows are packed as rows of their own;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path
from struct import pack as pack_into

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import map_batches, split_words, written

CAPACITY = 2048
#: Lengths are rounded up to multiples of this for the fit.
WIDTH = 8
#: Pieces numbered by one window group.
PIECES_A_BLOCK = 50_000
#: Entries of a worker's cache of chunks' ids, and of its cache of words' ids.
CACHE = 600_000

#: Fixed value: the word pattern of the tokenizer file.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters for which lower case and composition work letter by letter.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-įı-ž]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    letters, more = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        letters.append(chr(b if shown else more))
        more += not shown
    return letters


class Ids(dict):
    """Chunks (texts without white space) to their little-endian 32-bit ids, equal to the tokenizer's, learnt as they are met.

    White space always parts two words, so a text's ids are its chunks' ids one after another. A chunk
    of plain letters is cut into words, and only new words reach the tokenizer's merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        cut = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        lower = "Lowercase" in [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        if _WORD.pattern not in cut or not lower:
            raise ValueError(f"{path} doesn't lower-case and cut words as this module does")
        self.words = _Words(self.tokenizer.model)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            low = chunk.lower()
            if low.isalpha():
                found = self.words[low]
            elif low[:-1].isalpha() and not low[-1].isalnum():
                found = self.words[low[:-1]] + self.words[low[-1]]
            else:
                found = b"".join(map(self.words.__getitem__, _WORD.findall(low)))
        else:
            found = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = found
        return found

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text i are ids[bounds[i]:bounds[i + 1]]."""
        of_text, codes, chunks = split_words(texts)
        found = list(map(self.__getitem__, chunks))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        shift = (np.cumsum(sizes) - sizes)[codes] - upto[:-1]
        return np.frombuffer(b"".join(found), "<u4")[np.repeat(shift, n) + np.arange(upto[-1])], upto[of_text]


class _Words(dict):
    """Lower-case words to ids."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.tokenize(spelt)]
        self[word] = found = pack_into("<%dI" % len(ids), *ids)
        return found


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the id `end`, in pieces of at most `capacity`."""
    tail = np.array([end], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [], [])
        ids, bounds = ids_of(tokenizer_path).of(batch.column(1))
        for doc, low, high in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            own = ids[low:high].tobytes() + tail
            for k in range(0, len(own), 4 * capacity):
                part = own[k : k + 4 * capacity]
                for out, x in zip(rows, (doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out.append(x)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, piece int, start long, length long, ids_crc32 long", work)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson)."""
    gram, side = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = side - gram[:, active] @ x[active]
        slope[active] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-8 * max(1.0, abs(b).max(initial=0)):
            break
        active[int(slope.argmax())] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(on, on)] + 1e-9 * np.eye(len(on)), side[on], rcond=None)[0] if len(on) > 1 else side[on] / gram[on, on]
            if z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            bad = z <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - z[bad], 1e-300))
            x[on] += step * (z - x[on])
            active[on[(x[on] <= 1e-9) & bad]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(slots: int) -> list[tuple[int, ...]]:
    """One to three lengths in units of WIDTH, longest first, that fill `slots` (a single one may be shorter)."""
    two = [(slots - j, j) for j in range(1, slots // 2 + 1)]
    three = [(slots - j - k, j, k) for k in range(1, slots // 3 + 1) for j in range(k, (slots - k) // 2 + 1)]
    return [(slots,), *two, *three]


#: One run of a plan: pieces of this length with ranks rank .. rank + n - 1 go to sequences from `sequence`, at `offset`.
Run = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> tuple[list[Run], int]:
    """Runs (length, rank, n, sequence, offset) that place every piece of the histogram, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: list[tuple[int, int, int]] = []  # room, sequence, n: sorted open sequences
    sequences = 0

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def bin_of(length: int) -> int:
        return -(-length // width)

    if capacity in left:
        take(capacity, n := left[capacity], 0, 0)
        sequences += n
    slots = capacity // width
    kinds = patterns(slots)
    have = np.zeros(slots)
    members: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        have[bin_of(n) - 1] += left[n]
        members[bin_of(n)].append(n)
    kinds = [k for k in kinds if all(have[i - 1] for i in k)]
    if kinds:
        a = np.zeros((slots, len(kinds)))
        for col, kind in enumerate(kinds):
            for i in kind:
                a[i - 1, col] += 1
        fitted = nnls(a, have)
        for col in np.argsort(-fitted, kind="stable"):
            kind = kinds[col]
            repeats = min([int(fitted[col] + 0.5), *(int(have[i - 1]) // kind.count(i) for i in set(kind))])
            for i in kind:
                have[i - 1] -= repeats
            while repeats > 0:
                chosen: list[int] = []
                for pos, i in enumerate(kind):  # the longest of one class meet the shortest of the next
                    inside = members[i]
                    while inside and inside[0] not in left:
                        inside.pop(0)
                    while inside and inside[-1] not in left:
                        inside.pop()
                    chosen.append(inside[-1] if pos % 2 == 0 else inside[0])
                n = min([repeats, *(left[x] // chosen.count(x) for x in set(chosen))])
                if n == 0:  # two slots of one class want the last piece of a length: take the others
                    pool = [x for i in set(kind) for x in members[i] for _ in range(min(left.get(x, 0), kind.count(i)))]
                    chosen, n = _distinct(kind, pool, bin_of), 1
                offset = 0
                for x in chosen:
                    take(x, n, sequences, offset)
                    offset += x
                if offset < capacity:
                    insort(gaps, (capacity - offset, sequences, n))
                sequences += n
                repeats -= n
    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect_left(gaps, (length, -1, -1))
            if at < len(gaps):
                room, first, n = gaps.pop(at)
                m = min(n, left[length])
                take(length, m, first, capacity - room)
                if n > m:
                    insort(gaps, (room, first + m, n - m))
                if room > length:
                    insort(gaps, (room - length, first, m))
            else:
                each = capacity // length
                m = left[length] // each
                each, m = (each, m) if m else (left[length], 1)
                for k in range(each):
                    take(length, m, sequences, k * length)
                if each * length < capacity:
                    insort(gaps, (capacity - each * length, sequences, m))
                sequences += m
    return runs, sequences


def _distinct(kind: tuple[int, ...], pool: list[int], bin_of: Callable[[int], int]) -> list[int]:
    """For each class of the pattern one length of the pool, none used more often than the pool has it."""
    chosen = []
    for i in kind:
        x = next(x for x in pool if bin_of(x) == i)
        pool.remove(x)
        chosen.append(x)
    return chosen


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, width: int = WIDTH, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of df with sequence_id and offset. Tokenizes at once, into a written table."""
    cut = written(pieces(df, tokenizer_path, capacity, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs, _ = plan(histogram, capacity, width)
    blocks = 1 + sum(histogram.values()) // PIECES_A_BLOCK
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy("length", "block").count()
    first = counts.select("length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    order = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "row")) - 1
    ranked = dealt.withColumn("rank", order).join(first, ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 40 | table[:, 1]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(k).to_numpy() for k in (3, 5))
        at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    return map_batches(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place)
