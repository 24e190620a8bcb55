"""Byte-level BPE encoding and decoding with the vocabulary file of a public tokenizer.

A text is cut at added tokens, each stretch between them into words by the
tokenizer's pattern, and each word into its bytes. The words that a slice of
texts brings anew are merged together, a short word in a row of two contiguous
arrays, its parts between boundaries and the ranks of adjacent parts: each round
scans a row for its smallest rank, deletes the boundary between the two parts,
and looks up the ranks beside it anew, until no two adjacent parts merge. In a
long word the scans would cost the square of its length, so its pairs stand in a
heap and its parts in a linked list; the merges are the same. A worker keeps the
ids of the words it has met, in bounded number.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded alike; further columns are ignored; an empty table gives an empty
result. Ids outside the vocabulary can't be decoded and are refused.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import map_batches

#: Powers of two: most bytes of words that are merged together; the pairs of longer ones stand in a heap.
WIDTHS = (8, 16, 32, 64, 128)
#: Words whose ids a worker keeps, and as many older ones.
CACHE = 150_000
#: Bytes of text that are encoded at a time, and ids that are decoded.
SLICE, SLICE_IDS = 2_000_000, 500_000
#: Above every rank.
NEVER = np.iinfo(np.int32).max
#: Fixed value: the pattern that cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others are numbered from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """The merges of a tokenizer file, and the ids of words learnt as they are met."""

    def __init__(self, path: str):
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cutter = rules["model"], rules.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [k for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or rules.get("normalizer") or not plain.items() <= cutter.items():
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in white space")
        ids, byte_of = model["vocab"], byte_letters()
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        #: The id of each byte, and by rank the id of the part that a merge makes.
        self.byte_ids = np.array([ids[c] for c in sorted(byte_of, key=byte_of.get)], np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        #: Pairs of ids that merge to their ranks: as a dict, and as sorted arrays.
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int32)
        added = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("(" + ("|".join(map(regex.escape, sorted(added, key=len, reverse=True))) or "(?!)") + ")")
        self.added = {token: (i,) for token, i in added.items()}
        self.known: dict[str, tuple[int, ...]] = dict(self.added)
        self.older: dict[str, tuple[int, ...]] = {}

    def cut(self, text: str) -> list[str]:
        """Words and added tokens of a text; no word is spelt as an added token, as that would have been cut out first."""
        parts = self.marks.split(text)
        return list(chain.from_iterable([part] if k % 2 else self.words.findall(part) for k, part in enumerate(parts)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cuts = [self.cut(t) for t in texts]
        self.learn(set().union(*cuts))
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, words))) for words in cuts]

    def learn(self, words: set[str]) -> None:
        """Make the words' ids known."""
        if len(self.known) >= CACHE:
            self.known, self.older = dict(self.added), self.known
        rows: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        for word in words:
            if word in self.known:
                continue
            if (found := self.older.get(word)) is not None:
                self.known[word] = found
                continue
            raw = word.encode()
            if len(raw) > WIDTHS[-1]:
                self.known[word] = tuple(self.heaped(raw))
            else:
                rows[max(WIDTHS[0], 1 << (len(raw) - 1).bit_length())].append((word, raw))
        for width, new in rows.items():
            if new:
                parts = self.scanned([raw for _, raw in new], width)
                sizes = (parts >= 0).sum(axis=1).tolist()
                for (word, _), row, n in zip(new, parts.tolist(), sizes, strict=True):
                    self.known[word] = tuple(row[:n])

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NEVER)

    def scanned(self, words: list[bytes], width: int) -> np.ndarray:
        """The parts of each word after all merges, a row a word, -1 after its last part."""
        padded = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts = np.where(np.arange(width) < sizes[:, None], self.byte_ids[padded], -1)
        done, rows = np.full(parts.shape, -1, np.int32), np.arange(len(words))
        edge = np.full((len(words), 1), NEVER, np.int32)
        near = np.hstack([self.ranks_of(parts[:, :-1], parts[:, 1:]), edge])
        while len(rows):
            at = near.argmin(axis=1)
            low = near[np.arange(len(rows)), at]
            if (over := low == NEVER).any():
                done[rows[over], : parts.shape[1]] = parts[over]
                rows, parts, near, at, low = (x[~over] for x in (rows, parts, near, at, low))
            if not len(rows):
                break
            every = np.arange(len(rows))
            parts[every, at] = self.made[low]
            right = np.arange(parts.shape[1] - 1) > at[:, None]  # the boundary goes: what stands right of it moves up
            parts, near = (np.where(right, x[:, 1:], x[:, :-1]) for x in (parts, near))
            following = np.where(at + 1 < parts.shape[1], parts[every, np.minimum(at + 1, parts.shape[1] - 1)], -1)
            spot = np.minimum(at, parts.shape[1] - 1)
            near[every, spot] = self.ranks_of(parts[every, spot], following)
            inner = np.flatnonzero(at > 0)
            near[inner, at[inner] - 1] = self.ranks_of(parts[inner, at[inner] - 1], parts[inner, at[inner]])
        return done

    def heaped(self, word: bytes) -> list[int]:
        """The parts of one word by a heap of pairs over a linked list of parts: for long words."""
        n, parts = len(word), self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part at each place

        def rank_at(at: int) -> int:
            return self.ranks.get(parts[at] << 32 | parts[after[at]], NEVER) if after[at] < n else NEVER

        near = [rank_at(k) for k in range(n)]
        heap = [(r, k) for k, r in enumerate(near) if r < NEVER]
        heapq.heapify(heap)
        while heap:
            low, at = heapq.heappop(heap)
            if near[at] != low:
                continue
            gone = after[at]
            parts[at], after[at], near[gone] = int(self.made[low]), after[gone], NEVER
            if after[at] < n:
                before[after[at]] = at
            for k in (at, before[at]):
                if k >= 0:
                    near[k] = rank_at(k)
                    if near[k] < NEVER:
                        heapq.heappush(heap, (near[k], k))
        found, at = [], 0
        while at < n:
            found.append(parts[at])
            at = after[at]
        return found


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def spelling(path: str) -> list[bytes]:
    """The bytes of each id."""
    rules, byte_of = json.loads(Path(path).read_text(encoding="utf-8")), byte_letters()
    found = {i: bytes(map(byte_of.__getitem__, token)) for token, i in rules["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in rules["added_tokens"]}
    return [found[i] for i in range(len(found))]


def decoded(ids: Iterable[int], parts: list[bytes]) -> str:
    """The ids' bytes as text; bytes that are no UTF-8 become U+FFFD."""
    return b"".join([parts[i] for i in ids]).decode("utf-8", "replace")


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = merges_of(tokenizer_path).encode(batch.column(1).fill_null("").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, "doc_id long, ids array<int>", work, SLICE)


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the text they stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = spelling(tokenizer_path)
        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy())
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_IDS, side="right")))
                some = batch.slice(at, end - at)
                texts = [decoded(ids or (), parts) for ids in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                at = end

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and digests of each text's ids and of the text decoded from them; encodes and decodes in one worker."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = spelling(tokenizer_path)
        n, digests, texts = [], [], []
        for ids in merges_of(tokenizer_path).encode(batch.column(1).fill_null("").to_pylist()):
            n.append(len(ids))
            digests.append(sha256(",".join(map(str, ids)).encode()).hexdigest())
            texts.append(sha256(decoded(ids, parts).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work, SLICE)
