"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

Pieces are those of a SentencePiece model file. A text's lattice has an edge
for each piece at each place; its weight is the piece's log-probability times a
temperature. A unigram model's scores are log-probabilities; a BPE model has
ranks only, for which Zipf's law gives them. Forward filtering sums the weights
of all segmentations up to each place; backward sampling draws one segmentation
from the end, in proportion to its weight. The random numbers are a hash of the
row's key, the place and a seed, so a row gets the same segmentation wherever
and however often it is computed.

No piece holds a space after another letter, so segmentations of a text are
those of its chunks (spaces with the letters after them), and all distinct
chunks of a slice are filtered at once by numpy. A slice is a bounded number of
letters; a longer text is encoded in runs of its chunks. One chunk, a stretch of
letters without a space, is filtered whole; its memory grows with its length.

Letters that no piece spells are written as bytes, as is the letter that stands
for a space in pieces; so decoding gives the text back.

Defined results: a null text counts as empty and has no ids, the empty text too;
a null key counts as its own key; repeated rows get the same segmentation;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import map_batches

SPACE = "▁"
#: Resolution of sampled shares.
UNITS = 1 << 24
#: Repeated chunks of a slice from which a worker keeps their lattice.
WORTH_KEEPING = 1000
#: Letters of text whose distinct chunks share a lattice, some 100 MB of a worker's memory.
SLICE_LETTERS = 1_000_000
_CHUNK = re.compile(" +[^ ]*")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a model as a trie in arrays, with their log-probabilities."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in range(n)])
        if np.allclose(np.diff(scores[usable]), -1):  # ranks: Zipf's law
            scores[usable] = -np.log(np.arange(len(usable)) + 3.0)
        self.names = names
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.byte_score = scores[usable].min() - 5.0
        scores[self.byte_ids] = self.byte_score
        self.scores = scores
        letters = sorted({c for i in usable for c in names[i]})
        self.letter = np.zeros(0x110000, np.int32)  # 0: a letter of no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        children: dict[tuple[int, int], int] = {}
        ids, inner = [-1], set()
        for i in usable:
            node = 0
            for c in names[i]:
                key = (node, int(self.letter[ord(c)]))
                if key not in children:
                    children[key] = len(ids)
                    ids.append(-1)
                inner.add(node)
                node = children[key]
            ids[node] = i
        self.piece = np.array(ids, np.int32)
        # one sorted array of node and letter; the root's children stand in an array of their own
        self.first = np.zeros(len(letters) + 1, np.int32)
        rest = []
        for (node, c), child in children.items():
            if node == 0:
                self.first[c] = child
            else:
                rest.append((node * (len(letters) + 1) + c, child))
        rest.sort()
        self.base = len(letters) + 1
        size = 1 << max(4, (len(rest) * 4).bit_length())
        self.slots = np.full(size, -1, np.int64)
        self.child = np.zeros(size, np.int32)
        self.probes = 1
        for key, node in rest:  # open addressing; lookups go through as many probes as the longest run
            at, tries = key * 0x9E3779B1 & size - 1, 1
            while self.slots[at] >= 0:
                at, tries = at + 1 & size - 1, tries + 1
            self.slots[at], self.child[at], self.probes = key, node, max(self.probes, tries)
        self.inner = np.zeros(len(ids), bool)
        self.inner[list(inner)] = True
        self.kept: dict[float, tuple] = {}

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The children of the nodes by these letters, 0 where there is none."""
        keys = nodes.astype(np.int64) * self.base + letters
        at = keys * 0x9E3779B1 & len(self.slots) - 1
        found = np.where(self.slots[at] == keys, self.child[at], 0)
        open_ = np.flatnonzero((found == 0) & (self.slots[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & len(self.slots) - 1
            held = self.slots[at[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.child[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Forward-filtered lattices of distinct chunks, all in one array of places.

    Place p of the array is before letter p; each chunk has a place after its last
    letter too. The edges that end at place p stand together, from first[p]: their
    start, their piece (or -1 for a letter in bytes), and the running sum of their
    weights in units of 1 / UNITS, whole numbers so that a chunk is sampled alike
    beside any others.
    """

    def __init__(self, pieces: Pieces, chunks: list[str], alpha: float):
        text = np.frombuffer(("\n".join(chunks) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.text = text
        stop = np.zeros(len(text), bool)
        stop[self.ends] = True
        letters = np.where(text == 0x2581, 0, pieces.letter[text])  # the letter itself is written in bytes
        letters = np.where(text == 32, pieces.letter[0x2581], letters)
        letters[stop] = 0

        places = np.flatnonzero(~stop)
        node = pieces.first[letters[places]]
        lone = places[(node == 0) | (pieces.piece[node] < 0)]
        start, end, piece = [lone], [lone + 1], [np.full(len(lone), -1, np.int32)]
        n_bytes = 1 + (text[lone] > 0x7F) + (text[lone] > 0x7FF) + (text[lone] > 0xFFFF)
        score = [n_bytes * pieces.byte_score]
        at = places
        length = 1
        while True:
            keep = node > 0
            at, node = at[keep], node[keep]
            word = pieces.piece[node]
            hit = word >= 0
            start.append(at[hit])
            end.append(at[hit] + length)
            piece.append(word[hit])
            score.append(pieces.scores[word[hit]])
            more = pieces.inner[node]
            at, node = at[more], node[more]
            if not len(at):
                break
            node = pieces.step(node, letters[at + length])
            length += 1
        start, end, piece, score = map(np.concatenate, (start, end, piece, score))
        order = np.argsort(end, kind="stable")  # edges came by length
        start, end, piece, score = start[order], end[order], piece[order], alpha * score[order]

        # no edge passes over a cut, so sums start anew there: places are filtered in layers of their distance from the cut before
        size = len(text) + 1
        cut = np.cumsum(np.bincount(start + 1, minlength=size) - np.bincount(end, minlength=size)) == 0
        last = np.maximum.accumulate(np.where(cut, np.arange(size), 0))
        depth = end - last[end - 1]
        total = np.where(cut, 0.0, -np.inf)
        share = np.empty(len(start))
        layered = np.argsort(depth, kind="stable")
        layers = np.searchsorted(depth[layered], np.arange(1, depth.max(initial=0) + 2))
        for low, high in zip(layers[:-1], layers[1:], strict=True):
            edges = layered[low:high]
            if not len(edges):
                continue
            to, weight = end[edges], total[start[edges]] + score[edges]
            heads = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(weight, heads)
            n = np.diff(heads, append=len(to))
            part = np.exp(weight - np.repeat(top, n))
            sums = np.add.reduceat(part, heads)
            total[to[heads]] = np.where(cut[to[heads]], 0.0, top + np.log(sums))
            share[edges] = part / np.repeat(sums, n)
        weight = np.maximum(1, np.rint(share * UNITS)).astype(np.int64)
        self.start, self.piece = start, piece
        upto = np.cumsum(weight)
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        n = np.diff(heads, append=len(end))
        self.upto = upto - np.repeat(upto[heads] - weight[heads], n)
        self.first, self.sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.first[end[heads]], self.sum[end[heads]] = heads, self.upto[heads + n - 1]

    def sample(self, chunk: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, place, edge) of sampled segmentations, last edges first. key: a random 64-bit number an occurrence."""
        at, who, out = self.ends[chunk], np.arange(len(chunk)), []
        first = self.starts[chunk]
        turn = 0
        while len(who):
            u = (mixed(key ^ mixed(np.array([turn], np.uint64))) >> np.uint64(33)).astype(np.int64)
            drawn = u * self.sum[at] >> 31
            edge = self.first[at]
            on = np.flatnonzero(self.upto[edge] <= drawn)
            while len(on):
                edge[on] += 1
                on = on[self.upto[edge[on]] <= drawn[on]]
            out.append((who, at, edge))
            at = self.start[edge]
            go = at > first
            at, who, first, key = at[go], who[go], first[go], key[go]
            turn += 1
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, np.int64),) * 3


def encode_texts(texts: list[str | None], keys: list, pieces: Pieces, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the sampled ids of text i are ids[bounds[i]:bounds[i + 1]]."""
    ids, sizes, split, rows, first, held = [], [], [], [], [], 0

    def encode_split() -> None:
        found, ends = _encode_chunks(split, np.array(rows, np.uint64), np.array(first, np.int64), pieces, alpha)
        ids.append(found)
        for size, at in zip(np.diff(ends).tolist(), first, strict=True):
            if at:
                sizes[-1] += size
            else:
                sizes.append(size)

    for text, key in zip(texts, keys, strict=True):
        chunks = _CHUNK.findall(" " + text) if text else []
        upto = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        at = 0
        while at == 0 or at < len(chunks):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_LETTERS, side="right")))
            split.append(chunks[at:end])
            rows.append(xxhash.xxh64_intdigest(repr(key).encode(), seed))
            first.append(at)
            held += int(upto[min(end, len(chunks)) - 1] - (upto[at - 1] if at else 0)) if chunks else 0
            at = end
            if held >= SLICE_LETTERS:
                encode_split()
                split, rows, first, held = [], [], [], 0
    if split:
        encode_split()
    return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


def _encode_chunks(split: list[list[str]], rows: np.ndarray, first: np.ndarray, pieces: Pieces, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts for runs of chunks of rows (hashes of their keys); first: the place of each run's first chunk in its text.

    Chunks that were met twice in a worker's first slice keep their lattice, as
    they come again; the rest have one for this slice.
    """
    kept: tuple[dict[str, int], Lattice] | None = pieces.kept.get(alpha)
    known: dict[str, int] = dict(kept[0]) if kept else {}
    old, code = len(known), known.setdefault
    codes = np.fromiter((code(c, len(known)) for chunks in split for c in chunks), np.int64)
    if not len(codes):
        return np.empty(0, np.int32), np.zeros(len(split) + 1, np.int64)
    chunks = list(known)
    if not kept:
        often = [chunks[i] for i in np.flatnonzero(np.bincount(codes) > 1)]
        if len(often) >= WORTH_KEEPING:
            pieces.kept[alpha] = ({c: i for i, c in enumerate(often)}, Lattice(pieces, often, alpha))
    n = np.fromiter(map(len, split), np.int64, len(split))
    within = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n - first, n)
    random = mixed(np.repeat(rows, n) + mixed(within.astype(np.uint64)))
    found = []
    for lattice, at, shift in ((kept and kept[1], np.flatnonzero(codes < old), 0), (Lattice(pieces, chunks[old:], alpha), np.flatnonzero(codes >= old), old)):
        if len(at):
            who, place, edge = lattice.sample(codes[at] - shift, random[at])
            start = lattice.start[edge]
            found.append((at[who], place - lattice.starts[codes[at[who]] - shift], lattice.piece[edge], lattice.text[start]))
    who, place, ids, letter = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(who * (int(place.max()) + 1) + place)
    who, ids, letter = who[order], ids[order], letter[order]
    if (lone := ids < 0).any():  # letters in bytes take the place of their edge
        spelt = [pieces.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in letter[lone].tolist()]
        size = np.ones(len(ids), np.int64)
        size[lone] = [len(b) for b in spelt]
        who, ids, lone = np.repeat(who, size), np.repeat(ids, size), np.repeat(lone, size)
        ids[lone] = np.concatenate(spelt)
    per_text = np.bincount(np.repeat(np.arange(len(split)), n)[who], minlength=len(split))
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(per_text)])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(df: DataFrame, model_path: str, alpha: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int), a sampled segmentation of each text.

    alpha: 0 draws all segmentations alike, larger values the likelier ones more often.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = encode_texts(batch.column(1).to_pylist(), batch.column(0).to_pylist(), pieces_of(model_path), alpha, seed)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return map_batches(_keyed(df, id_col, text_col), f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>", work, SLICE_LETTERS)


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of any ids of the model."""
    spelt = _spellings(pieces)
    raw = b"".join([spelt[i] for i in ids.tolist()])
    return raw.decode("utf-8", "surrogatepass" if b"\xed" in raw else "replace").removeprefix(" ")


def _spellings(pieces: Pieces) -> list[bytes]:
    if not hasattr(pieces, "spelt"):
        pieces.spelt = [name.replace(SPACE, " ").encode() for name in pieces.names]
        for b, i in enumerate(pieces.byte_ids):
            pieces.spelt[i] = bytes([b])
    return pieces.spelt


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text, from ids; null ids have a null text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        flat, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        texts = [decode_ids(flat[i:j], pieces_of(model_path)) if ok else None for i, j, ok in zip(bounds[:-1], bounds[1:], column.is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), f"doc_id {df.schema[id_col].dataType.simpleString()}, text string", work)


def round_trip(df: DataFrame, model_path: str, alpha: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit numbers) and lossless: whether the sampled ids decode to the text."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, pieces = batch.column(1).to_pylist(), pieces_of(model_path)
        flat, bounds = encode_texts(texts, batch.column(0).to_pylist(), pieces, alpha, seed)
        rows = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts, strict=True))
        back = [decode_ids(flat[i:j], pieces) == t for i, j, t in rows]
        digests = [hashlib.sha256(flat[i:j].astype("<u4").tobytes()).hexdigest() for i, j, _ in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "lossless"])

    return map_batches(_keyed(df, id_col, text_col), f"doc_id {df.schema[id_col].dataType.simpleString()}, n_ids long, ids_sha256 string, lossless boolean", check, SLICE_LETTERS)
