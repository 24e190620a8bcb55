"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their four
16-bit sections. Two fingerprints at a distance d have section counts whose
absolute differences sum to d at most, so a tile meets only the tiles within
the radius; in a task numpy compares the pairs by exclusive or and bit count.
Every tile hands on a spanning forest of its links, so no group of copies is
turned into all its pairs, and no link between different fingerprints is lost.

keep_one, the pipeline's stage, has a rule of its own: texts are near copies if
their sets of five-word shingles have a Jaccard similarity of 0.8 or more. The
fingerprints of such texts differ by up to some 20 bits, too many for tiles, so
candidates are dealt by bands of MinHash values, passed on if their fingerprints
lie within a wide radius, and each pair is confirmed by its exact similarity.
Members of a bucket first meet its first and a few others, which is enough to
join copies. Buckets that then still hold members of several components are
compared in tiles by numpy, in rounds: of each two components a comparison hands
on the closest few pairs that the bounds allow, these are confirmed, and what
they join is one component in the next round, which hands on more, and only of
the buckets that had more. The rounds end when no comparison held anything back,
so no link is lost to the size of a bucket, and two groups that are joined cost
a few pairs, not all of theirs. The bounds lose nothing: sets of a similarity of
0.8 differ in a ninth of their summed sizes at most, and so do their sizes and
the parity bits of their shingles' hashes. The wide radius can lose a link: the
fingerprints of two large sets of a similarity of 0.8 differ by 10 bits on
average with a deviation of 3, so by more than 24 about once in 100,000 such
pairs; small sets vary more and are let through whatever their fingerprints.

Defined results: a null text counts as empty; a text of one or two words has
one shingle, a text without words the fingerprint zero, linked like any other;
repeated rows keep their rows; rows with a null id link others only through
their fingerprint and get the group's smallest id (null if there is none);
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.llm.common import hot_keys, join_unique, map_batches, written

#: The fixed values of the fingerprint.
SEED, SHINGLE, BITS = 42, 3, 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fingerprints of one tile that one task compares; larger tiles are split.
FINGERPRINTS_A_SPLIT = 4_000_000
#: Rows and columns of one comparison in memory.
BLOCK = 2048
#: The rule of keep_one: words of a shingle, the least similarity of near copies, and the bits by which their fingerprints may differ.
STAGE_SHINGLE, SIMILARITY, WIDE = 5, 0.8, 24
#: Two sets with fewer members than this together may differ by any number of bits.
SMALL_SETS = 40
#: The pairs of two components that one comparison hands on in the first round, and how many times as many in each further one.
CLOSEST, FURTHER = 4, 256
#: Bands of MinHash values and values a band (a pair at the least similarity shares a band with probability 0.9996), the members before it that a member of a bucket meets at first, besides the first, members of a bucket that one task holds, and the members by members that it compares at a time.
BANDS, VALUES, NEIGHBOURS, MEMBERS_A_SPLIT, MEMBERS_AT_ONCE = 20, 5, 4, 16_384, 1024
#: Ids of documents that may be broadcast (16 MB); more are joined by a shuffle.
IDS_AT_MOST = 1_000_000
#: Bits of the parities of a set's hashes.
PARITIES = 256
#: A column of keep_one's own.
DIGEST = "digest of the text in keep_one"
_RANDOM = np.random.default_rng(SEED).integers(0, 2**64, (3, BANDS * VALUES), np.uint64) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in order; a text without words has none."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def _majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: bit b is set if it is set in over half the shingles' hashes."""
    return _majority(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, fp long", work)


def _forest(own: np.ndarray, other: np.ndarray, radius: int) -> pa.RecordBatch:
    """A spanning forest, as links a, b, of the links between two sets of fingerprints.

    Labels of nodes are merged row by row of each compared block, so that a
    block in which all are near costs no more memory than any other.
    """
    label = np.arange(len(own) + len(other))
    for i in range(0, len(own), BLOCK):
        for j in range(0, len(other), BLOCK):
            near = np.bitwise_count(own[i : i + BLOCK, None] ^ other[None, j : j + BLOCK]) <= radius
            for row in np.flatnonzero(near.any(axis=1)):
                met = np.append(label[len(own) + j + np.flatnonzero(near[row])], label[i + row])
                if (least := met.min()) != met.max():
                    label[np.isin(label, met)] = least
    fp = np.concatenate([own, other]).view(np.int64)
    a, b = fp, fp[label]
    return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])


def tile_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links a, b between fingerprints within the radius.

    distinct: fp long, one row a fingerprint.
    Each fingerprint is at home in one tile and split, and visits the splits
    and neighbouring tiles that come before its own, so each pair meets once.
    """
    # a quarter of 65 in base 32 leaves room for neighbours below 0 and above 16
    section = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) for k in range(4)]
    home = sum(((s + 8).cast("long") * 32**k for k, s in enumerate(section[1:], 1)), (section[0] + 8).cast("long"))
    steps = sorted({sum(x * 32**k for k, x in enumerate(d)) for d in product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, d)) <= radius})
    before = [s for s in steps if s < 0]
    rows = distinct.select("fp", home.alias("tile"))
    tiles = rows.groupBy("tile").agg((1 + F.floor(F.count("*") / FINGERPRINTS_A_SPLIT)).cast("int").alias("splits"))
    tiles = F.broadcast(written(tiles, "tiles"))  # 17 ** 4 rows at most
    homes = rows.join(tiles, "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("splits")).cast("int").alias("own"), "fp")
    here = homes.select("tile", F.col("own").alias("split"), F.lit(0).alias("visit"), "fp")
    visits = rows.select(F.explode(F.array(*[F.col("tile") + s for s in before])).alias("tile"), "fp").join(tiles, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(1).alias("visit"), "fp")
    within = homes.filter("own > 0").select("tile", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("split"), F.lit(1).alias("visit"), "fp")
    dealt = here.union(visits).union(within).repartition("tile", "split").sortWithinPartitions("tile", "split", "visit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted: those at home in a tile are kept, then visitors pass by."""
        key, kept = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, split, visit, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(split) != 0) | (np.diff(visit) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if (now := (int(tile[i]), int(split[i]))) != key:
                    key, kept = now, []
                some = fp[i:j].view(np.uint64)
                if visit[i] == 0:
                    kept.append(some)
                for own in kept:
                    yield _forest(own, some, radius)

    return dealt.mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for every node of the links a, b.

    Labels spread along the links and then jump to the label's own label, until
    no label changes; each round is a written table.
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("near")).alias("component")), "labels")
    hubs = hot_keys(both, "near")
    while True:
        spread = join_unique(both, labels.withColumnRenamed("node", "near"), "near", hot=hubs).groupBy("node").agg(F.min("component").alias("found"))
        best = written(labels.join(spread, "node").select("node", "component", F.least("component", "found").alias("best")), "best")
        jumped = join_unique(best, labels.select(F.col("node").alias("best"), F.col("component").alias("far")), "best", "left")
        changes = Observation()
        after = jumped.select("node", F.least("best", F.coalesce("far", "best")).alias("to"), "component").observe(changes, F.count_if(F.col("to") < F.col("component")).alias("n"))
        labels = written(after.select("node", F.col("to").alias("component")), "labels")
        if not changes.get["n"]:
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable by links), a row for each row of df."""
    prints = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    linked = written(distinct.join(components(tile_links(distinct, radius)), F.col("fp") == F.col("node")).select("fp", "component", "rep"), "linked")
    roots = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = distinct.join(join_unique(linked, roots, "component").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return join_unique(prints, of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles."""
    return np.unique(shingle_hashes(text, STAGE_SHINGLE))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _bands(own: np.ndarray) -> np.ndarray:
    """A hash of each band of the set's MinHash values; none for an empty set."""
    if not len(own):
        return own
    low = np.full(BANDS * VALUES, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 4096):  # bounded memory for very long texts
        low = np.minimum(low, ((own[at : at + 4096, None] ^ _RANDOM[0]) * _RANDOM[1]).min(axis=0))
    return (low * _RANDOM[2]).reshape(BANDS, VALUES).sum(axis=1, dtype=np.uint64)


def _parities(own: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether the set holds an odd number of them. Two sets' bits differ at most as often as the sets do."""
    counts = np.bincount((own * _RANDOM[2, 0] >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES)
    return np.packbits(counts & 1).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the set of shingles), fp (the set's SimHash), bands, size and parities of each row of docs (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        nodes, prints = (np.fromiter(map(f, sets), np.uint64, len(sets)).view(np.int64) for f in (_node, _majority))
        bands = [_bands(own) for own in sets]
        ends = pa.array(np.cumsum([0, *map(len, bands)]), pa.int32())
        banded = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bands).view(np.int64)))
        sizes, parities = pa.array([len(own) for own in sets], pa.int64()), pa.array(map(_parities, sets), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array(prints), banded, sizes, parities], ["doc_id", "node", "fp", "bands", "size", "parities"])

    return map_batches(docs, "doc_id long, node long, fp long, bands array<long>, size long, parities binary", work)


def _within(differing: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether fingerprints that differ in these bits lie within the wide radius, for sets of a summed size."""
    return (np.bitwise_count(differing.view(np.uint64)) <= WIDE) | (total < SMALL_SETS)


def candidate_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs a, b of nodes that share a band and whose fingerprints lie within the wide radius; a pair can come once a band.

    distinct: node, fp, bands, size, one row a node.
    A member of a bucket meets the bucket's first and the few before itself, so
    a large group costs no more than its size.
    """
    dealt = distinct.select(F.explode("bands").alias("band"), "node", "fp", "size").repartition("band").sortWithinPartitions("band", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted: the last bucket's first and last members are carried to the next batch."""
        carried = [np.empty(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(carried[0])
            band, node, fp, size = (np.concatenate([c, batch.column(k).to_numpy(zero_copy_only=False)]) for k, c in enumerate(carried))
            at = np.arange(len(band))
            first = np.maximum.accumulate(np.where(np.diff(band, prepend=~band[0]) != 0, at, 0))
            found = []
            for met in (first, *(np.maximum(at - back, first) for back in range(1, NEIGHBOURS + 1))):
                use = (met < at) & (at >= old) & _within(fp ^ fp[met], size + size[met])
                found.append((node[met[use]], node[use]))
            keep = np.unique([first[-1], *range(max(first[-1], len(at) - NEIGHBOURS), len(at))])
            carried = [band[keep], node[keep], fp[keep], size[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found, strict=True)], ["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long")


def large_buckets(distinct: DataFrame) -> DataFrame:
    """band and node of the members of the buckets in which candidate_pairs() passes pairs over."""
    banded = distinct.select("node", F.explode("bands").alias("band"))
    large = written(banded.groupBy("band").count().filter(F.col("count") > NEIGHBOURS + 2).select("band"), "large")
    return written(join_unique(banded, large, "band", hot=hot_keys(banded, "band")), "members")


def remaining_pairs(distinct: DataFrame, members: DataFrame, labels: DataFrame, closest: int) -> DataFrame:
    """Pairs a, b of nodes of different components (labels: node, component) that share a bucket (members: band, node) and lie within the wide radius and the bounds.

    A comparison of two blocks of members hands on the closest few of the pairs
    that two components have in it; where there were more, their rows have the
    bucket's band, else null. A bucket with many members is dealt to tasks by
    pairs of its splits.
    """
    named = written(members.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "named")
    mixed = named.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    mixed = written(mixed.select("band", (1 + F.floor(F.col("n") / MEMBERS_A_SPLIT)).cast("int").alias("splits")), "mixed")
    rows = join_unique(named, mixed, "band").join(distinct.select("node", "fp", "size", "parities"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    tile = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    placed = met.select(tile.alias("tile"), (F.col("own") > F.col("other")).cast("int").alias("visit"), "node", "fp", "component", "size", "parities", (F.col("own") == F.col("other")).alias("within"), "band")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted: a tile's first split is kept, then the other passes by; a split alone meets itself."""
        key, kept = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, visit, node, fp, component, size, within, band = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 5, 7, 8))
            parities = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(visit) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (now := int(tile[i])) != key:
                    key, kept = now, []
                some = [column[i:j] for column in (node, fp, component, size, parities)]
                if not visit[i]:
                    kept.append(some)
                if visit[i] or within[i]:
                    for own in kept:
                        yield from _apart(own, some, int(band[i]), closest)

    # by size, so that most blocks can't hold similar sets of each other's
    return placed.repartition("tile").sortWithinPartitions("tile", "visit", "size").mapInArrow(compare, "a long, b long, band long")


def _apart(own: list[np.ndarray], other: list[np.ndarray], band: int, closest: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two sets of rows (node, fp, component, size, parities) of different components that lie within the wide radius and can be similar enough by their sizes and parities; the closest few of each two components and block."""
    for i in range(0, len(own[0]), MEMBERS_AT_ONCE):
        for j in range(0, len(other[0]), MEMBERS_AT_ONCE):
            (node, fp, component, size, parities), (node2, fp2, component2, size2, parities2) = ([c[at : at + MEMBERS_AT_ONCE] for c in side] for side, at in ((own, i), (other, j)))
            near = (component[:, None] != component2) & _possible(np.abs(size[:, None] - size2), size[:, None] + size2)
            if near.any():
                near &= _within(fp[:, None] ^ fp2, size[:, None] + size2)
            x, y = np.nonzero(near)
            odd = np.bitwise_count(parities[x] ^ parities2[y]).sum(axis=1, dtype=np.int64)
            keep = _possible(odd, size[x] + size2[y])
            x, y, odd = x[keep], y[keep], odd[keep]
            low, high = np.minimum(component[x], component2[y]), np.maximum(component[x], component2[y])
            order = np.lexsort((odd / np.maximum(size[x] + size2[y], 1), np.bitwise_count((fp[x] ^ fp2[y]).view(np.uint64)), high, low))
            x, y, low, high = x[order], y[order], low[order], high[order]
            starts = np.flatnonzero(np.append(True, (np.diff(low) != 0) | (np.diff(high) != 0))) if len(x) else np.empty(0, np.int64)
            counts = np.diff(np.append(starts, len(x)))
            keep = np.arange(len(x)) - np.repeat(starts, counts) < closest
            a, b = node[x[keep]], node2[y[keep]]
            more = np.repeat(counts > closest, counts)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), band), mask=~more)], ["a", "b", "band"])


def _possible(differing: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of a summed size that differ in at least so many members can be similar enough."""
    return differing * (1 + SIMILARITY) <= total * (1 - SIMILARITY) + 1e-6


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes, each sorted and distinct."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def texts_of(docs: DataFrame, distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) that stand for nodes of distinct (node, rep). Texts aren't shuffled unless there are many ids."""
    reps = written(distinct.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "reps")
    return docs.join(F.broadcast(reps) if reps.count() <= IDS_AT_MOST else reps, "doc_id", "left_semi")


def confirmed(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b of nodes of distinct (node, rep) whose exact similarity is high enough. pairs is a written table; only their texts are read again."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = texts_of(docs, distinct, nodes)

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(_node, sets), np.uint64, len(sets)).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = (batch.column(k).to_pylist() for k in (2, 3))
        near = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILARITY for x, y in zip(*sides, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    sets = written(map_batches(chosen.select("doc_id", "text"), "node long, hashes binary", collect).dropDuplicates(["node"]), "sets")
    both = join_unique(pairs, sets.toDF("a", "own"), "a").join(sets.toDF("b", "other"), "b").select("a", "b", "own", "other")
    return written(map_batches(both, "a long, b long", confirm), "links")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) where further links a, b between nodes join whole components."""
    for side in ("a", "b"):
        links = links.join(labels.toDF(side, f"of {side}"), side, "left").withColumn(side, F.coalesce(f"of {side}", side)).drop(f"of {side}")
    joined = components(links.filter("a != b").select("a", "b"))
    of = labels.unionByName(joined.select("node", F.col("node").alias("component"))).dropDuplicates(["node"])
    return written(of.join(joined.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")


def similar_components(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """node and component of every node with a link.

    Links that candidate_pairs() passed over then join whole components, in
    rounds, until no bucket has pairs of different components left untried. A
    comparison of two blocks holds fewer than MEMBERS_AT_ONCE ** 2 pairs, so
    four rounds are the most.
    """
    labels = components(confirmed(docs, distinct, written(candidate_pairs(distinct).distinct(), "pairs")))
    members, tried, closest = large_buckets(distinct), None, CLOSEST
    while True:
        found = written(remaining_pairs(distinct, members, labels, closest), "closest")
        pairs = found.select("a", "b").distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "untried")
        links = confirmed(docs, distinct, pairs)
        if not links.isEmpty():
            labels = joined_components(labels, links)
        more = found.filter("band IS NOT NULL").select("band").distinct()
        if more.isEmpty():
            return labels
        members = written(join_unique(members, more, "band"), "members")
        docs = written(texts_of(docs, distinct, members), "texts")  # all that further rounds read
        tried = pairs if tried is None else tried.unionByName(pairs)
        closest *= FURTHER


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the row of the smallest id of each group of near copies by five-word shingles.

    Of rows with equal id and text one stays; where different texts share a kept
    id, each of them stays. Rows with a null id all stay and link no others.
    """
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    alike = sketches(docs).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), *[F.first(c).alias(c) for c in ("bands", "size", "parities")])
    distinct = written(alike, "distinct")
    grouped = distinct.select("node", "rep").join(similar_components(docs, distinct), "node", "left")
    first = grouped.groupBy(F.coalesce("component", "node")).agg(F.min("rep").alias(id_col)).select(id_col).distinct()
    kept = df.filter(F.col(id_col).isNotNull()).join(first, id_col, "left_semi")
    kept = kept.select(*df.columns, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias(DIGEST)).dropDuplicates([id_col, DIGEST]).drop(DIGEST)
    return kept.unionByName(df.filter(F.col(id_col).isNull()))
