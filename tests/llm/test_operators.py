"""Each training-data operator against a brute-force version, over small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import catalog, collision_ann, kdtree_shards, language_id, licences, media, packing, sentencepiece_sampling, simhash, toxicity, warc
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component long, shard int, size string"
WORDS = "river stone cloud amber violet forest window candle marble silver garden copper thunder meadow harbour lantern".split()


def long_text(n: int = 60_000) -> str:
    return " ".join(WORDS[(i * 7 + i // 5) % len(WORDS)] + str(i % 97) for i in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, odd letters, and columns whose names clash with the operators' own."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog by the old door"), (2, "the CAT sat on the mat and looked at the dog by the old door"),
        (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one two"), (8, "naïve ﬁ ▁ 🦊 \u0000 <|endoftext|> 1984's"), (9, long_text()),
        (10, "Licensed under the Apache License, Version 2.0.\nplain words"), (10, "Licensed under the Apache License, Version 2.0.\nplain words"),
        (None, "a row without an id"), (None, None), (11, "tail   spaces  "), (12, "x" * 5000),
    ]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None, 7, 8, 9, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


# 1 SentencePiece
def test_sampled_segmentations_are_lossless_and_reproducible(spark, awkward, empty):
    path = public_tokenizers.path(catalog.SAMPLING_MODEL)
    got = sentencepiece_sampling.round_trip(awkward, path).collect()
    assert len(got) == awkward.count() and all(r.lossless for r in got)
    again = sentencepiece_sampling.round_trip(awkward.repartition(3), path).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    other = sentencepiece_sampling.round_trip(awkward, path, seed=1).collect()
    assert Counter(r.ids_sha256 for r in got) != Counter(r.ids_sha256 for r in other)
    decoded = sentencepiece_sampling.decode(sentencepiece_sampling.encode(awkward, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in decoded) == Counter((r.doc_id, r.text or "") for r in awkward.collect())
    assert sentencepiece_sampling.round_trip(empty, path).count() == 0


def test_sampling_follows_the_lattice_weights():
    pieces = sentencepiece_sampling.pieces_of(public_tokenizers.path(catalog.SAMPLING_MODEL))
    word, n, alpha = "the", 20_000, 0.5
    by_name = {pieces.names[i]: pieces.scores[i] for i in range(len(pieces.names))}

    def segmentations(rest):
        if not rest:
            yield ()
        for j in range(1, len(rest) + 1):
            if rest[:j] in by_name:
                yield from ((rest[:j], *more) for more in segmentations(rest[j:]))

    weights = {s: np.exp(alpha * sum(by_name[p] for p in s)) for s in segmentations("▁" + word)}
    total = sum(weights.values())
    ids, bounds = sentencepiece_sampling.encode_texts([word] * n, list(range(n)), pieces, alpha, 0)
    drawn = Counter(tuple(pieces.names[i] for i in ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert set(drawn) <= set(weights)
    for s, w in weights.items():
        assert abs(drawn[s] / n - w / total) < 0.02, s


def test_long_texts_are_sampled_in_runs_and_without_spaces(monkeypatch):
    pieces = sentencepiece_sampling.pieces_of(public_tokenizers.path(catalog.SAMPLING_MODEL))
    texts = ["one two  three four " * 50, None, "abcdefgh漢字かな" * 22_500, "a" * 3000 + " b", ""]
    ids, bounds = sentencepiece_sampling.encode_texts(texts, list(range(5)), pieces, 0.5, 0)
    assert [sentencepiece_sampling.decode_ids(ids[a:b], pieces) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t or "" for t in texts]
    monkeypatch.setattr(sentencepiece_sampling, "SLICE_LETTERS", 64)  # a run of some chunks at a time
    again, ends = sentencepiece_sampling.encode_texts(texts, list(range(5)), pieces, 0.5, 0)
    assert (again == ids).all() and (ends == bounds).all()


# 2 PNG media
def test_png_round_trip_and_features(awkward, empty):
    rows = media.features(media.to_media(awkward)).collect()
    texts = Counter((r.doc_id, r.text or "") for r in awkward.collect())
    assert len(rows) == sum(texts.values())
    by = {(i, hashlib.sha256(p).hexdigest()): p for i, t in texts for p in [t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))]}
    for r in rows:
        payload = by[r.doc_id, r.payload_sha256]
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_bytes % 64 == 0 and r.n_bytes <= r.payload_bytes and len(r.feature) == 16
    assert media.features(media.to_media(empty)).count() == 0


def test_png_checksums_filters_and_hash():
    image = (np.arange(64 * 10).reshape(10, 64) * 7 % 256).astype(np.uint8)
    data = media.encode_png(image.tobytes())
    assert np.array_equal(media.decode_png(data), image)
    damaged = bytearray(data)
    damaged[50] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(bytes(damaged))
    with pytest.raises(ValueError, match="signature"):
        media.decode_png(b"GIF89a" + data[6:])
    # all five filter types undone, against a plain version that filters byte by byte
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, (25, 16)).astype(int)
    kinds = np.array([0, 1, 2, 3, 4] * 5, np.uint8)
    lines = np.zeros((25, 16), np.uint8)
    for y in range(25):
        for x in range(16):
            a, b, c = (raw[y, x - 1] if x else 0), (raw[y - 1, x] if y else 0), (raw[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x] = (raw[y, x] - [0, a, b, (a + b) // 2, nearest][kinds[y]]) % 256
    assert np.array_equal(media.unfilter(kinds, lines), raw)


# 3 k-d tree shards
def test_kdtree_shards_hold_near_equal_bytes(awkward, documents, empty):
    for docs, shards in ((documents, 8), (awkward.withColumn("size", F.lit("clash")), 3)):
        rows = kdtree_shards.shard(docs, kdtree_shards.document_dims(docs), shards).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        held = Counter()
        for r in rows:
            held[r.shard] += r["size"]
        largest = max(r["size"] for r in rows)
        assert max(held.values()) <= sum(held.values()) / shards + 3 * largest
    assert kdtree_shards.shard(empty, kdtree_shards.document_dims(empty), 4).count() == 0


def test_kdtree_divides_a_group_of_equal_rows(spark):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("a").alias("lang"), F.lit("b").alias("source"))
    n = [r["count"] for r in kdtree_shards.shard(docs, kdtree_shards.document_dims(docs), 4).groupBy("shard").count().collect()]
    assert len(n) == 4 and max(n) - min(n) < 100


# 4 SimHash
def brute_components(rows):
    prints = []
    for i, text in rows:
        words = [w for w in simhash.WORD.findall((text or "").encode().translate(simhash._LOWER))]
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        bits = 0
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        for b in range(64):
            bits |= (2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b
        prints.append((i, bits))
    distinct = sorted({p for _, p in prints})
    label = {p: p for p in distinct}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= 2:
                label[root(distinct[a])] = root(distinct[b])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return Counter((i, f"{p:016x}", least.get(root(p))) for i, p in prints)


@pytest.mark.parametrize("splits", [1, 3])
def test_simhash_components_equal_brute_force(spark, awkward, documents, monkeypatch, splits):
    docs = documents.select("doc_id", "text").unionByName(awkward.select(F.col("doc_id") + 1_000_000, "text").toDF("doc_id", "text"))
    if splits > 1:
        monkeypatch.setattr(simhash, "FINGERPRINTS_A_SPLIT", 1)  # as many splits as a tile has fingerprints
    got = Counter(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == brute_components([tuple(r) for r in docs.collect()])


def test_simhash_links_dense_near_fingerprints(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 60, 3) for b in range(0, 60, 3)} | {base ^ 0xFFFF0000, 0})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.component for r in simhash.components(simhash.tile_links(frame)).collect()}
    assert set(got) == {p for p in prints if any(p != q and (p ^ q).bit_count() <= 2 for q in prints)}
    assert len(set(got.values())) == 1


def test_components_with_a_hub_and_a_chain(spark):
    """A hub with half of all links, a chain and a pair; components are those of union-find."""
    links = [(1000, i) for i in range(2000) if i != 1000] + [(i, i + 1) for i in range(5000, 5040)] + [(-5, 9999)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(2000)} | {i: 5000 for i in range(5000, 5041)} | {-5: -5, 9999: -5}


def test_keep_one_keeps_different_texts_of_one_id(spark):
    rows = [(1, "one two three four five six"), (1, "an other text of some more words here"), (1, "one two three four five six"), (2, "one two three four five six")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter(set(rows[:2]))


def test_simhash_keep_one(awkward, empty):
    kept = simhash.keep_one(awkward).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[1] == 1 and ids[2] == 0 and ids[10] == 1 and ids[None] == 2 and simhash.near_duplicates(empty).count() == 0


def test_keep_one_finds_every_pair_of_similar_texts(spark):
    """Kept are exactly the smallest ids of the components by brute-force five-word similarity, also of texts whose op4 fingerprints lie far apart."""
    rng = np.random.default_rng(5)
    rows = []
    for group in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for copy in range(3):
            changed = list(words)
            for at in rng.choice(150, copy * (1 + group % 4), replace=False):
                changed[at] = f"new{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(changed)))
    sets = {i: {tuple(w) for w in zip(*(t.split()[k:] for k in range(5)), strict=False)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    for _ in range(3):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    far = [p for p in links if (simhash.fingerprint(rows[p[0]][1]) ^ simhash.fingerprint(rows[p[1]][1])).bit_count() > 2]
    assert len(far) > 20
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_keep_one_collapses_a_large_group(spark):
    """A bucket over many batches hands on its first and last members."""
    base = [f"w{x}" for x in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"odd{i}", *base[i % 200 :]])) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("ids", [1_000_000, 0])
def test_keep_one_loses_no_link_of_a_large_bucket(spark, monkeypatch, ids):
    """Variants of one text that share buckets but are near copies of a few others only, against brute force, with buckets over several splits."""
    monkeypatch.setattr(simhash, "MEMBERS_A_SPLIT", 40)
    monkeypatch.setattr(simhash, "IDS_AT_MOST", ids)
    rng = np.random.default_rng(11)
    base, rows = [f"w{x}" for x in range(200)], []
    for i in range(300):
        changed = list(base)
        for at in rng.choice(200, 3, replace=False):
            changed[at] = f"odd{i}x{at}"
        rows.append((i, " ".join(changed)))
    sets = [simhash.shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        return i if root[i] == i else top(root[i])

    for b in range(len(rows)):
        for a in range(b):
            if simhash.similarity(sets[a], sets[b]) >= 0.8:
                root[max(top(a), top(b))] = min(top(a), top(b))
    expected = sorted({top(i) for i in range(len(rows))})
    assert 5 < len(expected) < 290
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == expected


def test_keep_one_joins_two_families_by_a_few_pairs(spark, monkeypatch):
    """Two families of 1,000 near copies each, near the similarity of 0.8 but over it only across a few members: they are joined without confirming a pair of each two members."""
    rng = np.random.default_rng(8)
    base, far = [f"w{x}" for x in range(300)], [20, 60, 100, 140, 180, 220]
    apart = [at for at in range(300) if min(abs(at - f) for f in far) > 9]
    other = [f"far{at}" if at in far else word for at, word in enumerate(base)]
    rows = []
    for family in (base, other):
        for i in range(1000):
            changed = list(family)
            at = rng.choice(apart) if i % 25 else rng.choice(far) + 1
            changed[at] = f"odd{len(rows)}"
            rows.append((len(rows), " ".join(changed)))
    sets = [simhash.shingle_set(text) for _, text in rows]
    bits = [np.frombuffer(simhash._parities(own), np.uint64) for own in sets]
    sample = [(a, b) for a in range(0, 1000, 10) for b in range(1000, 2000, 10)]
    allowed = [(a, b) for a, b in sample if simhash._possible(np.bitwise_count(bits[a] ^ bits[b]).sum(dtype=np.int64), np.array(len(sets[a]) + len(sets[b])))]
    near = [p for p in allowed if simhash.similarity(sets[p[0]], sets[p[1]]) >= simhash.SIMILARITY]
    assert len(allowed) > len(sample) // 2 and 0 < len(near) <= len(sample) // 20
    confirmed, tried = simhash.confirmed, []

    def counted(docs, distinct, pairs):
        tried.append(pairs.count())
        return confirmed(docs, distinct, pairs)

    monkeypatch.setattr(simhash, "confirmed", counted)
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert len(tried) > 1 and sum(tried[1:]) < 20_000, tried


def test_rounds_try_every_pair_that_is_held_back(spark, monkeypatch):
    """With one pair a round and block of two, rounds go on until the one pair that joins two groups is met, however far down the order it is."""
    rng = np.random.default_rng(2)
    nodes = np.arange(40)
    prints = [int(x) for x in rng.integers(0, 2**20, 40)]
    rows = [(int(n), p, 300, bytes(simhash.PARITIES // 8), [1]) for n, p in zip(nodes, prints, strict=True)]
    distinct = spark.createDataFrame(rows, "node long, fp long, size long, parities binary, bands array<long>")
    labels = spark.createDataFrame([(int(n), int(n) // 20 * 20) for n in nodes], "node long, component long")
    members = simhash.large_buckets(distinct)
    assert members.count() == 40
    want = {(a, b) for a in range(20) for b in range(20, 40) if (prints[a] ^ prints[b]).bit_count() <= simhash.WIDE}
    met = []
    for closest in (1, 8, 64, 1024):
        found = simhash.remaining_pairs(distinct, members, labels, closest).collect()
        pairs = {(r.a, r.b) for r in found}
        assert pairs <= want and all((r.band == 1) == (closest < len(want) * 2) for r in found)
        met.append(pairs)
    assert len(met[0]) == 1 and met[-1] == want and all(x < y for x, y in zip(met, met[1:], strict=False))


def test_keep_one_keeps_small_sets_whatever_their_fingerprints(spark):
    """Texts of eight words that share four of five shingles are near copies, although their fingerprints can differ by many bits."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 9)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:8]))]
    bits = [(simhash._majority(simhash.shingle_set(rows[i][1])) ^ simhash._majority(simhash.shingle_set(rows[i + 1][1]))).bit_count() for i in range(0, 800, 2)]
    assert max(bits) > 15
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == list(range(0, 800, 2))


def test_bounds_of_similar_sets_lose_nothing():
    """Whatever is similar enough passes the bounds of sizes and parities."""
    rng = np.random.default_rng(3)
    passed = 0
    for _ in range(400):
        own = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64))
        other = np.unique(np.concatenate([own[rng.random(len(own)) > rng.random() * 0.3], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)]))
        if len(other) and simhash.similarity(own, other) >= simhash.SIMILARITY:
            bits = [np.frombuffer(simhash._parities(x), np.uint64) for x in (own, other)]
            total = np.array(len(own) + len(other))
            assert simhash._possible(np.bitwise_count(bits[0] ^ bits[1]).sum(dtype=np.int64), total) and simhash._possible(np.array(abs(len(own) - len(other))), total)
            passed += 1
    assert passed > 50


# 5 WARC
def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "payload " * 20 + str(i % 4)) for i in range(40)]
    rows += [(100, None, None), (101, "http://a/b c", ""), (102, "u", "short"), (103, "u", "short"), (None, "u", "payload " * 20 + "0"), (5, "http://a/5", "payload " * 20 + "1"), (200, "u", "é🦊" * 30_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, shard string")
    out = [f"file://{tmp_path}/{k}" for k in "ab"]
    for path in out:
        manifest = warc.write_archive(pages.repartition(3), path, shard_bytes=2000, file_bytes=1500)
    got = [tuple(r) for r in warc.read_archive(spark, out[0]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()]
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    want, met = Counter(), set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = i is not None and len(raw) >= 100 and (first[raw] != i or (i, raw) in met)
        met.add((i, raw))
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None, None if again else raw] += 1
    assert Counter((*r[:5], None if r[5] is None else bytes(r[5])) for r in got) == want
    names = [{p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / k).glob("*.warc.gz")} for k in "ab"]
    assert names[0] == names[1] and len(names[0]) > 5 and not list(tmp_path.glob("*/_temporary"))
    assert {r.file: r.sha256 for r in manifest.collect()} == names[1]


def test_warc_shards_stay_even_with_odd_ids(spark, tmp_path):
    """One far id, a repeated row and rows without an id, each a third of the bytes or more than a shard, don't make one shard large."""
    text = [f"{i} " + "payload " * 50 for i in range(300)]
    rows = [(i, f"u{i}", text[i]) for i in range(300)] + [(-(2**62), "far", "far " * 100), (2**62, None, "far " * 101)]
    rows += [(7, "u7", text[7])] * 150 + [(7, f"v{i}", text[7]) for i in range(50)] + [(None, f"n{i % 3}", text[9]) for i in range(150)] + [(None, None, None)] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    digests = []
    for name in "ab":
        manifest = warc.write_archive(pages.repartition(4), f"file://{tmp_path}/{name}", shard_bytes=20_000)
        digests.append({r.file: r.sha256 for r in manifest.collect()})
    assert digests[0] == digests[1]
    sizes = [r.n for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 12 and max(sizes) <= 120
    got = warc.read_archive(spark, f"file://{tmp_path}/b").collect()
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter((i, hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert Counter(r.url for r in got if r.page_id == 7) == Counter({"u7": 151} | {f"v{i}": 1 for i in range(50)})
    sevens = [r for r in got if r.page_id == 7]
    assert [r.record_type for r in sevens].count("response") == 1 and all(r.refers_to == 7 for r in sevens if r.record_type == "revisit")
    assert all(r.record_type == "response" for r in got if r.page_id != 7)


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 6 language mixture
def test_language_accuracy_on_held_out_rows(spark):
    rows = catalog.op6_language_mixture(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred != 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) > 0


def test_language_mixture_and_edges(awkward, empty):
    shares = np.full((language_id.BUCKETS, 2), 1e-6)
    texts = ["the quick brown fox jumps over the lazy dog " * 20, "der schnelle braune fuchs springt über den faulen hund " * 20]
    for k, t in enumerate(texts):
        shares[:, k] += np.bincount(language_id.trigrams(t), minlength=language_id.BUCKETS)
    model = language_id.Model(["de" if k else "en" for k in range(2)], shares / shares.sum(axis=0))
    both = model.mixture(texts[0] + texts[1])
    share = len(texts[0]) / len(texts[0] + texts[1])
    assert set(both) == {"en", "de"} and abs(both["en"] - share) < 0.1
    assert model.mixture(texts[0]) == {"en": pytest.approx(1.0)}
    found = {r.doc_id: r for r in language_id.predict(awkward, model).collect()}
    assert len(found) == len({r.doc_id for r in awkward.collect()}) and found[3].lang_pred == found[4].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(awkward, nothing).collect()} == {"und"}


def test_maximisation_equals_a_grid_search():
    """Shares of two languages are those of the best likelihood over a fine grid."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(50, 0.3), 2).T + 1e-6
    for true in (0.1, 0.5, 0.8):
        n = rng.multinomial(5000, (p @ [true, 1 - true]) / (p @ [true, 1 - true]).sum()).astype(float)
        share, fit = language_id.Model._maximise(p, n, np.array([0.5, 0.5]))
        grid = np.linspace(0, 1, 2001)
        fits = np.array([n @ np.log(p @ [g, 1 - g]) for g in grid])
        assert abs(share[0] - grid[fits.argmax()]) < 0.01 and fit >= fits.max() - 0.05


# 7 collision counting
def test_nearest_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    v = centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 16)) * 0.6
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, [float("inf")] * 16), (3005, [1.0]), (None, [1.0] * 16), (3050, v[0].tolist()), (3006, [])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, rank int, score int")
    got = collision_ann.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect()
    ids, all_v = np.array([*range(3000), 3050]), np.vstack([v, v[:1]])
    unit = all_v / np.linalg.norm(all_v, axis=1)[:, None]
    hits = 0
    queries = [i for i in ids if i % 50 == 0]
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append(r)
    assert set(found) == set(queries)
    for q in queries:
        cosine = unit @ unit[np.flatnonzero(ids == q)[0]]
        best = [i for i in np.lexsort((ids, -cosine)) if ids[i] != q][:5]
        mine = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(mine, mine[1:], strict=False))
        assert all(abs(r.score - cosine[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in mine)
        hits += len({int(ids[i]) for i in best} & {r.vec_id for r in mine})
    assert hits >= 0.9 * 5 * len(queries)
    few = collision_ann.nearest(frame.filter("vec_id < 3"), F.col("vec_id") == 0, 5).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert collision_ann.nearest(frame.filter("vec_id < 0"), F.col("vec_id") == 0, 5).count() == 0


def test_nearest_neighbours_over_several_shards_and_passes(spark, monkeypatch):
    monkeypatch.setattr(collision_ann, "SHARD_ROWS", 150)
    monkeypatch.setattr(collision_ann, "PASSING", 4)
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    ids, unit = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits, queries = 0, [i for i in ids if i % 50 == 0]
    found = defaultdict(set)
    for r in collision_ann.nearest(frame, F.col("vec_id") % 50 == 0, 5).collect():
        found[r.query_id].add(r.vec_id)
    for q in queries:
        cosine = unit @ unit[np.flatnonzero(ids == q)[0]]
        hits += len(found[q] & {int(ids[i]) for i in [j for j in np.lexsort((ids, -cosine)) if ids[j] != q][:5]})
    assert len(found) == len(queries) and hits >= 0.9 * 5 * len(queries)


def test_nearest_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((60, 8)), 1)]
    rows += [(0, (np.array(rows[9][1]) * 1e200).tolist()), (100, (np.array(rows[9][1]) * 1e-200).tolist()), (101, [1.7e308] * 8), (150, [5e-324] * 8)]
    got = collision_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 2).collect()
    best = defaultdict(dict)
    for r in got:
        best[r.query_id][r["rank"]] = (r.vec_id, round(r.score, 12))
    assert set(best[0].values()) == {(10, 1.0), (100, 1.0)} and set(best[100].values()) == {(0, 1.0), (10, 1.0)}
    assert best[150][1] == (101, 1.0)


# 8 toxicity
def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = catalog.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_automaton_equals_edit_distance_and_context():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = ["scumbag", "idiotic", "moron", "worthless", "vile"]
    trie = toxicity.Trie(terms, [])
    for word in ["scumbag", "scmbag", "scunbagg", "idiotc", "moroon", "wortless", "wurthles", "vile", "vil", "mat", "orthless", "scumm"]:
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.edits(t)]
        found = trie.near(word)
        assert (found and (found[1], found[0])) == (min(near) if near else None), word
        if near and min(near)[0]:
            assert trie.may_be_near(word), word
    model = toxicity.Model(["scumbag"], [], weights=[-3.0, 4.0, 4.0, 3.2, 2.0, -0.5])
    assert model.score("you scumbag") >= 0.5 > model.score('He said "scumbag" is a word') and model.score("you scunbag") >= 0.5
    assert model.score(None) == model.score("") < 0.5


def test_toxicity_without_labels(spark, awkward, empty):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(awkward, labels, F.lit(False)))
    assert {r.score < 1e-9 for r in toxicity.score(awkward, model).collect()} == {True}
    assert toxicity.keep_clean(awkward, model).count() == awkward.count() and toxicity.score(empty, model).count() == 0


# 9 packing
def check_packing(rows, docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(catalog.PACKING_TOKENIZER))
    want = Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    tokens = sum(r.length for r in rows)
    return len(by), -(-tokens // capacity)


def test_packing_is_exact_and_tight(spark, awkward, documents, empty):
    path = public_tokenizers.path(catalog.PACKING_TOKENIZER)
    used, least = check_packing(packing.pack(documents, path).collect(), [(r.doc_id, r.text) for r in documents.collect()], 2048)
    assert used <= least * 1.03 + 1
    check_packing(packing.pack(awkward, path, capacity=256).collect(), [(r.doc_id, r.text) for r in awkward.collect()], 256)
    assert packing.pack(empty, path).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    for histogram in ({5: 3}, {2048: 10}, {1: 5000}, dict(Counter(rng.integers(1, 2049, 3000).tolist())), dict(Counter((rng.lognormal(5, 1, 20_000).astype(int) % 2048 + 1).tolist()))):
        runs, sequences = packing.plan(dict(histogram))
        ranks, filled = defaultdict(list), defaultdict(int)
        for length, rank, n, sequence, _ in runs:
            ranks[length] += range(rank, rank + n)
            for s in range(sequence, sequence + n):
                filled[s] += length
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        assert max(filled.values()) <= 2048 and len(filled) == sequences
        best = max(-(-sum(k * n for k, n in histogram.items()) // 2048), sum(n for k, n in histogram.items() if k > 1024))
        assert sequences <= best * 1.03 + 1


def test_packing_refuses_other_tokenizers():
    with pytest.raises(ValueError, match="lower-case"):
        packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))


# 10 licences
def test_license_scan(awkward, empty):
    rows = licences.scan(awkward).collect()
    assert [(r.doc_id, r.line, r.licence) for r in rows] == [(10, 0, "Apache-2.0")] * 2
    scanner = licences.Scanner()
    cases = {
        "Released under the MIT License.": "MIT", "released  under the mit license": "MIT", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.": "CC0-1.0",
        "You need a licence to drive a car in this country": None, "Licensed under the Apache Licence of nothing": None,
    }
    assert {t: scanner.match(t).licence for t in cases} == cases
    assert licences.scan(empty).count() == 0
    far = "word " * 3000 + "Licensed under the Apache License, Version 2.0." + " word" * 3000
    assert "Apache-2.0" in {scanner.match(b).licence for _, b in licences.blocks(far)}


def test_every_notice_is_found_in_long_prose(spark):
    """Each template stands word for word in prose of any length; every licence of a block has its row."""
    rows, want = [], []
    for i, (licence, template) in enumerate(licences.TEMPLATES):
        for size in (100, 900, 9000):
            prose = long_text(size // 8)
            rows.append((len(rows), f"{prose}. {template.replace('*', 'Jane Q. Doe')} {prose}"))
            want.append((rows[-1][0], licence))
    rows.append((len(rows), "Released under the MIT License. " + long_text(100) + " Licensed under the ISC License."))
    want += [(rows[-1][0], "MIT"), (rows[-1][0], "ISC")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("licence is not null").collect()
    assert Counter((r.doc_id, r.licence) for r in got) == Counter(want)
    assert all(r.saving > 0.3 for r in got)


@pytest.mark.parametrize(("first", "mark", "last"), [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */"), ("<!--\n", "", "\n-->"), ("", "-- ", ""), ("", "> ", "")])
def test_wrapped_notices_are_found(spark, first, mark, last):
    """Notices wrapped over lines, also in comments, have a row with the line they start at."""
    wrap = lambda t: [" ".join(t.split()[k : k + 6]) for k in range(0, len(t.split()), 6)]
    long = {name: t for name, t in licences.TEMPLATES if len(t) > 100}
    rows = [(i, "import this\n\n" + first + "\n".join(mark + x for x in ["Some words first", *wrap(t)]) + last + "\n\nmore") for i, t in enumerate(long.values())]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("licence is not null").collect()
    assert sorted((r.doc_id, r.licence, r.line) for r in got) == [(i, name, 3 + first.count("\n")) for i, name in enumerate(long)]
    apart = "Permission is hereby granted, free of charge,\n\n" + long["MIT"].split(",", 2)[2]
    assert all(m.licence is None for _, b in licences.blocks(apart) for m in licences.Scanner().matches(b))


def test_licences_of_all_documents_equal_a_plain_search(spark, documents):
    """Every place of every template in every paragraph of the table, by comparing word lists at each place."""
    want = set()
    templates = [(name, licences.words(t)) for name, t in licences.TEMPLATES + licences.TAGS if "*" not in t]
    rows = documents.select("doc_id", "text").collect()
    for r in rows:
        for content, _, _ in licences.paragraphs(r.text or ""):
            own = licences.words(content)
            for name, t in templates:
                if any(own[i : i + len(t)] == t for i in range(len(own) - len(t) + 1)):
                    want.add((r.doc_id, name))
    starred = [(name, t.split("*")) for name, t in licences.TEMPLATES if "*" in t]
    want |= {(r.doc_id, name) for r in rows for name, (a, b) in starred if a.strip().lower() in (r.text or "").lower() and licences.words(b)[0] in licences.words(r.text or "")}
    got = {(r.doc_id, r.licence) for r in licences.scan(documents).filter("licence is not null").collect()}
    assert got == want and len(want) >= 5


def test_license_tags(spark):
    rows = [(1, "// SPDX-License-Identifier: MIT\ncode"), (2, "# SPDX-License-Identifier: GPL-3.0-or-later"), (3, "SPDX-License-Identifier: Nothing-1.0")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.licence) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, "MIT"), (2, "GPL-3.0"), (3, None)]


def test_compression_picks_what_wording_confirms():
    """Fillers and spellings are no differences; negations, missing words and other versions are; an expression gives each of its identifiers."""
    scanner = licences.Scanner()
    cases = {
        "Released under the terms of the MIT License.": {"MIT"}, "Distributed under the MIT Licence.": {"MIT"}, "Licensed under the GNU General Public License, version 3 or later": {"GPL-3.0"},
        "This is not licensed under the MIT License.": set(), "It isn't released under the MIT License.": set(), "Licensed under the GNU General Public License, version 9": set(),
        "SPDX-License-Identifier: MIT OR Apache-2.0": {"MIT", "Apache-2.0"}, "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSL-1.0": {"GPL-2.0", "BSL-1.0"},
        "SPDX-License-Identifier: EPL-2.0 for now, and MIT": {"EPL-2.0"},
    }
    assert {t: {m.licence for m in scanner.matches(t)} - {None} for t in cases} == cases
    (filled,) = scanner.matches("Released under the terms of the MIT License.")
    assert (filled.missing, filled.extra) == (0, 3)
    ranked = scanner._ranked("some words. Licensed under the ISC License. more words")
    assert scanner.templates[ranked[0][0]][0] == "ISC" and [r[2] for r in ranked if scanner.templates[r[0]][0] == "Unlicense"][0] < licences.SHARE < ranked[0][2]


def test_wording_difference_is_the_best_alignment():
    """Against all ways to match a template's words, in order, with the block's."""
    rng = random.Random(3)
    for _ in range(200):
        template, block = [[rng.choice("abcd") for _ in range(rng.randint(1, n))] for n in (5, 9)]
        ways = [((), ())]
        for k in range(1, min(len(template), len(block)) + 1):
            ways += [(t, b) for t in combinations(range(len(template)), k) for b in combinations(range(len(block)), k) if all(template[i] == block[j] for i, j in zip(t, b, strict=True))]
        best = min((len(template) - len(t), sum(y - x - 1 for x, y in zip(b, b[1:]))) for t, b in ways)
        assert licences.difference(template, block) == best, (template, block)
