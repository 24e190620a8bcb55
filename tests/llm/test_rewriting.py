"""Fill-in-middle, byte-level BPE and spelling variants against plain versions, over small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import byte_bpe, catalog, fill_middle, spelling_variants
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, n long, word string, ids string, form string, output string, h1 long"
AWKWARD = [
    (1, "one line"), (1, "one line"), (2, "a\nb\n\nc\n"), (3, None), (4, ""), (5, "\n\n\n"), (6, "x" * 5000), (7, "naïve ﬁ ▁ 🦊\u0000\r\n<|endoftext|> 1984's\n"),
    (8, "holds <P> a mark\nand more"), (9, "\n".join(f"line {i} é🦊" * (i % 7) for i in range(4000))), (None, "a row\nwithout an id"), (None, None), (-10, "  \t \n  tail  "), (11, "<<P\n>S>\n<M"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", 1, "w", "z", "psm", "o", 5) for i, t in AWKWARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11 Fill-in-middle
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\r\v\f]*[^ \t\n\r\v\f]+|[ \t\n\r\v\f]+$", "char": r"(?s:.)"}


def cut_plainly(doc_id, text, unit, seed=7, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h4 % 100 < suffix_first:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("rate", [100, 60])
def test_cuts_equal_a_list_of_units(spark, awkward, unit, rate):
    rows = AWKWARD + [(1000 + k, "".join(random.Random(k).choice("ab \n é🦊") for _ in range(k % 40))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, fill_middle.transform(df, unit, rate=rate).collect()))
    assert got == Counter(cut_plainly(i, t, unit, rate=rate) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fill_middle.transform(df, unit, rate=rate).select("doc_id", fill_middle.restored().alias("text")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)


def test_cut_tables_with_extra_columns_and_none(awkward, empty):
    got = fill_middle.round_trip(awkward)
    assert Counter((r.doc_id, r.restored_sha256) for r in got.collect()) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in AWKWARD)
    assert fill_middle.round_trip(empty).columns == got.columns and fill_middle.round_trip(empty).count() == 0
    with pytest.raises(ValueError):
        fill_middle._classes(np.zeros(1, np.uint8), "page")


def test_cuts_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = catalog.queries()["op11_fill_in_middle"](spark, SMALL)
    want = con.sql(catalog.oracle_sql()["op11_fill_in_middle"])
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())


# 12 Byte-level BPE
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(catalog.BYTE_TOKENIZER))


def test_ids_equal_the_library(library):
    merges = byte_bpe.Merges(public_tokenizers.path(catalog.BYTE_TOKENIZER))
    rng = random.Random(1)
    pieces = [*"ab 1'\n\t　 \x1c\x85é.<|>sK世🦊", "<|endoftext|>", "'re", "<|end", "  ", "ing", " the"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(16))) for _ in range(20_000)]
    texts += ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (7, 8, 9, 16, 17, 63, 64, 65, 127, 128, 129, 130, 3000)] + ["x" * n for n in (128, 129, 5000)]
    texts += [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)} {chr(c)}  x" for c in range(0, 0x11000, 7) if not 0xD800 <= c < 0xE000]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert merges.encode(texts) == ids
    parts = byte_bpe.spelling(public_tokenizers.path(catalog.BYTE_TOKENIZER))
    assert [byte_bpe.decoded(i, parts) for i in ids] == texts
    for _ in range(3000):  # ids that spell no UTF-8
        odd = [rng.randrange(len(parts)) for _ in range(rng.randrange(9))]
        assert byte_bpe.decoded(odd, parts) == library.decode(odd, skip_special_tokens=False)


def test_rows_and_heap_merge_alike():
    merges = byte_bpe.Merges(public_tokenizers.path(catalog.BYTE_TOKENIZER))
    rng = random.Random(2)
    words = [bytes(rng.choice(b"theinga \xc3\xa9") for _ in range(rng.randrange(1, 65))) for _ in range(2000)]
    assert [[x for x in row if x >= 0] for row in merges.scanned(words, 64).tolist()] == [merges.heaped(w) for w in words]


def test_ids_are_decoded_in_slices(spark, awkward, monkeypatch):
    path = public_tokenizers.path(catalog.BYTE_TOKENIZER)
    encoded = byte_bpe.encode(awkward, path).coalesce(1)
    monkeypatch.setattr(byte_bpe, "SLICE_IDS", 3)
    assert Counter(r.text for r in byte_bpe.decode(encoded, path).collect()) == Counter(t or "" for _, t in AWKWARD)


def test_known_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 50)
    merges = byte_bpe.Merges(public_tokenizers.path(catalog.BYTE_TOKENIZER))
    for k in range(200):
        texts = [f"word{k} other{k % 9} and{'z' * k} 's <|endoftext|>"]
        assert merges.encode(texts) == [library.encode(texts[0], add_special_tokens=False).ids]
        assert len(merges.known) < 80 and len(merges.older) < 80


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.Merges(public_tokenizers.path(catalog.PACKING_TOKENIZER))


def test_round_trip_of_texts(spark, library, awkward, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path(catalog.BYTE_TOKENIZER)
    for df in (awkward, docs):
        got = byte_bpe.round_trip(df, path)
        want = Counter()
        for i, t in ((r.doc_id, r.text or "") for r in df.collect()):
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want[(i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)))] += 1
        assert Counter(map(tuple, got.collect())) == want
    assert byte_bpe.round_trip(empty, path).count() == 0 and byte_bpe.encode(empty, path).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(awkward, path), path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in back) == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in AWKWARD)
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), path).filter("text = ''").count() == 2


# 13 Spelling variants
def variants_plainly(rows, noise=97, min_letters=5, min_count=3):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}
    holes, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b and counts[b] >= 2 * counts[w] else None for w, b in best.items()}
    found = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return found


def test_variants_equal_all_pairs(spark, awkward):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for df in (docs, awkward):
        got = spelling_variants.variants(df).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == variants_plainly([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_dense_words(spark, seed):
    """Few letters, so that every kind of edit, runs of one letter, and chains of forms occur; no word is too short or too rare."""
    rng = random.Random(seed)
    rows = [(k, " ".join("".join(rng.choice("aab") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 40)))) for k in range(120)]
    rows += [(900 + k, "aaaa ÀÀ× àà× AB÷ ab÷ Ãb") for k in range(5)]
    got = spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=5, min_letters=1, min_count=1).collect()
    assert set(map(tuple, got)) == variants_plainly(rows, 5, 1, 1) and len(got) == len(set(got))
    assert any(r.form and r.form != r.root for r in got)


def test_long_chains_of_forms(spark):
    """Each word has twice the count of the one before: the root is many steps away."""
    rows = [("q" * 4 + "z" * k, 2**k) for k in range(1, 30)]
    forms = spark.createDataFrame([(w, "q" * 4 + "z" * (k + 2)) for k, (w, _) in enumerate(rows)], "word string, form string")
    assert {r.root for r in spelling_variants.with_roots(forms).collect()} == {"q" * 4 + "z" * 30}


def test_variants_of_odd_tables(spark, empty):
    assert spelling_variants.variants(empty).count() == 0
    long_word = "abc" * 40_000
    rows = [(k, f"{long_word} {long_word}d {long_word[1:]} short") for k in range(4)]
    got = {(len(r.word), r.n_near) for r in spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=1 << 40).collect()}
    assert got == {(120_000, 2), (120_001, 1), (119_999, 1), (5, 0)}
    with pytest.raises(ValueError):
        spelling_variants.variants(empty, times=1)
