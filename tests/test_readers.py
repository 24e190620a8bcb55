"""Readers over files that are read in many splits."""

from __future__ import annotations

import gzip
import random

import pytest

from lexiloom.sources import catalogs as K


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def numbered(spark, path):
    return sorted((r.file.rsplit("/", 1)[1], r.number, r.value) for r in K.lines(spark, path).collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_numbers_equal_a_plain_count_across_splits(spark, tmp_path, small_splits, monkeypatch, broadcast):
    """Both ways to join the sums; files of none, one and many lines, with empty lines, both ends of lines, no last end, lines longer than a split, and a packed file."""
    monkeypatch.setattr(K, "SPLITS", K.SPLITS if broadcast else 0)
    rng = random.Random(1)
    line = lambda: "x" * rng.choice([0, 1, 5, 60, 60, 60, 3000]) + rng.choice(["", "é", " ", " \r\t"])
    texts = {"none": "", "one": "a", "end": "\n", "lf": "\n".join(line() for _ in range(400)), "crlf": "\r\n".join(line() for _ in range(300)) + "\r\n"}
    want = []
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
        own = text.split("\n")
        want += [(name, i + 1, v.removesuffix("\r")) for i, v in enumerate(own[:-1] if own[-1] == "" else own)]
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"a\nb\n" * 700))
    want += [("z.gz", i + 1, "ab"[i % 2]) for i in range(1400)]
    rows = K.lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert numbered(spark, str(tmp_path)) == sorted(want)
    assert {(r.file.rsplit("/", 1)[1], r.number) for r in rows.filter("value = 'b'").collect()} == {(f, n) for f, n, v in want if v == "b"}


def test_first_bad_line_is_named_across_splits(spark, tmp_path, small_splits):
    good = '{"q":"cat","n":2}\n'
    (tmp_path / "a.jsonl").write_text(good * 777 + '{"q":" ","n":1}\n' + good * 100 + "oops\n" + good * 500)
    with pytest.raises(K.BadInput, match=r"a.jsonl, number 778: empty query; .*number 879: not json"):
        K.query_log(spark, str(tmp_path))


def test_exclusions_across_splits(spark, tmp_path, small_splits):
    text = "loose # no head\n" + "".join(f"[c{i // 90}]\n" * (i % 90 == 0) + f"Word {i}  # {i}\n" + "\n" * (i % 7 == 0) for i in range(900))
    (tmp_path / "x.txt").write_text(text)
    got = {(r.phrase, r.category) for r in K.exclusions(K.lines(spark, str(tmp_path))).collect()}
    assert got == {("loose", None)} | {(f"word {i}", f"c{i // 90}") for i in range(900)}


def test_keys_that_stand_twice(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "key string, n int")
    assert {(r.n, r.twice) for r in K.repeated(rows, "key").collect()} == {(1, True), (2, False), (3, True), (4, False), (5, False)}


def test_fitted_packs_equal_whole_ones(spark):
    """Against packing each locale's whole text for every number of aliases; batches end amid a pack."""
    rng = random.Random(2)
    rows = [(loc, i, f"item {i}", ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(0, 16))]) for loc, n in (("en", 400), ("de", 90), ("x", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "locale string, item int, head string, aliases array<string>").repartition(3)

    def plain(loc, budget):
        for n in range(16, -1, -1):
            text = "\n".join(f"{h}|{'|'.join(a[:n])}" for lo, _, h, a in rows if lo == loc)
            if (size := len(gzip.compress(text.encode(), 9, mtime=0))) <= budget or n == 0:
                return n, size

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for budget in (10, 900, 4000, 1 << 20):
            got = {r.locale: (r.aliases, r.bytes) for r in K.fitted_aliases(df, budget).collect()}
            assert got == {loc: plain(loc, budget) for loc in ("en", "de", "x")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
