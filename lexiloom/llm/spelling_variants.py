"""Spelling variants: words one edit apart, found by merging the subtrees of an errata trie.

The words of a corpus form a trie. At each node the child with most words is
heavy, the others are light, so a word goes through at most log2(words) light
edges. A light subtree is merged into the rest of its node in three ways: with
its first letter skipped, replaced by the heavy one, or with the heavy letter
put before it (the heavy subtree's letter skipped); and light subtrees of one
node are merged with each other, their first letters alike. Only the smaller
side is ever moved, and two terminals that coincide are one edit apart. A node
is named by a hash of its prefix; colliding names would merely share a heavy
letter, which no result depends on.

Each merge is an equi-join or a grouping: a moved word is looked up among the
words; light words that coincide form a group of at most one word a letter of
the alphabet, from which each takes the group's size and its two best members.
A pair one deletion apart is met once, at the last letter of the run that the
deletion shortens.

Defined results: a null text has no words; a null key counts as the empty text;
repeated rows count as often as they are there; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import HOT_SHARE, join_unique, map_batches, written

#: Code points of a word and its occurrences, at least.
MIN_LETTERS, MIN_COUNT = 5, 3
#: One in so many occurrences loses a letter.
NOISE = 97
#: Letters of words; only A to Z are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_FNV, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def noisy(run: str, key: str, noise: int = NOISE) -> str:
    """The lower-cased run, without one of its letters if the hash of key and run is divisible by `noise`."""
    run = run.translate(_LOWER)
    h = zlib.crc32(f"{key}:{run}".encode())
    at = h % len(run)
    return run if h % noise else run[:at] + run[at + 1 :]


def words(df: DataFrame, noise: int = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts with their occurrences. Each slice of texts is counted before the shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[str] = Counter()
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run, n in Counter(RUN.findall(text or "")).items():
                word = noisy(run, "" if key is None else str(key), noise)
                if len(word) >= min_letters:
                    found[word] += n
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = map_batches(rows, "word string, n long", work)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def trie_edges(vocabulary: DataFrame) -> DataFrame:
    """id, at, node, letter: the edge that a word takes at each place, counted from 0; node is a hash of the letters before."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, places, nodes, letters = [], [], [], []
        for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            node = _FNV
            for at, letter in enumerate(word):
                nodes.append(node)
                node = (node ^ ord(letter)) * _PRIME & _MASK
            ids += [i] * len(word)
            places += range(len(word))
            letters += word
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(nodes, pa.uint64()).view(pa.int64()), pa.array(letters, pa.string())], ["id", "at", "node", "letter"])

    return map_batches(vocabulary.select("id", "word"), "id long, at int, node long, letter string", work, 200_000)


def heavy_letters(edges: DataFrame) -> DataFrame:
    """node, heavy, below: of each node with several children the letter of the one with most words, and the words below it."""
    children = edges.groupBy("node", "letter").agg(F.count("*").alias("words"))
    nodes = children.groupBy("node").agg(F.count("*").alias("children"), F.max_by("letter", F.struct("words", "letter")).alias("heavy"), F.sum("words").alias("below"))
    return nodes.filter("children > 1").select("node", "heavy", "below")


def light_edges(vocabulary: DataFrame) -> DataFrame:
    """word, n, before, letter, after, heavy: each word cut at each of its light edges, with the heavy letter of the edge's node."""
    edges = written(trie_edges(vocabulary), "trie-edges")
    nodes = written(heavy_letters(edges), "heavy-letters")
    hot = nodes.filter(F.col("below") > HOT_SHARE * vocabulary.count()).select("node")
    light = join_unique(edges, nodes.select("node", "heavy"), "node", hot=hot).filter("letter <> heavy").select("id", "at", "heavy")
    at = F.col("at")
    return light.join(vocabulary, "id").select("word", "n", F.expr("substring(word, 1, at)").alias("before"), F.expr("substring(word, at + 1, 1)").alias("letter"), F.substring("word", at + 2, F.length("word")).alias("after"), "heavy")


def _best(n: str, word: str) -> Column:
    """Orders words by falling count, then in code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def near_counts(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, best: how many words are one edit away from each, and the one of them with the largest count.

    vocabulary: id, word, n, a written table.
    """
    light = written(light_edges(vocabulary), "light-edges")
    whole = F.concat("before", "letter", "after")
    moves = F.array(
        F.when(~F.startswith("after", "letter") & (F.col("after") != ""), F.concat("before", "after")),
        F.concat("before", "heavy", "after"),
        F.concat("before", "heavy", "letter", "after"),
    )
    moved = light.select(whole.alias("from"), F.col("n").alias("from_n"), F.explode(moves).alias("word")).filter("word IS NOT NULL")
    last = vocabulary.select(F.col("word").alias("from"), F.col("n").alias("from_n"), F.expr("substring(word, 1, length(word) - 1)").alias("word"))
    met = moved.unionByName(last).join(vocabulary.select("word", "n"), "word")
    sides = F.array(F.struct("word", "n", _best("from_n", "from").alias("best")), F.struct(F.col("from").alias("word"), F.col("from_n").alias("n"), _best("n", "word").alias("best")))
    met = met.select(F.inline(sides)).withColumn("links", F.lit(1).cast("long"))
    alike = light.groupBy("before", "after").agg(F.array_sort(F.collect_list(_best("n", "word"))).alias("words")).filter(F.size("words") > 1)
    own = F.col("own")
    other = F.when(F.col("words")[0]["word"] == own["word"], F.col("words")[1]).otherwise(F.col("words")[0])
    alike = alike.select("words", F.explode("words").alias("own")).select(own["word"].alias("word"), (-own["less"]).alias("n"), other.alias("best"), (F.size("words") - 1).cast("long").alias("links"))
    nothing = vocabulary.select("word", "n", F.lit(None).cast("struct<less:bigint,word:string>").alias("best"), F.lit(0).cast("long").alias("links"))
    return nothing.unionByName(met).unionByName(alike).groupBy("word").agg(F.max("n").alias("n"), F.sum("links").alias("n_near"), F.min("best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of the words with a form: the last word of a chain of forms, by pointer doubling. forms: word, form, a written table.

    A form has at least twice the count of its word, so a chain of more than 63 can't be.
    """
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = written(join_unique(found, ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        found = met.select("word", "root")
        if met.filter("moved").isEmpty():
            return found


def variants(df: DataFrame, noise: int = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of df.

    form is the near word with the largest count, if that is at least `times` the word's own (2 or more, so that forms lead to an end).
    """
    if times < 2:
        raise ValueError("forms could lead in a circle")
    counted = words(df, noise, min_letters, min_count, id_col, text_col)
    vocabulary = written(counted.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = near_counts(vocabulary).withColumn("fits", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)))
    near = written(near.select("word", "n", "n_near", F.when(F.col("fits"), F.col("best.word")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")), "near-words")
    roots = with_roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
