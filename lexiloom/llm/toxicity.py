"""Toxicity by misspelling-tolerant lexicon search with context windows.

Fitting: from a bounded sample of labelled rows, Spark counts in how many
toxic and clean documents each word and word stem occurs, near copies counting
once. Terms that tell toxic documents form the lexicon, held in a trie. A
Levenshtein automaton run along the trie finds the terms near each new word of
the corpus, so misspelled terms are caught too; surface forms that clean
documents use are left out. Each hit's window of words tells quotation (quote
marks, reporting verbs before it) from abuse, and a logistic model over the
summed hits by kind gives the document's score.

Defined results: a null or empty text has no hits and gets the score of a text
without hits; repeated rows are scored alike; null labels and null ids are not
learnt from; without labelled rows every score is 0; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import filter_texts, map_batches, slices, written

#: The most labelled rows that a model is fitted on, those with the smallest hash of their id.
SAMPLE = 20_000
#: The most terms and stems of a lexicon.
TERMS = 2_000
#: Documents a term must mark, and the share of them that must be toxic.
SUPPORT, PURITY = 3, 0.9
#: Letters of a stem.
STEMS = (4, 5, 6)
#: Words on either side of a hit that its context window spans.
WINDOW = 6
#: Verbs that report another's words, and quote marks.
REPORTS = frozenset("said says saying wrote writes called calls calling quoted quotes quote reported reads term word phrase".split())
QUOTES = "\"“”„«»‹›`"

_WORD = re.compile(r"\w+")
#: Words that a worker keeps the outcome of.
CACHE = 300_000


def edits(term: str) -> int:
    """Edits allowed in a term of this length."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass
class Node:
    """A place in the trie: the most edits that a term below it allows, and the term that ends here."""

    most: int = 0
    term: str | None = None
    children: dict[str, Node] = field(default_factory=dict)


class Trie:
    """Lexicon terms, and stems that match any word that begins with them."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.root = Node()
        self.terms, self.stems = frozenset(terms), frozenset(stems)
        for t in terms:
            node = self.root
            for c in t:
                node = node.children.setdefault(c, Node())
                node.most = max(node.most, edits(t))
            node.term = t
        # within k edits one of the term's k + 1 parts stands unchanged where its start or end is, or in its middle
        self.heads, self.tails, self.middles = set(), set(), set()
        for t in terms:
            if k := edits(t):
                part = len(t) // (k + 1)
                self.heads.add(t[:part])
                self.tails.add(t[-part:])
                if k == 2:
                    self.middles.add((part, t[part : len(t) - part]))
        self.sizes = {len(x) for x in self.heads | self.tails}
        self.longest = max(map(len, terms), default=0)

    def stem_of(self, word: str) -> str | None:
        return next((word[:n] for n in STEMS if word[:n] in self.stems and len(word) >= n), None)

    def may_be_near(self, word: str) -> bool:
        if not 4 <= len(word) <= self.longest + 2:
            return False
        if any(word[:n] in self.heads or word[-n:] in self.tails for n in self.sizes):
            return True
        return any(word.startswith(m, p + d) for p, m in self.middles for d in (-1, 0, 1))

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, by the automaton's rows along the trie."""
        best: tuple[int, str] | None = None

        def walk(node: Node, row: list[int]) -> None:
            nonlocal best
            for c, child in node.children.items():
                new = [last := row[0] + 1]
                for w, above, corner in zip(word, row[1:], row, strict=False):
                    last = corner if w == c else 1 + min(last, above, corner)
                    new.append(last)
                if child.term and last <= edits(child.term) and (best is None or (last, child.term) < best):
                    best = (last, child.term)
                if min(new) <= child.most:
                    walk(child, new)

        walk(self.root, list(range(len(word) + 1)))
        return (best[1], best[0]) if best else None


#: What a hit is: an exact term, a stem, or a term with one or two edits; all of them in abuse, or any in quotation.
KINDS = ("exact", "stem", "near", "far", "quoted")
QUOTED = KINDS.index("quoted")
#: Weights of a constant and of each kind before any row is seen: a single misspelling alone is a doubtful case.
PRIOR = (-3.0, 4.0, 4.0, 3.2, 2.0, -0.5)


@dataclass
class Model:
    """Lexicon, word forms known to be harmless, and the logistic weights of a constant and each kind of hit."""

    terms: list[str]
    stems: list[str]
    harmless: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [-30.0] + [0.0] * len(KINDS))

    def __post_init__(self) -> None:
        self.trie = Trie(self.terms, self.stems)
        self.known: dict[str, int] = {}
        self.met: set[str] = set()

    def __getstate__(self) -> tuple:
        return self.terms, self.stems, self.harmless, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def kind(self, word: str) -> int:
        """Index in KINDS, or -1."""
        if word in self.trie.terms:
            return 0
        if self.trie.stem_of(word):
            return 1
        if word not in self.harmless and self.trie.may_be_near(word) and (found := self.trie.near(word)):
            return 1 + found[1]
        return -1

    def found(self, words: set[str]) -> set[str]:
        """Those of the words that are hits; `known` then has their kinds."""
        if len(self.met) > CACHE:
            self.met.clear()
            self.known.clear()
        fresh = words - self.met
        self.known.update((w, k) for w in fresh if (k := self.kind(w)) >= 0)
        self.met |= fresh
        return words & self.known.keys()

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, index in KINDS) of each hit in the lower-cased text."""
        low = (text or "").lower()
        if not self.found(set(_WORD.findall(low))):
            return []
        found = [(m.start(), m.end(), self.known[m.group()]) for m in _WORD.finditer(low) if m.group() in self.known]
        return [(i, j, QUOTED if quoted(low, i, j) else k) for i, j, k in found]

    @staticmethod
    def features(hits: list[tuple[int, int, int]]) -> np.ndarray:
        counts = Counter(k for _, _, k in hits)
        return np.array([1.0, *(1 + math.log(counts[k]) if counts[k] else 0.0 for k in range(len(KINDS)))])

    def weigh(self, hits: list[tuple[int, int, int]]) -> float:
        z = float(self.features(hits) @ np.array(self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str | None) -> float:
        return self.weigh(self.hits(text))


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window of words around a hit shows it as another's words: quote marks on both sides, or a reporting verb just before a mark."""
    before, after = text[max(0, start - 12 * WINDOW) : start].split("\n")[-1], text[end : end + 12 * WINDOW].split("\n")[0]
    opened, closed = any(q in before for q in QUOTES), any(q in after for q in QUOTES)
    reported = not REPORTS.isdisjoint(_WORD.findall(before)[-WINDOW:])
    return opened and closed or reported and (opened or closed)


def _key(words: list[str]) -> int:
    """Near copies mostly share it: the least hash of the text's three-word shingles."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def labelled(docs: DataFrame, labels: DataFrame, holds_out, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of the sample: labelled rows that aren't held out, those with the smallest hashes."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~holds_out).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _forms(words: list[str]) -> set[str]:
    return set(words) | {w[:n] + "*" for w in set(words) for n in STEMS if len(w) > n}


def fit(rows: DataFrame) -> Model:
    """The model of a bounded table of doc_id, text and toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per form: how many toxic and clean documents hold it. Forms of clean documents that no toxic one of the task holds are sent on as they are."""
        for batch in batches:
            for part in slices(batch):
                toxic, clean = Counter(), Counter()
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (toxic if label else clean).update(_forms(_WORD.findall((text or "").lower())))
                forms = list(toxic.keys() | clean.keys())
                yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([toxic[f] for f in forms], pa.int64()), pa.array([clean[f] for f in forms], pa.int64())], ["form", "toxic", "clean"])

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [_key(_WORD.findall((t or "").lower())) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["text", "toxic", "key"])

    keyed = map_batches(rows.select("text", F.col("toxic").cast("int").alias("toxic")), "text string, toxic int, key long", key)
    single = written(keyed.groupBy("key").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r"), F.avg("toxic").alias("share")).select("r.text", (F.col("share") >= 0.5).cast("int").alias("toxic")), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in single.groupBy("toxic").count().collect()}
    if not n.get(1):
        return Model([], [])
    counts = single.mapInArrow(count, "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = (n.get(0, 0) + 1) / (n[1] + 1)
    telling = counts.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") * rate >= PURITY * (F.col("toxic") * rate + F.col("clean"))) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))))
    best = [(r["form"], r["toxic"]) for r in telling.orderBy(F.desc("toxic"), "form").limit(TERMS).collect()]
    forms = frozenset(f for f, _ in best)
    strong = max((c for _, c in best), default=0)

    def hold(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(forms & _forms(_WORD.findall((t or "").lower()))) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["forms"])

    held = map_batches(single.filter("toxic = 1").select("text"), "forms array<string>", hold).filter(F.size("forms") > 0).collect()
    model = Model(*_lexicon([r["forms"] for r in held], dict(best), strong))
    return _weigh(model, single)


def _lexicon(held: list[list[str]], support: dict[str, int], strong: int) -> tuple[list[str], list[str]]:
    """Terms and stems: greedily those that mark most toxic documents not yet marked, then the other strong words.

    Of equals the form with more documents goes first. A word stays out if it has
    few documents of its own, as a rare word of a toxic text tells nothing.
    """
    where: dict[str, set[int]] = defaultdict(set)
    for i, forms in enumerate(held):
        for f in forms:
            where[f].add(i)
    open_, chosen = set(range(len(held))), []
    while open_:
        form = max(where, key=lambda f: (len(where[f] & open_), support[f], not f.endswith("*"), f), default=None)
        if form is None or len(where[form] & open_) < SUPPORT:
            break
        chosen.append(form)
        open_ -= where.pop(form)
    least = max(SUPPORT, strong / 8)
    chosen += [f for f in where if support[f] >= least and not f.endswith("*")]
    return [f for f in chosen if not f.endswith("*")], [f[:-1] for f in chosen if f.endswith("*")]


def _weigh(model: Model, rows: DataFrame) -> Model:
    """The model with the harmless forms near its terms and with fitted weights; the rows are a bounded sample.

    The weights are fitted on one half of the rows, with the harmless forms of the
    other half, as forms that no row has shown must be weighed as well.
    """
    half = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)) == 0

    def clean_forms(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = [sorted(w for w in model.found(set(_WORD.findall((t or "").lower()))) if model.known[w] >= 2) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(near, pa.list_(pa.string()))], ["half", "near"])

    found = map_batches(rows.filter("toxic = 0").select("text", half.alias("half")), "half boolean, near array<string>", clean_forms)
    forms = [(r["half"], r["w"]) for r in found.select("half", F.explode("near").alias("w")).distinct().collect()]
    partly = Model(model.terms, model.stems, frozenset(w for h, w in forms if h))

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        features = [partly.features(partly.hits(t)).tolist() for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(features, pa.list_(pa.float64()))], ["toxic", "features"])

    seen = map_batches(rows.filter(~half).select("text", "toxic"), "toxic int, features array<double>", look)
    grouped = seen.groupBy("toxic", "features").agg(F.count("*").alias("n")).collect()
    weights = np.array(PRIOR)
    if grouped:
        weights = _logistic(np.array([r["features"] for r in grouped]), np.array([r["toxic"] for r in grouped], float), np.array([r["n"] for r in grouped], float), np.array(PRIOR))
    return Model(model.terms, model.stems, frozenset(w for _, w in forms), weights.tolist())


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton's method, drawn to the prior with one document's strength."""
    w, pull = prior.copy(), np.array([1e-3, *[0.1] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + pull * (w - prior)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 2.0 / max(1e-12, abs(step).max()))
        if abs(step).max() < 1e-8:
            break
    return w


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and hits (spans start, end, kind in the lower-cased text) for each row."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [model.hits(t) for t in batch.column(1).to_pylist()]
        scores = pa.array(map(model.weigh, hits), pa.float64())
        found = pa.array([[{"start": i, "end": j, "kind": KINDS[k]} for i, j, k in own] for own in hits], spans)
        return pa.RecordBatch.from_arrays([batch.column(0), scores, found], ["doc_id", "score", "hits"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, score double, hits array<struct<start:int,end:int,kind:string>>", work)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose text scores below the threshold, with all their columns."""
    return filter_texts(df, text_col, lambda text: model.score(text) < threshold)
