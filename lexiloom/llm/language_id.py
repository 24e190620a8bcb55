"""Language identification by multilingual mixture inference.

Training: Spark counts hashed byte trigrams by language over all training rows.
Prediction: each document's trigrams are a mixture of the languages' trigram
distributions. Expectation-maximisation estimates the proportions; languages
join the document's set one by one as long as the likelihood, less a penalty
for each further language, grows. The prediction is the language with the
largest share, and the score is that share.

Defined results: a null text or one without letters is `und` with score 0, as
is every text if nothing could be learnt; rows with null language aren't
learnt from; repeated rows count as rows; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import filter_texts, map_batches, slices

#: Buckets that byte trigrams are hashed to.
BUCKETS = 1 << 16
#: Added to each bucket's share of a language, as a count in a million.
SMOOTH = 0.5
#: Rounds of expectation-maximisation at most, and the change of a share at which it stops.
ROUNDS, TOLERANCE = 20, 1e-3
#: Trigrams overlap, so each counts as this share of an independent observation in the penalised likelihood.
INDEPENDENT = 1 / 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, white space and digits folded."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    raw = np.where((raw < 97) & (raw != 39), np.uint8(32), raw).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
    return (code >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """Languages and their trigram probabilities, a row for each bucket."""

    languages: list[str]
    shares: np.ndarray

    def proportions(self, codes: np.ndarray) -> dict[str, float]:
        """The document's languages and their shares."""
        if not self.languages or not len(codes):
            return {}
        n = np.ones(len(codes))
        if len(codes) > BUCKETS:  # long texts cost no more than their distinct trigrams
            times = np.bincount(codes, minlength=BUCKETS)
            codes = np.flatnonzero(times)
            n = times[codes].astype(float)
        n *= INDEPENDENT
        p = self.shares[codes]
        fits = n @ np.log(p)
        chosen = [int(fits.argmax())]
        share, best = np.ones(1), float(fits[chosen[0]])
        penalty = np.log(n.sum() + 2)  # twice half the logarithm: a share, and which language it is
        while len(chosen) < len(self.languages):
            rest = [k for k in range(len(self.languages)) if k not in chosen]
            # where the likelihood rises most as a further language gets its first share
            slope = (n / (p[:, chosen] @ share)) @ p[:, rest] / n.sum()
            if slope.max() <= 1:
                break
            more = [*chosen, rest[int(slope.argmax())]]
            new, fit = self._maximise(p[:, more], n, np.append(share * 0.9, 0.1))
            if fit - best <= penalty:
                break
            chosen, share, best = more, new, fit
        return {self.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}

    @staticmethod
    def _maximise(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(ROUNDS):
            new = share * ((n / (p @ share)) @ p) / n.sum()
            moved, share = abs(new - share).max(), new
            if moved < TOLERANCE:
                break
        return share, float(n @ np.log(p @ share))

    def mixture(self, text: str | None) -> dict[str, float]:
        return self.proportions(trigrams(text)) if text and _LETTER.search(text) else {}


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from all rows with a language. What comes to the driver is one count for each language and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if lang not in held:
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    held[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "bucket", "n"])

    usable = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = usable.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(languages)))
    table[counts["bucket"], np.searchsorted(np.array(languages, dtype=object), counts["lang"]) if languages else counts["bucket"]] = counts["n"]
    table += SMOOTH * np.maximum(table.sum(axis=0), 1) / 1e6
    return Model(languages, np.ascontiguousarray(table / table.sum(axis=0)))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and mixture (shares by language) for each row. The broadcast table has BUCKETS rows and a column a language."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.mixture(t) for t in batch.column(1).to_pylist()]
        best = [max(m, key=lambda k: (m[k], k)) if m else UNKNOWN for m in found]  # noqa: B023
        score = [min(1.0, m.get(k, 0.0)) for m, k in zip(found, best, strict=True)]
        mixture = pa.array([list(m.items()) for m in found], pa.map_(pa.string(), pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), mixture], ["doc_id", "lang_pred", "score", "mixture"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, lang_pred string, score double, mixture map<string,double>", work)


def keep_known(df: DataFrame, model: Model, text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """The rows of df whose text has a known language with at least this share, with all their columns."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return filter_texts(df, text_col, lambda text: max(sent.value.mixture(text).values(), default=0.0) >= least_share)


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null ids have the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n
