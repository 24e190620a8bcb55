"""Fill-in-middle transformation: texts cut into prefix, middle and suffix at borders of units, and put together again.

A slice of texts is one buffer of bytes. It is stored as maximal runs of one
character class (line ends and other letters, or letters of one width), each
with the number of units that end up to it. A cut after u units is found by a
binary search for the run that holds the end of unit u; inside the run the
place follows by arithmetic, so no list of units is ever made.

Defined results: a null text counts as empty; an empty text, and one that holds
a mark, stays plain; a null key counts as the empty text in the seed; repeated
rows are cut alike; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Production parameters: seed, percent of texts that are cut, percent of those with the suffix first.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: What ends in a run of a class: nothing unless the text ends there, one unit at its end, or one unit after so many bytes each.
OPEN, WHOLE = -1, 0

_SPACES = b" \t\n\r\v\f"


def _classes(buffer: np.ndarray, unit: str) -> np.ndarray:
    """Of each byte what its class ends: OPEN, WHOLE or a number of bytes a unit."""
    if unit == "line":
        return np.where(buffer == 10, 1, OPEN).astype(np.int8)
    if unit == "word":
        return np.where(np.isin(buffer, np.frombuffer(_SPACES, np.uint8)), OPEN, WHOLE).astype(np.int8)
    if unit == "char":
        lead = buffer[(buffer & 0xC0) != 0x80]
        width = (1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)).astype(np.int8)
        return np.repeat(width, width)
    raise ValueError(f"no unit {unit!r}")


class Runs:
    """Maximal class runs of texts that stand one after another in a buffer, with cumulative counts of units.

    Units: "line" ends with a line end, "word" is white space and the letters
    after it, "char" is a code point; what remains at a text's end is a unit too.
    """

    def __init__(self, buffer: np.ndarray, bounds: np.ndarray, unit: str):
        kinds = _classes(buffer, unit)
        self.bounds = bounds
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        self.start = np.union1d(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, bounds[filled]) if len(filled) else np.zeros(0, np.int64)
        self.end = np.append(self.start[1:], len(buffer))[: len(self.start)]
        self.step = kinds[self.start].astype(np.int64)
        first = np.searchsorted(self.start, bounds)
        last = np.zeros(len(self.start), np.int64)
        last[first[1:][filled] - 1] = 1
        units = np.where(self.step > 0, (self.end - self.start) // np.maximum(self.step, 1), np.where(self.step == WHOLE, 1, last))
        #: Units that end before each run, and after the last one.
        self.upto = np.concatenate([[0], np.cumsum(units)])
        self.before = self.upto[first[:-1]]
        #: Units of each text.
        self.units = self.upto[first[1:]] - self.before

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """For each text the place in the buffer after so many of its units."""
        wanted = self.before + units
        at = np.minimum(np.searchsorted(self.upto[1:], wanted), max(len(self.start) - 1, 0))
        if not len(self.start):
            return self.bounds[:-1].copy()
        inside = np.where(self.step[at] > 0, self.start[at] + self.step[at] * (wanted - self.upto[at]), self.end[at])
        return np.where(units == 0, self.bounds[:-1], inside)


def _hashes(id_col: str, seed: int) -> list:
    """h1 to h4: the first four groups of eight digits of the hex sha256 of seed, colon and key, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(df: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: each text cut at two random borders of its n units.

    The form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain, the text as it is.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).fill_null("").cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        buffer = np.frombuffer(raw, np.uint8)
        h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
        runs = Runs(buffer, bounds, unit)
        one, two = h1 % (runs.units + 1), h2 % (runs.units + 1)
        ends = np.stack([bounds[:-1], runs.cuts(np.minimum(one, two)), runs.cuts(np.maximum(one, two)), bounds[1:]])
        letters = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
        chars = np.diff(letters[ends], axis=0)
        cut, spm = h3 % 100 < rate, h4 % 100 < suffix_first
        forms, outputs = [], []
        for i in range(len(texts)):
            a, b, c, d = ends[:, i].tolist()
            text = bytes(raw[a:d])
            if not text or not cut[i] or any(m in text for m in marks):
                forms.append("plain")
                outputs.append(text)
            else:
                prefix, middle, suffix = text[: b - a], text[b - a : c - a], text[c - a :]
                forms.append("spm" if spm[i] else "psm")
                outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle) if spm[i] else (marks[0], prefix, marks[1], suffix, marks[2], middle)))
        plain = np.array([f == "plain" for f in forms], bool)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(runs.units), pa.array(forms, pa.string()), pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain), pa.array(outputs, pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *_hashes(id_col, seed))
    return map_batches(rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", work)


def restored():
    """The text that columns `output` and `form` stand for; no text that was cut holds a mark, so the marks part it in one way."""
    parts = F.split("output", "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output"))


def round_trip(df: DataFrame, **parameters) -> DataFrame:
    """Digests of each text's output and of the text restored from it."""
    return transform(df, **parameters).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


#: The query as DuckDB SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
lines AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS u,
  ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
cuts AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b FROM lines),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
