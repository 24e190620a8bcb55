"""Text functions: normalisation, tokens, windows of tokens, privacy and edit distance."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Letters kept of a normalised text, and tokens of a query.
MAX_LENGTH, MAX_TOKENS = 64, 8

#: Letters without a decomposition, and the patterns and words of the privacy rules.
FOLDED = {"ı": "i", "đ": "d", "ł": "l", "ø": "o", "ß": "ss"}
EMAIL = r"[^\s@]@[^\s@]+\.[^\s@]{2}"
ADDRESS = r"(?i)([a-z][a-z0-9+.-]*://|\bwww\.)"
DOMAIN = r"(?i)[\p{L}\p{N}-]\.(com|net|org|edu|gov|info|biz|xyz)\b"
MAIL_PROVIDERS = ["gmail", "googlemail", "hotmail", "outlook", "yahoo", "icloud", "protonmail", "gmx", "yandex"]
URL_TOKENS = ["http", "https", "www", "mailto"]
TLDS = ["com", "net", "org", "edu", "gov", "info", "biz", "xyz"]
MAX_DIGITS, DIGIT_RUN, CODE_DIGITS, MAX_TOKEN_LENGTH = 6, 5, 3, 30


def ascii_normalized(text: Column, length: int = MAX_LENGTH) -> Column:
    """Lower-case ASCII words with single spaces; apostrophes go, anything else parts words."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9+]+", " ")
    return F.trim(F.left(F.trim(kept), F.lit(length)))


#: Emoji and their invisible glue; marks that people skip (Latin, Greek and Cyrillic accents, Arabic vowel marks and tatweel, Hebrew points); apostrophes.
PICTURES = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}\U000E0020-\U000E007F]")
GLUE = regex.compile(r"[\u200D\uFE0E\uFE0F\u20E3]")
SKIPPED_MARKS = regex.compile(r"[\u0300-\u036F\u064B-\u065F\u0670\u0640\u0591-\u05C7]")
APOSTROPHES = regex.compile(r"['\u2019`\u00B4]")
_FOLDS = regex.compile(f"[{''.join(FOLDED)}]")
_PARTS = regex.compile(r"\+(?!\d)|[^\p{L}\p{M}\p{N}+]+")
_SPACING = regex.compile(r"[\p{Cc}\p{Z}\uFEFF]+")


def cut(text: str, length: int) -> str:
    """At most so many UTF-16 units, without half a letter or a blank at the end."""
    if len(text) * 2 <= length or len(text.encode("utf-16-le", "surrogatepass")) <= 2 * length:
        return text
    return text.encode("utf-16-le", "surrogatepass")[: 2 * length].decode("utf-16-le", "ignore").rstrip()


def normalize(text: str | None, length: int = MAX_LENGTH) -> str | None:
    """Compatibility form, lower case, without emoji, skipped marks and apostrophes; a plus stays before a digit."""
    if text is None:
        return None
    if not text.isascii():
        low = GLUE.sub("", PICTURES.sub(" ", unicodedata.normalize("NFKC", text))).lower()
        bare = SKIPPED_MARKS.sub("", unicodedata.normalize("NFD", low))
        text = unicodedata.normalize("NFC", _FOLDS.sub(lambda m: FOLDED[m[0]], bare))
    return cut(" ".join(_PARTS.sub(" ", APOSTROPHES.sub("", text.lower())).split()), length)


def embedding_text(text: str | None, length: int = MAX_LENGTH) -> str | None:
    """What an embedding model reads: compatibility form and lower case with single blanks; accents, marks and emoji stay."""
    if text is None:
        return None
    low = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower())
    return cut(_SPACING.sub(" ", low).strip(), length)


def normalized(length: int = MAX_LENGTH):
    """normalize() as a vectorised function of a column."""

    @F.pandas_udf(StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalize(t, length), na_action="ignore")

    return of


def embeddable(length: int = MAX_LENGTH):
    """embedding_text() as a vectorised function of a column."""

    @F.pandas_udf(StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embedding_text(t, length), na_action="ignore")

    return of


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def windows(toks: Column, most: int = 4) -> Column:
    """All runs of 1 to `most` tokens, space-joined."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(toks, i, n)))
    return F.flatten(F.array(*[F.when(F.size(toks) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]))


def privacy_reason(text: Column, blocked: list[str] | None = None) -> Column:
    """Why a text must not be published, by the first rule that holds, or null. blocked: phrases that a blocklist blocks.

    Rules about words read one array, split once a text; cheap tests stand before
    patterns, so most texts never meet the dear ones.
    """
    listed = lambda names: F.array(*map(F.lit, names))
    digits = lambda t: F.length(F.regexp_replace(t, r"\P{Nd}+", ""))
    like = lambda pattern: F.regexp_like(text, F.lit(pattern))
    n_digits = F.when(like(r"\p{Nd}"), digits(text)).otherwise(0)

    def rules(words: Column) -> Column:
        tld = F.arrays_overlap(F.slice(words, 2, 1 << 30), listed(TLDS))
        reason = (
            F.when(F.contains(text, F.lit("@")) & like(EMAIL), "email")
            .when((F.contains(text, F.lit("://")) | F.contains(F.lower(text), F.lit("www."))) & like(ADDRESS), "url")
            .when(F.contains(text, F.lit(".")) & like(DOMAIN), "url")
            .when(F.arrays_overlap(words, listed(MAIL_PROVIDERS)), "email")
            .when(F.arrays_overlap(words, listed(URL_TOKENS)) | tld, "url")
            .when(n_digits > MAX_DIGITS, "phone")
            .when(like(rf"\p{{Nd}}{{{DIGIT_RUN}}}"), "number")
            .when((n_digits >= CODE_DIGITS) & F.exists(words, lambda t: F.regexp_like(t, F.lit(r"\p{L}")) & (digits(t) >= CODE_DIGITS)), "code")
            .when(like(rf"[\p{{L}}\p{{M}}\p{{N}}]{{{MAX_TOKEN_LENGTH + 1}}}"), "long-token")
        )
        if blocked:
            joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
            hits = [F.contains(joined, F.lit(f" {p} ")) for p in blocked]
            reason = reason.when(reduce(lambda a, b: a | b, hits), "blocked")
        return reason

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")
    return F.get(F.transform(F.array(words), rules), F.lit(0))


def osa(a: str, b: str) -> int:
    """Edits between two words, where a swap of neighbours is one edit and no part is edited twice."""
    return int(_osa_rows(np.array([a], object), np.array([b], object))[0])


def _osa_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """osa() of all pairs at once: the table's cells are columns over the pairs. Pairs should be of like lengths."""
    if not len(a):
        return np.zeros(0, np.int32)
    grid = lambda words: (np.array([list(map(ord, w)) + [0] * (max(map(len, words)) - len(w)) for w in words], np.int64), np.array(list(map(len, words))))
    (x, n), (y, m) = grid(a), grid(b)
    before, row = None, np.tile(np.arange(y.shape[1] + 1), (len(a), 1))
    rows = [row]
    for i in range(x.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(y.shape[1]):
            new[:, j + 1] = np.minimum(np.minimum(new[:, j], row[:, j + 1]) + 1, row[:, j] + (x[:, i] != y[:, j]))
            if i and j:
                swap = (x[:, i] == y[:, j - 1]) & (x[:, i - 1] == y[:, j])
                new[:, j + 1] = np.where(swap, np.minimum(new[:, j + 1], before[:, j - 1] + 1), new[:, j + 1])
        before, row = row, new
        rows.append(row)
    return np.stack(rows)[n, np.arange(len(a)), m].astype(np.int32)


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_osa_rows(a.to_numpy(object), b.to_numpy(object)), dtype="int32")


def max_edits(token: Column) -> Column:
    return F.when(F.length(token) < 4, 0).when(F.length(token) < 8, 1).otherwise(2)
