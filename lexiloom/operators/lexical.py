"""Phrase index and lexical search: a batch of queries is one plan of equi-joins.

A prefix is matched by joining on the exploded prefixes of the vocabulary, a
misspelling by the strings that both words become when letters are deleted, so
no join compares all pairs and a word meets its neighbours only.
The vocabulary grows far slower than the phrases; no side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import MAX_TOKENS, ascii_normalized, max_edits, osa_distance, tokens
from lexiloom.operators.analytics import rank

#: Fields in order of strength and the weight of each.
FIELDS = {"name": 1.0, "shortcode": 0.95, "keyword": 0.85, "alias": 0.8, "typo": 0.75, "low": 0.55}
#: Fixed values of the scoring rules.
PREFIX_BASE, PREFIX_SHARE, PREFIX_OF_WORD, SQUEEZE, TYPO, TYPO_SHORT, TYPO_TWO = 0.6, 0.35, 0.5, 0.85, 0.8, 0.7, 0.65
MIN_COVERAGE, LENGTH_BASE, LENGTH_SHARE, EXACT_MANY, INEXACT, BONUS, MAX_BONUS, REJOINED = 0.34, 0.6, 0.4, 1.1, 0.9, 0.02, 0.06, 0.95
#: Words that a prefix completes to (the first so many in order), and the letters of a token that counts as short.
MAX_PREFIX_WORDS, SHORT_TYPO = 400, 5


def phrases(catalog: DataFrame, item: str, fields: dict[str, str]) -> DataFrame:
    """item, phrase, field_ix, weight: each phrase of an item once, under its strongest field. fields: field to column."""
    names = list(FIELDS)
    parts = F.array(*[F.struct(F.lit(names.index(f)).alias("field_ix"), F.lit(FIELDS[f]).alias("weight"), ascii_normalized(F.col(c)).alias("phrase")) for f, c in fields.items()])
    rows = catalog.select(F.col(item).alias("item"), F.explode(parts).alias("p")).select("item", "p.*").filter("phrase <> ''")
    return rows.groupBy("item", "phrase").agg(F.min("field_ix").alias("field_ix"), F.max("weight").alias("weight"))


def postings(index: DataFrame) -> DataFrame:
    """token, item, phrase, field_ix, weight, n_tokens: a row for each token of a phrase."""
    toks = tokens(F.col("phrase"))
    return index.select(F.explode(toks).alias("token"), "item", "phrase", "field_ix", "weight", F.size(toks).alias("n_tokens"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """token, df (items that hold it), idf = ln(1 + items / df)."""
    df = posts.select("token", "item").distinct().groupBy("token").agg(F.count("*").alias("df"))
    items = posts.select("item").distinct().groupBy().agg(F.count("*").alias("items"))
    return df.join(F.broadcast(items)).select("token", "df", F.log(1 + F.col("items") / F.col("df")).alias("idf"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, pos, qtoken, n_query: the first tokens of each query (query_id, q)."""
    toks = F.slice(tokens(ascii_normalized(F.col("q"))), 1, MAX_TOKENS)
    return queries.select("query_id", F.posexplode(toks).alias("pos", "qtoken"), F.size(toks).alias("n_query"))


def prefix_candidates(asked: DataFrame, vocab: DataFrame, least: int = 1) -> DataFrame:
    """qtoken, token, quality of the words that a token begins, the first so many in order."""
    heads = vocab.select("token", F.explode(F.transform(F.sequence(F.lit(least), F.length("token")), lambda n: F.left(F.col("token"), n))).alias("qtoken"))
    met = heads.join(asked.select("qtoken").distinct(), "qtoken").withColumn("place", rank(Window.partitionBy("qtoken").orderBy("token"))).filter(F.col("place") <= MAX_PREFIX_WORDS)
    is_word = F.max(F.when(F.col("token") == F.col("qtoken"), 1).otherwise(0)).over(Window.partitionBy("qtoken"))
    quality = (PREFIX_BASE + PREFIX_SHARE * F.length("qtoken") / F.length("token")) * F.when(is_word == 1, PREFIX_OF_WORD).otherwise(1.0)
    return met.withColumn("quality", quality).filter("token <> qtoken").select("qtoken", "token", "quality")


def squeeze_candidates(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """qtoken, token, quality where a token is a word but for its repeated last letter."""
    short = asked.select("qtoken").distinct().withColumn("token", F.regexp_replace("qtoken", r"(.)\1+$", "$1")).filter("token <> qtoken")
    return short.join(vocab.select("token"), "token").select("qtoken", "token", F.lit(SQUEEZE).alias("quality"))


def deletions(word: Column, k: Column) -> Column:
    """The strings that a word becomes when up to k (0 to 2) of its letters are deleted, itself included."""
    cut = lambda w, i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))
    places = lambda w, first: F.when(F.length(w) >= first, F.sequence(first, F.length(w))).otherwise(F.array().cast("array<int>"))
    one = F.transform(places(word, F.lit(1)), lambda i: cut(word, i))
    # the second letter to go stands at or after the place of the first
    two = F.flatten(F.transform(places(word, F.lit(1)), lambda i: F.transform(places(cut(word, i), i), lambda j: cut(cut(word, i), j))))
    none = F.array(word)
    return F.array_distinct(F.when(k == 0, none).when(k == 1, F.concat(none, one)).otherwise(F.concat(none, one, two)))


def misspelling_keys(vocab: DataFrame) -> DataFrame:
    """token, key: hashes of a word's deletions, as many letters as a token that may mean it is allowed edits."""
    longest = F.when(F.length("token") < 3, 0).when(F.length("token") < 6, 1).otherwise(2)  # a token has an edit more than its length allows at most
    return vocab.select("token", F.explode(F.transform(deletions(F.col("token"), longest), lambda x: F.xxhash64(x))).alias("key"))


def misspelling_pairs(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """qtoken, token, k: pairs that share a deletion; all pairs within a token's k edits are among them."""
    wanted = asked.select("qtoken").distinct().withColumn("k", max_edits(F.col("qtoken"))).filter("k > 0")
    mine = wanted.select("qtoken", "k", F.explode(F.transform(deletions(F.col("qtoken"), F.col("k")), lambda x: F.xxhash64(x))).alias("key"))
    near = mine.join(keys, "key").filter(F.abs(F.length("qtoken") - F.length("token")) <= F.col("k"))
    return near.select("qtoken", "token", "k").distinct()


def fuzzy_candidates(asked: DataFrame, vocab: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """qtoken, token, quality, edits of the words within a token's edits that begin alike, or with their first two letters swapped.

    Words meet by their deletions (misspelling_keys(), which an index may have stored); edits are counted once a pair.
    """
    first = lambda c, n: F.substring(c, n, 1)
    alike = (first("qtoken", 1) == first("token", 1)) | ((first("qtoken", 1) == first("token", 2)) & (first("qtoken", 2) == first("token", 1)))
    near = misspelling_pairs(asked, misspelling_keys(vocab) if keys is None else keys).filter(alike).withColumn("edits", osa_distance("qtoken", "token"))
    quality = F.when(F.col("edits") == 2, TYPO_TWO).when(F.length("qtoken") <= SHORT_TYPO, TYPO_SHORT).otherwise(TYPO)
    return near.filter((F.col("edits") > 0) & (F.col("edits") <= F.col("k"))).select("qtoken", "token", quality.alias("quality"), "edits")


def contained_phrases(texts: DataFrame, phrases_: DataFrame, id_col: str, toks: Column, most: int = 4) -> DataFrame:
    """id, phrase: phrases that stand in a text as whole words, by an equi-join on its windows."""
    from lexiloom.functions.text import windows

    rows = texts.select(F.col(id_col), toks.alias("toks"))  # a column: inside a lambda it would be computed again for each window
    return rows.select(F.col(id_col), F.explode(F.array_distinct(windows(F.col("toks"), most))).alias("phrase")).join(phrases_, "phrase")


def diversified(rows: DataFrame, group: str, factor: float = 0.93) -> DataFrame:
    """Scores fall by a factor for each better row of the same query and group."""
    k = rank(Window.partitionBy("query_id", group).orderBy(F.desc("score"), "item")) - 1
    return rows.withColumn("score", F.round(F.col("score") * F.pow(F.lit(factor), k), 6))
