"""Lexical search over packs of several locales, a batch of queries as one plan.

Each pack is a bit of a mask. A query prefers its own locale's packs, searches
these and others, and scores every item by its best phrase: how rare and how
well matched its words are, less for other locales, with three caps in order.

Tables: an index is item, phrase, field_ix, weight, mask, n_tokens, given as such
or as stored by word_index; queries are query_id, q, preferred, searched (masks)
and locale. A query is searched as typed (turn 0) and, where two of its words make
one, with them joined (turn 1), both in one pass.

Phrases are scored once for all items that share them, and items once for all of
the same phrases: only where results are placed are they met one by one. A phrase must be found by
one of a query's heavy words: the light ones together couldn't cover enough of
it, so their postings, the long ones, are never read. Items are then fetched for
the best phrases only, down to a score under which none can be among the results.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import MAX_TOKENS, ascii_normalized, tokens
from lexiloom.operators import lexical as L
from lexiloom.operators.analytics import rank
from lexiloom.operators.word_index import KIND, WordIndex, blocks, heads, in_blocks, prepared, vocabulary
from lexiloom.sources.tables import kept

#: Least margin under a cap, factors of other locales, weight of function words, fields, and thresholds of the verdicts.
MARGIN, FOREIGN, FOREIGN_PREFIX, FUNCTION_WEIGHT, STRONG_FIELDS, DOMINANT_FIELDS = 0.01, 0.92, 0.7, 0.3, 4, 2
SURE, COVERED, FULL_CONFIDENCE = 0.6, 0.85, 0.9
#: Scripts written without spaces, and the longest piece that a run of them is split into.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}]"
MAX_PIECE = 16
#: Results of a query: the default and the most that may be asked for.
LIMIT, MAX_LIMIT = 24, 50


def thousandths(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def limited(asked: int | None) -> int:
    return LIMIT if asked is None else max(1, min(MAX_LIMIT, asked))


def pack_index(packs: list[DataFrame]) -> DataFrame:
    """The index of packs (item, phrase, field_ix, weight): a phrase of an item once, under its strongest field and first pack's weight; mask has a bit for each pack that holds it."""
    rows = reduce(DataFrame.unionByName, [p.select("item", "phrase", "field_ix", "weight", F.lit(i).alias("pack"), F.lit(1 << i).cast("long").alias("bit")) for i, p in enumerate(packs)])
    one = rows.filter("phrase <> ''").groupBy("item", "phrase").agg(F.min(F.struct("field_ix", "pack", "weight")).alias("r"), F.bit_or("bit").alias("mask"))
    return one.select("item", "phrase", "r.field_ix", "r.weight", "mask", F.size(tokens(F.col("phrase"))).alias("n_tokens"))


def postings(index: DataFrame) -> DataFrame:
    return index.withColumn("token", F.explode(tokens(F.col("phrase"))))


def segmented(asked: DataFrame, vocab: DataFrame, function_words: DataFrame) -> DataFrame:
    """asked (query_id, locale, toks) with tokens of unspaced scripts that are no words split into words, longest first; other letters stay together.

    Substrings of such tokens are joined to the vocabulary, so only those that are words reach Python.
    """
    own = asked.select("locale", F.explode("toks").alias("run")).filter(F.col("run").rlike(UNSPACED)).distinct()
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_PIECE), F.length(F.col("run")) - i + 1)), lambda n: F.substring("run", i, n))))
    pieces = own.select("locale", "run", F.explode(F.array_distinct(parts)).alias("token"))
    known = pieces.join(vocab.select("token"), "token").unionByName(pieces.join(function_words, ["locale", "token"], "left_semi")).groupBy("locale", "run").agg(F.collect_set("token").alias("known"))

    @F.pandas_udf("array<string>")
    def split(runs: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([segments(r, frozenset(w)) for r, w in zip(runs, words, strict=True)])

    cuts = known.select("locale", "run", split("run", "known").alias("pieces"))
    each = asked.select("query_id", "locale", F.posexplode("toks").alias("at", "run")).join(cuts, ["locale", "run"], "left")
    whole = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("pieces", F.array("run")).alias("p")))).alias("all"))
    return asked.drop("toks").join(whole.select("query_id", F.slice(F.flatten("all.p"), 1, MAX_TOKENS).alias("toks")), "query_id")


def segments(run: str, words: frozenset[str]) -> list[str]:
    """The run cut into words, the longest first from the left; letters between them stay together."""
    out, lost, at = [], "", 0
    while at < len(run):
        found = next((run[at : at + n] for n in range(min(MAX_PIECE, len(run) - at), 0, -1) if run[at : at + n] in words), "")
        if not found:
            lost += run[at]
            at += 1
            continue
        out += [lost, found] if lost else [found]
        lost, at = "", at + len(found)
    return [*out, lost] if lost else out


QUERY = ["query_id", "turn"]


def asked_tokens(queries: DataFrame, function_words: DataFrame, prefix: bool = True) -> DataFrame:
    """A row a token: query_id, turn, preferred, searched, n_query, pos, qtoken, function (it is a function word), only_exact and as_prefix.

    queries: query_id, turn, toks, open (the last word may be unfinished), locale, preferred, searched. function_words: locale, token; a locale's list is short and broadcast.
    """
    rows = queries.select(*QUERY, "locale", "preferred", "searched", "open", F.posexplode("toks").alias("pos", "qtoken"), F.size("toks").alias("n_query"))
    marked = rows.join(F.broadcast(function_words.select("locale", F.col("token").alias("qtoken"), F.lit(True).alias("function")).distinct()), ["locale", "qtoken"], "left").withColumn("function", F.coalesce("function", F.lit(False)))
    content = F.min(F.col("function").cast("int")).over(Window.partitionBy(*QUERY)) == 0
    return marked.withColumn("only_exact", content & F.col("function")).withColumn("as_prefix", F.lit(prefix) & F.col("open") & (F.col("pos") == F.col("n_query") - 1)).drop("open")


KEY = ["qtoken", "preferred", "searched", "only_exact", "as_prefix"]


def candidates(asked: DataFrame, vocab: DataFrame, begun: DataFrame | None = None, misspelt: DataFrame | None = None) -> DataFrame:
    """KEY, token, quality, partial (a completion into another locale's word) and kind, the order of the rules.

    Exact words; completions of the last word; and, for a token that has neither, a repeated last letter or a misspelling.
    begun and misspelt are the vocabulary's beginnings and deletions, if an index has stored them.
    """
    keys = asked.select(*KEY).distinct()
    inside, own = F.col("mask").bitwiseAND(F.col("searched")) != 0, F.col("mask").bitwiseAND(F.col("preferred")) != 0
    pick = lambda rows, quality, partial, kind: rows.select(*KEY, "token", quality.alias("quality"), partial.alias("partial"), F.lit(kind).alias("kind"))
    words = vocab.select("token", "mask")
    exact = keys.join(words.withColumnRenamed("token", "qtoken"), "qtoken").filter(inside).withColumn("token", F.col("qtoken"))
    known = keys.filter("as_prefix and not only_exact").join(exact.select(*KEY, F.lit(True).alias("known")), KEY, "left")
    longer = known.join(heads(vocab) if begun is None else begun, "qtoken").filter(inside & (F.col("token") != F.col("qtoken")))
    quality = (L.PREFIX_BASE + L.PREFIX_SHARE * F.length("qtoken") / F.length("token")) * F.when(F.col("known"), L.PREFIX_OF_WORD).otherwise(1.0) * F.when(own, 1.0).otherwise(FOREIGN_PREFIX)
    met = kept(pick(exact, F.lit(1.0), F.lit(False), 0).unionByName(pick(longer, quality, ~own, 1)), "met")

    lost = keys.filter("not only_exact").join(met.select(*KEY).distinct(), KEY, "left_anti")
    short = lost.withColumn("token", F.regexp_replace("qtoken", r"(.)\1+$", "$1")).filter("token <> qtoken").join(words, "token").filter(inside)
    brief = F.length("qtoken") <= L.SHORT_TYPO
    typos = lost.join(L.fuzzy_candidates(lost, vocab, misspelt), "qtoken").join(words, "token").filter(inside)
    typos = typos.filter(~(brief & (F.startswith(F.col("qtoken"), F.col("token")) | ~own)))
    every = [met, pick(short, F.lit(L.SQUEEZE), F.lit(False), 2), pick(typos, F.col("quality"), F.lit(False), 3)]
    return reduce(DataFrame.unionByName, every).groupBy(*KEY, "token").agg(F.max("quality").alias("quality"), F.max("partial").alias("partial"), F.min("kind").alias("kind"))


def scored(asked: DataFrame, words: WordIndex, least: float = L.MIN_COVERAGE) -> DataFrame:
    """A row for each query and kind of phrase that is good enough: its items, its score s, whether it is the whole query (exact), completes another locale's word (part) and how much of the query its whole words cover."""
    vocab = words.vocabulary
    cands = kept(candidates(asked, vocab, words.heads, words.misspellings), "candidates")
    top = F.broadcast(vocab.agg(F.max("idf").alias("top_idf")))
    ranked = cands.join(vocab.select("token", "idf"), "token").groupBy(*KEY).agg(F.min_by("idf", F.struct(-F.col("quality"), "kind", F.when(F.col("kind") == 3, F.length("token")).otherwise(0), "token")).alias("idf"))
    weight = F.coalesce("idf", "top_idf")
    weighed = asked.join(ranked, KEY, "left").join(top).withColumn("w", F.when(F.col("function"), F.least(weight, F.lit(FUNCTION_WEIGHT))).otherwise(weight))
    query = Window.partitionBy(*QUERY)
    lighter = query.orderBy("w", "pos").rowsBetween(Window.unboundedPreceding, 0)
    unknown = F.max((F.col("idf").isNull() & ~F.col("function")).cast("int")).over(query)
    weighed = weighed.withColumn("total", F.sum("w").over(query)).withColumn("unknown", unknown)
    weighed = weighed.withColumn("heavy", F.sum("w").over(lighter) >= F.col("total") * (least - 1e-9))
    of_query = ["preferred", "searched", "n_query", "total", "unknown"]
    meant = kept(weighed.select(*QUERY, "n_query", "total", "unknown", "pos", "w", "heavy", *KEY).join(cands, KEY).select(*QUERY, *of_query, "pos", "w", "heavy", "token", "quality", "partial"), "meant")

    wanted = meant.filter("heavy").select(*QUERY, "searched", "token").distinct().join(vocab.select("token", "blocks"), "token")
    found = in_blocks(wanted, F.col("blocks")).join(words.postings, ["token", "block"]).filter(F.col("mask").bitwiseAND(F.col("searched")) != 0).select(*QUERY, *KIND, "n_tokens", "items").distinct()
    by = [*QUERY, *KIND, "n_tokens", "items", "preferred", "n_query", "total", "unknown"]
    hits = found.withColumn("token", F.explode(F.array_distinct(tokens(F.col("phrase"))))).join(meant, [*QUERY, "token"])
    token = hits.groupBy(*by, "pos", "w").agg(F.max("quality").alias("q"), F.max((~F.col("partial")).cast("int")).alias("whole"))
    sums = token.groupBy(*by).agg(F.sum(F.col("q") * F.col("w")).alias("got"), F.sum(F.col("whole") * F.col("w")).alias("got_whole"), F.count("*").alias("matched"), F.count_if(F.col("q") == 1).alias("exact_tokens"), F.min("whole").alias("all_whole"))
    rows = sums.withColumn("coverage", F.col("got") / F.col("total")).filter(F.col("coverage") >= least)
    rows = rows.filter(~((F.col("unknown") == 1) & (F.col("matched") == 1) & (F.col("exact_tokens") == 0)))
    exact = (F.col("exact_tokens") == F.col("n_query")) & (F.col("n_tokens") == F.col("n_query"))
    own = F.col("mask").bitwiseAND(F.col("preferred")) != 0
    score = F.col("weight") * F.col("coverage") * (L.LENGTH_BASE + L.LENGTH_SHARE * F.least(F.lit(1.0), F.col("matched") / F.col("n_tokens")))
    score = score * F.when(exact, F.when(F.col("n_query") >= 2, L.EXACT_MANY).otherwise(1.0)).otherwise(L.INEXACT) * F.when(own, 1.0).otherwise(FOREIGN)
    return rows.select(*QUERY, *KIND, "items", F.round(score, 9).alias("s"), exact.alias("exact"), own.alias("own"), (F.col("all_whole") == 0).alias("part"), (F.col("got_whole") / F.col("total")).alias("covers"))


#: Times the results that are asked for: items whose best phrases set the score under which no other is fetched.
DEPTH = 4
#: How far below the last of so many items' scores another one's best phrase can lie and its final score still be higher: the bonus, and the margin of the caps.
REACH = L.MAX_BONUS + MARGIN


def reachable(rows: DataFrame, words: WordIndex, size: int) -> DataFrame:
    """query_id, turn, item: items that can be among the first `size` of a query, or set a cap for them.

    The best kinds of a query, whole levels of score, are expanded until DEPTH
    times `size` items are met. If `size` of those are best known by a phrase of
    the preferred locale that no cap but the first can lower, an item whose best
    phrase lies REACH below the last of them stays behind them all.
    """
    raw = F.round(F.col("s") * 1e9).cast("long")
    rows = rows.withColumn("raw", raw)
    fetch = lambda some: in_blocks(some, blocks(F.col("items"))).join(words.members, [*KIND, "block"])
    down = Window.partitionBy(*QUERY).orderBy(F.desc("raw"))
    levels = rows.groupBy(*QUERY, "raw").agg(F.sum("items").alias("items")).withColumn("upto", F.sum("items").over(down) - F.col("items"))
    head = rows.join(levels.filter(F.col("upto") < DEPTH * size).select(*QUERY, "raw"), [*QUERY, "raw"])
    best = fetch(head).groupBy(*QUERY, "item").agg(F.min_by(F.struct("raw", (F.col("own") & ~F.col("part")).alias("pure")), F.struct(-F.col("raw"), "field_ix", "phrase")).alias("r"))
    pure = best.filter("r.pure").groupBy(*QUERY, F.col("r.raw").alias("raw")).count().withColumn("upto", F.sum("count").over(down))
    last = pure.filter(F.col("upto") >= size).groupBy(*QUERY).agg(F.max("raw").alias("last"))
    sure = F.col("own") & F.col("exact") & (F.col("field_ix") < STRONG_FIELDS)
    near = F.col("last").isNull() | sure | (F.col("raw") >= F.col("last") - int(REACH * 1e9) - 1)
    return fetch(rows.join(last, QUERY, "left").filter(near)).select(*QUERY, "item").distinct()


def best_items(rows: DataFrame, words: WordIndex, size: int) -> DataFrame:
    """A row for each query and reachable item: its best phrase, with a bonus for further phrases of the preferred locale."""
    rows = reachable(rows, words, size).join(words.items.select("item", *KIND), "item").join(rows, [*QUERY, *KIND])
    order = F.struct(-F.col("s"), "field_ix", "phrase")
    strong = F.col("own") & F.col("exact") & (F.col("field_ix") < STRONG_FIELDS)
    best = rows.groupBy(*QUERY, "item").agg(F.min_by(F.struct("phrase", "field_ix", "s", "exact", "own", "part"), order).alias("r"), F.count_if("own").alias("n_own"), F.max(strong).alias("sure")).select(*QUERY, "item", "r.*", "n_own", "sure")
    support = F.col("n_own") - F.col("own").cast("int")
    return best.withColumn("score", F.least(F.lit(1.0), F.col("s") + F.least(F.lit(L.MAX_BONUS), L.BONUS * support)))


def capped(items: DataFrame) -> DataFrame:
    """The three caps, in order: parts of a query below its whole matches, other locales' exact names below own exact matches, other locales' completions below own matches."""
    query = Window.partitionBy(*QUERY)
    raw = F.round(F.col("s") * 1e9).cast("long")
    above = query.orderBy(F.desc("raw")).rangeBetween(Window.unboundedPreceding, -1)  # strictly better phrases
    floor = F.min(F.when(F.col("exact") & F.col("own"), F.col("score"))).over(above)
    rows = items.withColumn("raw", raw).withColumn("floor", floor)
    lower = lambda condition, cap: F.when(condition & cap.isNotNull(), F.least(F.col("score"), cap)).otherwise(F.col("score"))
    rows = rows.withColumn("score", lower(~F.col("exact"), F.col("floor") - MARGIN))
    rows = rows.withColumn("top", F.max(F.when(F.col("sure"), F.col("score"))).over(query))
    rows = rows.withColumn("score", lower(~F.col("sure") & F.col("exact") & (F.col("field_ix") < DOMINANT_FIELDS) & ~F.col("own") & (F.col("top") > 0), F.col("top") - MARGIN))
    rows = rows.withColumn("low", F.min(F.when(~F.col("part") & F.col("own"), F.col("score"))).over(query))
    return rows.withColumn("score", lower(F.col("part"), F.greatest(F.lit(0.0), F.col("low") - MARGIN))).drop("raw", "floor", "top", "low")


def ranked(items: DataFrame, alike: DataFrame, popularity: DataFrame, limit: int) -> DataFrame:
    """query_id, turn, place, item, score, phrase, field_ix: by score, then popularity (item, popularity), then item.

    items stand for those alike (item, member). Of these only the first `limit` can be among the results, and only in
    the `limit` groups whose first ones come first.
    """
    order = [F.desc_nulls_last("popularity"), "member"]
    known = alike.join(popularity.select(F.col("item").alias("member"), "popularity"), "member", "left")
    firsts = kept(known.withColumn("n", rank(Window.partitionBy("item").orderBy(*order))).filter(F.col("n") <= limit), "firsts")
    query = Window.partitionBy(*QUERY).orderBy(F.desc("score"), *order)
    few = lambda rows: rows.withColumn("place", rank(query)).filter(F.col("place") <= limit)
    groups = few(items.withColumn("score", F.round("score", 9)).join(firsts.filter("n = 1").drop("n"), "item")).drop("popularity", "member", "place")
    placed = few(groups.join(firsts.drop("n"), "item"))
    return placed.select(*QUERY, "place", F.col("member").alias("item"), thousandths(F.col("score")).alias("score"), "phrase", "field_ix")


def joined_words(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """The queries (query_id, toks, ...) with a first pair of neighbours that make one word, joined; the others are left out."""
    pairs = queries.select("query_id", F.posexplode(F.transform(F.slice("toks", 2, MAX_TOKENS), lambda t, i: F.struct(F.get(F.col("toks"), i).alias("left"), t.alias("right")))).alias("at", "p")).select("query_id", "at", "p.*")
    pairs = pairs.filter((F.length("left") >= 2) & (F.length("right") >= 2) & ~F.concat("left", "right").rlike(UNSPACED)).withColumn("token", F.concat("left", "right"))
    first = pairs.join(vocab.select("token"), "token").groupBy("query_id").agg(F.min(F.struct("at", "token")).alias("r"))
    toks = F.concat(F.slice("toks", 1, F.col("r.at")), F.array("r.token"), F.slice("toks", F.col("r.at") + 3, MAX_TOKENS))
    return queries.join(first, "query_id").withColumn("toks", toks).drop("r")


def search(queries: DataFrame, index: DataFrame | WordIndex, popularity: DataFrame, function_words: DataFrame, limit: int | None = None, prefix: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, coverage): query_id, place, item, score, phrase, field_ix; and query_id, confidence, coverage, n_query of every query with tokens.

    A query whose neighbouring words make one word is searched that way too, at a
    factor; each item keeps its better score. An index that isn't stored is
    prepared for this search alone.
    """
    size = limited(limit)
    words = index if isinstance(index, WordIndex) else prepared(index)
    toks = F.slice(tokens(ascii_or_given(F.col("q"))), 1, MAX_TOKENS)
    rows = queries.select("query_id", "locale", "preferred", "searched", toks.alias("toks"), (~F.col("q").rlike(r"\s$")).alias("open"))
    rows = kept(segmented(kept(rows.filter(F.size("toks") > 0), "queries"), words.vocabulary, function_words), "segmented")
    both = rows.withColumn("turn", F.lit(0)).unionByName(joined_words(rows, words.vocabulary).withColumn("turn", F.lit(1)))
    phrases = kept(scored(asked_tokens(both, function_words, prefix), words), "phrases")
    covers = phrases.groupBy("query_id").agg(thousandths(F.max("covers")).alias("coverage"))
    listed = ranked(capped(best_items(phrases, words, size)), words.alike, popularity, size)
    listed = listed.withColumn("score", F.when(F.col("turn") == 1, thousandths(F.round(F.col("score") * L.REJOINED, 9))).otherwise(F.col("score")))
    born = F.min(F.struct("turn", "place"))  # equal scores keep the order of the query as typed, then of the joined one
    best = listed.groupBy("query_id", "item").agg(F.min_by(F.struct("score", "phrase", "field_ix"), F.struct(-F.col("score"), "turn")).alias("r"), born.alias("born")).select("query_id", "item", "r.*", "born")
    placed = best.withColumn("place", rank(Window.partitionBy("query_id").orderBy(F.desc("score"), "born"))).filter(F.col("place") <= size)
    results = kept(placed.select("query_id", "place", "item", "score", "phrase", "field_ix"), "results")
    tops = results.groupBy("query_id").agg(F.max("score").alias("confidence"))
    known = rows.select("query_id", F.size("toks").alias("n_query")).join(tops, "query_id", "left").join(covers, "query_id", "left")
    return results, known.fillna(0.0, ["confidence", "coverage"])


def ascii_or_given(q: Column) -> Column:
    """Normalised text: ASCII by column functions; other scripts are normalised before, by text.normalized()."""
    return F.when(q.rlike(r"^[\x00-\x7F]*$"), ascii_normalized(q)).otherwise(F.trim(q))


def wants_semantic(coverage: DataFrame) -> DataFrame:
    """coverage with semantic: whether the dictionary is too unsure to answer alone."""
    return coverage.withColumn("semantic", (F.col("confidence") < SURE) | ((F.col("n_query") >= 2) & (F.col("confidence") < FULL_CONFIDENCE)))


def verdicts(coverage: DataFrame, semantic_strength: DataFrame | None = None) -> DataFrame:
    """coverage with unsure: the dictionary doesn't cover the query, and no semantic list (query_id, strength) is strong."""
    covered = (F.col("coverage") >= COVERED) & (F.col("confidence") >= SURE)
    rows = coverage if semantic_strength is None else coverage.join(semantic_strength, "query_id", "left")
    strong = F.lit(False) if semantic_strength is None else F.coalesce(F.col("strength") >= SURE, F.lit(False))
    return rows.withColumn("unsure", ~covered & ~strong)


#: Fixed values of the free-text match.
TEXT_TOKENS, PER_WINDOW, TEXT_LEAST, PHRASE_BONUS, TEXT_BONUS, TEXT_MAX_BONUS, COMMON_FACTOR = 64, 16, 0.45, 0.1, 0.04, 0.12, 0.6


def text_windows(texts: DataFrame, stop_words: list[str], most: int = 4, max_tokens: int | None = None) -> DataFrame:
    """text_id, window, words: distinct runs of one to `most` tokens that aren't stop words alone, and the text's distinct tokens. texts: text_id, toks."""
    from lexiloom.functions.text import windows

    rows = texts.withColumn("toks", F.slice("toks", 1, max_tokens)) if max_tokens else texts
    stops = F.array(*map(F.lit, stop_words)).cast("array<string>")
    telling = lambda w: F.size(F.array_except(F.split(w, " "), stops)) > 0
    return rows.select("text_id", F.explode(F.filter(F.array_distinct(windows(F.col("toks"), most)), telling)).alias("window"), F.array_distinct("toks").alias("words"))


def match_text(texts: DataFrame, index: DataFrame, popularity: DataFrame, function_words: DataFrame, stop_words: list[str], common: list[str], limit: int = 10, max_tokens: int | None = TEXT_TOKENS) -> DataFrame:
    """text_id, place, item, score, phrase, window: items whose phrases stand in a text.

    Each distinct window is searched once over all texts. A result counts by its
    score, the squared share of its phrase that stands in the text, and a factor
    of its length; further phrases add a bonus; and items of one window follow
    one another with falling scores. texts: text_id, toks, locale, preferred, searched.
    """
    found = kept(text_windows(texts.select("text_id", "toks"), stop_words, max_tokens=max_tokens).join(texts.select("text_id", "locale", "preferred", "searched"), "text_id"), "windows")
    asked = found.select(F.col("window").alias("q"), "locale", "preferred", "searched").distinct().withColumn("query_id", F.xxhash64("q", "locale", "preferred", "searched"))
    results, _ = search(asked, index, popularity, function_words, PER_WINDOW, prefix=False)
    hits = found.withColumn("query_id", F.xxhash64("window", "locale", "preferred", "searched")).join(results.drop("place"), "query_id")
    parts = F.split("phrase", " ")
    there = F.aggregate(parts, F.lit(0.0), lambda s, w: s + F.when(F.array_contains("words", w), 1.0).when((F.length(w) >= 4) & F.exists("words", lambda x: _one_edit(w, x)), 0.5).otherwise(0.0))
    share = there / F.size(parts)
    factor = F.when(F.size(parts) > 1, 1 + PHRASE_BONUS * (F.size(parts) - 1)).when(F.col("phrase").isin(common), COMMON_FACTOR).otherwise(1.0)
    rows = hits.withColumn("s", F.round(F.col("score") * share * share * factor, 9)).filter(F.col("s") >= TEXT_LEAST)
    best = rows.groupBy("text_id", "item").agg(F.min_by(F.struct("s", "phrase", "window"), F.struct(-F.col("s"), -F.size(F.split("window", " ")), "window", "phrase")).alias("r"), F.count_distinct("phrase").alias("n")).select("text_id", "item", "r.*", "n")
    total = F.least(F.lit(1.0), F.col("s") + F.least(F.lit(TEXT_MAX_BONUS), TEXT_BONUS * (F.col("n") - 1)))
    spread = L.diversified(best.select(F.col("text_id").alias("query_id"), "item", "phrase", "window", total.alias("score")), "window")
    placed = spread.withColumn("place", rank(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))).filter(F.col("place") <= limit)
    return placed.select(F.col("query_id").alias("text_id"), "place", "item", thousandths(F.col("score")).alias("score"), "phrase", "window")


def _one_edit(a: Column, b: Column) -> Column:
    """At most one edit, or one swap of neighbours, apart."""
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.lit(64))) == b)
    return (F.abs(F.length(a) - F.length(b)) <= 1) & ((F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swap))


#: Factors of reactions offline, and the score of those that fill the list.
REACTION_FACTOR, FACE_FACTOR, TOPIC_FACTOR, FILL_SCORE = 1.15, 0.95, 0.7, 0.3


def offline_reactions(matches: DataFrame, asks: DataFrame, kinds: DataFrame, fill: list[tuple[int, bool]], limit: int = 6) -> DataFrame:
    """text_id, place, item, score: matches of match_text() leaning to items people react with, then fixed ones.

    asks: text_id, question; kinds: item, kind (reaction, face or other); fill: (item, only for questions), in order.
    """
    factor = F.when(F.col("kind") == "reaction", REACTION_FACTOR).when(F.col("kind") == "face", FACE_FACTOR).otherwise(TOPIC_FACTOR)
    own = matches.join(kinds, "item", "left").select("text_id", "item", F.lit(0).alias("tier"), F.col("place").alias("was"), F.least(F.lit(1.0), F.round(F.col("score") * factor, 9)).alias("score"))
    listed = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(only).alias("only"), F.lit(at).alias("was")) for at, (i, only) in enumerate(fill)])
    more = asks.select("text_id", "question", F.explode(listed).alias("f")).filter("question or not f.only").select("text_id", F.col("f.item").cast("long").alias("item"), F.lit(1).alias("tier"), F.col("f.was").cast("long").alias("was"), F.lit(FILL_SCORE).alias("score"))
    top = own.withColumn("n", rank(Window.partitionBy("text_id").orderBy(F.desc("score"), "was"))).filter(F.col("n") <= limit).drop("n")
    rest = more.join(top.select("text_id", "item"), ["text_id", "item"], "left_anti")
    placed = top.unionByName(rest).withColumn("place", rank(Window.partitionBy("text_id").orderBy("tier", F.when(F.col("tier") == 0, -F.col("score")), "was"))).filter(F.col("place") <= limit)
    return placed.select("text_id", "place", "item", thousandths(F.col("score")).alias("score"))
