"""Queries of lexical search over two locales' packs and of free-text matches, with their SQL.

The packs come from `part`: an English one of names, types and brands, and a
French one whose names have their words swapped. Queries are names, some cut,
misspelt, split or with an unknown word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import fusion as R
from lexiloom.operators import lexical as L
from lexiloom.operators import locale_search as S
from lexiloom.sources.tables import read_table as table

FUNCTION_WORDS = [("en", "new"), ("en", "the"), ("fr", "old")]
STOP_WORDS, COMMON_WORDS = ["the", "of", "a"], ["new", "old"]


def packs(s, d):
    part = table(s, d, "part")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    english = L.phrases(part, "p_partkey", {"name": "p_name", "keyword": "p_type", "alias": "p_brand"})
    french = L.phrases(part.select("p_partkey", F.concat_ws(" ", second, first).alias("name"), first.alias("alias")), "p_partkey", {"name": "name", "alias": "alias"})
    return S.pack_index([english, french])


def masks(df):
    """Even queries prefer English, odd ones French; two of three search both, the others their own and English."""
    own = F.when(F.col("query_id") % 2 == 0, 1).otherwise(2)
    searched = F.when(F.col("query_id") % 3 == 0, own.bitwiseOR(F.lit(1))).otherwise(3)
    return df.withColumn("locale", F.when(F.col("query_id") % 2 == 0, "en").otherwise("fr")).withColumn("preferred", own.cast("long")).withColumn("searched", searched.cast("long"))


def queries_of(s, d):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    names = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    n = F.col("query_id") % 7
    swapped = F.concat(F.left(b, F.lit(1)), F.substring(b, 3, 1), F.substring(b, 2, 1), F.substr(b, F.lit(4)))
    q = (
        F.when(n == 0, F.col("p_name")).when(n == 1, F.concat_ws(" ", a, F.left(b, F.lit(2)))).when(n == 2, F.concat_ws(" ", F.concat(b, F.right(b, F.lit(1))), a))
        .when(n == 3, F.concat(F.lit("zzzzz "), a)).when(n == 4, F.concat_ws(" ", a, swapped)).when(n == 5, F.concat_ws(" ", a, F.left(b, F.lit(2)), F.substr(b, F.lit(3)))).otherwise(F.concat(b, F.lit(" ")))
    )
    return masks(names.select("query_id", q.alias("q")))


def function_words(s):
    return s.createDataFrame(FUNCTION_WORDS, "locale string, token string")


def popularity(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("popularity"))


def found(s, d):
    return S.search(queries_of(s, d), packs(s, d), popularity(s, d), function_words(s), 8)


def typo_candidates(s, d):
    asked = S.asked_tokens(queries_of(s, d).select("*", F.slice(T.tokens(T.ascii_normalized(F.col("q"))), 1, 8).alias("toks"), (~F.col("q").rlike(r"\s$")).alias("open"), F.lit(0).alias("turn")), function_words(s))
    return S.candidates(asked, S.vocabulary(S.postings(packs(s, d)))).select("qtoken", "preferred", "searched", "token", F.round("quality", 6).alias("quality"), "partial", "kind").distinct()


def semantic_strength(s, d):
    coverage = found(s, d)[1]
    return S.verdicts(coverage, coverage.select("query_id", ((F.col("query_id") % 10) / 10.0).alias("strength"))).select("query_id", "confidence", "coverage", "unsure")


def messages(s, d):
    """Texts made of four names each, and their locale."""
    part = table(s, d, "part").select(F.floor(F.col("p_partkey") / 40).alias("text_id"), F.col("p_partkey").alias("k"), "p_name").filter("k % 10 = 3")
    rows = part.groupBy("text_id").agg(F.concat_ws(" of the ", F.array_sort(F.collect_list(F.struct("k", "p_name")))["p_name"]).alias("text"))
    return masks(rows.withColumn("query_id", F.col("text_id"))).drop("query_id").withColumn("toks", T.tokens(T.ascii_normalized(F.col("text"), 1 << 30)))


def matches(s, d, limit=10):
    return S.match_text(messages(s, d).drop("text"), packs(s, d), popularity(s, d), function_words(s), STOP_WORDS, COMMON_WORDS, limit)


def reactions(s, d):
    kinds = table(s, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 40, "reaction").when(F.col("p_size") > 20, "face").otherwise("other").alias("kind"))
    asks = messages(s, d).select("text_id", (F.col("text_id") % 2 == 0).alias("question"))
    return S.offline_reactions(matches(s, d, 40), asks, kinds, [(1, True), (2, True), (3, False), (4, False)])


def slang(s, d):
    """Items named by numbers; queries of digits."""
    index = table(s, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("string").alias("phrase"), (F.col("p_partkey") % 6).cast("int").alias("field_ix"))
    q = table(s, d, "part").select(F.col("p_size").cast("long").alias("query_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("n "), F.col("p_size").cast("string"))).alias("q")).distinct()
    ranked = q.join(index, F.col("phrase") == F.regexp_replace("q", "n ", "")).withColumn("place", S.rank(S.Window.partitionBy("query_id").orderBy("item")))
    return R.number_slang(q, ranked.select("query_id", F.col("item").alias("id"), "place", F.lit(0.7).alias("score"), "phrase", "field_ix"))


NORM = "trim(left(trim(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9+]+', ' ', 'g')), 64))"
PACKS = f"""raw AS (SELECT p_partkey AS item, p, f, w, {NORM.format(x="t")} AS phrase FROM (
 SELECT p_partkey, 0 AS p, 0 AS f, 1.0e0 AS w, p_name AS t FROM part UNION ALL SELECT p_partkey, 0, 2, 0.85e0, p_type FROM part UNION ALL SELECT p_partkey, 0, 3, 0.8e0, p_brand FROM part
 UNION ALL SELECT p_partkey, 1, 0, 1.0e0, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part UNION ALL SELECT p_partkey, 1, 3, 0.8e0, split_part(p_name, ' ', 1) FROM part)),
 phr AS (SELECT item, phrase, first(f ORDER BY f, p) AS field_ix, first(w ORDER BY f, p) AS weight, CAST(bit_or(1 << p) AS BIGINT) AS mask, len(string_split(phrase, ' ')) AS n_tokens FROM raw WHERE phrase <> '' GROUP BY item, phrase),
 posts AS (SELECT *, unnest(string_split(phrase, ' ')) AS token FROM phr),
 vocab AS (SELECT token, bit_or(mask) AS mask, ln(1 + (SELECT count(DISTINCT item) FROM posts) / count(DISTINCT item)) AS idf FROM posts GROUP BY token),
 fw(locale, token) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in FUNCTION_WORDS)}), pop AS (SELECT p_partkey AS item, p_size AS popularity FROM part)"""
MASKS = "CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'fr' END AS locale, CAST(CASE WHEN query_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS preferred, CAST(CASE WHEN query_id % 3 = 0 AND query_id % 2 = 0 THEN 1 ELSE 3 END AS BIGINT) AS searched"
ASKED = f"""names AS (SELECT min(p_partkey) AS query_id, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part GROUP BY p_name),
 qs AS (SELECT query_id, CASE query_id % 7 WHEN 0 THEN p_name WHEN 1 THEN a || ' ' || left(b, 2) WHEN 2 THEN b || right(b, 1) || ' ' || a WHEN 3 THEN 'zzzzz ' || a WHEN 4 THEN a || ' ' || b[1] || b[3] || b[2] || b[4:] WHEN 5 THEN a || ' ' || left(b, 2) || ' ' || b[3:] ELSE b || ' ' END AS q FROM names),
 t0 AS (SELECT query_id, {MASKS}, NOT regexp_matches(q, '\\s$') AS open, string_split({NORM.format(x="q")}, ' ') AS toks FROM qs)"""


def chain(t: str, limit: int, prefix: bool = True) -> str:
    """The search of the queries t{t} (query_id, locale, preferred, searched, open, toks) down to r{t}."""
    key = "qtoken, preferred, searched, only_exact, as_prefix"
    budget = "CASE WHEN length(qtoken) < 4 THEN 0 WHEN length(qtoken) < 8 THEN 1 ELSE 2 END"
    return f"""u{t} AS (SELECT query_id, locale, preferred, searched, open, unnest(toks) AS qtoken, generate_subscripts(toks, 1) - 1 AS pos, len(toks) AS n_query FROM t{t}),
 a{t} AS (SELECT u.*, fw.token IS NOT NULL AS function, fw.token IS NOT NULL AND NOT bool_and(fw.token IS NOT NULL) OVER (PARTITION BY query_id) AS only_exact, {"open" if prefix else "false"} AND pos = n_query - 1 AS as_prefix FROM u{t} u LEFT JOIN fw ON fw.locale = u.locale AND fw.token = u.qtoken),
 k{t} AS (SELECT DISTINCT {key} FROM a{t}),
 ex{t} AS (SELECT k.*, token FROM k{t} k JOIN vocab ON token = qtoken AND mask & searched <> 0),
 nr{t} AS (SELECT * FROM (SELECT qtoken, token, mask FROM (SELECT DISTINCT qtoken FROM k{t} WHERE as_prefix AND NOT only_exact) JOIN vocab ON starts_with(token, qtoken) QUALIFY row_number() OVER (PARTITION BY qtoken ORDER BY token) <= 400) WHERE token <> qtoken),
 lo{t} AS (SELECT k.*, n.token, n.mask & preferred = 0 AS partial, (0.6e0 + 0.35e0 * length(qtoken) / length(n.token)) * CASE WHEN ex.token IS NULL THEN 1e0 ELSE 0.5e0 END * CASE WHEN n.mask & preferred <> 0 THEN 1e0 ELSE 0.7e0 END AS quality FROM k{t} k JOIN nr{t} n USING (qtoken) LEFT JOIN ex{t} ex USING ({key}) WHERE as_prefix AND NOT only_exact AND n.mask & searched <> 0),
 ls{t} AS (SELECT k.* FROM k{t} k ANTI JOIN (SELECT {key} FROM ex{t} UNION SELECT {key} FROM lo{t}) USING ({key}) WHERE NOT only_exact),
 c{t} AS (SELECT {key}, token, max(quality) AS quality, max(partial) AS partial, min(kind) AS kind FROM (SELECT {key}, token, 1e0 AS quality, false AS partial, 0 AS kind FROM ex{t} UNION ALL SELECT {key}, token, quality, partial, 1 FROM lo{t}
  UNION ALL SELECT {key}, token, 0.85e0, false, 2 FROM ls{t} JOIN vocab ON length(token) < length(qtoken) AND qtoken = token || repeat(right(token, 1), CAST(length(qtoken) - length(token) AS BIGINT)) AND (length(token) < 2 OR right(token, 1) <> token[-2]) WHERE mask & searched <> 0
  UNION ALL SELECT {key}, token, CASE WHEN damerau_levenshtein(qtoken, token) = 2 THEN 0.65e0 WHEN length(qtoken) <= 5 THEN 0.7e0 ELSE 0.8e0 END, false, 3 FROM ls{t} JOIN vocab ON (qtoken[1] = token[1] OR (qtoken[1] = token[2] AND qtoken[2] = token[1])) AND damerau_levenshtein(qtoken, token) BETWEEN 1 AND {budget} WHERE mask & searched <> 0 AND NOT (length(qtoken) <= 5 AND (starts_with(qtoken, token) OR mask & preferred = 0))) GROUP BY ALL),
 b{t} AS (SELECT {key}, first(idf ORDER BY quality DESC, kind, CASE WHEN kind = 3 THEN length(token) ELSE 0 END, token) AS idf FROM c{t} JOIN vocab USING (token) GROUP BY ALL),
 w{t} AS (SELECT a.*, idf, CASE WHEN function THEN least(coalesce(idf, (SELECT max(idf) FROM vocab)), 0.3e0) ELSE coalesce(idf, (SELECT max(idf) FROM vocab)) END AS w FROM a{t} a LEFT JOIN b{t} USING ({key})),
 to{t} AS (SELECT query_id, sum(w) AS total, max(idf IS NULL AND NOT function) AS unknown FROM w{t} GROUP BY 1),
 pt{t} AS (SELECT query_id, item, phrase, field_ix, weight, p.mask, n_tokens, n_query, w.preferred, pos, w, max(quality) AS q, max(NOT partial) AS whole FROM w{t} w JOIN c{t} c USING ({key}) JOIN posts p ON p.token = c.token AND p.mask & w.searched <> 0 GROUP BY ALL),
 ph{t} AS (SELECT query_id, item, phrase, field_ix, weight, mask, n_tokens, n_query, preferred, sum(q * w) AS got, sum(CASE WHEN whole THEN w ELSE 0e0 END) AS got_whole, count(*) AS matched, count_if(q = 1) AS n_exact, bool_and(whole) AS all_whole FROM pt{t} GROUP BY ALL),
 sc{t} AS (SELECT *, n_exact = n_query AND n_tokens = n_query AS exact, mask & preferred <> 0 AS own, NOT all_whole AS part, got_whole / total AS covers,
  round(weight * (got / total) * (0.6e0 + 0.4e0 * least(1.0e0, matched / n_tokens)) * CASE WHEN n_exact = n_query AND n_tokens = n_query THEN CASE WHEN n_query >= 2 THEN 1.1e0 ELSE 1e0 END ELSE 0.9e0 END * CASE WHEN mask & preferred <> 0 THEN 1e0 ELSE 0.92e0 END, 9) AS s FROM ph{t} JOIN to{t} USING (query_id) WHERE got / total >= 0.34e0 AND NOT (unknown AND matched = 1 AND n_exact = 0)),
 it{t} AS (SELECT query_id, item, first(phrase ORDER BY s DESC, field_ix, phrase) AS phrase, first(field_ix ORDER BY s DESC, field_ix, phrase) AS field_ix, max(s) AS s, first(exact ORDER BY s DESC, field_ix, phrase) AS exact, first(own ORDER BY s DESC, field_ix, phrase) AS own, first(part ORDER BY s DESC, field_ix, phrase) AS part, count_if(own) AS n_own, max(own AND exact AND field_ix < 4) AS sure, max(covers) AS covers FROM sc{t} GROUP BY 1, 2),
 i1{t} AS (SELECT *, least(1e0, s + least(0.06e0, 0.02e0 * (n_own - CASE WHEN own THEN 1 ELSE 0 END))) AS score FROM it{t}),
 i2{t} AS (SELECT * REPLACE (CASE WHEN NOT exact AND f IS NOT NULL THEN least(score, f - 0.01e0) ELSE score END AS score) FROM (SELECT x.*, (SELECT min(score) FROM i1{t} y WHERE y.query_id = x.query_id AND y.exact AND y.own AND y.s > x.s) AS f FROM i1{t} x)),
 i3{t} AS (SELECT * REPLACE (CASE WHEN NOT sure AND exact AND field_ix < 2 AND NOT own AND top > 0 THEN least(score, top - 0.01e0) ELSE score END AS score) FROM (SELECT *, max(CASE WHEN sure THEN score END) OVER (PARTITION BY query_id) AS top FROM i2{t})),
 i4{t} AS (SELECT * REPLACE (round(CASE WHEN part AND low IS NOT NULL THEN least(score, greatest(0e0, low - 0.01e0)) ELSE score END, 9) AS score) FROM (SELECT *, min(CASE WHEN NOT part AND own THEN score END) OVER (PARTITION BY query_id) AS low FROM i3{t})),
 r{t} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, popularity DESC, item) AS place, item, floor(score * 1000 + 0.5e0) / 1000 AS score, phrase, field_ix FROM i4{t} JOIN pop USING (item) QUALIFY place <= {limit})"""


def merged(limit: int) -> str:
    """j1: queries with two words joined; res: both searches' results; cov: confidence and coverage."""
    return f"""jp AS (SELECT query_id, min(i) AS i FROM (SELECT query_id, unnest(range(1, len(toks))) AS i, toks FROM t0) WHERE length(toks[i]) >= 2 AND length(toks[i + 1]) >= 2 AND toks[i] || toks[i + 1] IN (SELECT token FROM vocab) GROUP BY 1),
 t1 AS (SELECT query_id, locale, preferred, searched, open, list_concat(list_concat(toks[1 : i - 1], [toks[i] || toks[i + 1]]), toks[i + 2 :]) AS toks FROM t0 JOIN jp USING (query_id)), {chain("1", limit)},
 un AS (SELECT *, 0 AS turn FROM r0 UNION ALL SELECT * REPLACE (floor(round(score * 0.95e0, 9) * 1000 + 0.5e0) / 1000 AS score), 1 FROM r1),
 be AS (SELECT query_id, item, first(score ORDER BY score DESC, turn) AS score, first(phrase ORDER BY score DESC, turn) AS phrase, first(field_ix ORDER BY score DESC, turn) AS field_ix, min(turn * 1000 + place) AS born FROM un GROUP BY 1, 2),
 res AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, born) AS place, item, score, phrase, field_ix FROM be QUALIFY place <= {limit}),
 cov AS (SELECT t0.query_id, CAST(len(toks) AS INT) AS n_query, coalesce(max(score), 0e0) AS confidence, coalesce((SELECT floor(max(covers) * 1000 + 0.5e0) / 1000 FROM (SELECT query_id, covers FROM sc0 UNION ALL SELECT query_id, covers FROM sc1) x WHERE x.query_id = t0.query_id), 0e0) AS coverage FROM t0 LEFT JOIN res USING (query_id) GROUP BY 1, 2)"""


def text_sql(limit: int) -> str:
    """div: the matches of the messages' windows, up to `limit` a text."""
    words = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""ms AS (SELECT text_id AS query_id, string_split({NORM.format(x="text").replace(", 64)", f", {1 << 30})")}, ' ')[1:64] AS toks FROM (SELECT p_partkey // 40 AS text_id, string_agg(p_name, ' of the ' ORDER BY p_partkey) AS text FROM part WHERE p_partkey % 10 = 3 GROUP BY 1)),
 tx AS (SELECT query_id AS text_id, list_distinct(toks) AS words, toks, {MASKS} FROM ms),
 wn AS (SELECT DISTINCT text_id, words, locale, preferred, searched, w FROM (SELECT * EXCLUDE toks, unnest(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, greatest(len(toks) - n + 2, 1)), lambda i: array_to_string(toks[i : i + n - 1], ' '))))) AS w FROM tx) WHERE len(list_filter(string_split(w, ' '), lambda x: NOT list_contains({words(STOP_WORDS)}, x))) > 0),
 id AS (SELECT row_number() OVER (ORDER BY w, locale, preferred, searched) AS query_id, * FROM (SELECT DISTINCT w, locale, preferred, searched FROM wn)),
 t0 AS (SELECT query_id, locale, preferred, searched, false AS open, string_split(w, ' ') AS toks FROM id), {chain("0", 16, False)}, {merged(16)},
 ht AS (SELECT text_id, item, phrase, wn.w AS win, score, string_split(phrase, ' ') AS p, (SELECT sum(CASE WHEN list_contains(words, y) THEN 1e0 WHEN length(y) >= 4 AND len(list_filter(words, lambda z: damerau_levenshtein(y, z) <= 1)) > 0 THEN 0.5e0 ELSE 0e0 END) FROM (SELECT unnest(string_split(phrase, ' ')) AS y)) / len(p) AS share FROM wn JOIN id USING (w, locale, preferred, searched) JOIN res USING (query_id)),
 hs AS (SELECT *, round(score * share * share * CASE WHEN len(p) > 1 THEN 1 + 0.1e0 * (len(p) - 1) WHEN list_contains({words(COMMON_WORDS)}, phrase) THEN 0.6e0 ELSE 1e0 END, 9) AS s FROM ht),
 bt AS (SELECT text_id, item, max(s) AS s, first(phrase ORDER BY s DESC, len(string_split(win, ' ')) DESC, win, phrase) AS phrase, first(win ORDER BY s DESC, len(string_split(win, ' ')) DESC, win, phrase) AS win, count(DISTINCT phrase) AS n FROM hs WHERE s >= 0.45e0 GROUP BY 1, 2),
 dv AS (SELECT text_id, item, phrase, win, round(least(1e0, s + least(0.12e0, 0.04e0 * (n - 1))) * power(0.93e0, row_number() OVER (PARTITION BY text_id, win ORDER BY least(1e0, s + least(0.12e0, 0.04e0 * (n - 1))) DESC, item) - 1), 6) AS score FROM bt),
 div AS (SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, item) AS place, item, floor(score * 1000 + 0.5e0) / 1000 AS score, phrase, win FROM dv QUALIFY place <= {limit})"""


FULL = f"WITH {PACKS}, {ASKED}, {chain('0', 8)}, {merged(8)}"

QUERIES = {
    "pack_index": (packs, f"WITH {PACKS} SELECT item, phrase, CAST(field_ix AS INT) AS field_ix, weight, mask, CAST(n_tokens AS INT) AS n_tokens FROM phr"),
    "vocabulary_masks": (lambda s, d: S.vocabulary(S.postings(packs(s, d))).withColumn("idf", F.round("idf", 6)), f"WITH {PACKS} SELECT token, mask, round(idf, 6) AS idf FROM vocab"),
    "word_candidates": (typo_candidates, f"WITH {PACKS}, {ASKED}, {chain('0', 8)} SELECT DISTINCT qtoken, preferred, searched, token, round(quality, 6) AS quality, partial, CAST(kind AS INT) AS kind FROM c0"),
    "lexical_search_topk": (lambda s, d: found(s, d)[0], FULL + " SELECT query_id, place, item, score, phrase, CAST(field_ix AS INT) AS field_ix FROM res"),
    "lexical_confidence": (lambda s, d: found(s, d)[1], FULL + " SELECT query_id, n_query, confidence, coverage FROM cov"),
    "semantic_gate": (lambda s, d: S.wants_semantic(found(s, d)[1]).select("query_id", "semantic"), FULL + " SELECT query_id, confidence < 0.6e0 OR (n_query >= 2 AND confidence < 0.9e0) AS semantic FROM cov"),
    "unsure_verdicts": (semantic_strength, FULL + " SELECT query_id, confidence, coverage, NOT (coverage >= 0.85e0 AND confidence >= 0.6e0) AND NOT (query_id % 10) / 10e0 >= 0.6e0 AS unsure FROM cov"),
    "split_word_repair": (
        lambda s, d: S.joined_words(queries_of(s, d).withColumn("toks", T.tokens(T.ascii_normalized(F.col("q")))), S.vocabulary(S.postings(packs(s, d)))).select("query_id", F.concat_ws(" ", "toks").alias("q")),
        FULL + " SELECT query_id, array_to_string(toks, ' ') AS q FROM t1",
    ),
    "text_match_diversified": (matches, f"WITH {PACKS}, {text_sql(10)} SELECT text_id, place, item, score, phrase, win AS window FROM div"),
    "offline_reactions": (
        reactions,
        f"""WITH {PACKS}, {text_sql(40)}, own AS (SELECT text_id, item, least(1e0, round(score * CASE WHEN popularity > 40 THEN 1.15e0 WHEN popularity > 20 THEN 0.95e0 ELSE 0.7e0 END, 9)) AS score, place AS was FROM div JOIN pop USING (item)),
 top AS (SELECT *, 0 AS tier FROM own QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, was) <= 6),
 fil AS (SELECT text_id, i AS item, 0.3e0 AS score, nr AS was, 1 AS tier FROM tx, (VALUES (1, true, 0), (2, true, 1), (3, false, 2), (4, false, 3)) v(i, q_only, nr) WHERE (text_id % 2 = 0 OR NOT q_only) AND (text_id, i) NOT IN (SELECT (text_id, item) FROM top))
 SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY tier, CASE WHEN tier = 0 THEN -score END, was) AS place, CAST(item AS BIGINT) AS item, floor(score * 1000 + 0.5e0) / 1000 AS score FROM (SELECT text_id, item, score, was, tier FROM top UNION ALL SELECT text_id, item, score, was, tier FROM fil) QUALIFY place <= 6""",
    ),
    "number_slang": (slang, "WITH t AS (SELECT p_size, min(p_partkey) AS id FROM part GROUP BY 1) SELECT CAST(p_size AS BIGINT) AS query_id, id FROM t WHERE p_size % 2 = 0 AND id % 6 < 4"),
}
