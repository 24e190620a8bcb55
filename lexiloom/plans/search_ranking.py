"""Queries of lexical and vector search, fusion, evaluation, curation and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import code_search as CS
from lexiloom.operators import curation as C
from lexiloom.operators import evals as E
from lexiloom.operators import fusion as R
from lexiloom.operators import lexical as L
from lexiloom.operators import vectors as V
from lexiloom.plans.search_analytics import QD
from lexiloom.sources.tables import read_table as table
from lexiloom.sources.tables import scratch
from lexiloom.streaming import counters, keyed_meter

# --- lexical ---------------------------------------------------------------


def norm_sql(x: str, length: int = 64) -> str:
    return f"trim(left(trim(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9+]+', ' ', 'g')), {length}))"


def index_of(s, d):
    return L.phrases(table(s, d, "part"), "p_partkey", {"name": "p_name", "keyword": "p_type", "alias": "p_brand"})


def asked(s, d):
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    names = table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    n = F.col("query_id") % 4
    q = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat_ws(" ", first, F.left(second, F.lit(3)))).when(n == 2, F.concat(second, F.right(second, F.lit(1)))).otherwise(F.concat(F.lit("zzz "), first))
    return names.select("query_id", q.alias("q"))


def vocab_of(s, d):
    return L.vocabulary(L.postings(index_of(s, d)))


INDEX = f"""raw AS (SELECT p_partkey AS item, 0 AS field_ix, 1.0e0 AS weight, {norm_sql("p_name")} AS phrase FROM part UNION ALL SELECT p_partkey, 2, 0.85e0, {norm_sql("p_type")} FROM part UNION ALL SELECT p_partkey, 3, 0.8e0, {norm_sql("p_brand")} FROM part),
 phr AS (SELECT item, phrase, min(field_ix) AS field_ix, max(weight) AS weight FROM raw WHERE phrase <> '' GROUP BY ALL),
 posts AS (SELECT unnest(string_split(phrase, ' ')) AS token, item, phrase, field_ix, weight, CAST(len(string_split(phrase, ' ')) AS INT) AS n_tokens FROM phr),
 vocab AS (SELECT token, CAST(count(DISTINCT item) AS BIGINT) AS df, ln(1 + (SELECT count(DISTINCT item) FROM posts) / count(DISTINCT item)) AS idf FROM posts GROUP BY token)"""
ASKED = f"""names AS (SELECT min(p_partkey) AS query_id, p_name, string_split(p_name, ' ') AS w FROM part GROUP BY p_name),
 queries AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN p_name WHEN 1 THEN w[1] || ' ' || left(w[2], 3) WHEN 2 THEN w[2] || right(w[2], 1) ELSE 'zzz ' || w[1] END AS q FROM names),
 toks AS (SELECT query_id, string_split({norm_sql("q")}, ' ')[1:8] AS t FROM queries),
 asked AS (SELECT query_id, unnest(t) AS qtoken, generate_subscripts(t, 1) AS pos, len(t) AS n_query FROM toks),
 q1 AS (SELECT DISTINCT qtoken FROM asked),
 prefix AS (SELECT qtoken, token, (0.6e0 + 0.35e0 * length(qtoken) / length(token)) * CASE WHEN max(token = qtoken) OVER (PARTITION BY qtoken) THEN 0.5e0 ELSE 1e0 END AS quality FROM (SELECT q1.qtoken, token FROM q1 JOIN vocab ON starts_with(token, qtoken) QUALIFY row_number() OVER (PARTITION BY qtoken ORDER BY token) <= 400)),
 squeeze AS (SELECT qtoken, token, 0.85e0 AS quality FROM q1 JOIN vocab ON token <> qtoken AND length(token) < length(qtoken) AND right(token, 1) = right(qtoken, 1) AND qtoken = token || repeat(right(token, 1), CAST(length(qtoken) - length(token) AS BIGINT)) AND (length(token) < 2 OR right(token, 1) <> token[-2])),
 cands AS (SELECT qtoken, token, max(quality) AS quality, max(whole) AS whole FROM (SELECT qtoken, qtoken AS token, 1.0e0 AS quality, 1 AS whole FROM q1 WHERE qtoken IN (SELECT token FROM vocab) UNION ALL SELECT qtoken, token, quality, 0 FROM prefix WHERE token <> qtoken UNION ALL SELECT *, 0 FROM squeeze) GROUP BY ALL)"""
def fuzzy(s, d):
    words = L.query_tokens(asked(s, d)).select("qtoken").distinct()
    wrong = words.select(F.concat(F.left("qtoken", F.lit(1)), F.substr("qtoken", F.lit(3), F.lit(1)), F.substr("qtoken", F.lit(2), F.lit(1)), F.substr("qtoken", F.lit(4))).alias("qtoken"))
    return L.fuzzy_candidates(wrong, vocab_of(s, d))


# --- vectors ---------------------------------------------------------------
#: Queries of vector searches: every row whose id is divisible by this.
EVERY = 50


def vecs(s, d, dims=None):
    v = F.col("embedding") if dims is None else V.truncated(F.col("embedding"), dims)
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"))


def dots(s, d, k, dims=None):
    rows = vecs(s, d, dims)
    return V.scores(asking(rows), rows, k)


def asking(rows):
    return rows.filter(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id")


def label_dots(s, d, dims=None):
    rows = vecs(s, d, dims).join(labels(s, d), "id")
    return V.best_per(V.scores(asking(rows), rows, per="label"), "label").withColumn("label", F.col("label").cast("int"))


def labels(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def dots_sql(name: str = "dots", dims: int | None = None) -> str:
    v = "CAST(embedding AS DOUBLE[])" if dims is None else f"CAST(embedding AS DOUBLE[])[1:{dims}]"
    dot = "list_dot_product(q.v, r.v)" + ("" if dims is None else " / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(r.v, r.v))")
    return f"{name}_v AS (SELECT vec_id AS id, label, {v} AS v FROM embeddings), {name} AS (SELECT q.id AS query_id, r.id, r.label, {dot} AS dot FROM {name}_v q, {name}_v r WHERE q.id % {EVERY} = 0 AND q.id <> r.id)"


def top_list(s, d, k=10, dims=None):
    return V.top(dots(s, d, k, dims), k).select("query_id", "id", "place", F.round("dot", 6).alias("score"))


def code_list(s, d):
    rows = vecs(s, d)
    return CS.nearest(asking(rows), rows, 10).select("query_id", "id", "place", F.round("dot", 6).alias("score"))


def list_sql(name: str, source: str, k: int = 10) -> str:
    return f"{name} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS place, round(dot, 6) AS score FROM {source} QUALIFY place <= {k})"


CANDIDATE_ROWS = "cand AS (SELECT query_id, id, 'text' AS tier FROM t UNION ALL SELECT query_id, id, 'glyph' FROM (SELECT * FROM g WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM t) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) <= 3))"
LISTS = f"{dots_sql('d1')}, {dots_sql('d2', 16)}, {list_sql('a', 'd1')}, {list_sql('b', 'd2')}"


def two(s, d):
    return top_list(s, d), top_list(s, d, dims=16)


def fused_input(s, d):
    a, b = two(s, d)
    return R.lists(("full", 1.0, False, a), ("short", 0.5, True, b))


def exempt(s, d):
    return top_list(s, d).filter("place = 10").select("query_id", "id")


def families(s, d):
    """Ten ids in a row are a family."""
    return vecs(s, d).select("id", F.floor(F.col("id") / 10).alias("family"))


def trusted(s, d):
    return R.level_and_gap(two(s, d)[1], 0.3, 0.9, 0.02, 0.3)


def fused_modes(s, d):
    a, b = two(s, d)
    modes = [R.fuse(a, b, trusted(s, d), learned=learned).select("query_id", "id", "place", F.lit(name).alias("mode")) for name, learned in (("learned", True), ("weighted", False))]
    return modes[0].unionByName(modes[1])


def reactions(s, d):
    a, b = two(s, d)
    lists = {"textEmoji": a.filter("place <= 1"), "prior": b.filter("place <= 4"), "alias": a, "neighbours": b}
    return R.reactions(lists, families(s, d), close=0.8)


def photos(s, d):
    a, b = two(s, d)
    return R.photos(a.filter("place <= 2"), a, b, families(s, d))


def centered_top(s, d):
    return V.centered(label_dots(s, d)).select("query_id", "label", F.round("centered", 6).alias("centered"))


def candidate_rows(s, d):
    return V.two_tier(dots(s, d, 6), dots(s, d, 9, 8), 6, 3)


def policy(s, d):
    rows, short = vecs(s, d), vecs(s, d, 8)
    pairs = V.pair_dots(candidate_rows(s, d).drop("tier"), asking(rows), rows, "dot")
    both = V.pair_dots(pairs, asking(short), short, "glyph").join(V.means(asking(short), short), "query_id")
    score = F.floor(F.round(F.col("dot") + 0.25 * (F.col("glyph") - F.col("mean")), 9) * 1000 + 0.5) / 1000
    return V.top(both.withColumn("score", score), 5, "score").select("query_id", "id", "score", "place")


def copied(s, d):
    """The vectors, and three copies of every tenth."""
    rows = vecs(s, d)
    extra = rows.filter("id % 10 = 0").withColumn("copy", F.explode(F.array(*map(F.lit, (1, 2, 3))).cast("array<long>")))
    return rows.unionByName(extra.select((F.col("id") + 1_000_000_000 * F.col("copy")).alias("id"), "v"))


def quantized(s, d):
    q = table(s, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), V.quantized(F.col("embedding")).alias("c"))
    error = F.array_max(F.zip_with("v", V.dequantized(F.col("c")), lambda a, b: F.abs(a - b)))
    return q.select("vec_id", F.round("c.scale", 9).alias("scale"), F.aggregate("c.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("q_sum"), F.round(error, 6).alias("max_error"), V.sign_bits(F.col("v")).alias("signs"))


def rerank(s, d):
    a, b = two(s, d)
    return R.rerank(a, b, R.level_and_gap(b, 0.3, 0.9, 0.02, 0.3))


CONF = "conf AS (SELECT query_id, round(greatest(greatest(0e0, least(1e0, (top - 0.3e0) / (0.9e0 - 0.3e0))), greatest(0e0, least(1e0, (coalesce(top - rest, 0e0) - 0.02e0) / (0.3e0 - 0.02e0)))), 6) AS confidence FROM (SELECT query_id, max(score) FILTER (WHERE place = 1) AS top, avg(score) FILTER (WHERE place BETWEEN 2 AND 5) AS rest FROM b GROUP BY 1))"
RERANK_CTES = (LISTS, CONF, """ac AS (SELECT query_id, max(score) AS ac FROM a GROUP BY 1), e AS (SELECT query_id, max(score) AS best, min(score) AS lowest FROM b GROUP BY 1),
 j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.score AS s1, a.place AS p1, b.score AS s2, b.place AS p2 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id),
 f AS (SELECT j.*, ac, best, coalesce(s2, lowest - 0.02e0, 0e0) AS sc, confidence FROM j LEFT JOIN ac USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN conf USING (query_id)),
 l AS (SELECT query_id, id, p1, p2, round(CASE WHEN s1 IS NULL THEN 0e0 ELSE -0.334e0 END + coalesce(s1, 0e0) * 1.59e0 + CASE WHEN s1 IS NULL THEN 0e0 ELSE 1 / p1 END * 1.899e0 + CASE WHEN s1 IS NULL THEN 0e0 ELSE s1 / ac END * 0.3387e0 + sc * 10.67e0 + (best - sc) * -7.255e0 + coalesce(s1, 0e0) * ac * 1.838e0 + sc * confidence * 3.632e0, 6) AS learned, coalesce(s1, 0e0) >= 0.9e0 AS pinned FROM f)""")
RERANKED = "SELECT query_id, id, learned, pinned, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, CASE WHEN pinned THEN p1 END, learned DESC, p1 NULLS LAST, p2 NULLS LAST) AS place FROM l QUALIFY place <= 10"
#: A full ranking by pins, floor and weighted reciprocal ranks; w holds each query's weights and floor.
RECIPROCAL = "SELECT query_id, id, fused, place FROM (SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN pa END, fused DESC, pa NULLS LAST, pb NULLS LAST) AS place FROM (SELECT j.*, CASE WHEN s1 >= {pin} THEN 0 WHEN s1 >= fl THEN 1 ELSE 2 END AS tier, CASE WHEN s1 >= {pin} THEN NULL ELSE round(coalesce(wa / (60 + pa), 0e0) + coalesce(wb / (60 + pb), 0e0), 9) END AS fused FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.score AS s1, a.place AS pa, b.place AS pb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id) j JOIN w USING (query_id))) WHERE place <= 10"


def fused_sql(k: int, floor: float, scale: float, limit: int = 10) -> str:
    """Evidence fusion of the rows u (query_id, id, place, source, list_ix, part), ids ex without a floor; ten ids in a row are a family."""
    return f"SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, born, ord) AS place FROM (SELECT *, floor(least(1e0, total / {scale}e0) * 1000 + 0.5e0) / 1000 AS score FROM (SELECT query_id, id, round(sum(part), 9) AS total, first(source ORDER BY part DESC, list_ix) AS source, min(list_ix) AS born, first(place ORDER BY list_ix) AS ord FROM u GROUP BY 1, 2) t WHERE total >= {floor}e0 OR (query_id, id) IN (SELECT (query_id, id) FROM ex) QUALIFY row_number() OVER (PARTITION BY query_id, id // 10 ORDER BY total DESC, born, ord) = 1) QUALIFY place <= {limit}"



def in_turn(s, d):
    return R.interleaved(*two(s, d))


def answered(s, d):
    a, b = two(s, d)
    return R.first_answer(a.filter("query_id % 100 = 0"), b).select("query_id", "id", "place")


def now_shelf(s, d):
    rows = table(s, d, "part").select(F.col("p_size").alias("entry_ix"), F.col("p_brand").alias("entry"), F.floor(F.col("p_partkey") / 100).alias("pos"), (F.col("p_partkey") % 37).alias("id"))
    return R.shelf(rows, 12)


def modes(s, d):
    a, b = two(s, d)
    gate = a.filter("place = 1").select("query_id", (F.col("score") < 0.62).alias("semantic"))
    return E.four_modes(a, b, R.fuse(a, b, trusted(s, d)), gate)


def demote(s, d):
    return R.demoted(top_list(s, d).join(labels(s, d), "id"), F.col("label") % 2 == 1).select("query_id", "id", "place")


def editorial(s, d):
    picks = vecs(s, d).filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), (F.col("id") + 100).alias("id"), (F.col("id") % 2 == 0).alias("lead"), F.lit(1).cast("long").alias("pos"))
    return R.inserted(top_list(s, d), picks).select("query_id", "id", "tier", "place")


def custom(s, d):
    a, b = two(s, d)
    return R.custom_first(a.filter("place <= 2"), b).select("query_id", "id", "tier", "place")


# --- evaluation ------------------------------------------------------------


def judged_rows(s, d):
    own = labels(s, d).select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    return top_list(s, d).join(labels(s, d), "id").join(own, "query_id").withColumn("relevant", F.col("label") == F.col("want"))


JUDGED = f"{dots_sql()}, {list_sql('l', 'dots')}, rows AS (SELECT l.*, e.label, w.label AS want, e.label = w.label AS relevant FROM l JOIN embeddings e ON e.vec_id = l.id JOIN embeddings w ON w.vec_id = l.query_id), first AS (SELECT query_id, any_value(want) AS want, CAST(coalesce(min(place) FILTER (WHERE relevant), 0) AS BIGINT) AS first FROM rows GROUP BY 1)"
METRICS = "CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN first = 1 THEN 1e0 ELSE 0e0 END), 6) AS r1, round(avg(CASE WHEN first BETWEEN 1 AND 5 THEN 1e0 ELSE 0e0 END), 6) AS r5, round(avg(CASE WHEN first BETWEEN 1 AND 10 THEN 1e0 ELSE 0e0 END), 6) AS r10, round(avg(CASE WHEN first BETWEEN 1 AND 10 THEN 1e0 / first ELSE 0e0 END), 6) AS mrr"


def by_label(s, d):
    own = labels(s, d).select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    return E.recall_mrr(E.first_relevant(judged_rows(s, d)).join(own, "query_id"), "want")


def gate(s, d):
    now = by_label(s, d)
    return E.regressions(now, now.select("want", F.lit(0.5).alias("r1")), "want", "r1", 0.1)


def calibration(s, d):
    rows = judged_rows(s, d).withColumn("kind", F.when(F.col("relevant"), "hit").otherwise("miss"))
    return E.nearest_rank(rows, "score", [0.25, 0.5], "kind")


def failures(s, d):
    first = E.first_relevant(judged_rows(s, d)).join(labels(s, d).withColumnRenamed("id", "query_id"), "query_id")
    return E.pivoted(first.withColumn("kind", E.miss_type(F.col("first"), F.lit(1), F.lit(10))).withColumn("half", F.when(F.col("label") < 5, "low").otherwise("high")), "kind", "half", ["low", "high"])


# --- curation --------------------------------------------------------------


def popularity(s, d):
    return C.midpoint_percentile(table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_size", "p_brand")


def collision(s, d):
    return C.collisions(table(s, d, "part").select("p_name", "p_partkey", "p_retailprice"), "p_name", "p_partkey", "p_retailprice")


def overlays(s, d):
    lists = table(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("base"), F.array_sort(F.collect_set(F.when(F.col("p_size") > 45, F.col("p_type")))).alias("over"))
    return lists.select("p_brand", F.concat_ws(",", C.overlay(F.col("over"), F.col("base"))).alias("merged"))


def privacy(s, d):
    return table(s, d, "documents").groupBy(F.coalesce(T.privacy_reason(F.col("text")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PRIVACY = f"""WITH d AS (SELECT text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)
 SELECT CASE WHEN regexp_matches(text, '{T.EMAIL}') THEN 'email' WHEN regexp_matches(text, '{T.ADDRESS}') OR regexp_matches(text, '{T.DOMAIN}') THEN 'url' WHEN list_has_any(w, {sql_list(T.MAIL_PROVIDERS)}) THEN 'email'
 WHEN list_has_any(w, {sql_list(T.URL_TOKENS)}) OR list_has_any(w[2:], {sql_list(T.TLDS)}) THEN 'url' WHEN length(regexp_replace(text, '\\P{{Nd}}', '', 'g')) > 6 THEN 'phone' WHEN regexp_matches(text, '\\p{{Nd}}{{5,}}') THEN 'number'
 WHEN len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}') AND length(regexp_replace(x, '\\P{{Nd}}', '', 'g')) >= 3)) > 0 THEN 'code' WHEN len(list_filter(w, lambda x: length(x) > 30)) > 0 THEN 'long-token' ELSE 'ok' END AS reason, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1"""
BLOCK, DEMOTE, ALLOWED = ["idiot", "scum", "moron", "you idiot"], ["trash", "clown", "of the"], ["clown fish"]


def moderation(s, d):
    return C.moderated(table(s, d, "documents"), "text", BLOCK, DEMOTE, ALLOWED).groupBy("lang", "verdict").agg(F.count("*").alias("n"))


def curation_edits(s, d):
    phrases = table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("fr").alias("locale"), F.col("p_partkey").alias("item"), F.col("p_name").alias("phrase"))
    edits = table(s, d, "part").filter("p_partkey % 5 = 0").select(F.when(F.col("p_partkey") % 3 == 0, "*").otherwise("en").alias("locale"), F.col("p_partkey").alias("item"), F.col("p_name").alias("phrase"), F.when(F.col("p_size") > 25, "remove").otherwise("low").alias("action"), F.col("p_size").alias("pos"))
    edits = edits.unionByName(edits.filter("pos < 10").select(F.lit("*").alias("locale"), "item", "phrase", F.lit("remove").alias("action"), (F.col("pos") - 5).alias("pos")))
    return C.curated(phrases, edits).groupBy("locale", "action").agg(F.count("*").alias("n"))


def prefix_lookup(s, d):
    names = table(s, d, "part").select(F.col("p_name").alias("q")).distinct()
    keys = names.select(F.when(F.length("q") % 2 == 0, F.left("q", F.lit(2))).otherwise(F.left("q", F.lit(6))).alias("shard_key"))
    return C.longest_prefix(names, keys)


def split_sql(budget):
    """dealt: q, shard_key of the entries z (q, bytes)."""
    return f"""h AS (SELECT q, bytes, left(q, CAST(i AS INT)) AS k FROM (SELECT q, bytes, unnest(range(1, length(q) + 1)) AS i FROM z)), g AS (SELECT k, left(k, CAST(length(k) - 1 AS INT)) AS parent, sum(bytes) AS held FROM h GROUP BY 1),
 keys AS (SELECT k FROM g WHERE parent = '' UNION ALL SELECT k FROM (SELECT c.k, p.held - (sum(c.held) OVER (PARTITION BY c.parent ORDER BY c.held DESC, c.k) - c.held) AS rest FROM g c JOIN g p ON p.k = c.parent WHERE p.held > {budget}) WHERE rest > {budget}),
 dealt AS (SELECT q, first(k ORDER BY length(k) DESC) AS shard_key FROM h JOIN keys USING (k) GROUP BY 1)"""


def prefix_split(s, d):
    q = F.concat_ws(" ", "p_name", "p_partkey")
    return C.split_prefixes(table(s, d, "part").select(q.alias("q"), F.octet_length(q).cast("long").alias("bytes")), 4000)


# --- texts and streams -----------------------------------------------------
CUES = ["of the", "in the", "de la", "the", "and to"]


def said(s, d):
    return table(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


def cues(s, d):
    phrases = s.createDataFrame([(p,) for p in CUES], "phrase string")
    rows = said(s, d).withColumn("key", F.struct("conv_id", "turn", "text"))
    return L.contained_phrases(rows, F.broadcast(phrases), "key", T.tokens(T.ascii_normalized(F.col("text"), 1 << 30)), 2).groupBy("phrase").agg(F.count("*").alias("n"))


def clauses(s, d):
    parts = F.filter(F.transform(F.split("text", "[.,;:!?\\n]+"), lambda x: F.trim(x)), lambda x: F.size(F.split(x, " +")) >= 2)
    return said(s, d).select("conv_id", "turn", "text", F.size(parts).cast("long").alias("n_clauses"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first_clause")).drop("text")


def text_windows(s, d):
    # Tokens and windows are columns, as an expression inside a lambda is computed again for each window.
    rows = said(s, d).withColumn("toks", T.tokens(T.ascii_normalized(F.col("text"), 1 << 30))).withColumn("w", T.windows(F.col("toks")))
    w = F.col("w")
    return rows.select("conv_id", "turn", F.size(w).cast("long").alias("n_windows"), F.array_min(w).alias("least"), F.array_max(w).alias("most"))


def normalized_text(s, d):
    return table(s, d, "documents").select("doc_id", T.normalized(1 << 30)("text").alias("normalized"))


def arriving(rows, folder, batches, *by):
    """Write rows as the files of so many batches, dealt by a hash or in turn; how many files a batch has: one for each task that can run at once, so that no file grows alone."""
    each = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(batches * each, *by).write.parquet(folder)
    return each


def stream(s, d):
    """The events dealt to files by a hash, so that days come in no order, in four batches."""
    out, schema = scratch(s, "stream"), table(s, d, "events").schema
    each = arriving(table(s, d, "events"), f"{out}/in", 4, "event_id")
    counters.run_once(counters.event_stream(s, f"{out}/in", "*.parquet", schema, each), f"{out}/counts", f"{out}/checkpoint")
    return counters.current(s, f"{out}/counts")


def usage_alerts(s, d):
    out, orders = scratch(s, "meter"), table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    each = arriving(orders, f"{out}/in", 3, "o_orderkey")
    events = counters.event_stream(s, f"{out}/in", "*.parquet", orders.schema, each)
    counters.meter(events, F.col("o_custkey"), F.date_format("o_orderdate", "yyyy"), F.lit(1), 4, out, f"{out}/checkpoint")
    return s.read.parquet(f"{out}/alerts").drop("batch", "id")


def usage_state(s, d):
    """The same alerts from keyed state. Orders come in no order of time, so a year stays open for as long as they span."""
    out, orders = scratch(s, "meter"), table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    each = arriving(orders, f"{out}/in", 3, "o_orderkey")
    events, at = counters.event_stream(s, f"{out}/in", "*.parquet", orders.schema, each), F.col("o_orderdate").cast("timestamp")
    ends = F.add_months(F.trunc(at, "year"), 12).cast("timestamp")
    keyed_meter.meter(events, F.col("o_custkey"), at, F.date_format(at, "yyyy"), ends, F.lit(1), 4, "10000 days", f"{out}/rows", f"{out}/checkpoint")
    return s.read.parquet(f"{out}/rows").filter("kind = 'alert'").select("account", "period", "percent")


def report_stream(s, d):
    out = scratch(s, "reports")
    e = table(s, d, "events")
    report = F.format_string('{"v":1,"sample":%s,"counts":{"%s":%d}}', F.when(F.col("event_id") % 7 == 0, "7").otherwise("0.5"), F.col("event_type"), F.col("user_id") % 5)
    raw = e.select(report.alias("report"))
    each = arriving(raw, f"{out}/in", 4)
    counters.count_reports(counters.event_stream(s, f"{out}/in", "*.parquet", raw.schema, each), out, f"{out}/checkpoint")
    refused = s.read.parquet(f"{out}/refused").agg(F.lit("refused").alias("event"), F.count("*").cast("double").alias("n"))
    return counters.current(s, f"{out}/counts", ["event"], ("n",)).unionByName(refused)


def simple(what: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {what}"


QUERIES = {
    "phrase_table": (index_of, simple("SELECT item, phrase, field_ix, weight FROM phr", INDEX)),
    "vocab_postings": (lambda s, d: L.postings(index_of(s, d)).groupBy("token", "field_ix").agg(F.count("*").alias("n")), simple("SELECT token, field_ix, CAST(count(*) AS BIGINT) AS n FROM posts GROUP BY ALL", INDEX)),
    "token_idf": (lambda s, d: vocab_of(s, d).withColumn("idf", F.round("idf", 6)), simple("SELECT token, df, round(idf, 6) AS idf FROM vocab", INDEX)),
    "token_mask": (lambda s, d: L.postings(index_of(s, d)).groupBy("token").agg(F.bit_or(F.expr("shiftleft(1, field_ix)")).alias("mask")), simple("SELECT token, CAST(bit_or(CAST(1 AS INT) << field_ix) AS INT) AS mask FROM posts GROUP BY 1", INDEX)),
    "exact_token_match": (lambda s, d: L.query_tokens(asked(s, d)).select("qtoken").distinct().join(vocab_of(s, d).select(F.col("token").alias("qtoken")), "qtoken"), simple("SELECT qtoken FROM cands WHERE whole = 1", INDEX, ASKED)),
    "prefix_candidates": (lambda s, d: L.prefix_candidates(L.query_tokens(asked(s, d)), vocab_of(s, d)).withColumn("quality", F.round("quality", 6)), simple("SELECT qtoken, token, round(quality, 6) AS quality FROM prefix WHERE token <> qtoken", INDEX, ASKED)),
    "squeeze_candidates": (lambda s, d: L.squeeze_candidates(L.query_tokens(asked(s, d)), vocab_of(s, d)), simple("SELECT qtoken, token, quality FROM squeeze", INDEX, ASKED)),
    "fuzzy_candidates": (
        fuzzy,
        simple("SELECT qtoken, token, CASE WHEN e = 2 THEN 0.65e0 WHEN length(qtoken) <= 5 THEN 0.7e0 ELSE 0.8e0 END AS quality, CAST(e AS INT) AS edits FROM (SELECT qtoken, token, damerau_levenshtein(qtoken, token) AS e FROM wr JOIN vocab ON qtoken[1] = token[1] OR (qtoken[1] = token[2] AND qtoken[2] = token[1])) WHERE e BETWEEN 1 AND CASE WHEN length(qtoken) < 4 THEN 0 WHEN length(qtoken) < 8 THEN 1 ELSE 2 END", INDEX, ASKED, "wr AS (SELECT DISTINCT qtoken[1] || qtoken[3] || qtoken[2] || qtoken[4:] AS qtoken FROM asked)"),
    ),
    "vector_topk": (top_list, simple("SELECT * FROM l", dots_sql(), list_sql("l", "dots"))),
    "code_topk": (code_list, simple("SELECT * FROM l", dots_sql(), list_sql("l", "dots"))),
    "truncated_topk": (lambda s, d: top_list(s, d, 5, 16), simple("SELECT * FROM l", dots_sql(dims=16), list_sql("l", "dots", 5))),
    "vector_best_per_label": (lambda s, d: label_dots(s, d).withColumn("dot", F.round("dot", 6)), simple("SELECT query_id, label, round(max(dot), 6) AS dot FROM dots GROUP BY ALL", dots_sql())),
    "centered_scores": (centered_top, simple("SELECT query_id, label, round(dot - avg(dot) OVER (PARTITION BY query_id), 6) AS centered FROM (SELECT query_id, label, max(dot) AS dot FROM dots GROUP BY ALL)", dots_sql())),
    "semantic_rows": (candidate_rows, simple("SELECT * FROM cand", dots_sql(), dots_sql("g", 8), list_sql("t", "dots", 6), CANDIDATE_ROWS)),
    "semantic_policy": (
        policy,
        simple("SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM p QUALIFY place <= 5", dots_sql(), dots_sql("g", 8), list_sql("t", "dots", 6), CANDIDATE_ROWS, "p AS (SELECT dots.query_id, dots.id, floor(round(dots.dot + 0.25e0 * c, 9) * 1000 + 0.5e0) / 1000 AS score FROM dots JOIN cand USING (query_id, id) JOIN (SELECT query_id, id, dot - avg(dot) OVER (PARTITION BY query_id) AS c FROM g) x ON x.query_id = dots.query_id AND x.id = dots.id)"),
    ),
    "quantized_roundtrip": (
        quantized,
        "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM v), q AS (SELECT *, list_transform(v, lambda x: floor(x / scale + 0.5e0)) AS q FROM s) SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS q_sum, round(list_max(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2] * scale))), 6) AS max_error, array_to_string(list_transform(v, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS signs FROM q",
    ),
    "degenerate_vectors": (
        lambda s, d: V.degenerate(copied(s, d)),
        "SELECT array_to_string(list_transform(embedding[1:24], lambda x: printf('%.3f', floor(CAST(x AS DOUBLE) * 1000 + 0.5e0) / 1000)), ',') AS key, CAST(count(DISTINCT vec_id) AS BIGINT) AS n FROM (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + CAST(1000000000 AS BIGINT) * c, embedding FROM embeddings, (SELECT unnest([1, 2, 3]) AS c) WHERE vec_id % 10 = 0) GROUP BY 1 HAVING count(DISTINCT vec_id) >= 4",
    ),
    "semantic_confidence": (lambda s, d: R.level_and_gap(two(s, d)[1], 0.3, 0.9, 0.02, 0.3), simple("SELECT * FROM conf", LISTS, CONF)),
    "rrf_fusion": (
        lambda s, d: R.reciprocal(*two(s, d), semantic_weight=0.5, pin=0.6, floor=0.5),
        simple(RECIPROCAL.format(wa="1e0", wb="0.5e0", floor="0.5e0", pin="0.6e0"), LISTS, "w AS (SELECT DISTINCT query_id, 1e0 AS wa, 0.5e0 AS wb, 0.5e0 AS fl FROM a)"),
    ),
    "fuse_modes": (
        fused_modes,
        simple(
            "SELECT query_id, id, place, 'weighted' AS mode FROM (" + RECIPROCAL.format(pin="0.9e0") + ") UNION ALL SELECT query_id, id, place, 'learned' FROM learned",
            *RERANK_CTES,
            "w AS (SELECT c.query_id, 0.4e0 + ac AS wa, 0.4e0 + 0.6e0 * confidence AS wb, CASE WHEN ac >= 0.6e0 THEN ac - 0.1e0 END AS fl FROM conf c JOIN ac USING (query_id))",
            "learned AS (" + RERANKED + ")",
        ),
    ),
    "evidence_fusion": (
        lambda s, d: R.evidence(fused_input(s, d), families(s, d), scale=1.5, exempt=exempt(s, d)),
        simple(fused_sql(8, 0.35, 1.5), LISTS, "u AS (SELECT *, 'full' AS source, 0 AS list_ix, 1e0 * 9 / (8 + place) AS part FROM a UNION ALL SELECT *, 'short', 1, 0.5e0 * 9 / (8 + place) * score FROM b)", "ex AS (SELECT query_id, id FROM a WHERE place = 10)"),
    ),
    "reaction_ranking": (
        reactions,
        simple(
            fused_sql(8, 0.35, 2.0),
            LISTS,
            "u AS (SELECT *, 'textEmoji' AS source, 0 AS list_ix, 1e0 * 9 / (8 + place) AS part FROM a WHERE place <= 1 UNION ALL SELECT *, 'prior', 2, 0.5e0 * 9 / (8 + place) FROM b WHERE place <= 4 UNION ALL SELECT *, 'alias', 3, 0.6e0 * 9 / (8 + place) * score FROM a UNION ALL SELECT *, 'neighbours', 4, 0.3e0 * 9 / (8 + place) FROM b UNION ALL SELECT query_id, id, p, score, 'closeNeighbours', 5, 0.5e0 * 9 / (8 + p) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS p FROM b WHERE score >= 0.8e0))",
            "ex AS (SELECT query_id, id FROM b WHERE place <= 4)",
        ).replace("UNION ALL SELECT query_id, id, p, score,", "UNION ALL SELECT query_id, id, p AS place, score,"),
    ),
    "photo_ranking": (
        photos,
        simple(fused_sql(8, 0.46, 2.0), LISTS, "u AS (SELECT *, 'proposed' AS source, 0 AS list_ix, 1e0 * 9 / (8 + place) AS part FROM a WHERE place <= 2 UNION ALL SELECT *, 'keyword', 1, 0.5e0 * 9 / (8 + place) * score FROM a WHERE score >= 0.5e0 UNION ALL SELECT *, 'caption', 2, 0.5e0 * 9 / (8 + place) FROM b)", "ex AS (SELECT query_id, id FROM a WHERE false)"),
    ),
    "learned_rerank": (rerank, simple(RERANKED, *RERANK_CTES)),
    "interleaved_lists": (in_turn, simple("SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY was, l) AS place FROM (SELECT query_id, id, place AS was, 0 AS l FROM a UNION ALL SELECT query_id, id, place, 1 FROM b)", LISTS)),
    "first_answer": (answered, simple("SELECT query_id, id, place FROM a WHERE query_id % 100 = 0 UNION ALL SELECT query_id, id, place FROM b WHERE query_id % 100 <> 0", LISTS)),
    "relevant_now_shelf": (now_shelf, "WITH r AS (SELECT p_partkey % 37 AS id, p_partkey // 100 AS pos, p_size AS ix, p_brand AS entry FROM part), o AS (SELECT id, pos, ix, entry FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, ix, entry) = 1) SELECT id, entry, row_number() OVER (ORDER BY pos, ix, id) AS place FROM o QUALIFY place <= 12"),
    "four_modes": (
        modes,
        simple("SELECT 'alias' AS mode, query_id, id, place FROM a UNION ALL SELECT 'semantic', query_id, id, place FROM b UNION ALL SELECT 'fused', query_id, id, place FROM fu UNION ALL SELECT 'gated', query_id, id, place FROM fu WHERE query_id IN (SELECT query_id FROM g) UNION ALL SELECT 'gated', query_id, id, place FROM a WHERE query_id NOT IN (SELECT query_id FROM g)", *RERANK_CTES, "fu AS (" + RERANKED + ")", "g AS (SELECT query_id FROM a WHERE place = 1 AND score < 0.62e0)"),
    ),
    "gate_share": (lambda s, d: E.gate_share(top_list(s, d).filter("place = 1").select("query_id", (F.col("score") < 0.62).alias("semantic"))), simple("SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(CASE WHEN score < 0.62e0 THEN 1e0 ELSE 0e0 END), 6) AS share FROM a WHERE place = 1", LISTS)),
    "demote_partition": (demote, simple("SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY label % 2 = 1, place) AS place FROM l JOIN embeddings e ON e.vec_id = l.id", dots_sql(), list_sql("l", "dots"))),
    "custom_first": (custom, simple("SELECT query_id, id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, was, id) AS place FROM (SELECT query_id, id, place AS was, 0 AS tier FROM a WHERE place <= 2 UNION ALL SELECT query_id, id, place, 1 FROM b) QUALIFY place <= 10", LISTS)),
    "editorial_insert": (
        editorial,
        simple("SELECT query_id, id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, was, id) AS place FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY tier, was) = 1) QUALIFY place <= 10", dots_sql(), list_sql("l", "dots"), f"u AS (SELECT vec_id AS query_id, vec_id + 100 AS id, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 2 END AS tier, 1 AS was FROM embeddings WHERE vec_id % {EVERY} = 0 UNION ALL SELECT query_id, id, CASE WHEN place = 1 THEN 1 ELSE 3 END, place FROM l)"),
    ),
    "recall_mrr": (lambda s, d: E.recall_mrr(E.first_relevant(judged_rows(s, d))), simple(f"SELECT {METRICS} FROM first", JUDGED)),
    "recall_mrr_by_label": (by_label, simple(f"SELECT want, {METRICS} FROM first GROUP BY want", JUDGED)),
    "macro_average": (lambda s, d: E.macro(by_label(s, d), ["r1", "mrr"]), simple(f"SELECT CAST(count(*) AS BIGINT) AS groups, round(avg(r1), 6) AS r1, round(avg(mrr), 6) AS mrr FROM (SELECT want, {METRICS} FROM first GROUP BY want)", JUDGED)),
    "precision_at_k": (lambda s, d: E.precision(judged_rows(s, d), 4), simple("SELECT query_id, max(CASE WHEN relevant AND place = 1 THEN 1 ELSE 0 END) AS p1, round(sum(CASE WHEN relevant AND place <= 4 THEN 1 ELSE 0 END) / 4, 6) AS pk, max(CASE WHEN relevant AND place <= 4 THEN 1 ELSE 0 END) AS hit FROM rows GROUP BY 1", JUDGED)),
    "nearest_rank_percentile": (
        lambda s, d: E.nearest_rank(table(s, d, "orders"), "o_totalprice", [0.5, 0.95], "o_orderstatus"),
        "SELECT o_orderstatus, l[CAST(least(n, floor(0.5e0 * n) + 1) AS INT)] AS p50, l[CAST(least(n, floor(0.95e0 * n) + 1) AS INT)] AS p95 FROM (SELECT o_orderstatus, list(o_totalprice ORDER BY o_totalprice) AS l, count(*) AS n FROM orders GROUP BY 1)",
    ),
    "calibration": (calibration, simple("SELECT kind, l[CAST(least(n, floor(0.25e0 * n) + 1) AS INT)] AS p25, l[CAST(least(n, floor(0.5e0 * n) + 1) AS INT)] AS p50 FROM (SELECT CASE WHEN relevant THEN 'hit' ELSE 'miss' END AS kind, list(score ORDER BY score) AS l, count(*) AS n FROM rows GROUP BY 1)", JUDGED)),
    "regression_gate": (gate, simple(f"SELECT want, r1 AS now, 0.5e0 AS before FROM (SELECT want, {METRICS} FROM first GROUP BY want) WHERE 0.5e0 - r1 > 0.1e0", JUDGED)),
    "failure_pivot": (failures, simple("SELECT kind, CAST(count_if(want < 5) AS BIGINT) AS n_low, CAST(count_if(want >= 5) AS BIGINT) AS n_high, CAST(count(*) AS BIGINT) AS n_all FROM (SELECT want, CASE WHEN first = 1 THEN 'right' WHEN first BETWEEN 2 AND 5 THEN 'ranked-low' WHEN first > 5 THEN 'ranked-deep' ELSE 'missed' END AS kind FROM first) GROUP BY 1", JUDGED)),
    "percentile_popularity": (popularity, "SELECT p_partkey, p_brand, p_size, CAST(greatest(1, floor(100 * (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + count(*) OVER (PARTITION BY p_brand, p_size) / 2e0) / count(*) OVER (PARTITION BY p_brand) + 0.5e0)) AS BIGINT) AS percentile FROM part"),
    "collision_cap": (collision, "SELECT p_name, p_partkey, CAST(n AS BIGINT) AS owners, CASE WHEN place <= 8 THEN 'keep' WHEN n > 20 THEN 'drop' ELSE 'demote' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS place, count(*) OVER (PARTITION BY p_name) AS n FROM part)"),
    "first_placement_dedupe": (lambda s, d: C.first_placement(table(s, d, "part").select("p_name", "p_brand", "p_size", "p_partkey"), ["p_name", "p_brand"], ["p_size", "p_partkey"]), "SELECT p_name, p_brand, p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size, p_partkey) = 1"),
    "overlay_merge": (overlays, "WITH l AS (SELECT p_brand, list_sort(list_distinct(list(p_type))) AS b, coalesce(list_sort(list_distinct(list(p_type) FILTER (WHERE p_size > 45))), []) AS o FROM part GROUP BY 1) SELECT p_brand, array_to_string(list_concat(o, list_filter(b, lambda x: NOT list_contains(o, x))), ',') AS merged FROM l"),
    "curation_edits": (
        curation_edits,
        "WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'fr' END AS locale, p_partkey, p_size FROM part) SELECT locale, CASE WHEN p_partkey % 5 = 0 AND p_size < 10 THEN 'remove' WHEN p_partkey % 5 = 0 AND (p_partkey % 3 = 0 OR locale = 'en') THEN CASE WHEN p_size > 25 THEN 'remove' ELSE 'low' END ELSE 'keep' END AS action, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2",
    ),
    "privacy_reason_counts": (privacy, PRIVACY),
    "moderation_verdicts": (
        moderation,
        f"WITH d AS (SELECT lang, replace(' ' || regexp_replace(lower(text), '\\s+', ' ', 'g') || ' ', ' {ALLOWED[0]} ', '  ') AS t FROM documents), h AS (SELECT lang, t IS NOT NULL AND ({' OR '.join(f"contains(t, ' {w} ')" for w in BLOCK)}) AS b, t IS NOT NULL AND ({' OR '.join(f"contains(t, ' {w} ')" for w in DEMOTE)}) AS m FROM d) SELECT lang, CASE WHEN b THEN 'block' WHEN m THEN 'demote' ELSE 'ok' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY 1, 2",
    ),
    "longest_prefix_lookup": (prefix_lookup, "WITH n AS (SELECT DISTINCT p_name AS q FROM part), k AS (SELECT DISTINCT CASE WHEN length(q) % 2 = 0 THEN left(q, 2) ELSE left(q, 6) END AS k FROM n) SELECT q, (SELECT first(k ORDER BY length(k) DESC) FROM k WHERE starts_with(q, k)) AS shard_key FROM n"),
    "adaptive_prefix_split": (
        prefix_split,
        f"WITH z AS (SELECT p_name || ' ' || p_partkey AS q, strlen(p_name || ' ' || p_partkey) AS bytes FROM part), {split_sql(4000)} SELECT shard_key, CAST(count(*) AS BIGINT) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM z JOIN dealt USING (q) GROUP BY 1",
    ),
    "intent_cues": (cues, f"SELECT phrase, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT conv_id, turn, text, ' ' || {norm_sql('text', 1 << 30)} || ' ' AS t FROM conversations WHERE role = 'user') c, (SELECT unnest({sql_list(CUES)}) AS phrase) p WHERE contains(t, ' ' || phrase || ' ') GROUP BY 1"),
    "clause_split": (clauses, "WITH c AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.,;:!?\\n]+'), lambda x: trim(x)), lambda x: len(regexp_split_to_array(x, ' +')) >= 2) AS p FROM conversations WHERE role = 'user') SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n_clauses, coalesce(p[1], '') AS first_clause FROM c"),
    "text_windows": (
        text_windows,
        f"WITH t AS (SELECT conv_id, turn, list_filter(string_split({norm_sql('text', 1 << 30)}, ' '), lambda x: x <> '') AS t FROM conversations WHERE role = 'user'), w AS (SELECT conv_id, turn, flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i : i + n - 1], ' ')))) AS w FROM t) SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_windows, list_min(w) AS least, list_max(w) AS most FROM w",
    ),
    "normalized_text": (normalized_text, None),
    "stream_query_daily": (stream, f"WITH {QD} SELECT * FROM query_daily"),
    "stream_usage_alerts": (usage_alerts, "SELECT o_custkey AS account, strftime(o_orderdate, '%Y') AS period, percent FROM orders, (SELECT unnest([80, 100]) AS percent) GROUP BY ALL HAVING count(*) >= ceil(4 * percent / 100e0)"),
    "stream_usage_state": (usage_state, "SELECT o_custkey AS account, strftime(o_orderdate, '%Y') AS period, percent FROM orders, (SELECT unnest([80, 100]) AS percent) GROUP BY ALL HAVING count(*) >= ceil(4 * percent / 100e0)"),
    "stream_client_reports": (report_stream, "SELECT event_type AS event, round(sum(2e0 * (user_id % 5)), 6) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1 UNION ALL SELECT 'refused', CAST(count(*) AS DOUBLE) FROM events WHERE event_id % 7 = 0"),
}
