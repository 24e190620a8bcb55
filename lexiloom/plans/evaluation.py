"""Queries of evaluation, with their SQL. Lists are vector searches in 64 and 16 dimensions; a result is relevant if it has its query's label."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import evals as E
from lexiloom.plans import search_ranking as P
from lexiloom.sources.tables import kept
from lexiloom.sources.tables import read_table as table

a_list, b_list = P.top_list, lambda s, d: P.top_list(s, d, dims=16)
CTES = f"WITH {P.LISTS}, e AS (SELECT vec_id AS id, label FROM embeddings)"
FIRST = "f_{x} AS (SELECT query_id, CAST(coalesce(min(place) FILTER (WHERE r.label = w.label), 0) AS BIGINT) AS first FROM {x} JOIN e r ON r.id = {x}.id JOIN e w ON w.id = query_id GROUP BY 1)"


def asking(s, d):
    """The queries with their label; every id with a query's label is an answer."""
    return P.labels(s, d).filter(f"id % {P.EVERY} = 0").withColumnRenamed("id", "query_id")


def answers(s, d):
    return P.labels(s, d).withColumnRenamed("id", "answer")


def first(s, d, rows):
    own = P.labels(s, d)
    return E.first_relevant(rows.join(own, "id").join(own.toDF("query_id", "want"), "query_id").withColumn("relevant", F.col("label") == F.col("want")))


def by_half(s, d):
    return first(s, d, a_list(s, d)).withColumn("half", F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd"))


def calibrated(s, d):
    top = a_list(s, d).filter("place = 1").select("query_id", "score")
    return E.calibrated(first(s, d, a_list(s, d)).join(top, "query_id").withColumn("hit", F.col("first") == 1), "score", "hit")


def traps(s, d):
    rows = a_list(s, d).join(P.labels(s, d), "id")
    return E.forbidden(rows, F.col("label") == 3, 4).join(E.class_ceilings(asking(s, d), answers(s, d), "label"), "query_id")


def evidence(s, d):
    """Ranks in the two lists, and facts derived from the query's id."""
    q = F.col("query_id")
    rows = first(s, d, b_list(s, d)).select("query_id", F.col("first").alias("rank")).join(first(s, d, a_list(s, d)).select("query_id", F.col("first").alias("alias_rank")), "query_id")
    at = lambda n, r: (F.floor(q / 50) % n == r)
    return rows.select("query_id", "rank", F.when(at(5, 1), 2).otherwise(0).alias("folded"), "alias_rank", F.when(at(3, 0), 1).otherwise(0).alias("semantic_rank"), F.when(at(2, 0), 1).otherwise(0).alias("fused_rank"), at(4, 0).alias("gate"), at(7, 2).alias("disputed"), at(11, 3).alias("pictures"), at(13, 5).alias("romanized"), at(6, 5).alias("unspaced"), at(9, 4).alias("capped"), F.when(at(4, 1), None).otherwise(F.lit("m")).alias("matched"), F.when(at(2, 1), "m").otherwise("q").alias("q"), (F.floor(q / 50) % 3).alias("unknown"), (1 + F.floor(q / 50) % 2).alias("n_tokens"))


def kinds(s, d):
    rows = evidence(s, d)
    return rows.select("query_id", *[E.failure(m).alias(m) for m in ("alias", "fused", "gated")])


def rule_sql(mode: str) -> str:
    at = lambda n, r: f"k % {n} = {r}"
    more = f"WHEN NOT {at(4, 0)} AND {at(2, 0)} THEN 'gate-skipped' " if mode == "gated" else ""
    if mode != "alias":
        more += f"WHEN a BETWEEN 1 AND 5 THEN 'fusion-dropped-alias' WHEN {at(3, 0)} THEN 'fusion-dropped-semantic' "
    return f"CASE WHEN r BETWEEN 1 AND 5 THEN NULL WHEN {at(11, 3)} THEN 'emoji-in-query' WHEN {at(5, 1)} THEN 'gendered-label' WHEN {at(7, 2)} THEN 'disputed-label' {more}WHEN {at(13, 5)} THEN 'romanized' WHEN {at(6, 5)} THEN 'unsegmented-script' WHEN {at(9, 4)} THEN 'collision-capped' WHEN {at(4, 1)} THEN 'no-match' WHEN k % 3 > 0 THEN 'unknown-word' WHEN {at(2, 1)} THEN 'exact-phrase-other-item' WHEN k % 2 = 1 THEN 'phrase-partial' ELSE 'word-sense' END AS {mode}"


def stored(s, d):
    runs = a_list(s, d).withColumn("run", F.lit("full")).unionByName(b_list(s, d).withColumn("run", F.lit("short")))
    runs = kept(runs, "runs")
    return E.rejudged(runs, E.class_answers(runs, asking(s, d), answers(s, d).filter("answer % 2 = 0"), "label"))


def ranked_folded(s, d):
    rows, fold = kept(a_list(s, d), "list"), lambda c: F.floor(c / 10)
    return E.rank_of(rows, E.class_answers(rows, asking(s, d), answers(s, d).filter("answer % 3 = 0"), "label", fold), fold)


def chunked(s, d):
    rows = table(s, d, "part").select("p_brand", "p_partkey", (F.row_number().over(E.Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("n"), F.count("*").over(E.Window.partitionBy("p_brand")).alias("total"))
    return rows.groupBy("p_brand", E.chunk_of(F.col("n"), F.col("total"), 7).cast("long").alias("chunk")).agg(F.count("*").alias("n"))


def integrity(s, d):
    part = table(s, d, "part")
    actual = part.filter("p_partkey % 10 <> 3").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 10 == 7, 10_000_000).otherwise(0)).alias("p_partkey"))
    return E.integrity(part, actual.unionByName(actual.filter("p_partkey % 10 = 5")), "p_partkey")


def gate_against_run(s, d):
    now, before = (E.recall_mrr(first(s, d, rows).join(P.labels(s, d).toDF("query_id", "want"), "query_id"), "want") for rows in (b_list(s, d), a_list(s, d)))
    return E.regressions(now, before, "want", "mrr", 0.05)


def listed(s, d):
    """Results with their features and whether they are relevant."""
    own = P.labels(s, d)
    rows = b_list(s, d).join(own, "id").join(own.toDF("query_id", "want"), "query_id").join(a_list(s, d).select("query_id", "id", F.col("score").alias("full")), ["query_id", "id"], "left").fillna(0.0, ["full"])
    return rows.withColumn("relevant", F.col("label") == F.col("want")).withColumn("inverse", 1 / F.col("place"))


def fitted(s, d):
    """Share of queries whose most relevant result leads, for each fold by weights learned from the other four."""
    rows = kept(listed(s, d), "listed")
    return E.recall_mrr(E.held_out(rows, E.fit_reranker(rows, ["score", "full", "inverse"])), "fold").select("fold", "n", "r1", "mrr")


def candidates(s, d):
    """The results of both lists, met once, with the scores and places of each, and a popularity."""
    own, pair = P.labels(s, d), ["query_id", "id"]
    text = a_list(s, d).select(*pair, F.col("score").alias("text"), F.col("place").alias("text_place"))
    glyph = b_list(s, d).select(*pair, F.col("score").alias("glyph"), F.col("place").alias("glyph_place"))
    rows = text.join(glyph, pair, "full").join(own, "id").join(own.toDF("query_id", "want"), "query_id")
    half = F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd")
    return rows.select("*", (F.col("label") == F.col("want")).alias("relevant"), (F.col("id") * 37 % 101).alias("popularity"), half.alias("half"))


def variants():
    """The orders to compare: as shipped, without the term of the second list, and by places alone."""
    score = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    popular = [F.desc("popularity"), F.col("id")]
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    return {"shipped": [F.desc(score(F.greatest("text", "glyph"))), *popular], "no-glyph": [F.desc(score(F.col("text"))), *popular], "rrf": [F.desc(F.round(part("text_place") + part("glyph_place"), 9)), F.col("id")]}


VARIANTS_SQL = {
    "shipped": "round(coalesce(greatest(a.score, b.score), 0), 2) DESC, id * 37 % 101 DESC, id",
    "no-glyph": "round(coalesce(a.score, 0), 2) DESC, id * 37 % 101 DESC, id",
    "rrf": "round(coalesce(1e0 / (60 + a.place), 0) + coalesce(1e0 / (60 + b.place), 0), 9) DESC, id",
}


def variants_sql() -> str:
    """Each variant ranked by itself."""
    one = "SELECT '{v}' AS variant, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {o}) AS place FROM a FULL JOIN b USING (query_id, id)"
    every = " UNION ALL ".join(one.format(v=v, o=o) for v, o in VARIANTS_SQL.items())
    firsts = "SELECT variant, query_id, CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END AS half, coalesce(min(place) FILTER (WHERE r.label = w.label), 0) AS first FROM v JOIN e r USING (id) JOIN e w ON w.id = query_id GROUP BY 1, 2"
    return CTES + f", v AS ({every}), f AS ({firsts}) SELECT variant, half, {P.METRICS} FROM f GROUP BY GROUPING SETS ((variant, half), (variant))"


QUERIES = {
    "rank_with_folding": (ranked_folded, CTES + f", ans AS (SELECT DISTINCT w.id AS query_id, r.id // 10 AS k FROM e w JOIN e r USING (label) WHERE w.id % {P.EVERY} = 0 AND r.id % 3 = 0) SELECT query_id, CAST(coalesce(min(place) FILTER (WHERE (query_id, id // 10) IN (SELECT (query_id, k) FROM ans)), 0) AS BIGINT) AS rank FROM a GROUP BY 1"),
    "semantic_calibration": (calibrated, CTES + ", " + FIRST.format(x="a") + ", j AS (SELECT score, first = 1 AS hit FROM f_a JOIN a USING (query_id) WHERE place = 1), l AS (SELECT list(score ORDER BY score) FILTER (WHERE hit) AS h, list(score ORDER BY score) FILTER (WHERE NOT hit) AS m FROM j), q AS (SELECT floor(round(h[CAST(least(len(h), floor(0.5e0 * len(h)) + 1) AS INT)], 9) * 100 + 0.5e0) / 100 AS c, floor(round(m[CAST(least(len(m), floor(0.25e0 * len(m)) + 1) AS INT)], 9) * 100 + 0.5e0) / 100 AS f FROM l) SELECT CASE WHEN c IS NULL THEN 1e0 ELSE floor(round(least(coalesce(f, c - 0.15e0), c - 0.05e0), 9) * 100 + 0.5e0) / 100 END AS floor, coalesce(c, 1.05e0) AS ceiling FROM q"),
    "trap_and_ceiling": (traps, CTES + f" SELECT query_id, max(label = 3 AND place <= 4) AS forbid, any_value(ceiling) AS ceiling FROM a JOIN e USING (id) JOIN (SELECT w.id AS query_id, least(4, count(*)) / 4 AS ceiling FROM e w JOIN e r USING (label) GROUP BY 1) USING (query_id) GROUP BY 1"),
    "metrics_with_totals": (
        lambda s, d: E.with_totals(by_half(s, d), "half"),
        CTES + ", " + FIRST.format(x="a") + f", h AS (SELECT first, CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END AS half FROM f_a), g AS (SELECT half, grouping(half) AS every, {P.METRICS} FROM h GROUP BY GROUPING SETS ((half), ())) SELECT half, n, r1, r5, r10, mrr, false AS macro FROM g UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), round(avg(r1), 6), round(avg(r5), 6), round(avg(r10), 6), round(avg(mrr), 6), true FROM g WHERE every = 0",
    ),
    "fidelity": (lambda s, d: E.fidelity(a_list(s, d), b_list(s, d)), CTES + " SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(n / 10), 6) AS share FROM (SELECT query_id, count(b.id) AS n FROM a LEFT JOIN b USING (query_id, id) GROUP BY 1)"),
    "odd_result_noise": (lambda s, d: E.noise(a_list(s, d).join(P.labels(s, d), "id"), F.col("label") == 2), CTES + " SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(h), 6) AS share FROM (SELECT query_id, max(CASE WHEN label = 2 AND place <= 5 THEN 1e0 ELSE 0e0 END) AS h FROM a JOIN e USING (id) GROUP BY 1)"),
    "worst_misses": (lambda s, d: E.worst_misses(first(s, d, b_list(s, d)), first(s, d, a_list(s, d)), 1), CTES + ", " + FIRST.format(x="a") + ", " + FIRST.format(x="b") + " SELECT b.query_id, b.first, a.first AS other FROM f_b b JOIN f_a a USING (query_id) WHERE b.first = 0 OR b.first > 1 ORDER BY CASE WHEN b.first = 0 THEN 1 << 30 ELSE b.first END DESC, CASE WHEN a.first = 0 THEN 1 << 30 ELSE a.first END DESC, query_id LIMIT 10"),
    "failure_types": (kinds, CTES + ", " + FIRST.format(x="a") + ", " + FIRST.format(x="b") + ", v AS (SELECT query_id, query_id // 50 AS k, b.first AS r, a.first AS a FROM f_b b JOIN f_a a USING (query_id)) SELECT query_id, " + ", ".join(map(rule_sql, ("alias", "fused", "gated"))) + " FROM v"),
    "rejudged_runs": (stored, CTES + f", ans AS (SELECT w.id AS query_id, r.id FROM e w JOIN e r USING (label) WHERE w.id % {P.EVERY} = 0 AND r.id % 2 = 0), u AS (SELECT 'full' AS run, * FROM a UNION ALL SELECT 'short', * FROM b) SELECT run, query_id, CAST(coalesce(min(place) FILTER (WHERE (query_id, id) IN (SELECT (query_id, id) FROM ans)), 0) AS BIGINT) AS rank FROM u GROUP BY 1, 2"),
    "run_regressions": (gate_against_run, CTES + ", " + FIRST.format(x="a") + ", " + FIRST.format(x="b") + f", n AS (SELECT label AS want, {P.METRICS} FROM f_b JOIN e ON e.id = query_id GROUP BY 1), o AS (SELECT label AS want, {P.METRICS} FROM f_a JOIN e ON e.id = query_id GROUP BY 1) SELECT want, n.mrr AS now, o.mrr AS before FROM n JOIN o USING (want) WHERE o.mrr - n.mrr > 0.05e0"),
    "even_chunks": (chunked, "SELECT p_brand, CAST(floor(n / ceil(total / ceil(total / 7e0))) AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n, count(*) OVER (PARTITION BY p_brand) AS total FROM part) GROUP BY 1, 2"),
    "batch_integrity": (integrity, "SELECT p_partkey, CASE p_partkey % 10 WHEN 3 THEN 'missing' WHEN 7 THEN 'missing' ELSE 'duplicated' END AS problem FROM part WHERE p_partkey % 10 IN (3, 5, 7) UNION ALL SELECT p_partkey + 10000000, 'unexpected' FROM part WHERE p_partkey % 10 = 7"),
    "reranker_fit": (fitted, None),
    "ranking_ablations": (lambda s, d: E.ablations(candidates(s, d), variants(), "half"), variants_sql()),
}
