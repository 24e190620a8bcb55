"""The query of placing phrases: suppliers as the phrases of the parts they deliver."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import placement as P
from lexiloom.sources.tables import read_table as table


def inputs(s, d):
    """phrases, indexed, edits and low: a part's items in the order of its orders; a phrase's number of owners goes from a few to hundreds."""
    k, supplier = F.col("l_partkey"), F.col("l_suppkey")
    phrase = F.concat(F.lit("s"), supplier, F.lit("-"), (F.col("l_quantity").cast("long") % (1 + supplier % 20)))
    rows = table(s, d, "lineitem").select(
        F.concat(F.lit("L"), k % 3).alias("locale"), k.alias("item"), k.alias("ord"), F.struct(F.col("l_linenumber") != 1, "l_orderkey", "l_linenumber").alias("pos"), phrase.alias("phrase"), F.when(F.col("l_linenumber") > 4, "typo").otherwise("alias").alias("field"), (F.col("l_linenumber") == 1).alias("manual")
    )
    key = rows.select("locale", "item", "phrase").distinct()
    number = F.pmod(F.crc32(F.concat_ws(" ", "item", "phrase")), F.lit(40))
    edits = key.filter(number < 2).select(F.when(number == 0, "*").otherwise(F.col("locale")).alias("locale"), "item", "phrase", F.lit(1).alias("pos"), F.when(F.pmod(F.col("item"), F.lit(2)) == 0, "remove").otherwise("low").alias("action"))
    return rows, key.filter(number == 2), edits, key.filter(number.between(3, 6))


def verdict():
    """block or demote for phrases that end in certain figures, in place of a word list."""
    return F.when(F.endswith("phrase", F.lit("-3")), "block").when(F.endswith("phrase", F.lit("7")), "demote").otherwise("ok")


QUERIES = {"validated_phrases": (lambda s, d: P.validated(*inputs(s, d), verdict()), None)}
