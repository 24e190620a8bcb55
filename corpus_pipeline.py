"""The corpus pipeline: toxicity, language ID, near-duplicates and packing over the documents table.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import language_id, packing, simhash, toxicity
from lexiloom.llm.catalog import PACKING_TOKENIZER
from lexiloom.llm.common import written
from lexiloom.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, by a model of the labels of documents that aren't held out."""
    held_out = language_id.remainder(5) == 0
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.labelled(docs, read_table(spark, sf_dir, "labels"), held_out)))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a language that holds at least half of them; those without letters go."""
    return language_id.keep_known(docs, language_id.fit(docs.filter(language_id.remainder(4) != 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.keep_one(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path(PACKING_TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("language ID", keep_languages), ("SimHash near-dedup", drop_near_duplicates), ("best-fit packing", pack_sequences)]

#: SQL can express none of the four stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
