"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import byte_bpe, collision_ann, fill_middle, kdtree_shards, language_id, licences, media, packing, sentencepiece_sampling, simhash, spelling_variants, toxicity, warc
from lexiloom.sources.tables import read_table

SAMPLING_MODEL, PACKING_TOKENIZER, BYTE_TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(SAMPLING_MODEL))


def op2_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(read_table(spark, sf_dir, "documents")))


def op3_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = kdtree_shards.shard(docs, kdtree_shards.document_dims(docs), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = language_id.remainder(4) == 2
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = language_id.remainder(5) == 0
    model = toxicity.fit(toxicity.labelled(docs, read_table(spark, sf_dir, "labels"), held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.round_trip(read_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_sentencepiece_sampling, op2_png_media, op3_kdtree_shards, op4_simhash_near_dedup, op5_warc_writer, op6_language_mixture, op7_collision_counting_ann, op8_toxicity, op9_pattern_packing, op10_license_scan, op11_fill_in_middle, op12_byte_bpe, op13_spelling_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": fill_middle.SQL}
