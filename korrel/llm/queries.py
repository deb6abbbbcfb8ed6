"""The subpackage's queries: thin readers over the operators, by the contracts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.llm import bpe, language, licences, media, packing, simhash, sketch, substring_index, suffix, toxicity
from korrel.llm.common import documents

#: Different shingles up to which op5's fingerprints hold a text whole.
SKETCH_WHOLE = 256

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id", "n_copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(language.held_out(), F.lit(False))
    model = language.train(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir)).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(documents(spark, sf_dir), whole=SKETCH_WHOLE)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.remove_repeats(documents(spark, sf_dir)).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(documents(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train_held_out(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out")
    return toxicity.scores(docs, model).select("doc_id", held_out, "score", "predicted", F.size("spans").alias("n_spans"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {"op1_simhash": op1_simhash, "op2_language": op2_language, "op3_licences": op3_licences, "op4_suffix": op4_suffix, "op5_sketch": op5_sketch, "op6_substrings": op6_substrings, "op7_bpe": op7_bpe, "op8_packing": op8_packing, "op9_media": op9_media, "op10_toxicity": op10_toxicity, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_licences": licences.sql()}
