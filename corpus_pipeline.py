"""A training-data pipeline: each stage takes documents and calls one operator.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir), docs
having the columns of ``documents``, and returns the documents it keeps, the last
one the packed sequences. ``run`` applies them in order, each stage's result being
written as Parquet and read again.

1. toxicity: a field trained on all labels; documents with a score of 0.7 or more go.
2. language: trained on the ``lang`` of the documents left; documents without a
   letter, or whose best language has less than half of the likelihood, go.
3. near_duplicates: of each component of documents whose five-word shingles have a
   Jaccard similarity of 0.8 or more the least id stays; candidates come from SimHash
   anchors and, as these reach three bits only, from min-hash bands.
4. substrings: word windows that an earlier document has are cut out; ``text`` and
   ``n_chars`` change, no document goes.
5. packing: sequences of at most 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.llm import language, near, packing, substring_index, toxicity
from korrel.llm.common import Scratch, documents, prepare


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.keep_identified(docs, language.train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = substring_index.remove_repeats(docs, with_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", clean), ("language", identified), ("near_duplicates", distinct), ("substrings", without_repeats), ("packing", packed)]

#: The stages train models and resolve links, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)
