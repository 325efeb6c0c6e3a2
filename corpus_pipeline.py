"""The stages of a training-corpus pipeline, from `documents` to token ids.

Each stage works on all that the one before kept, as read back from Parquet. Documents that the quality classifier rejects go;
lines that match an earlier line go from the texts; of each group of near-duplicates the document with the smallest doc_id
stays; documents are chosen to meet the target weights, each once at most; what is left is encoded.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import bpe, linedup, mixing, neardup, quality
from kindred.llm.common import materialize

#: The mixture of the pipeline: four fifths of the tokens, no document twice.
TARGETS = replace(mixing.PRODUCTION, share=(4, 5), epochs=1)


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, TARGETS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]
#: A classifier, rounds of components and a tokenizer can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
