"""The queries opN_<name>: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import ann, bpe, compress, decontaminate, langid, linedup, mixing, neardup, oracles, quality, ranked, secrets, shards, telephony

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_report(table(spark, sf_dir, "documents"))


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.telephony(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.train(docs))


def op7_setsketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(table(spark, sf_dir, "documents"))


def op9_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.coded(table(spark, sf_dir, "embeddings"))


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.built(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_multi_index_hashing, op4_telephony, op5_byte_bpe, op6_language_id, op7_setsketch_near_dup, op8_mixing, op9_karmarkar_karp_shards, op10_quality, op11_filtering_lloyd, op12_bit_sliced_search, op13_decontamination)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": oracles.LINE_DEDUP, "op7_setsketch_near_dup": oracles.NEAR_DUPLICATES, "op11_filtering_lloyd": oracles.VECTOR_CODES, "op12_bit_sliced_search": oracles.RANKED, "op13_decontamination": oracles.CONTAMINATION}
