"""Queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftstone.llm import fingerprints, sharding
from siftstone.llm.exact_dedup import exact_dedup
from siftstone.llm.language import identify
from siftstone.llm.language import train as train_language
from siftstone.llm.near_dedup import near_classes
from siftstone.llm.packing import pack
from siftstone.llm.pieces import Vocabulary, encode
from siftstone.llm.quality import quality
from siftstone.llm.suffix_dedup import cut_repeats
from siftstone.llm.toxicity import drop_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no URL: source stands in for the host and lang for the path below it."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), Vocabulary.load())


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.flat(fingerprints.fingerprint(_table(spark, sf_dir, "documents")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train_language(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class, the number of different texts it is linked to, and whether it stays."""
    return near_classes(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_quality, op3_sentencepiece, op4_merkle, op5_language, op6_exact_dedup, op7_shard, op8_toxicity, op9_near_dedup, op10_packing)
}

ORACLES: dict[str, str] = {
    "op4_merkle": fingerprints.ORACLE,
    "op6_exact_dedup": "SELECT d.* FROM documents d JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) k ON k.doc_id = d.doc_id",
    "op7_shard": sharding.oracle(),
}
