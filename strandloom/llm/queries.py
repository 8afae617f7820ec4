"""Queries of the subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, dedup, infill, langid, manifest, merkle, mixing, ngram, quality, secrets, sharding, topk, toxicity
from .oracles import ORACLES


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_docs(spark, sf_dir), shingle=2)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_docs(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.document_scores(_docs(spark, sf_dir))


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.window_hits(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_docs(spark, sf_dir))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_docs(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_docs(spark, sf_dir))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_docs(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_secrets, op3_lm_score, op4_lpt_shards, op5_toxicity, op6_decontaminate, op7_quality, op8_merkle, op9_mix_sources, op10_language, op11_exact_top_k, op12_merkle_manifest, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
