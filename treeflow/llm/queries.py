"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import gif, langid, mixing, oracles, pii, quality, recompression, sentencepieces, simhash, suffix_dedup, token_files
from .common import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(gif.store(documents(spark, sf_dir)))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.roundtrip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.assess(docs, quality.fit(docs))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_gif, op3_langid, op4_simhash, op5_sentencepiece, op6_token_files, op7_suffix_array, op8_pii, op9_quality, op10_recompression)}
ORACLE_SQL: dict[str, str] = {"op7_suffix_array": oracles.OP7_SUFFIX_ARRAY, "op10_recompression": oracles.OP10_RECOMPRESSION}
