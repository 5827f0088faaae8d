"""The queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tremora.llm import (
    chat, decontaminate, hard_negatives, lexical, licenses, minhash, pieces, quality, secrets, sharding, simhash, toxicity, urls,
)
from tremora.llm.common import read_table
from tremora.llm.oracles import ORACLES

#: The vocabulary file of the queries; operators take its path.
PIECE_MODEL = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(read_table(spark, sf_dir, "conversations"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read_table(spark, sf_dir, "documents"))


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(read_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(read_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(read_table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_secret_scan": op2_secret_scan,
        "op3_simhash": op3_simhash,
        "op4_minimax_sharding": op4_minimax_sharding,
        "op5_quality_rules": op5_quality_rules,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_url_filter": op9_url_filter,
        "op10_license_scan": op10_license_scan,
        "op11_lexical_search": op11_lexical_search,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_minhash": op13_minhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
