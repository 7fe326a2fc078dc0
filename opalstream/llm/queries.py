"""The queries opN_<name> over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opalstream.llm import byte_bpe, chat_format, collocations, conversation_repair, fingerprints, language_model, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_store


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokens_digest(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_format.with_hostile(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.chats_digest(chat_format.format_chats(chats))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_digest(documents(spark, sf_dir))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digest(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_store": op3_token_store,
    "op4_secret_scan": op4_secret_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_chat_format": op6_chat_format,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language_model": op8_language_model,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op10_mixing": mixing.oracle(), "op12_collocations": collocations.oracle()}
