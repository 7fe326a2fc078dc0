"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opalstream.llm import common, mixing, near_dedup, packing, quality_rules, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are outliers of their language and source go.

    Null and empty texts, of no words, go.  Null languages and sources are values of their own.  Repeated rows are
    judged alike, very long texts whole; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; five words and a similarity of 0.8.

    Of rows that repeat a doc_id one stays; rows without a doc_id stay, as nothing can name them.  Texts without
    words are nobody's copies.  Very long texts are compared whole; an empty table stays empty."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.Near(shingle=5, num=80, trees=16, coordinates=256, once=True, leaf=256))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; null texts stay null, all rows stay, repeated ones alike."""
    return secret_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows chosen for the target weights, once for each epoch they are used in, so a row may come twice.

    Texts without words are never chosen.  Null languages and sources are leaves of their own; rows that repeat a
    doc_id are chosen together; an empty table stays empty."""
    return mixing.choose(docs).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.  A row that mixing used twice is packed twice; `row` tells the uses apart.

    Null and empty texts are one end id; very long texts are cut at the windows; no row gives no piece."""
    return packing.pack_documents(docs).withColumn("ids_crc32", packing.ids_crc32(packing.F.col("ids")))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup_stage), ("secret_scan", secrets), ("mixing", mix), ("packing", pack)]
#: Regular expressions with windows, exact set joins and a tokenizer: not SQL.  tests/llm tests it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, before = common.Tables(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        tables.drop(before)
        before = docs
    return docs
