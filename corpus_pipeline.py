"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, mixing, near_dedup, quality_classifier, token_file
from corpusloom.llm.common import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Each row is judged by its own text, source and lang: null and repeated ids are no matter, null and empty texts are
    judged as texts without words, rows that repeat stay or go together. Without labels all rows get the same evidence. An
    empty table stays empty; columns but doc_id, text, source and lang are only carried along.
    """
    return quality_classifier.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: shingles of five words, a similarity of 0.8.

    That of the least doc_id stays; of rows with one doc_id, one. Rows without doc_id go: no least id can name them. Null and
    empty texts are duplicates of nothing and stay. Texts of any length count whole. An empty table stays empty.
    """
    return near_dedup.drop_near_duplicates(docs, threshold=80, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of eight words of any benchmark item.

    Each row is judged by its own whole text; null and empty texts stay, rows that repeat stay or go together. Without items all stay.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target weight asks for.

    Null is a source of its own. Texts without words are never taken. Rows that repeat are mixed each. Ties in the order are
    broken by ids and hashes of texts, so reruns agree. An empty table stays empty.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards and reads them back: place, length and checksum of each document.

    A null or empty text has only its end id; rows that repeat are written each. An empty table gives no row.
    """
    return token_file.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("token output", tokens)]

#: No SQL can express the classifier's fit or the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
