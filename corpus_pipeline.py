"""Corpus preparation: language, near duplicates, benchmark passages, secrets, tokens.

Each stage gets what its predecessor kept, as written Parquet.  Documents whose text is null, empty or
without letters go in the first stage, and so do those unlike every language that the table has labels for.
Of documents in one group of near copies the one with the smallest doc_id stays; of several rows with that
doc_id, or where all are null, one.  Extra columns pass through all stages but the last.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sigtrace.llm import decontaminate, langid, secrets, sentencepieces, simhash
from sigtrace.llm.queries import PATTERN, PIECES, RANKS, table
from sigtrace.operators.staging import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose words are like those of a learned language, or of several."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles linked at 3 bits or fewer."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not make up by a twentieth or more."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by their kind."""
    return secrets.redact(docs, RANKS, PATTERN)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with their digests."""
    return sentencepieces.encode(docs, PIECES, with_ids=True).drop("decoded")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("SentencePiece encoding and decoding", tokens),
]

#: A trained field, components of near copies and SentencePiece ids have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
