"""Registered queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, fertility, hashtree, langid, licenses, merkle, negatives, secrets, sentencepieces, simhash, topk, urlrules, whitening,
)

from .rows import only

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


@query
def op2_shards(spark, sf_dir):
    return hashtree.shard(table(spark, sf_dir, "documents"))


@query
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), RANKS, PATTERN)


@query
def op5_url_filter(spark, sf_dir):
    return urlrules.classify(table(spark, sf_dir, "pages"))


@query
def op6_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query
def op7_sentencepiece(spark, sf_dir):
    return sentencepieces.encode(table(spark, sf_dir, "documents"), PIECES)


@query
def op8_warc_fixity(spark, sf_dir):
    written = merkle.layout(table(spark, sf_dir, "pages"))
    found = merkle.audit(merkle.fixity(written), merkle.fixity(merkle.aged(written)), moved=True)
    return found.fillna(-1, ["expected_offset", "found_offset"])  # -1: the record is not in that replica


@query
def op9_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op10_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_fertility(spark, sf_dir):
    judged = fertility.judge(table(spark, sf_dir, "documents"), RANKS, PATTERN, PIECES)
    return judged.drop("lang", "script", "reasons").drop(*fertility.MEASURES)


@query
def op12_hard_negatives(spark, sf_dir):
    vectors = only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


@query
def op13_whitening(spark, sf_dir):
    return whitening.components(table(spark, sf_dir, "embeddings"))
