"""From raw documents to a deduplicated, mixed and encoded corpus, in stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.llm import bpe, langid, lines, mixing, ngrams
from hexsupport.llm.store import Workspace, temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is not recognised with a probability of a half, go."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; ``n_chars`` follows the text; documents that lose their last line go."""
    kept = lines.deduplicated(docs).filter("n_lines = 0 OR n_removed < n_lines")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return ngrams.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics come near their target shares of three quarters of the tokens."""
    return mixing.mixed(docs).filter("kept").select(*docs.columns)


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, bytes_col="decoded").drop("text")
    return bpe.digests(ids.withColumn("ids", F.col("token_ids"))).withColumnRenamed("ids", "token_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: SQL can express neither a trained model nor fuzzy lines, raking or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again.

    Once a stage's result is written, its intermediate tables and the result before it are freed.
    """
    ws = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        with temporary():
            docs = ws.write(stage(spark, docs, sf_dir))
        ws.drop(*before)
        before = [docs]
    return docs
