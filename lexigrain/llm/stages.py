"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives what it keeps.

The first three return the columns of ``docs``, in their order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, minhash_dedup, packing, toxicity
from .common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model fitted on ``labels`` calls toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that are near an earlier one; documents that consist of such lines only go."""
    return line_dedup.drop_lines(docs, line_dedup.ALL_LINES)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return minhash_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))
