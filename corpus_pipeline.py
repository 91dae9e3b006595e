"""From raw documents to token ids: quality rules, near duplicates, repeated passages, mixing,
byte-level BPE. Each stage works on what the one before it has kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm import bpe, jaccard, mixing, quality_rules, suffixes
from leafscan.llm.common import drop_stored, storing, table
from leafscan.session import checkpoint_dir
from leafscan.sources.tables import drop_path

RANKS = "byte_bpe_50k.tiktoken"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_stored: list[str] = []


def staged(stage: Stage) -> Stage:
    """The stage, which first removes what the stages before have stored for themselves.

    Their results have been written by then. Tables that the documents at hand are still
    read from stay.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _stored:
            drop_stored(spark, _stored, docs.inputFiles())
        with storing(_stored):
            return stage(spark, docs, sf_dir)

    return run


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or a rule their host is flagged for, go."""
    return quality_rules.keep_documents(docs)


@staged
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return jaccard.keep_one(docs)


@staged
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in several places go from all of them."""
    return suffixes.cut_documents(docs)


@staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: left out, once, in part or twice, in training order."""
    return mixing.mix_documents(docs)


@staged
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to its bytes."""
    decoded = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return decoded.select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", encoding_stage),
]
# Suffix sorting and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next, which
    is removed when the one after it has been written."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            drop_path(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
