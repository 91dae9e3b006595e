"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import crc_mod, null_free, stored

FOLDS = 5


def held_out(key: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id's text is a multiple of FOLDS."""
    return crc_mod(F.col(key), FOLDS) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(fold, label, text)`` of at most ``rows`` labelled documents outside the held-out fold.

    They are the first by the md5 of their ids, so a run finds the same ones again. A null
    label or id is left out; of an id with several labels the greatest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    # as many ids as the bound says, so small enough to be sent to every task
    ids = stored(known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows))
    met = docs.select("doc_id", null_free().alias("text")).join(F.broadcast(ids), "doc_id")
    fold = crc_mod(F.col("doc_id"), FOLDS * 8).cast("int").alias("fold")
    return stored(met.select(fold, "label", "text"))
