"""From hits to two ranked blocks, for one query or for many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_rank() -> list[Column]:
    """Best score first; ties by page id, then by text row."""
    return [F.col("score"), F.col("id"), F.col("row_id")]


def passes(name_hit: Column, content_hit: Column) -> Column:
    """Array of the passes a row matches in: 0 by name, 1 by content."""
    return F.array_compact(F.array(F.when(name_hit, 0), F.when(content_hit, 1)))


def two_blocks(hits: DataFrame, k: int, query: list[str]) -> DataFrame:
    """Best k hits of each pass; names shown in the first leave the second afterwards.

    ``hits`` holds the query columns and ``row_id, id, name, description, pass, score``.
    Each task keeps its own best k before anything is shuffled, so a query may hit any
    share of the rows; behind the first window there are at most 2k rows for each query.
    """
    group = Window.partitionBy(*query, "pass").orderBy(*by_rank())
    place = F.row_number().over(group)
    best = hits.withColumn("rank", place).where(F.col("rank") <= k)
    first_pass = F.min("pass").over(Window.partitionBy(*query, "name"))
    kept = best.withColumn("first_pass", first_pass).where(F.col("pass") == F.col("first_pass"))
    columns = [*query, "name", "description", "pass", "rank", "score"]
    return kept.withColumn("rank", place).select(*columns)
