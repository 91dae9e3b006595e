"""Listing, counting, and printable lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscan.functions.text import shorten
from leafscan.sources.tables import Index


def list_pages(index: Index) -> DataFrame:
    """All pages by name; the id settles equal names and spreads a frequent one."""
    return index.page.orderBy("name", "id").select("name", "description")


def count_pages(index: Index) -> DataFrame:
    return index.page.agg(F.count(F.lit(1)).alias("n_pages"))


def name_width(name: Column) -> Column:
    """Aggregate: longest name in bytes, 1 without rows."""
    return F.coalesce(F.max(F.octet_length(name)), F.lit(1))


def _line(width: Column, limit: int) -> Column:
    padded = F.rpad(F.col("name"), width, F.lit(" "))
    return F.concat(padded, F.lit(" - "), shorten(F.col("description"), limit))


def aligned(df: DataFrame, width: int = 55) -> DataFrame:
    """``line``: padded name, dash, shortened description.

    The padding is a scalar subquery over the names alone, so the rows are not gathered.
    """
    padding = df.select(name_width(F.col("name"))).scalar()
    return df.select(_line(padding, width).alias("line"))


def aligned_blocks(result: DataFrame, width: int = 55) -> DataFrame:
    """``(pass, rank, line)`` of a search result, each block padded to its own names."""
    padding = F.max(F.octet_length("name")).over(Window.partitionBy("pass"))
    return result.select("pass", "rank", _line(padding, width).alias("line"))
