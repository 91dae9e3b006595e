"""Page rows: insert-if-absent, surrogate ids, and text rows under shared names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.session import checkpoint_dir

# A name on more pages than this is joined by broadcast, so that it does not fill one
# task. At most (pages / HOT_NAME) names can be that frequent.
HOT_NAME = 1_000_000
# monotonically_increasing_id keeps the partition above this bit, the position below.
POSITION_BITS = 33


def insert_pages(new: DataFrame, existing: DataFrame | None, order: list[str]) -> DataFrame:
    """Rows of ``new`` whose path is not taken yet, one for each path.

    Rows with a NULL are ignored. Among rows of one path the first by ``order`` wins; it
    is found by a minimum, so a path with very many rows is reduced before the shuffle.
    """
    rest = [c for c in new.columns if c not in ("path", *order)]
    first = F.min(F.struct(*order, *rest)).alias("first")
    kept = new.dropna().groupBy("path").agg(first)
    kept = kept.select(*("path" if c == "path" else F.col(f"first.{c}") for c in new.columns))
    if existing is None:
        return kept
    return kept.join(existing.select("path"), "path", "left_anti")


def assign_ids(new: DataFrame, start: int, key: str | list[str] = "path", column: str = "id") -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in the order of a unique key.

    The sorted rows are checkpointed, which fixes their partitions; each row's number is
    then its position plus the sizes of the partitions before its own. Only those sizes
    reach the driver.
    """
    spark = new.sparkSession
    checkpoint_dir(spark)
    ordered = new.orderBy(key).checkpoint()
    place = F.monotonically_increasing_id()
    numbered = ordered.withColumn("_place", place)
    part = F.shiftright("_place", POSITION_BITS).alias("_part")
    sizes = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    offsets, seen = [], start
    for size in sizes:
        offsets.append((size["_part"], seen))
        seen += size["n"]
    # as an Arrow table, which needs no Python worker
    columns = [pa.array([row[i] for row in offsets], pa.int64()) for i in (0, 1)]
    before = spark.createDataFrame(pa.table(columns, names=["_part", "_before"]))
    position = F.col("_place").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(column, F.col("_before") + position + 1)
        .drop("_place", "_part", "_before")
    )


def first_pages(pages: DataFrame, hot: int = HOT_NAME) -> DataFrame:
    """``(path, id, description)``: for every page the first page of its name, by id."""
    per_name = pages.groupBy("name").agg(
        F.min(F.struct("id", "description")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    slim = pages.select("path", "name")
    frequent = F.broadcast(per_name.where(F.col("n") > hot))
    other = per_name.where(F.col("n") <= hot)
    joined = slim.join(frequent, "name").unionByName(
        slim.join(frequent, "name", "left_anti").join(other, "name")
    )
    return joined.select("path", "first.id", "first.description")


def text_rows(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts ``(path, name, content)`` under id and description of their name's first page."""
    return texts.join(first_pages(pages), "path")


def lookup_id(page: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, id)``: lowest id for each looked-up name; NULL finds NULL."""
    wanted = names.select("name").distinct()
    first = page.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("id"))
    return wanted.join(first, F.col("name").eqNullSafe(F.col("_name"))).select("name", "id")
