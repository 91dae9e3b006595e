"""The stored catalogue: page, fts, postings, gram_df and commits as Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leafscan.schemas import BLOCK_ROWS, PARTITIONS, SLICE_ROWS, TABLES, stored
from leafscan.sources.files import BINARY


@dataclass(frozen=True)
class Index:
    """Tables of a catalogue as of its last finished ingest, and their totals."""

    page: DataFrame
    fts: DataFrame
    postings: DataFrame
    gram_df: DataFrame
    last_batch: int
    n_pages: int
    n_rows: int
    n_grams: int
    n_dropped: int
    raw_bytes: int
    max_id: int
    max_row_id: int

    @property
    def spark(self) -> SparkSession:
        return self.page.sparkSession

    @property
    def average(self) -> float:
        return self.n_grams / self.n_rows if self.n_rows else 0.0


def table_path(directory: str, table: str) -> str:
    return f"{directory.rstrip('/')}/{table}"


def ensure_tables(spark: SparkSession, directory: str) -> None:
    """Create the tables that are not there yet; existing ones are left alone."""
    for table in TABLES:
        empty = spark.createDataFrame([], stored(table))
        keys = [name for name, _ in PARTITIONS[table]]
        empty.write.mode("ignore").partitionBy(*keys).parquet(table_path(directory, table))


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(stored(name)).parquet(table_path(directory, name))


def live_commits(spark: SparkSession, directory: str) -> list[Row]:
    """Commits that no later one stands for, oldest first; one small row for each ingest or merge.

    Catalogues from before there were merges have no ``since``.
    """
    commits = _table(spark, directory, "commits")
    rows = commits.withColumn("since", F.coalesce("since", "batch")).collect()
    live, covered = [], None
    for row in sorted(rows, key=lambda row: row["batch"], reverse=True):
        if covered is None or row["batch"] < covered:
            live.append(row)
            covered = row["since"]
    return live[::-1]


def in_batches(batches: list[int]) -> Column:
    """Whether a row's batch is among these, as ranges that prune folders."""
    ranges: list[list[int]] = []
    for batch in sorted(batches):
        if ranges and ranges[-1][1] == batch - 1:
            ranges[-1][1] = batch
        else:
            ranges.append([batch, batch])
    return reduce(or_, (F.col("batch").between(*ends) for ends in ranges), F.lit(False))


def load_index(spark: SparkSession, directory: str) -> Index:
    """Scan of the stored tables; rows of an unfinished ingest or merge are not seen, nor those
    of batches that a merge has written again."""
    live = live_commits(spark, directory)
    sums = {name: sum(row[name] for row in live) for name in ("n_pages", "n_rows", "n_grams", "n_dropped", "raw_bytes")}
    tops = {name: max((row[name] for row in live), default=0) for name in ("max_id", "max_row_id")}
    batches = [row["batch"] for row in live]
    tables = (_table(spark, directory, name).where(in_batches(batches)) for name in ("page", "fts", "postings", "gram_df"))
    return Index(*tables, last_batch=max(batches, default=0), **sums, **tops)


def dropped_files(index: Index, directory: str) -> DataFrame:
    """``(path, modified)`` of the files found damaged, up to the last finished ingest.

    What a merge has written again may come twice.
    """
    rows = _table(index.spark, directory, "dropped").where(F.col("batch") <= index.last_batch)
    return rows.select("path", "modified")


def block(key: str) -> Column:
    """Storage block of a page id or row id."""
    return (F.col(key) / BLOCK_ROWS).cast("long").alias("block")


def write_batch(
    df: DataFrame, directory: str, table: str, batch: int, codec: str, dealt: bool = False
) -> None:
    """Write one ingest's part of a table; writing it again replaces it.

    Unless they are dealt out already, rows are spread by the table's own partition key first,
    in pieces of even size: a large bucket or block is split over several tasks, small ones
    share one.
    """
    keys = [name for name, _ in PARTITIONS[table] if name != "batch"]
    order = {"page": ["id"], "fts": ["row_id"], "postings": ["gram", "first"], "gram_df": ["gram"]}
    if dealt:
        pass
    elif "block" in keys:
        # slices of a block, so that one block may fill several tasks
        slices = (F.col(order[table][0]) / SLICE_ROWS).cast("long")
        df = df.withColumn("slice", slices).hint("rebalance", "block", "slice").drop("slice")
    elif keys:
        df = df.hint("rebalance", *keys)
    if table in order:
        df = df.sortWithinPartitions(*keys, *order[table])
    target = f"{table_path(directory, table)}/batch={batch}"
    writer = df.write.mode("overwrite").option("compression", codec)
    # sorted keys take a third of the space as differences
    writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    for key in ("id", "row_id"):
        writer = writer.option(f"parquet.enable.dictionary#{key}", "false")
    (writer.partitionBy(*keys) if keys else writer).parquet(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target.getFileSystem(conf).delete(target, True)


def stored_batches(spark: SparkSession, directory: str, table: str) -> list[int]:
    """Numbers of the batches a table has a folder for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(directory, table))
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    names = [status.getPath().getName() for status in path.getFileSystem(conf).listStatus(path)]
    return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))


def footprint(spark: SparkSession, directory: str) -> DataFrame:
    """``(raw_bytes, stored_bytes, ratio)``: text put in against Parquet bytes kept.

    Both sides come from metadata: the commits' totals, and file lengths by a listing
    that never opens a file.
    """
    reader = spark.read.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", "*.parquet")
    files = reader.load([table_path(directory, table) for table in TABLES]).select("length")
    raw = load_index(spark, directory).raw_bytes
    sizes = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"))
    ratio = F.when(F.lit(raw) > 0, F.col("stored_bytes") / F.lit(raw))
    return sizes.select(F.lit(raw).cast("long").alias("raw_bytes"), "stored_bytes", ratio.alias("ratio"))
