"""Merging the batches of many small ingests into one, while readers go on."""

from __future__ import annotations

import math

from pyspark.sql import Row, SparkSession

from leafscan.operators.grams import joined_lists
from leafscan.plans.build import write_postings
from leafscan.schemas import COMMITS, TABLES
from leafscan.sources.tables import (
    Index,
    drop_path,
    dropped_files,
    ensure_tables,
    in_batches,
    live_commits,
    load_index,
    stored_batches,
    table_path,
    write_batch,
)


def worth_merging(commits: list[Row], ratio: float) -> list[Row]:
    """The newest commits, back to the first one with more than ``ratio`` times the rows of all after it.

    So a row that is written again is then in a batch at least ``1 + 1 / ratio`` times the size:
    how often that happens grows with the logarithm of the catalogue. ``inf`` takes them all.
    """
    taken, n_rows = commits[-1:], commits[-1]["n_rows"] if commits else 0
    for row in commits[-2::-1]:
        if math.isfinite(ratio) and row["n_rows"] > ratio * n_rows:
            break
        taken.append(row)
        n_rows += row["n_rows"]
    return taken[::-1]


def merge_batches(spark: SparkSession, directory: str, ratio: float = 1.0, codec: str = "zstd") -> Index:
    """Write the newest batches again as one, with few files and long lists of postings.

    Ids and contents stay as they are, so searches return the same rows and scores. Readers
    switch to the merged batch when its commit is there; a merge that dies before leaves
    nothing visible, and the next ingest or merge writes over it. Contents are shuffled once, and
    not read for the postings: these are joined from the lists of the batches.
    The old folders stay for readers that have them open, until ``remove_merged``. As with an
    ingest, one writer at a time. An empty catalogue, or one batch, is left alone.
    """
    ensure_tables(spark, directory)
    merged = worth_merging(live_commits(spark, directory), ratio)
    if len(merged) < 2:
        return load_index(spark, directory)
    index = load_index(spark, directory)
    batch = index.last_batch + 1
    chosen = in_batches([row["batch"] for row in merged])
    for table in ("page", "fts"):
        rows = getattr(index, table).where(chosen).drop("batch")
        write_batch(rows, directory, table, batch, codec)
    lists = index.postings.where(chosen).drop("batch").hint("rebalance", "bucket")
    lists = joined_lists(lists.sortWithinPartitions("bucket", "gram", "first"))
    write_postings(spark, directory, batch, codec, lists)
    write_batch(dropped_files(index, directory).distinct(), directory, "dropped", batch, codec)
    commit = {name: sum(row[name] for row in merged) for name in ("n_pages", "n_rows", "n_grams", "n_dropped", "raw_bytes")}
    commit |= {name: max(row[name] for row in merged) for name in ("max_id", "max_row_id")}
    commit["since"] = min(row["since"] for row in merged)
    values = tuple(commit[name] for name in COMMITS.names)
    write_batch(spark.createDataFrame([values], COMMITS).coalesce(1), directory, "commits", batch, codec)
    return load_index(spark, directory)


def remove_merged(spark: SparkSession, directory: str) -> int:
    """Remove the folders of batches that merges have written again; how many batches went.

    Commits go last, so a run that dies in between is finished by the next one. Not while a
    search of an index that was loaded before the merge is under way.
    """
    live = live_commits(spark, directory)
    last, kept = max((row["batch"] for row in live), default=0), {row["batch"] for row in live}
    gone: set[int] = set()
    for table in sorted(TABLES, key=lambda table: table == "commits"):
        # batches beyond the last commit belong to a writer at work
        for batch in stored_batches(spark, directory, table):
            if batch <= last and batch not in kept:
                drop_path(spark, f"{table_path(directory, table)}/batch={batch}")
                gone.add(batch)
    return len(gone)
