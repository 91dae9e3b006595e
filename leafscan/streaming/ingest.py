"""Incremental ingest of page files as a Structured Streaming job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.operators.pages import assign_ids
from leafscan.plans.build import ingest_texts, unknown_files
from leafscan.sources.files import (
    BINARY,
    _escaped,
    by_store,
    decode_all,
    distinct_roots,
    files_at,
    hidden_files,
    in_section,
    plain_path,
    visible_files,
)
from leafscan.sources.tables import ensure_tables, load_index

# Files that a stream has found: their times are as they were then, in milliseconds.
FOUND = "path string, modified long"
# Fixed value: what was found stays in the list, whatever its age.
FOREVER = "36500d"


def note_found(spark: SparkSession, roots: list[str], noted: str, max_file_age: str) -> None:
    """Add the files under the roots that are not in the list yet to it.

    A file older than the latest one in the list by more than ``max_file_age`` does not count as
    new, and is forgotten, so that it counts again when it changes.
    """
    spark.createDataFrame([], FOUND).write.mode("ignore").parquet(noted)
    known = spark.read.schema(FOUND).parquet(noted)
    files = visible_files(spark, roots).select("path", F.unix_millis("modificationTime").alias("modified"))
    latest = known.agg(F.max("modified")).first()[0]
    if latest is not None:
        oldest = latest - spark._jvm.org.apache.spark.network.util.JavaUtils.timeStringAsMs(max_file_age)
        known, files = (df.where(F.col("modified") >= oldest) for df in (known, files))
        files = files.join(known.select("path"), "path", "left_anti")
    new = files.persist()
    try:
        # without new files no part is added
        if not new.isEmpty():
            new.write.mode("append").parquet(noted)
    finally:
        new.unpersist()


def in_parts(found: DataFrame, most: int) -> list[DataFrame]:
    """The files of a list, oldest first, in parts of bounded size."""
    n = found.count()
    if n <= most:
        return [found] if n else []
    placed = assign_ids(found, 0, key=["modified", "path"], column="place")
    return [placed.where(F.col("place").between(i + 1, i + most)) for i in range(0, n, most)]


def ingest_available(
    spark: SparkSession,
    roots: list[str],
    directory: str,
    checkpoint: str,
    max_files: int = 1_000_000,
    max_file_age: str = "36500d",
) -> None:
    """Add every file that arrived under the roots since the last run, then stop.

    The list beside the stream's progress remembers which files it has seen, and each micro-batch
    skips paths the catalogue already holds, so a batch that is replayed after a failure adds
    nothing twice. Files count as new whatever their age, up to ``max_file_age``, and are added
    ``max_files`` at a time. Files whose names begin with ``_`` or ``.``, which no stream sees,
    follow as a batch of their own.

    Tasks list the folders, and the stream reads the parts of their list: as a source of the files
    themselves, Spark lists each file of a batch again as a folder of its own. It does so only in
    stores that Arrow does not know.
    """
    ensure_tables(spark, directory)

    def stream(root: str) -> DataFrame:
        reader = spark.readStream.format("binaryFile").schema(BINARY)
        reader = reader.option("pathGlobFilter", "*gz").option("maxFilesPerTrigger", max_files)
        reader = reader.option("maxFileAge", max_file_age).option("recursiveFileLookup", "true")
        found = plain_path(reader.load(f"{_escaped(root)}/man*"))
        return found.where(in_section(F.col("path"), root))

    def add(files: DataFrame, _epoch: int) -> None:
        if not files.select("path").isEmpty():
            fresh = unknown_files(files, load_index(files.sparkSession, directory), directory)
            ingest_texts(files.sparkSession, decode_all(fresh), directory)

    def add_found(found: DataFrame, epoch: int) -> None:
        for part in in_parts(found, max_files):
            add(files_at(part), epoch)

    roots = distinct_roots(spark, roots)
    own, other = by_store(roots)
    streams = []
    if own:
        noted = f"{checkpoint.rstrip('/')}/found"
        note_found(spark, own, noted, max_file_age)
        found = spark.readStream.schema(FOUND).option("maxFileAge", FOREVER).parquet(noted)
        streams.append((found, add_found, f"{checkpoint.rstrip('/')}/found_progress"))
    if other:
        streams.append((reduce(DataFrame.unionByName, map(stream, other)), add, checkpoint))
    for files, adding, progress in streams:
        writer = files.writeStream.foreachBatch(adding).option("checkpointLocation", progress)
        writer.trigger(availableNow=True).start().awaitTermination()
    add(hidden_files(spark, roots), 0)
