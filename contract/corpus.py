"""Page sources, catalogues and page files that Spark derives from the given tables."""

from __future__ import annotations

import gzip
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.plans.build import ingest_texts
from leafscan.session import checkpoint_dir, spread
from leafscan.sources.tables import Index, ensure_tables, load_index

_catalogues: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def section() -> Column:
    return F.lit(1) + F.col("doc_id") % 8


def word() -> Column:
    return F.regexp_extract("text", "[A-Za-z]+", 0)


def page_source(body: Column) -> Column:
    """A page as its renderer leaves it: heading, NAME section, text."""
    heading = F.concat(F.col("lang"), F.lit("("), F.col("doc_id"), F.lit(")\n\nNAME\n       "))
    title = F.concat(F.col("source"), F.lit("."), F.col("doc_id"), F.lit(" - "), body)
    return F.concat(heading, title, F.lit("\n\nDESCRIPTION\n"), F.col("text"))


def page_sources(documents: DataFrame) -> DataFrame:
    """``(path, raw)`` of every document; the first line of the text is its title.

    Names come from the first word and a section, so many documents share one.
    """
    path = F.concat_ws(
        "/",
        F.lit("/corpus"),
        F.col("source"),
        F.col("doc_id"),
        F.concat(F.lit("man"), section()),
        F.concat(word(), F.lit("."), section(), F.lit(".gz")),
    )
    return documents.select(path.alias("path"), page_source(F.substring_index("text", "\n", 1)).alias("raw"))


def new_folder(spark: SparkSession) -> str:
    """An unused folder under the shared checkpoint folder."""
    shared = checkpoint_dir(spark).rstrip("/")
    return f"{shared}/leafscan-{uuid.uuid4().hex}"


def catalogue(spark: SparkSession, sf_dir: str) -> Index:
    """Catalogue of all documents, built at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogues:
        folder = new_folder(spark)
        ensure_tables(spark, folder)
        documents = spread(table(spark, sf_dir, "documents"), "doc_id")
        ingest_texts(spark, page_sources(documents), folder)
        _catalogues[key] = folder
    return load_index(spark, _catalogues[key])


def catalogue_folder(spark: SparkSession, sf_dir: str) -> str:
    catalogue(spark, sf_dir)
    return _catalogues[spark.sparkContext.applicationId, sf_dir]


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text rows ``(row_id, name, content)``."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    return documents.select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("name"), F.col("text").alias("content")
    )


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Writer:
    """Writes files from a task, each folder made once and its store looked up once."""

    def __init__(self) -> None:
        self.folders: dict[str, tuple[fs.FileSystem, str]] = {}

    def put(self, folder: str, name: str, data: bytes) -> None:
        if folder not in self.folders:
            store, path = _store(folder)
            store.create_dir(path, recursive=True)
            self.folders[folder] = store, path
        store, path = self.folders[folder]
        with store.open_output_stream(f"{path}/{name}", compression=None) as file:
            file.write(data)


def _written(files: DataFrame, write: Callable[[Iterator[pa.RecordBatch]], Iterator[int]]) -> None:
    """Runs a writer in every task; it tells the rows of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in write(batches):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_page_files(documents: DataFrame, root: str) -> None:
    """Every document as a gzip file of its own in ``<root>/man=<section>/``, written by tasks.

    Each file ends with a newline, which is all of a document without a page source. It is named
    by its task, its text and a number among equal ones, so a task that runs again writes the
    same files, whatever the order of its rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[int]:
        writer, seen = Writer(), Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for raw, man in zip(*(column.to_pylist() for column in batch.columns)):
                data = f"{raw or ''}\n".encode()
                key = md5(data).hexdigest(), man
                name = f"part-{part:05d}-{key[0]}-{seen[key]}.txt.gz"
                writer.put(f"{root}/man={man}", name, gzip.compress(data, 1, mtime=0))
                seen[key] += 1
            yield batch.num_rows

    raw = page_source(F.substring_index("text", "\n", 1)).alias("raw")
    # the folder that Spark's writers give a null
    man = F.coalesce(section().cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("man")
    _written(spread(documents, "doc_id").select(raw, man), write)


# Files of write_named_files that are cut short, and those whose names Spark hides.
CUT, UNDERSCORE, DOT = 5, 0, 1


def write_named_files(documents: DataFrame, root: str) -> None:
    """Every document as ``<root>/man<section>/<start><doc_id>.<section>.gz``, written by tasks.

    Every seventh name starts with ``_``, another seventh with a dot; every eleventh file is cut
    short. Each has a copy in a folder below, which is no page.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[int]:
        writer = Writer()
        for batch in batches:
            for folder, name, raw, cut in zip(*(column.to_pylist() for column in batch.columns)):
                data = gzip.compress(raw.encode(), 1, mtime=0)
                for place in (folder, f"{folder}/k=v"):
                    writer.put(place, name, data[:-9] if cut else data)
            yield batch.num_rows

    start = F.when(F.col("doc_id") % 7 == UNDERSCORE, "_").when(F.col("doc_id") % 7 == DOT, ".").otherwise("")
    files = spread(documents, "doc_id").select(
        F.concat(F.lit(f"{root}/man"), section()).alias("folder"),
        F.concat(start, F.col("doc_id"), F.lit("."), section(), F.lit(".gz")).alias("name"),
        page_source(F.substring_index("text", "\n", 1)).alias("raw"),
        (F.col("doc_id") % 11 == CUT).alias("cut"),
    )
    _written(files.where("raw IS NOT NULL"), write)
