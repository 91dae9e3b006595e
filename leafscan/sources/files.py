"""Page files: finding them under root folders, and decompressing them."""

from __future__ import annotations

import logging
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

BINARY = "path string, modificationTime timestamp, length long, content binary"
STATED = "path string, mtime long, length long"
# Decoded text handed back to Spark at once, in bytes.
FLUSH = 32 << 20
# Files of a folder's list handed back to Spark at once, and tasks for each core that open files.
LISTED, READERS = 10_000, 4


def _escaped(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def section_dirs(spark: SparkSession, roots: list[str]) -> list[str]:
    """Folders named ``man*`` directly under the roots; roots that cannot be read are skipped."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found = set()
    for root in roots:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{_escaped(root.rstrip('/'))}/man*")
        try:
            for status in pattern.getFileSystem(conf).globStatus(pattern) or []:
                if status.isDirectory():
                    found.add(status.getPath().toString())
        except Exception as error:  # a missing root or one without permission
            log.warning("skipping %s: %s", root, str(error).splitlines()[0])
    return sorted(found)


def plain_path(df: DataFrame) -> DataFrame:
    """Local paths without the ``file:`` scheme Spark puts before them."""
    return df.withColumn("path", F.regexp_replace("path", "^file:(?://)?", ""))


def distinct_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots as the paths under them begin; one that cannot be resolved is skipped."""
    conf, found = spark._jsparkSession.sessionState().newHadoopConf(), set()
    for root in roots:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
            full = path.getFileSystem(conf).makeQualified(path).toString()
        except Exception as error:  # no file system of that name
            log.warning("skipping %s: %s", root, str(error).splitlines()[0])
            continue
        found.add(re.sub("^file:(?://)?", "", full))
    return sorted(found)


def in_section(path: Column, root: str) -> Column:
    """Whether a path is that of a file directly in a ``man*`` folder directly under the root."""
    start = f"{root.rstrip('/')}/man"
    rest = F.substring(path, len(start) + 1, 1 << 30)
    slashes = F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit("")))
    return F.startswith(path, F.lit(start)) & (slashes == 1)


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``(path, modificationTime, length, content)`` of every ``man*/*gz`` under the roots.

    Each path comes once, without a shuffle to make sure: a folder is listed by one task, and
    the index of Spark's reader holds a file once. Folders are listed without taking ``k=v`` for
    a partition; what lies deeper is left out. ``content`` is read only where it is selected.
    """
    roots = distinct_roots(spark, roots)
    own, other = by_store(section_dirs(spark, roots))
    found = _listed(spark, own)
    if other:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*gz").option("recursiveFileLookup", "true")
        read = plain_path(reader.load([_escaped(path) for path in other]))
        read = read.where(reduce(or_, (in_section(F.col("path"), root) for root in roots)))
        found = found.unionByName(read).unionByName(_hidden_in(spark, other))
    return found


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def by_store(dirs: list[str]) -> tuple[list[str], list[str]]:
    """Folders that Arrow can open, and those in stores that only Spark's readers know."""
    own, other = [], []
    for folder in dirs:
        plain = re.sub("^file:(?://)?", "", folder)
        try:
            _store(plain)
        except (pa.ArrowException, OSError):
            other.append(folder)
        else:
            own.append(plain)
    return own, other


def _listed(spark: SparkSession, dirs: list[str], wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """The page files directly in the folders, with the columns of ``discover``; on request those
    alone whose names are wanted.

    Tasks list the folders, and the files are dealt out anew, so that the driver holds no file
    name and a task reads as many small files as come to it.
    """
    if not dirs:
        return spark.createDataFrame([], BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (folder for batch in batches for folder in batch.column(0).to_pylist()):
            store, place = _store(folder)
            infos = store.get_file_info(fs.FileSelector(place))
            # Spark leaves files without a byte out
            infos = [info for info in infos if info.is_file and info.size and info.base_name.endswith("gz")]
            infos = [info for info in infos if not wanted or wanted(info.base_name)]
            for i in range(0, len(infos), LISTED):
                part = infos[i : i + LISTED]
                yield _stated([f"{folder}/{info.base_name}" for info in part], part)

    folders = spark.createDataFrame(pa.table([pa.array(dirs, pa.string())], names=["folder"]))
    return _dealt(folders.mapInArrow(run, STATED))


def _stated(paths: list[str], infos: list[fs.FileInfo]) -> pa.RecordBatch:
    columns = [
        pa.array(paths, pa.string()),
        pa.array([info.mtime_ns // 1_000_000 for info in infos], pa.int64()),
        pa.array([info.size for info in infos], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["path", "mtime", "length"])


def _dealt(files: DataFrame) -> DataFrame:
    """Files ``(path, mtime, length)`` dealt out to the tasks that open them, with the columns of ``discover``."""
    files = files.repartition(READERS * files.sparkSession.sparkContext.defaultParallelism, "path")
    return files.select("path", F.timestamp_millis("mtime").alias("modificationTime"), "length", _content("path").alias("content"))


def visible_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The page files that Spark's file index would list, with the columns of ``discover``, of
    roots that Arrow can open."""
    own, _ = by_store(section_dirs(spark, roots))
    return _listed(spark, own, lambda name: not _hidden(name))


def files_at(paths: DataFrame) -> DataFrame:
    """Files of these paths as they are now, with the columns of ``discover``, where Arrow can open
    them; those that went or lost all bytes since are left out, as Spark's reader does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, infos = [], []
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store, place = _store_of(folder)
                info = store.get_file_info(f"{place}/{name}")
                if info.is_file and info.size:
                    known.append(path)
                    infos.append(info)
            yield _stated(known, infos)

    return _dealt(paths.select("path").mapInArrow(run, STATED))


@lru_cache(maxsize=1024)
def _store_of(folder: str) -> tuple[fs.FileSystem, str]:
    return _store(folder)


def _content(path: str) -> Column:
    """A file's bytes. Row by row, so that no batch holds many large files."""

    def read(path: str) -> bytes:
        folder, _, name = path.rpartition("/")
        store, place = _store_of(folder)
        with store.open_input_stream(f"{place}/{name}", compression=None) as file:
            return file.read()

    return F.udf(read, "binary", useArrow=False)(path)


def _hidden(name: str) -> bool:
    """Whether Spark's file index leaves a file of this name out."""
    named = name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
    return named or name.startswith(".")


def hidden_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The page files whose names begin with ``_`` or ``.``, with the columns of ``discover``.

    Spark's reader never lists them.
    """
    own, other = by_store(section_dirs(spark, roots))
    found = _listed(spark, own, _hidden)
    return found.unionByName(_hidden_in(spark, other)) if other else found


def _hidden_in(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Those of folders that tasks cannot list: the driver lists them, and tasks open them."""
    path_of, conf, found = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf(), []
    for folder in dirs:
        pattern = path_of(f"{_escaped(folder)}/[._]*gz")
        try:
            found += pattern.getFileSystem(conf).globStatus(pattern) or []
        except Exception as error:  # a folder without permission
            log.warning("skipping %s: %s", folder, str(error).splitlines()[0])
    return _opened(spark, [status for status in found if _hidden(status.getPath().getName())])


def _opened(spark: SparkSession, statuses: list) -> DataFrame:
    """Files of the given states, opened in tasks; those without a byte are left out, as Spark does."""
    rows = [
        (status.getPath().toString(), status.getModificationTime(), status.getLen())
        for status in statuses
        if status.isFile() and status.getLen()
    ]
    if not rows:
        return spark.createDataFrame([], BINARY)
    listed = plain_path(spark.createDataFrame(rows, STATED))
    read = listed.mapInArrow(_read, f"{STATED}, content binary")
    return read.select("path", F.timestamp_millis("mtime").alias("modificationTime"), "length", "content")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, path in enumerate(batch.column(0).to_pylist()):
            local = path.startswith("/")
            store, place = (fs.LocalFileSystem(), path) if local else fs.FileSystem.from_uri(path)
            with store.open_input_stream(place, compression=None) as file:
                content = pa.array([file.read()], pa.binary())
            names = ["path", "mtime", "length", "content"]
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, content], names=names)


def named_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Given files, with the columns of ``discover``; a path without a scheme is local."""
    if not paths:
        return spark.createDataFrame([], BINARY)
    full = [f"file:{path}" if path.startswith("/") else path for path in paths]
    hidden = [path for path in full if _hidden(path.rsplit("/", 1)[-1])]
    conf, states = spark._jsparkSession.sessionState().newHadoopConf(), []
    for name in hidden:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        states.append(path.getFileSystem(conf).getFileStatus(path))
    listed = [_escaped(path) for path in full if path not in set(hidden)]
    opened = _opened(spark, states)
    if not listed:
        return opened
    return plain_path(spark.read.format("binaryFile").load(listed)).unionByName(opened)


def gunzip(data: bytes) -> bytes | None:
    """First member of a gzip file; None if it is damaged or cut short."""
    stream = zlib.decompressobj(wbits=31)
    try:
        text = stream.decompress(data) + stream.flush()
    except zlib.error:
        return None
    return text if stream.eof else None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("raw", pa.string()), ("mtime", pa.int64())])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        rows, held = [], 0
        for path, mtime, data in zip(*batch.columns):
            text = gunzip(data.as_py() or b"")
            raw = None if text is None else text.decode("utf-8", "replace")
            rows.append((path.as_py(), raw, mtime.as_py()))
            held += len(text or b"")
            if held >= FLUSH:
                yield emit(rows)
                rows, held = [], 0
        if rows:
            yield emit(rows)


def decode_all(files: DataFrame) -> DataFrame:
    """``(path, raw, mtime)`` for every file; ``raw`` is NULL where decompression failed.

    Spark's reader puts few small files into a task; a task here takes those of many.
    """
    read = files.select("path", F.unix_timestamp("modificationTime").alias("mtime"), "content")
    read = read.coalesce(READERS * files.sparkSession.sparkContext.defaultParallelism)
    return read.mapInArrow(_decode, "path string, raw string, mtime long")


def decode(files: DataFrame) -> DataFrame:
    """Decoded files alone; damaged ones are left out and their neighbours kept."""
    return decode_all(files).where(F.col("raw").isNotNull())
