"""What the operators share: tables, stored intermediate results, joins and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from leafscan.session import checkpoint_dir
from leafscan.sources.tables import drop_path

# What separates words.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
# Rows that an Arrow batch brings to Python, and bytes it takes back at once.
BATCH_ROWS = 1000
FLUSH_BYTES = 8 << 20
# A joined side of no more rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 50_000
# Bits of the filter that tells which texts are needed.
BITS = 1 << 25
# Values of a salt that deals out the rows of a frequent key.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_free(text: str = "text") -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(null_free(text), F.lit(WORD)).cast("long")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of a number's decimal text; a null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


# Makes Spark remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Tables stored by what runs now, for whoever removes them.
_all_paths: list[str] = []
_paths: ContextVar[list[str]] = ContextVar("paths", default=_all_paths)


@contextmanager
def storing(paths: list[str]) -> Iterator[None]:
    """Notes the folders of the tables stored meanwhile in ``paths``."""
    before = _paths.set(paths)
    try:
        yield
    finally:
        _paths.reset(before)


def drop_stored(spark: SparkSession, paths: list[str], but: Iterable[str] = ()) -> None:
    """Removes stored tables, unless a file of them is among those to keep."""
    kept = list(but)
    for path in list(paths):
        name = path.rsplit("/", 1)[1]
        if not any(name in file for file in kept):
            drop_path(spark, path)
            paths.remove(path)


def release(spark: SparkSession) -> None:
    """Removes every table that the operators have stored in this process, but those of a
    pipeline, which removes its own. Results that are still to be computed are lost."""
    drop_stored(spark, _all_paths)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table of their own under ``spark.checkpoint.dir``.

    Cuts the lineage: every executor can read it, and it outlives the executors that wrote it.
    The shuffle files of the write are of no more use and go.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _paths.get().append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join with a table that has one row for each key; nulls are equal to each other.

    ``right`` is counted: it is broadcast up to BROADCAST_ROWS. Beyond, both sides are
    shuffled, and adaptive execution splits the partition of a frequent key.
    """
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    same = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, same, how).drop(*(f"_{k}" for k in keys))


# A key of more rows may be joined apart from the others.
FREQUENT = 10_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Inner join with a stored table that has one row for each key, and how many rows have it.

    Rows of frequent keys stay where they are and get their match by broadcast. The least
    count that makes a key frequent grows with the total, so that at most BROADCAST_ROWS
    keys can reach it. All others are shuffled.
    """
    total = counted.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least = max(FREQUENT, total // BROADCAST_ROWS)
    often = counted.where(F.col(count) > least)
    if often.isEmpty():
        return rows.join(counted, keys)
    often = F.broadcast(often)
    seldom = rows.join(often.select(*keys), keys, "left_anti").join(counted.where(F.col(count) <= least), keys)
    return rows.join(often, keys).unionByName(seldom)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows that come before within their keys.

    Rows are sorted by range, so that a frequent key fills several partitions; a partition's
    rows then start from the sums of the key's earlier partitions. The ranges are stored,
    which fixes the partition of a row.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged)
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = ranged.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(parts), F.lit(0))).drop("_sum")
    other = before.select(*(F.col(k).alias(f"_{k}") for k in ["_part", *keys]), "_before")
    same = [local[k].eqNullSafe(other[f"_{k}"]) for k in ["_part", *keys]]
    joined = local.join(other, same)
    return joined.withColumn(out, F.col("_local") + F.col("_before")).select(*df.columns, out)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session bounds them tighter."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


Rows = Callable[[Iterator[tuple]], Iterable[tuple]]


def map_rows(df: DataFrame, function: Rows, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from the rows of a partition to rows.

    Batches are small in both directions: BATCH_ROWS rows come in, and what goes out is
    handed over whenever it holds FLUSH_BYTES.
    """
    small_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def incoming() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), target.types)]
            return pa.RecordBatch.from_arrays(columns, schema=target)

        rows, held = [], 0
        for row in function(incoming()):
            rows.append(row)
            held += 64 + sum(len(x) * (1 if isinstance(x, (str, bytes)) else 8) for x in row if hasattr(x, "__len__"))
            if held >= FLUSH_BYTES:
                yield emit(rows)
                rows, held = [], 0
        if rows:
            yield emit(rows)

    return df.mapInArrow(run, schema)


Columns = Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]]
# Elements of a column that are handed to Spark at once.
FLUSH_ROWS = 1 << 17


def map_columns(df: DataFrame, function: Columns, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from batches to tuples of equally long numpy arrays."""
    small_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            columns = [pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*parts), target.types)]
            whole = pa.RecordBatch.from_arrays(columns, schema=target)
            for start in range(0, whole.num_rows, FLUSH_ROWS):
                yield whole.slice(start, FLUSH_ROWS)

        parts, held = [], 0
        for part in function(batches):
            parts.append(part)
            held += len(part[0])
            if held >= FLUSH_ROWS:
                yield from emit(parts)
                parts, held = [], 0
        if held:
            yield from emit(parts)

    return df.mapInArrow(run, schema)


def wanted_bits(nodes: DataFrame) -> np.ndarray:
    """A filter of BITS bits that lets the given nodes pass, and few others."""
    bit = F.pmod("node", F.lit(BITS)) + 1  # these functions count from 1
    rows = nodes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in rows.collect():
        start = (bucket - 1) * 4096
        out[start : start + 4096] = np.frombuffer(bits, np.uint8)
    return out
