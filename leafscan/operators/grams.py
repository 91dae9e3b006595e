"""The trigram index: grams, postings, document frequencies and row lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscan.functions.text import fold
from leafscan.schemas import BUCKETS

# Rows of a postings batch handed back to Spark at once.
FLUSH = 1 << 18
# Postings that a task holds before it packs them into lists.
PACKED = 1 << 21
# Bytes of an Arrow batch that are Python strings at once.
READ = 1 << 20


def gram_array(col: Column) -> Column:
    """Every overlapping 3-character window, in text order; none for shorter text."""
    return F.regexp_extract_all(fold(col), F.lit("(?s)(?=(...))."), F.lit(1))


def trigrams(fts: DataFrame) -> DataFrame:
    """One row for each gram occurrence in name or content: ``(row_id, gram)``."""
    grams = F.concat(gram_array(F.col("name")), gram_array(F.col("content")))
    return fts.select("row_id", F.explode(grams).alias("gram"))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)


def gram_keys(text: str) -> np.ndarray:
    """Grams as numbers: three code points of 21 bits each."""
    points = _code_points(text)
    if len(points) < 3:
        return points[:0]
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


def _spell(keys: np.ndarray) -> pa.Array:
    points = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], axis=1)
    return pa.array(np.ascontiguousarray(points.astype("<u4")).view("<U3").ravel())


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about READ bytes."""
    rows = max(1, batch.num_rows * READ // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys start, and how long they are."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    sizes = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=sizes[:-1])
    sizes[-1:] = len(keys) - starts[-1:]
    return starts, sizes


def _counted(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``(row_id, grams, counts, number of grams)`` of the rows of a batch that have any."""
    for piece in pieces(batch):
        for row_id, name, content in zip(*(column.to_pylist() for column in piece.columns)):
            keys = np.concatenate([gram_keys(name or ""), gram_keys(content or "")])
            if len(keys):
                keys.sort()
                starts, counts = runs_of(keys)
                yield row_id, keys[starts], counts, len(keys)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gram", "row_id", "tf", "n_grams"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        keys, counts = (np.concatenate([row[i] for row in rows]) for i in (1, 2))
        sizes = [len(row[1]) for row in rows]
        row_ids, totals = (np.repeat([row[i] for row in rows], sizes) for i in (0, 3))
        arrays = [_spell(keys), pa.array(row_ids), pa.array(counts), pa.array(totals)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        rows, held = [], 0
        for row in _counted(batch):
            rows.append(row)
            held += len(row[1])
            if held >= FLUSH:
                yield emit(rows)
                rows, held = [], 0
        if rows:
            yield emit(rows)


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in as many groups of seven bits as each needs, low ones first, and how many
    bytes that makes. All bytes of a number but its last have the high bit set."""
    sizes = np.ones(len(values), np.int8)
    left = np.flatnonzero(values > 0x7F)
    while len(left):
        sizes[left] += 1
        left = left[values[left] >> 7 * (sizes[left] - 1).astype(np.int64) > 0x7F]
    places = np.cumsum(sizes, dtype=np.int64)
    out = np.empty(int(places[-1]) if len(places) else 0, np.uint8)
    places -= sizes
    # few numbers need a second byte, and fewer a third
    out[places] = values & 0x7F
    left = np.flatnonzero(sizes > 1)
    places, rest = places[left], values[left]
    while len(rest):
        out[places] |= 0x80
        places, rest = places + 1, rest >> 7
        out[places] = rest & 0x7F
        more = rest > 0x7F
        places, rest = places[more], rest[more]
    return out, sizes


def from_bytes(raw: np.ndarray) -> np.ndarray:
    """The numbers that ``to_bytes`` put into so many bytes."""
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    values = np.zeros(len(last), np.int64)
    for i in range(int((last - first).max(initial=-1)) + 1):
        has = first + i <= last
        values[has] |= (raw[first[has] + i].astype(np.int64) & 0x7F) << 7 * i
    return values


def _lists(keys: np.ndarray, row_ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Packed lists of postings that are in order of grams, then rows."""
    starts, sizes = runs_of(keys)
    gaps = np.diff(row_ids, prepend=0)
    gaps[starts] = 0
    # of each list all distances, then all counts
    place = np.arange(len(keys)) + np.repeat(starts, sizes)
    values = np.empty(2 * len(keys), np.int64)
    values[place] = gaps
    place += np.repeat(sizes, sizes)
    values[place] = counts
    del gaps, place
    raw, widths = to_bytes(values)
    ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)[2 * (starts + sizes) - 1]]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    arrays = [_spell(keys[starts]), pa.array(row_ids[starts]), pa.array(sizes), packed]
    return pa.RecordBatch.from_arrays(arrays, names=["gram", "first", "n", "packed"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lists of the grams of neighbouring rows, PACKED postings at a time."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda row: row[0])
        keys, counts = (np.concatenate([row[i] for row in rows]) for i in (1, 2))
        row_ids = np.repeat(np.array([row[0] for row in rows], np.int64), [len(row[1]) for row in rows])
        rows.clear()
        # rows are in order, and a stable sort leaves them so within a gram
        order = np.argsort(keys, kind="stable")
        return _lists(keys[order], row_ids[order], counts[order])

    rows, held = [], 0
    for batch in batches:
        for row_id, keys, counts, _ in _counted(batch):
            rows.append((row_id, keys, counts.astype(np.int32)))
            held += len(keys)
            if held >= PACKED:
                yield emit(rows)
                held = 0
    if rows:
        yield emit(rows)


def packed_postings(fts: DataFrame) -> DataFrame:
    """``(gram, first, n, packed)``: the postings of neighbouring rows as one list for each gram.

    They are counted and packed in the task that reads the rows, so what is shuffled and
    stored afterwards is a byte or two for each row of a list.
    """
    folded = fts.select("row_id", fold(F.col("name")), fold(F.col("content")))
    return folded.mapInArrow(_pack, "gram string, first long, n long, packed binary")


def _parts(whole: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """A batch of lists in parts of about FLUSH postings; their numbers are in one column."""
    ends = np.cumsum(whole.column(place).to_numpy())
    start = 0
    while start < whole.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + FLUSH, "right")), start + 1)
        yield whole.slice(start, stop - start)
        start = stop


def _unpacked(first: pa.Array, n: pa.Array, packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of lists, and the rows and counts of all their postings."""
    first, n = first.to_numpy(), n.to_numpy()
    values = from_bytes(np.frombuffer(b"".join(packed.to_pylist()), np.uint8))
    begins = np.cumsum(n) - n
    place = np.arange(int(n.sum())) + np.repeat(begins, n)
    gaps, tf = values[place], values[place + np.repeat(n, n)]
    sums = np.cumsum(gaps)
    return n, sums + np.repeat(first - sums[begins], n), tf


def unpacked(lists: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, row_id, tf)`` for each entry of packed lists ``(*keep, first, n, packed)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, len(keep) + 1):
                n, row_ids, tf = _unpacked(*batch.columns[len(keep) :])
                rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
                kept = [batch.column(i).take(rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(row_ids), pa.array(tf)], names=[*keep, "row_id", "tf"])

    columns = lists.select(*keep, "first", "n", "packed")
    kinds = [f"{name} {columns.schema[name].dataType.simpleString()}" for name in keep]
    return columns.mapInArrow(run, ", ".join([*kinds, "row_id long", "tf long"]))


def joined_lists(lists: DataFrame) -> DataFrame:
    """Packed lists ``(gram, first, n, packed)`` with neighbouring ones of a gram as one, of about
    FLUSH postings at most. The lists of a gram have no row in common, and stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def emit() -> pa.RecordBatch:
            keys, row_ids, tf = map(np.concatenate, zip(*parts))
            order = np.lexsort((row_ids, keys))
            return _lists(keys[order], row_ids[order], tf[order])

        for whole in batches:
            for batch in _parts(whole, 2):
                n, row_ids, tf = _unpacked(*batch.columns[1:])
                # all grams have three characters
                keys = gram_keys("".join(batch.column(0).to_pylist()))[::3]
                parts.append((np.repeat(keys, n), row_ids, tf))
                held += len(tf)
                if held >= FLUSH:
                    yield emit()
                    parts, held = [], 0
        if parts:
            yield emit()

    columns = lists.select("gram", "first", "n", "packed")
    return columns.mapInArrow(run, "gram string, first long, n long, packed binary")


def postings(fts: DataFrame) -> DataFrame:
    """``(gram, row_id, tf, n_grams)``: counts of each gram in each row.

    A row's grams are counted where the row is read, so nothing is shuffled: only the
    distinct grams leave the task, a quarter of the occurrences or less. ``n_grams`` is
    the row's length, carried along so that scoring needs no join for it.
    """
    folded = fts.select("row_id", fold(F.col("name")), fold(F.col("content")))
    return folded.mapInArrow(_count_grams, "gram string, row_id long, tf long, n_grams long")


def gram_df(posted: DataFrame) -> DataFrame:
    """In how many rows each gram occurs."""
    return posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def packed_df(lists: DataFrame) -> DataFrame:
    """The same from packed lists."""
    return lists.groupBy("gram").agg(F.sum("n").alias("df"))


def gram_count(name: Column, content: Column) -> Column:
    """Length of a row in grams; folding keeps the number of characters."""
    lengths = [F.greatest(F.char_length(col) - 2, F.lit(0)) for col in (name, content)]
    return (lengths[0] + lengths[1]).cast("long")


def doc_stats(fts: DataFrame) -> DataFrame:
    """``(row_id, n_grams)`` for every row, those without grams included."""
    return fts.select("row_id", gram_count(F.col("name"), F.col("content")).alias("n_grams"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """Number of rows, their total length in grams, and the average."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("n_grams"), F.lit(0)).alias("n_grams"),
        F.avg("n_grams").alias("avg_grams"),
    )


def bucket(gram: Column) -> Column:
    """Storage bucket of a gram; folds to a constant for a literal."""
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")
