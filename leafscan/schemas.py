"""Schemas of the stored tables, and the layout numbers they share."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, False) for name, kind in fields])


L, I, S = T.LongType(), T.IntegerType(), T.StringType()

PAGE = _schema(
    ("id", L), ("name", S), ("description", S), ("section", I), ("path", S), ("last_modified", L)
)
# A text row carries its page's description: pages never change once inserted, so the
# join of the two tables is done once, when the row is written, and not in each search.
# It also carries its length in grams, which scoring needs once for each row.
FTS = _schema(("row_id", L), ("id", L), ("name", S), ("description", S), ("content", S), ("n_grams", L))
# A packed list of the rows that hold a gram, of some neighbouring rows: where it starts, how
# many they are, and their distances and counts in few bytes each.
POSTINGS = _schema(("gram", S), ("first", L), ("n", L), ("packed", T.BinaryType()))
GRAM_DF = _schema(("gram", S), ("df", L))
# Files that could not be decompressed, as they were when that was tried.
DROPPED = _schema(("path", S), ("modified", L))
# One row per finished ingest or merge. It is written last, so it is also the commit mark.
# The batch stands for itself and all batches from ``since`` on.
COMMITS = _schema(
    ("n_pages", L),
    ("n_rows", L),
    ("n_grams", L),
    ("n_dropped", L),
    ("raw_bytes", L),
    ("max_id", L),
    ("max_row_id", L),
    ("since", L),
)
RESULT = T.StructType(
    [
        T.StructField("name", S),
        T.StructField("description", S),
        T.StructField("pass", I),
        T.StructField("rank", I),
        T.StructField("score", T.DoubleType()),
    ]
)

# Partition columns behind the data columns of each table.
PARTITIONS = {
    "page": (("batch", L), ("block", L)),
    "fts": (("batch", L), ("block", L)),
    "postings": (("batch", L), ("bucket", I)),
    "gram_df": (("batch", L),),
    "dropped": (("batch", L),),
    "commits": (("batch", L),),
}
TABLES = {"page": PAGE, "fts": FTS, "postings": POSTINGS, "gram_df": GRAM_DF, "dropped": DROPPED, "commits": COMMITS}

# Rows of page and fts are stored in blocks of consecutive keys, so that a join with a
# handful of keys prunes to their blocks.
BLOCK_ROWS = 1 << 20
# A block is written in slices of this many rows, which are never split.
SLICE_ROWS = 1 << 10
# Postings are stored in this many hash buckets of the gram, so that a query reads only
# the buckets of its own grams.
BUCKETS = 64


def stored(table: str) -> T.StructType:
    """Data columns and partition columns of a table."""
    columns = list(TABLES[table].fields)
    columns += [T.StructField(name, kind, True) for name, kind in PARTITIONS[table]]
    return T.StructType(columns)
