"""Building and extending a catalogue from page files or page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafscan.functions.text import (
    description,
    page_name,
    plain_text,
    section_and_mtime,
    until_nul,
)
from leafscan.operators.grams import bucket, gram_count, packed_df, packed_postings
from leafscan.operators.pages import assign_ids, first_pages
from leafscan.schemas import COMMITS, TABLES
from leafscan.session import spread
from leafscan.sources.files import decode_all, discover, named_files
from leafscan.sources.tables import (
    Index,
    block,
    drop_path,
    dropped_files,
    ensure_tables,
    load_index,
    table_path,
    write_batch,
)


# Up to this many new files are opened by name.
NAMED_FILES = 1000


def extract(decoded: DataFrame, derive: bool = False) -> DataFrame:
    """``(path, name, description, section, last_modified, content)`` of decoded pages."""
    mtime = F.timestamp_seconds("mtime") if "mtime" in decoded.columns else None
    content = until_nul(plain_text(F.col("raw")))
    # when the file was changed tells a damaged one from its successor
    file_time = ["mtime"] if "mtime" in decoded.columns else []
    named = decoded.withColumn("content", content).withColumn("name", page_name(F.col("path")))
    section, modified = section_and_mtime(derive, F.col("name"), mtime)
    return named.select(
        "path",
        "name",
        description(F.col("content")).alias("description"),
        section.alias("section"),
        modified.alias("last_modified"),
        "content",
        *file_time,
    )


def build(
    spark: SparkSession,
    roots: list[str],
    directory: str,
    faithful: bool = False,
    derive: bool = False,
    codec: str = "zstd",
) -> Index:
    """Read all page files under the roots into the catalogue; may be run again.

    Known paths are skipped, and damaged files until they change. With ``faithful`` known paths
    add another text row each time.
    """
    ensure_tables(spark, directory)
    files = discover(spark, roots)
    if not faithful:
        files = unknown_files(files, load_index(spark, directory), directory)
    return ingest_texts(spark, decode_all(files), directory, faithful, derive, codec)


def unknown_files(files: DataFrame, index: Index, directory: str) -> DataFrame:
    """Files whose path the catalogue does not hold and that were not found damaged as they are.

    The comparison uses paths and times alone. A few new files are then opened by name, so that
    building again does not read the whole tree.
    """
    if not index.last_batch:
        return files
    listed = files.select("path", F.unix_timestamp("modificationTime").alias("modified"))
    listed = listed.join(dropped_files(index, directory), ["path", "modified"], "left_anti")
    fresh = listed.select("path").join(index.page.select("path"), "path", "left_anti")
    few = [row["path"] for row in fresh.limit(NAMED_FILES + 1).collect()]
    if len(few) > NAMED_FILES:
        return files.join(fresh, "path", "left_semi")
    return named_files(index.spark, few)


def numbered_texts(staged: DataFrame, keys: DataFrame) -> DataFrame:
    """Staged texts ``(path, _row, name, content, n_grams)`` under the ids of their keys
    ``(path, _row, row_id, id, description)``; texts without a key are left out.

    Row ids follow the paths, so dealing texts out by ranges of paths puts them where they are
    to be stored. The keys travel with them as rows of their own and meet them in a window of
    the same partitions: contents are shuffled once.
    """
    text, key = F.struct("name", "content", "n_grams"), F.struct("row_id", "id", "description")
    texts = staged.select("path", "_row", text.alias("text"))
    numbers = keys.select("path", "_row", key.alias("key"))
    both = texts.unionByName(numbers, allowMissingColumns=True)
    met = Window.partitionBy("path", "_row")
    dealt = both.repartitionByRange("path", "_row").withColumn("key", F.first("key", ignorenulls=True).over(met))
    found = dealt.where(F.col("text").isNotNull() & F.col("key").isNotNull())
    return found.select("key.row_id", "key.id", "text.name", "key.description", "text.content", "text.n_grams")


def write_postings(spark: SparkSession, directory: str, batch: int, codec: str, lists: DataFrame | None = None) -> None:
    """The packed lists of a batch, and their document frequencies, from the texts it has stored,
    or from lists dealt out by their buckets."""

    def written(table: str) -> DataFrame:
        return spark.read.schema(TABLES[table]).parquet(f"{table_path(directory, table)}/batch={batch}")

    dealt = lists is not None
    if not dealt:
        texts = spread(written("fts").select("row_id", "name", "content"), "row_id", by_range=True)
        lists = packed_postings(texts)
    posted = lists.withColumn("bucket", bucket(F.col("gram")))
    write_batch(posted, directory, "postings", batch, codec, dealt=dealt)
    write_batch(packed_df(written("postings")), directory, "gram_df", batch, codec)


def ingest_texts(
    spark: SparkSession,
    decoded: DataFrame,
    directory: str,
    faithful: bool = False,
    derive: bool = False,
    codec: str = "zstd",
) -> Index:
    """Add decoded pages ``(path, raw)`` as one batch.

    A path that comes twice is one page, and unless ``faithful`` a path that the catalogue
    holds already is skipped. A page whose ``raw`` is null is damaged: it is recorded with the time
    of its file (``mtime``, 0 if there is none) and counted once, also if nothing else is added. Every table gets the batch as a folder of its own and ``commits`` comes last: a run that dies
    before that leaves nothing visible, and the next run writes over it.
    """
    index = load_index(spark, directory)
    batch = index.last_batch + 1
    staged_path = f"{table_path(directory, '_staging')}/batch={batch}"
    sizes = [
        F.octet_length("content").alias("n_bytes"),
        gram_count(F.col("name"), F.col("content")).alias("n_grams"),
    ]
    extracted = extract(decoded, derive).select("*", *sizes, F.monotonically_increasing_id().alias("_row"))
    extracted.write.mode("overwrite").option("compression", codec).parquet(staged_path)
    staged = spark.read.schema(extracted.schema).parquet(staged_path)

    good = staged.where(F.col("content").isNotNull())

    def kept(*columns: str) -> DataFrame:
        # one row for each path, chosen by keys alone; the stored row number tells its text
        rows = good.groupBy("path").agg(F.min(F.struct("_row", *columns)).alias("first")).select("path", "first.*")
        return rows.join(index.page.select("path"), "path", "left_anti") if index.n_pages and not faithful else rows

    totals = kept("n_bytes", "n_grams").agg(
        F.count("n_bytes").alias("n_rows"),
        F.coalesce(F.sum("n_grams"), F.lit(0)).alias("n_grams"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("raw_bytes"),
    ).first()
    modified = F.col("mtime") if "mtime" in staged.columns else F.lit(0).cast("long")
    damaged = staged.where(F.col("n_bytes").isNull()).select("path", modified.alias("modified")).distinct()
    damaged = damaged.join(dropped_files(index, directory), ["path", "modified"], "left_anti")
    n_dropped = damaged.count()

    def commit(n_pages: int) -> Index:
        write_batch(damaged, directory, "dropped", batch, codec)
        row = (
            n_pages,
            totals["n_rows"],
            totals["n_grams"],
            n_dropped,
            totals["raw_bytes"],
            index.max_id + n_pages,
            index.max_row_id + totals["n_rows"],
            batch,
        )
        write_batch(spark.createDataFrame([row], COMMITS).coalesce(1), directory, "commits", batch, codec)
        drop_path(spark, staged_path)
        return load_index(spark, directory)

    if not totals["n_rows"]:
        if n_dropped:
            # a run that died may have left folders under this number
            for table in ("page", "fts", "postings", "gram_df"):
                drop_path(spark, f"{table_path(directory, table)}/batch={batch}")
            return commit(0)
        drop_path(spark, staged_path)
        return index

    # rows keep no content until the ids are known
    slim = kept("name", "description", "section", "last_modified")
    rows = assign_ids(slim, index.max_row_id, column="row_id")
    if faithful and index.n_pages:
        fresh = rows.join(index.page.select("path"), "path", "left_anti")
        pages = assign_ids(fresh.drop("row_id"), index.max_id)
        n_pages = pages.count()
    else:
        pages = rows.withColumn("id", F.col("row_id") + (index.max_id - index.max_row_id))
        pages = pages.drop("row_id")
        n_pages = totals["n_rows"]
    pages = pages.select("id", "name", "description", "section", "path", "last_modified")
    write_batch(pages.select("*", block("id")), directory, "page", batch, codec)

    # names of this batch may have their first page in an earlier one
    named = pages.select("path", "name", "id", "description")
    if index.n_pages:
        known = index.page.select("path", "name", "id", "description")
        named = named.unionByName(known.join(rows.select("name").distinct(), "name", "left_semi"))
    keys = rows.select("path", "_row", "row_id").join(first_pages(named), "path")
    texts = numbered_texts(good, keys).select("*", block("row_id"))
    write_batch(texts, directory, "fts", batch, codec, dealt=True)

    write_postings(spark, directory, batch, codec)
    return commit(n_pages)
