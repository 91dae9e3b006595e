import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from leafscan.operators import grams as G
from leafscan.plans import search as S
from leafscan.plans.build import ingest_texts
from leafscan.plans.merge import merge_batches, remove_merged, worth_merging
from leafscan.sources import tables

from tests.pages import GOLDEN_PAGES

PATTERNS = [("socket", False), ("system_[^_]*_types", True), ("S*9", False), ("made up", False)]


def results(index):
    found = [S.search(index, pattern, is_re).collect() for pattern, is_re in PATTERNS]
    stored = [sorted(map(tuple, df.drop("batch").collect())) for df in (index.page, index.fts)]
    df = index.gram_df.groupBy("gram").agg(F.sum("df")).collect()
    return found, stored, sorted(map(tuple, df)), index.n_pages, index.n_rows, index.n_grams, index.raw_bytes


@pytest.fixture
def many(spark, tmp_path):
    """A catalogue of three small ingests; the names of the second repeat."""
    folder = str(tmp_path / "index")
    tables.ensure_tables(spark, folder)
    schema = "path string, raw string"
    parts = [GOLDEN_PAGES[::2], GOLDEN_PAGES[1::2]]
    parts.insert(1, [(f"/other{path}", f"{raw}\nagain") for path, raw in GOLDEN_PAGES[:4]])
    for part in parts:
        ingest_texts(spark, spark.createDataFrame(part, schema).coalesce(1), folder)
    return folder


def batches(spark, folder):
    return {table: tables.stored_batches(spark, folder, table) for table in tables.TABLES}


def test_merge_keeps_rows_and_scores(spark, many):
    before = tables.load_index(spark, many)
    wanted = results(before)
    index = merge_batches(spark, many, math.inf)
    assert results(index) == wanted and results(before) == wanted
    assert index.last_batch == 4 and (index.max_id, index.max_row_id) == (before.max_id, before.max_row_id)
    grams = index.gram_df.select("gram")
    assert grams.count() == grams.distinct().count()
    assert remove_merged(spark, many) == 3
    assert batches(spark, many) == {table: [4] for table in tables.TABLES}
    assert results(tables.load_index(spark, many)) == wanted
    # nothing is left to merge or to remove
    assert merge_batches(spark, many, math.inf).last_batch == 4 and remove_merged(spark, many) == 0


def test_interrupted_merge_is_invisible(spark, many, monkeypatch):
    wanted = results(tables.load_index(spark, many))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr("leafscan.plans.merge.write_postings", die)
        with pytest.raises(RuntimeError):
            merge_batches(spark, many, math.inf)
    assert 4 in batches(spark, many)["fts"]
    assert results(tables.load_index(spark, many)) == wanted
    assert remove_merged(spark, many) == 0
    # the next ingest writes over what the merge left
    more = spark.createDataFrame([("/m/man1/new.1.gz", "new")], "path string, raw string")
    index = ingest_texts(spark, more, many)
    assert index.last_batch == 4 and index.fts.where("batch = 4").count() == 1
    assert index.page.count() == index.n_pages == wanted[3] + 1


def test_ingest_after_a_merge(spark, many):
    merged = merge_batches(spark, many, math.inf)
    more = spark.createDataFrame([("/z/man1/z.1.gz", "socket z"), GOLDEN_PAGES[0]], "path string, raw string")
    index = ingest_texts(spark, more, many)
    assert index.n_rows == merged.n_rows + 1 and index.max_row_id == merged.max_row_id + 1
    # the large batch is not written again for one row, unless asked for
    assert merge_batches(spark, many).last_batch == 5
    wanted = results(index)
    index = merge_batches(spark, many, math.inf)
    assert index.last_batch == 6 and results(index) == wanted
    assert remove_merged(spark, many) == 5


def test_worth_merging():
    def taken(sizes, ratio=1.0):
        commits = [Row(batch=i, n_rows=n) for i, n in enumerate(sizes)]
        return [row["batch"] for row in worth_merging(commits, ratio)]

    assert taken([]) == [] and taken([5]) == [0]
    assert taken([1] * 6) == [0, 1, 2, 3, 4, 5]
    assert taken([50, 1, 1]) == [1, 2] and taken([2, 1, 1]) == [0, 1, 2]
    assert taken([50, 1], math.inf) == [0, 1] and taken([8, 4], 2.0) == [0, 1]


def test_merge_of_an_empty_catalogue(spark, tmp_path):
    folder = str(tmp_path / "index")
    tables.ensure_tables(spark, folder)
    assert merge_batches(spark, folder, math.inf).n_rows == 0 and remove_merged(spark, folder) == 0


def test_commits_from_before_merges(spark, many):
    """A catalogue whose commits have no ``since`` reads as before."""
    wanted = results(tables.load_index(spark, many))
    old = spark.read.parquet(f"{many}/commits").drop("since")
    rows = old.collect()
    for row in rows:
        part = spark.createDataFrame([row], old.schema).drop("batch").coalesce(1)
        part.write.mode("overwrite").parquet(f"{many}/commits/batch={row['batch']}")
    assert results(tables.load_index(spark, many)) == wanted


def test_merge_joins_lists_without_reading_texts(spark, many, monkeypatch):
    """Every posting once, in fewer lists; lists of interleaved rows and of many pieces too."""
    before = tables.load_index(spark, many)

    def entries(index):
        return sorted(map(tuple, G.unpacked(index.postings, "gram").collect()))

    wanted, n_lists = entries(before), before.postings.count()

    def die(*_):
        raise AssertionError("the texts were read for their grams")

    monkeypatch.setattr("leafscan.plans.build.packed_postings", die)
    index = merge_batches(spark, many, math.inf)
    assert entries(index) == wanted and index.postings.count() < n_lists
    rows = [(i, "abcab" * (i % 5), "xabc" * (i % 3)) for i in range(60)]
    texts = spark.createDataFrame(rows, "row_id long, name string, content string")
    lists = G.packed_postings(texts.where("row_id % 2 = 0").coalesce(1))
    lists = lists.unionByName(G.packed_postings(texts.where("row_id % 2 = 1").coalesce(1)))
    for flush in (1, 50, 1 << 18):
        monkeypatch.setattr(G, "FLUSH", flush)
        joined = G.joined_lists(lists.coalesce(1).sortWithinPartitions("gram", "first"))
        assert sorted(map(tuple, G.unpacked(joined, "gram").collect())) == sorted(map(tuple, G.unpacked(lists, "gram").collect()))
