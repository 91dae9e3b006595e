"""Packed posting lists, contents that move once, and pairs that meet texts by block."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafscan.functions import needles
from leafscan.operators import grams as G
from leafscan.plans import batch
from leafscan.plans.build import ingest_texts, numbered_texts
from leafscan.sources.tables import ensure_tables, footprint

from tests.pages import page


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**62)), max_size=40))
def test_numbers_survive_packing(values):
    raw, sizes = G.to_bytes(np.array(values, np.int64))
    assert G.from_bytes(raw).tolist() == values and sizes.sum() == len(raw)
    assert all(size == max(1, -(-value.bit_length() // 7)) for value, size in zip(values, sizes.tolist()))


@pytest.mark.parametrize("packed", (1, 60, 1 << 21))
def test_packed_lists_hold_the_postings(spark, packed, monkeypatch):
    monkeypatch.setattr(G, "PACKED", packed)
    monkeypatch.setattr(G, "FLUSH", 7 * packed)
    rng = random.Random(3)
    texts = [(rng.randrange(1 << 40), f"n{i}", "".join(rng.choice("abc é\n") for _ in range(i))) for i in range(40)]
    texts += [(7, "", ""), (2**50, "aaaa" * 100, "aaab")]
    rows = spark.createDataFrame(texts, "row_id long, name string, content string").repartition(3)
    lists = G.packed_postings(rows)
    plain = G.postings(rows).select("gram", "row_id", "tf")
    assert sorted(map(tuple, G.unpacked(lists, "gram").collect())) == sorted(map(tuple, plain.collect()))
    assert dict(G.packed_df(lists).collect()) == dict(G.gram_df(plain).collect())
    assert G.unpacked(lists.where("false"), "gram").count() == 0


def test_contents_are_shuffled_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [(f"/p{i % 7}", i, f"n{i}", "text " * i, i) for i in range(20)]
        staged = spark.createDataFrame(texts, "path string, _row long, name string, content string, n_grams long")
        keys = [(f"/p{i}", i, 100 + i, 50 + i, f"d{i}") for i in range(7)]
        numbers = spark.createDataFrame(keys, "path string, _row long, row_id long, id long, description string")
        dealt = numbered_texts(staged, numbers)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Join" not in plan
        got = sorted(map(tuple, dealt.collect()))
        assert got == [(100 + i, 50 + i, f"n{i}", f"d{i}", "text " * i, i) for i in range(7)]
        # rows lie where they are to be stored
        parts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("row_id"), F.max("row_id")).orderBy("p").collect()
        assert all(a[2] < b[1] for a, b in zip(parts, parts[1:]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("packed"))
    ensure_tables(spark, folder)
    rng = random.Random(7)
    words = ["socket", "pipe", "quark", "strange", "charm", "bottom", "top", "up", "down"]
    pages = [page(f"{rng.choice(words)}{i}.1", f"{i} - x", " ".join(rng.choices(words, k=6))) for i in range(80)]
    built = ingest_texts(spark, spark.createDataFrame(pages, "path string, raw string"), folder)
    return built, folder


def test_lengths_are_stored_once_for_each_row(spark, index):
    built, folder = index
    stats = {r.row_id: r.n_grams for r in G.doc_stats(built.fts).collect()}
    assert {r.row_id: r.n_grams for r in built.fts.select("row_id", "n_grams").collect()} == stats
    assert "n_grams" not in built.postings.columns and footprint(spark, folder).first()["ratio"] is not None


def test_pairs_in_parts_give_the_same_hits(spark, index, monkeypatch):
    built, _ = index
    patterns = ["quark strange", "charm", "socket7", "top?down", "zzzz", "ottom up"]
    queries = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "query_id long, pattern string")
    monkeypatch.setattr(batch, "block", lambda key: (F.col(key) % 3).alias("block"))
    whole = {n: G.unpacked(built.postings.where(F.col("gram") == n), "gram").count() for n in ("qua", "cha")}
    assert all(whole.values())
    weighed = batch.weigh(built, batch.compile_globs(queries)).checkpoint()
    pairs = batch.pair_candidates(built, weighed, 6).checkpoint()
    for most in (1, 5, 1000):
        parts = batch.parts_of(pairs, most)
        rows = [tuple(r) for part in parts for r in part.collect()]
        assert sorted(rows) == sorted(map(tuple, pairs.collect())) and len(parts) >= min(4, 60 // most)
    monkeypatch.undo()
    want = sorted(map(str, batch.indexed_hits(built, weighed).collect()))
    assert want and sorted(map(str, batch.indexed_hits(built, weighed, most=9).collect())) == want
    plan = batch.indexed_hits(built, weighed, most=9)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Scan parquet")[0]
    assert "SortMergeJoin" not in before and "hashpartitioning(row_id" not in before


def test_few_texts_are_strings_at_once():
    """A batch of any size is read in pieces, and so is one with a single long text."""
    batch = pa.RecordBatch.from_pydict({"row_id": list(range(4000)), "name": ["n"] * 4000, "content": ["text " * 200] * 4000})
    sizes = [piece.num_rows for piece in G.pieces(batch)]
    assert sum(sizes) == 4000 and max(sizes) * 1000 < 2 * G.READ
    assert [row[0] for row in G._counted(batch)] == list(range(4000))
    long = pa.RecordBatch.from_pydict({"row_id": [1], "name": [None], "content": ["abc" * G.READ]})
    (row,) = G._counted(long)
    assert row[2].tolist() == [G.READ, G.READ - 1, G.READ - 1] and row[3] == 3 * G.READ - 2
    assert [piece.num_rows for piece in G.pieces(batch.slice(0, 0))] == []


def test_needles_are_looked_for_in_pieces(spark, monkeypatch):
    """Hits of a batch leave in pieces that do not grow with it."""
    found = needles.scored_finder(spark, {"ab": [1, 2], "c": [3]}, {1: [None], 2: [[("abc", 2.0)]], 3: [None]}, 5.0)
    texts = pa.array(["xabc" * 300, None, "", "c"] * 1000)
    columns = (texts, texts, texts, texts, pa.array([1198, 0, 0, 0] * 1000))
    out = list(found.func(iter([columns])))
    assert len(out) > 3 and max(map(len, out)) < 4000
    rows = [row for piece in out for row in piece.to_pylist()]
    assert len(rows) == 4000 and sorted(rows[0]["by_content"]) == [1, 2, 3] and rows[1]["by_name"] == [] == rows[2]["by_name"]
    assert rows[3]["by_name"] == [3] and rows[3]["name_scores"] == [0.0] and min(rows[0]["content_scores"]) < 0
