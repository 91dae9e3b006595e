import gzip
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafscan.operators import pages as P
from leafscan.plans.build import build, ingest_texts
from leafscan.plans.merge import merge_batches, remove_merged
from leafscan.sources import files, tables
from leafscan.streaming.ingest import ingest_available

MANUAL = "x\n\nNAME\n       socket - made\n       up\n\nTEXT\nbody\n"


def put(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture
def tree(tmp_path):
    """Two roots with every kind of file the discovery has to tell apart."""
    first, second = tmp_path / "first", tmp_path / "second"
    put(first / "man7/socket.7.gz", gzip.compress(MANUAL.encode()))
    put(first / "man1/a.1.gz.gz", gzip.compress(b"a page"))
    put(first / "man1/foogz", gzip.compress(b"foo page"))
    put(first / "man1/plain.1", b"plain")
    put(first / "man1/bad.1.gz", b"not gzip")
    put(first / "man1/short.1.gz", gzip.compress(b"cut short" * 99)[:-9])
    put(first / "man1/empty.1.gz", b"")
    put(first / "man1/nothing.1.gz", gzip.compress(b""))
    put(first / "man1/multi.1.gz", gzip.compress(b"one") + gzip.compress(b"two"))
    put(first / "man1/u.1.gz", gzip.compress(b"\xff!"))
    put(first / "man1/nul.1.gz", gzip.compress(b"before\0after"))
    put(first / "man1/sub/x.1.gz", gzip.compress(b"x"))
    put(first / "cat1/z.gz", gzip.compress(b"z"))
    put(second / "man7/socket.7.gz", gzip.compress(b"x\n\nNAME\n  other\n\nsecond"))
    return first, second


GOOD = {"socket.7", "a.1", "foogz", "nothing.1", "multi.1", "u.1", "nul.1"}
# Spark leaves out files without a byte by itself, so empty.1.gz is not even counted.
DAMAGED = {"bad.1.gz", "short.1.gz"}


def test_discover(spark, tree):
    first, second = tree
    found = files.discover(spark, [str(first), str(first) + "/", str(second), "/absent"])
    names = sorted(Path(r.path).relative_to(first.parent).as_posix() for r in found.select("path").collect())
    assert len(names) == 10
    assert "second/man7/socket.7.gz" in names and "first/man1/foogz" in names
    assert files.discover(spark, ["/absent"]).count() == 0


def test_decode(spark, tree):
    every = files.decode_all(files.discover(spark, [str(tree[0])]))
    raw = {Path(r.path).name: r.raw for r in every.collect()}
    assert {name for name, text in raw.items() if text is None} == DAMAGED
    assert raw["multi.1.gz"] == "one" and raw["u.1.gz"] == "�!" and raw["nothing.1.gz"] == ""
    assert files.decode(files.discover(spark, [str(tree[0])])).count() == len(raw) - len(DAMAGED)


def rows(index):
    page = {r.path.rsplit("/", 3)[-3] + "/" + r.name: r for r in index.page.collect()}
    fts = sorted((r.id, r.name, r.description, r.content) for r in index.fts.collect())
    return page, fts


def test_build(spark, tree, tmp_path):
    first, second = tree
    index = build(spark, [str(first), str(second)], str(tmp_path / "index"))
    page, fts = rows(index)
    assert set(page) == {f"first/{n}" for n in GOOD} | {"second/socket.7"}
    assert sorted(r.id for r in page.values()) == list(range(1, 9))
    assert [r.path for r in sorted(page.values(), key=lambda r: r.id)] == sorted(r.path for r in page.values())
    assert page["first/socket.7"].description == "socket - made up"
    assert page["second/socket.7"].description == "other"
    assert {(r.section, r.last_modified) for r in page.values()} == {(1, 0)}
    # both socket texts stand under the first socket page
    shared = page["first/socket.7"].id
    assert [row[0] for row in fts if row[1] == "socket.7"] == [shared, shared]
    assert {row[2] for row in fts if row[1] == "socket.7"} == {"socket - made up"}
    assert [row[3] for row in fts if row[1] == "nul.1"] == ["before"]
    assert (index.n_dropped, index.n_pages, index.n_rows) == (2, 8, 8)

    size = tables.footprint(spark, str(tmp_path / "index")).first()
    assert size.raw_bytes == sum(len(row[3].encode()) for row in fts) and size.stored_bytes > 0


def test_damaged_files_are_left_alone_until_they_change(spark, tree, tmp_path):
    """A batch without a good file keeps its count; merging forgets none."""
    first, folder = tree[0], str(tmp_path / "index")
    assert build(spark, [str(first)], folder).n_dropped == 2
    assert build(spark, [str(first)], folder).last_batch == 1
    bad = first / "man1/bad.1.gz"
    put(bad, b"bad still")
    os.utime(bad, (1, 1))
    index = build(spark, [str(first)], folder)
    assert (index.last_batch, index.n_dropped, index.n_pages) == (2, 3, 7)
    put(bad, gzip.compress(b"mended"))
    index = build(spark, [str(first)], folder)
    assert (index.last_batch, index.n_dropped, index.n_pages) == (3, 3, 8)
    assert index.fts.where("content = 'mended'").count() == 1
    index = merge_batches(spark, folder, float("inf"))
    assert remove_merged(spark, folder) == 3
    assert (index.n_dropped, index.n_rows) == (3, 8)
    assert build(spark, [str(first)], folder).last_batch == 4


@pytest.mark.parametrize("by_name", [1000, 0])
def test_build_again_adds_only_what_is_new(spark, tree, tmp_path, monkeypatch, by_name):
    monkeypatch.setattr("leafscan.plans.build.NAMED_FILES", by_name)
    first, second = tree
    folder = str(tmp_path / "index")
    before = rows(build(spark, [str(first)], folder))
    assert rows(build(spark, [str(first)], folder)) == before
    index = build(spark, [str(first), str(second)], folder)
    page, fts = rows(index)
    assert page["second/socket.7"].id == index.max_id == 8
    assert page["first/socket.7"] == before[0]["first/socket.7"]
    assert [r[0] for r in fts if r[1] == "socket.7"] == [page["first/socket.7"].id] * 2

    again = build(spark, [str(first), str(second)], folder, faithful=True)
    assert again.n_pages == 8 and again.n_rows == 16
    assert again.page.count() == 8 and again.fts.select("row_id").distinct().count() == 16
    assert rows(again)[1] == sorted(fts * 2)


def test_unfinished_ingest_is_invisible_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "index")
    tables.ensure_tables(spark, folder)
    texts = spark.createDataFrame([("/m/man1/a.1.gz", "one"), ("/m/man1/b.1.gz", "two")], "path string, raw string")
    ingest_texts(spark, texts.limit(1), folder)
    stray = spark.createDataFrame([(9, 9, "stray", "", "stray", 0)], "row_id long, id long, name string, description string, content string, block long")
    tables.write_batch(stray, folder, "fts", 2, "zstd")
    assert tables.load_index(spark, folder).fts.count() == 1
    index = ingest_texts(spark, texts.where("raw = 'two'"), folder)
    assert sorted(r.name for r in index.fts.collect()) == ["a.1", "b.1"]


def test_derived_columns(spark, tree, tmp_path):
    index = build(spark, [str(tree[0])], str(tmp_path / "index"), derive=True)
    page, _ = rows(index)
    assert page["first/socket.7"].section == 7 and page["first/socket.7"].last_modified > 0


def test_ensure_tables_twice(spark, tmp_path):
    folder = str(tmp_path / "index")
    tables.ensure_tables(spark, folder)
    tables.ensure_tables(spark, folder)
    index = tables.load_index(spark, folder)
    assert index.page.count() == index.fts.count() == index.n_rows == 0


def test_insert_pages(spark):
    schema = "path string, name string, ord int"
    new = [("a", "late", 2), ("a", "first", 1), ("b", None, 1), ("b", "kept", 2), (None, "x", 1), ("c", "taken", 1)]
    existing = spark.createDataFrame([("c",)], "path string")
    kept = P.insert_pages(spark.createDataFrame(new, schema), existing, ["ord"])
    assert sorted(map(tuple, kept.collect())) == [("a", "first", 1), ("b", "kept", 2)]


def test_assign_ids_over_many_partitions(spark):
    keys = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("path"))
    numbered = P.assign_ids(keys.repartition(13), 70)
    assert all(r.id == 71 + int(r.path) for r in numbered.collect())
    assert P.assign_ids(keys.limit(0), 3).count() == 0


@pytest.mark.parametrize("hot", [2, 1000])
def test_first_pages_split_frequent_names(spark, hot):
    pages = [(i, "often" if i % 3 else f"n{i}", f"d{i}", f"p{i}") for i in range(1, 31)]
    frame = spark.createDataFrame(pages, "id long, name string, description string, path string")
    got = {r.path: (r.id, r.description) for r in P.first_pages(frame, hot).collect()}
    want = {p: (1, "d1") if name == "often" else (i, f"d{i}") for i, name, _, p in pages}
    assert got == want


def test_lookup_id_is_null_safe(spark):
    page = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, name string")
    wanted = spark.createDataFrame([("a",), (None,), ("x",)], "name string")
    assert set(map(tuple, P.lookup_id(page, wanted).collect())) == {("a", 1), (None, 3)}


def test_incremental_ingest(spark, tree, tmp_path):
    first, second = tree
    roots, folder, progress = [str(first), str(second)], str(tmp_path / "index"), str(tmp_path / "progress")
    late = second / "man7/socket.7.gz"
    data = late.read_bytes()
    late.unlink()
    ingest_available(spark, roots, folder, progress)
    assert tables.load_index(spark, folder).n_pages == 7
    put(late, data)
    put(second / "man2/new.2.gz", gzip.compress(b"new"))
    ingest_available(spark, roots, folder, progress)
    ingest_available(spark, roots, folder, progress)
    index = tables.load_index(spark, folder)
    assert (index.n_pages, index.n_rows, index.page.count(), index.fts.count()) == (9, 9, 9, 9)
    # progress lost: everything is seen again and nothing is added
    ingest_available(spark, roots, folder, str(tmp_path / "other"))
    assert tables.load_index(spark, folder).fts.count() == 9


def test_a_path_is_one_page(spark, tmp_path):
    folder = str(tmp_path / "catalogue")
    tables.ensure_tables(spark, folder)
    texts = spark.createDataFrame([("/a", "one"), ("/a", "again"), ("/b", "two")], "path string, raw string")
    ingest_texts(spark, texts.coalesce(1), folder)
    more = spark.createDataFrame([("/a", "late"), ("/c", "new"), ("/c", "new")], "path string, raw string")
    index = ingest_texts(spark, more, folder)
    assert sorted(row["path"] for row in index.page.collect()) == ["/a", "/b", "/c"]
    assert sorted(row["content"] for row in index.fts.collect()) == ["new", "one", "two"]
    assert (index.n_pages, index.n_rows) == (3, 3)


def test_one_root_given_twice(spark, tree, tmp_path):
    folder, root = str(tmp_path / "catalogue"), str(tree[1])
    ingest_available(spark, [root, f"{root}/"], folder, str(tmp_path / "progress"))
    index = tables.load_index(spark, folder)
    assert (index.page.count(), index.fts.count(), index.n_rows) == (1, 1, 1)


@pytest.mark.parametrize("route", ["build", "stream"])
def test_every_page_file_once(spark, tmp_path, route):
    """Names that Spark hides, a folder like a partition, one root named twice, a file like a section."""
    root, folder = tmp_path / "root", str(tmp_path / "index")
    for name in ("_exit.2.gz", ".x.2.gz", "_a=b.2.gz", "read.2.gz"):
        put(root / "man2" / name, gzip.compress(name.encode()))
    put(root / "man2/k=v/deep.2.gz", gzip.compress(b"deep"))
    put(root / "man2/man3/deep.3.gz", gzip.compress(b"deep"))
    put(root / "man3/j=w/deep.3.gz", gzip.compress(b"deep"))
    put(root / "manual.gz", gzip.compress(b"manual"))
    put(root / "_man2/out.gz", gzip.compress(b"out"))
    roots = [str(root), f"{root}/"]
    for _ in range(2):
        if route == "build":
            index = build(spark, roots, folder)
        else:
            ingest_available(spark, roots, folder, str(tmp_path / "progress"))
            index = tables.load_index(spark, folder)
    wanted = sorted(f"{root}/man2/{name}" for name in ("_exit.2.gz", ".x.2.gz", "_a=b.2.gz", "read.2.gz"))
    assert sorted(r.path for r in index.page.select("path").collect()) == wanted
    texts = sorted(r.content.strip() for r in index.fts.select("content").collect())
    assert texts == sorted(("_exit.2.gz", ".x.2.gz", "_a=b.2.gz", "read.2.gz"))
    assert index.n_pages == index.n_rows == 4
