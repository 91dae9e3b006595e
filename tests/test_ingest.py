"""What the stream remembers, and how it reads what it has found."""

import gzip
import os
from pathlib import Path

import pytest

from contract.corpus import write_named_files
from leafscan.schemas import BUCKETS
from leafscan.sources import tables
from leafscan.sources.files import READERS
from leafscan.streaming import ingest
from leafscan.streaming.ingest import ingest_available


def put(path: Path, text: str, time: int = 1_000_000) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))
    os.utime(path, (time, time))


def names(spark, folder: str) -> list[str]:
    return sorted(row["name"] for row in tables.load_index(spark, folder).page.collect())


def last_job(spark) -> int:
    spark.sparkContext.setJobGroup("marker", "marker")
    spark.range(1).count()
    spark.sparkContext._jsc.clearJobGroup()
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup("marker"))


def test_tasks_do_not_grow_with_the_files(spark, tmp_path):
    """Spark lists each file that a stream of files has found in a task of its own."""
    for i in range(80):
        put(tmp_path / f"root/man{i % 2}/p{i}.1.gz", f"page {i}")
    tracker, first = spark.sparkContext.statusTracker(), last_job(spark)
    ingest_available(spark, [str(tmp_path / "root")], str(tmp_path / "index"), str(tmp_path / "progress"))
    jobs = map(tracker.getJobInfo, range(first + 1, last_job(spark)))
    stages = [tracker.getStageInfo(stage) for job in jobs if job for stage in job.stageIds]
    assert len(names(spark, str(tmp_path / "index"))) == 80
    assert max(stage.numTasks for stage in stages if stage) <= max(READERS * spark.sparkContext.defaultParallelism, BUCKETS) < 80


def test_found_files_wait_for_a_run_that_ends(spark, tmp_path, monkeypatch):
    """What a run that died has found is added by the next, but for what went meanwhile; once."""
    root, folder, progress = tmp_path / "root", str(tmp_path / "index"), str(tmp_path / "progress")
    for name in ("gone.1", "kept.1"):
        put(root / f"man1/{name}.gz", name)
    with monkeypatch.context() as broken:
        broken.setattr(ingest, "ingest_texts", None)
        with pytest.raises(Exception):
            ingest_available(spark, [str(root)], folder, progress)
    assert names(spark, folder) == []
    (root / "man1/gone.1.gz").unlink()
    put(root / "man1/late.1.gz", "late")
    for _ in range(2):
        ingest_available(spark, [str(root)], folder, progress)
        assert names(spark, folder) == ["kept.1", "late.1"]
    found = spark.read.parquet(f"{progress}/found")
    assert sorted(row["path"].rsplit("/")[-1] for row in found.collect()) == ["gone.1.gz", "kept.1.gz", "late.1.gz"]


def test_many_files_are_added_in_parts_oldest_first(spark, tmp_path):
    folder = str(tmp_path / "index")
    for i in range(5):
        put(tmp_path / f"root/man1/p{i}.1.gz", f"page {i}", 1_000_000 - i)
    ingest_available(spark, [str(tmp_path / "root")], folder, str(tmp_path / "progress"), max_files=2)
    parts = tables.load_index(spark, folder).page.select("batch", "name").collect()
    assert sorted((row["batch"], row["name"]) for row in parts) == [
        (1, "p3.1"), (1, "p4.1"), (2, "p1.1"), (2, "p2.1"), (3, "p0.1"),
    ]


def test_copies_below_sections_are_never_found(spark, tmp_path):
    """A stream of files holds the copies in deeper folders as well and reads their states with the others."""
    root, folder, progress = (str(tmp_path / name) for name in ("root", "index", "progress"))
    schema = "doc_id long, text string, lang string, source string"
    for start in (0, 12):
        rows = [(i, f"text {i}", "en", "s") for i in range(start, start + 12)]
        write_named_files(spark.createDataFrame(rows, schema), root)
        ingest_available(spark, [root], folder, progress)
    # those of 5 and 16 are damaged; 0, 1, 7, 8, 14, 15, 21 and 22 are hidden
    index = tables.load_index(spark, folder)
    assert (index.n_pages, index.n_dropped) == (22, 2)
    found = [row["path"] for row in spark.read.parquet(f"{progress}/found").collect()]
    assert sorted(int(path.rsplit("/")[-1].split(".")[0]) for path in found) == [i for i in range(24) if i % 7 > 1]


def test_old_files_are_left_out_after_the_first_run(spark, tmp_path):
    root, folder, progress = tmp_path / "root", str(tmp_path / "index"), str(tmp_path / "progress")
    put(root / "man1/old.1.gz", "old", 1_000_000)
    put(root / "man1/new.1.gz", "new", 2_000_000)
    ingest_available(spark, [str(root)], folder, progress, max_file_age="1h")
    put(root / "man1/older.1.gz", "older", 2_000_000 - 3601)
    put(root / "man1/young.1.gz", "young", 2_000_000 - 3600)
    ingest_available(spark, [str(root)], folder, progress, max_file_age="1h")
    assert names(spark, folder) == ["new.1", "old.1", "young.1"]


def test_stores_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    root, folder, progress = tmp_path / "root", str(tmp_path / "index"), str(tmp_path / "progress")
    for module in (ingest, ingest.hidden_files.__globals__):
        put_in = monkeypatch.setitem if isinstance(module, dict) else monkeypatch.setattr
        put_in(module, "by_store", lambda dirs: ([], dirs))
    put(root / "man1/one.1.gz", "one")
    put(root / "man1/_two.1.gz", "two")
    put(root / "man1/k=v/deep.1.gz", "deep")
    ingest_available(spark, [str(root)], folder, progress)
    put(root / "man2/late.1.gz", "late")
    for _ in range(2):
        ingest_available(spark, [str(root)], folder, progress)
    assert names(spark, folder) == ["_two.1", "late.1", "one.1"]
