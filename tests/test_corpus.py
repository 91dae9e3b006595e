import gzip
from pathlib import Path

from contract.corpus import write_named_files, write_page_files
from leafscan.sources.files import READERS, discover, hidden_files

SCHEMA = "doc_id long, text string, lang string, source string"
ROWS = [(1, "one\nmore", "en", "s"), (1, "one\nmore", "en", "s"), (9, "nine", None, "s"), (None, "none", "en", "s"), (2, None, "en", "s")]


def written(root: Path) -> list[tuple[str, str]]:
    """Folder and text of every file; whatever else lies there would not be gzip."""
    files = (path for path in root.rglob("*") if path.is_file())
    return sorted((path.parent.name, gzip.decompress(path.read_bytes()).decode()) for path in files)


def test_page_files_come_from_tasks_alone(spark, tmp_path):
    """A file for each row, equal rows and nulls included, nothing beside, and the same again."""
    documents, root = spark.createDataFrame(ROWS, SCHEMA), tmp_path / "root"
    write_page_files(documents, f"file://{root}")
    found = written(root)
    assert [folder for folder, _ in found] == ["man=2", "man=2", "man=2", "man=3", "man=__HIVE_DEFAULT_PARTITION__"]
    one = "en(1)\n\nNAME\n       s.1 - one\n\nDESCRIPTION\none\nmore\n"
    assert [text for _, text in found] == ["\n", one, one, "\n", "\n"]
    write_page_files(documents, f"file://{root}")
    assert written(root) == found
    assert discover(spark, [str(root)]).count() == len(ROWS)


def test_named_files(spark, tmp_path):
    write_named_files(spark.createDataFrame([(3, "three", "en", "s"), (4, None, "en", "s")], SCHEMA), str(tmp_path))
    names = sorted(path.relative_to(tmp_path).as_posix() for path in tmp_path.rglob("*gz"))
    assert names == ["man4/3.4.gz", "man4/k=v/3.4.gz"]


def test_driver_lists_no_files(spark, tmp_path, monkeypatch):
    """Files of stores that tasks can open never come to the driver, hidden ones included."""
    rows = [(i, f"text {i}", "en", "s") for i in range(40)]
    write_named_files(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    monkeypatch.setattr("leafscan.sources.files._opened", None)
    found = discover(spark, [str(tmp_path), f"{tmp_path}/", "/absent"])
    assert found.select("path").distinct().count() == found.count() == len(rows)
    assert not found.select("path").inputFiles()
    assert found.rdd.getNumPartitions() <= READERS * spark.sparkContext.defaultParallelism
    assert hidden_files(spark, [str(tmp_path)]).count() == sum(i % 7 < 2 for i in range(40))
    assert found.where("octet_length(content) <> length").count() == 0
