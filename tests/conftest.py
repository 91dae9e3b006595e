import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_index(spark, tmp_path_factory):
    """A catalogue of made-up pages that covers the golden rows and the edge cases."""
    from leafscan.plans.build import ingest_texts
    from leafscan.sources.tables import ensure_tables

    from tests.pages import GOLDEN_PAGES

    folder = str(tmp_path_factory.mktemp("index"))
    ensure_tables(spark, folder)
    pages = spark.createDataFrame(GOLDEN_PAGES, "path string, raw string")
    return ingest_texts(spark, pages, folder)
