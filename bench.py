"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from contract.corpus import catalogue, catalogue_folder  # noqa: E402
from contract.queries import REGISTRY  # noqa: E402
from leafscan.sources.tables import footprint  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "count_pages list_pages aligned_listing describe_pages plain_pages glob_content regex_content "
    "pages_joined postings gram_df candidates bm25_search two_block_search common_search "
    "wildcard_search short_search regex_search regex_hostile regex_index_search batch_search param_search"
).split()


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    settings = {
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": CPUS,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        # pieces of a local job are small: keep all cores busy
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    start = time.perf_counter()
    index = catalogue(spark, SF_DIR)
    seconds = {"build_index": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            REGISTRY[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    line = {
        "metric": "total_seconds",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "rows": index.n_rows,
        "stored_to_raw": round(footprint(spark, catalogue_folder(spark, SF_DIR)).first()["ratio"], 3),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
