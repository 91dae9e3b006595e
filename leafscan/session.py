"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a job on many small page files wants. Python workers get batches bounded
# in rows, and a task reads hundreds of small files instead of thirty.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster
    a missing setting is an error, because executors cannot see the driver's disk.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="leafscan-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


def spread(df: DataFrame, key: str, by_range: bool = False) -> DataFrame:
    """At least a partition for each core; only a scan of few files is redistributed, on
    request so that neighbours by the key stay together."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartitionByRange(cores, key) if by_range else df.repartition(cores, key)
