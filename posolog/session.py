"""Session settings the plans are written for, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffle partitions, switches join strategies on
# measured sizes and splits partitions that one key dominates.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def well_spread(scan: DataFrame) -> DataFrame:
    """Spread a file scan that has fewer splits than the session has cores.

    Costly text rules would otherwise run in one task when a small table lies in
    one file.  A scan of many splits is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can reach.

    A temporary folder stands in only where the setting is absent and the master
    is local, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="posolog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table that several later plans read, and continue from the copy.

    The copy is columnar, cuts the lineage and outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/posolog-tables/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(_reordered(df, partition_by)).parquet(path).select(*df.columns)


def _reordered(df: DataFrame, last: Sequence[str]):
    columns = [c for c in df.columns if c not in last] + list(last)
    return df.select(*columns).schema
