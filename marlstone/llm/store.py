"""Intermediate tables in the folder that all executors share.

The folder is the one that ``spark.checkpoint.dir`` names.  Where that is unset
(local tests), a temporary folder is set as the checkpoint folder; a cluster
must set its own, since a machine-local folder would not be seen by others.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.functions.batches import bounded_batches, trimmed  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URL, read from the session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and return it as read from there.

    Later steps then depend on the files alone, so a lost executor costs no
    recomputation.  The shuffle files of the finished lineage are released.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    schema = df.schema
    del df, w
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table_bytes(df: DataFrame) -> int:
    """Size of a written table's files, for the check before a broadcast."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    total = 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total
