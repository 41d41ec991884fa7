"""Tables of one scale directory, and the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) under ``sf_dir``."""
    return spark.read.parquet(table_path(sf_dir, name))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; only where neither that setting nor a checkpoint folder exists
    (a single-machine test session) a temporary one is made. On a cluster that is an error, as driver and executors would
    each see a folder of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="convoy-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """A table as read, in at least as many partitions as there are cores, for work that takes long per row.

    Only a table of fewer files and row groups than cores is shuffled; a large one is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch(spark: SparkSession, what: str) -> str:
    """A path nobody else uses, in the shared folder."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def size_on_disk(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder; 0 if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength() if system.exists(target) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; missing paths are fine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
