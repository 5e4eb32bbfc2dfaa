"""Where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset in local mode (tests) a temporary one of our own.

    What is written there goes when the driver's program ends, as results may be read until then.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(clean)
    _written.append((spark, path))
    return path


def clean() -> None:
    """Delete all scratch tables that this program wrote: at its end, or before that when their results have been read."""
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended: the folder is left to its owner
            break
    _written.clear()
    if _local_root is not None:
        shutil.rmtree(_local_root.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let go of what long loops on the driver leave: shuffle files and broadcasts go when their owners are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
