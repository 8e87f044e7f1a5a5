"""Lineage cuts that survive the loss of executors.

Everything goes to the folder that the cluster names in ``spark.checkpoint.dir``.
A folder of our own is set only in a local session that names none (tests); a cluster without
one is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skarn-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; the result no longer depends on its inputs.

    A written table has its real size: a checkpoint keeps the estimate of the plan behind it, which
    multiplies over joins and rounds until planning itself takes minutes.
    """
    return cut_to(df)[0]


def cut_to(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, with the folder, for tables that are discarded before the end."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sweep(spark: SparkSession) -> None:
    """Shuffle files of frames that nothing refers to go now, and not when the driver next runs short of memory."""
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``shared_path`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
