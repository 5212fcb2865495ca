"""Written intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset (tests, a laptop) a temporary folder is made
once for the session and set as its checkpoint folder; a cluster has to name its own, and it is an error if it doesn't.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kinetiq-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and nothing above is computed twice."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinetiq_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; only for tables that no later plan reads."""
    path = getattr(df, "_kinetiq_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; it does so when they are collected."""
    gc.collect()
    spark._jvm.System.gc()


def releasing(run):
    """A function for ``mapInArrow`` that gives Arrow's spare memory back when a task ends; workers outlive their tasks."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task
