"""Intermediate tables of the engine, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on a local master without that setting, below /tmp.
    It is deleted when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(root or 'file:///tmp/quantloom-checkpoints').rstrip('/')}/quantloom/{label}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.pop(path, None)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` and reads it back: same columns, no lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _cleanup() -> None:
    for path, spark in list(_MADE.items()):
        try:
            delete(spark, path)
        except Exception:  # the session is gone: the cluster's own cleaner takes the folder
            pass
