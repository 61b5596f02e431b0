"""Shared-folder tables that cut lineage between the stages of an operator.

Every executor and the driver must see these files, so they go below ``spark.checkpoint.dir``.
Where that setting is absent (tests on a local master) a folder below /tmp is used instead.
"""

from __future__ import annotations

import atexit
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS, _DEFAULT_ROWS, FEW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
_MADE: dict[str, SparkSession] = {}
_LOCK = threading.Lock()
_WRITES: dict[int, list] = {}  # by session: running writes, the setting before the first


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/quantloom-checkpoints"


class Workspace:
    """A fresh folder for one call of an operator. Tables are plain Parquet, so a lost executor
    costs nothing that is already written. A lazy result may read them: call ``close`` (or leave the
    ``with`` block) after the result is written; else the folder goes when the process ends.

    Texts are long rows: where the session has Spark's default of 10,000 rows an Arrow batch, it is
    set to 1,000, for a worker and its JVM hold several batches at a time.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/quantloom/{label}-{uuid.uuid4().hex}"
        self.n = 0
        _MADE[self.path] = spark
        if spark.conf.get(_ROWS) == _DEFAULT_ROWS:
            spark.conf.set(_ROWS, FEW_ROWS)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back (same columns, no lineage).

        Spark removes the write's shuffle files when it ends, since nothing can read them again;
        else they stay on the executors until the driver's garbage collector meets their plan.
        """
        self.n += 1
        at = f"{self.path}/{self.n:02d}-{name}"
        conf, own = self.spark.conf, id(self.spark)
        with _LOCK:  # the first of several writes at a time sets it, the last one puts it back
            running = _WRITES.setdefault(own, [0, conf.get(_CLEANUP, "false")])
            running[0] += 1
            conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(at)
        finally:
            with _LOCK:
                running[0] -= 1
                if not running[0]:
                    conf.set(_CLEANUP, running[1])
                    del _WRITES[own]
        return self.spark.read.schema(df.schema).parquet(at)

    def close(self) -> None:
        if _MADE.pop(self.path, None):
            _delete(self.spark, self.path)


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows of the driver as a DataFrame. They go by Arrow: a list would start Python workers on
    the executors only to pickle it."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for path, spark in _MADE.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the cluster's own cleaner takes the folder
            pass
