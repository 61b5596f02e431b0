"""Sinks that a restart does not write to twice.

Every micro-batch has a folder of its own, named by its number and replaced as a whole, so a batch that runs
again after a failure leaves one copy. Rows are versions of a key; readers take the latest one, and
``compact`` folds finished batches into one table of latest rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quantloom.sources.scratch import delete, exists

KEY = ("symbol", "ts", "seq")


@dataclass(frozen=True)
class UpsertSink:
    """A folder of Parquet batches keyed by ``key``; of equal keys the row of the latest batch counts, within
    a batch the last by ``order`` (a column that tells versions apart), or any if they are equal."""

    path: str
    key: tuple[str, ...] = KEY
    order: str | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Writes a micro-batch; a function for ``foreachBatch``."""
        base = self._base(batch.sparkSession)
        if number <= base:  # it is part of the compacted table already
            return
        self._latest(batch, []).write.mode("overwrite").parquet(f"{self.path}/batch={number:012d}")

    def start(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _latest(self, rows: DataFrame, first: list) -> DataFrame:
        by = [*first, *([F.col(self.order).desc_nulls_last()] if self.order else [])]
        if not by:
            return rows.dropDuplicates(list(self.key))
        w = Window.partitionBy(*self.key).orderBy(*by)
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def _finished(self, spark: SparkSession) -> list[int]:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and exists(spark, f"{self.path}/{n}/_SUCCESS"))

    def _base(self, spark: SparkSession) -> int:
        """The last batch of the newest compacted table, -1 without one."""
        found = [int(n.removeprefix("base=")) for n in self._bases(spark)]
        return max(found, default=-1)

    def _bases(self, spark: SparkSession) -> list[str]:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return [n for n in names if n.startswith("base=") and exists(spark, f"{self.path}/{n}/_SUCCESS")]

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row of every key, over all finished batches."""
        base = self._base(spark)
        parts = [(-1, f"{self.path}/base={base:012d}")] if base >= 0 else []
        parts += [(n, f"{self.path}/batch={n:012d}") for n in self._finished(spark) if n > base]
        if not parts:
            raise ValueError("nothing has been written yet")
        rows = None
        for n, at in parts:
            own = spark.read.parquet(at).withColumn("__batch", F.lit(n))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        return self._latest(rows, [F.col("__batch").desc()]).drop("__batch")

    def compact(self, spark: SparkSession) -> None:
        """Folds all finished batches into one table, and then deletes them. Batches with these numbers that
        come again are ignored. A reader that has started before must have ended."""
        done, was = self._finished(spark), self._bases(spark)
        if not done:
            return
        self.read(spark).write.mode("overwrite").parquet(f"{self.path}/base={done[-1]:012d}")
        for n in done:
            delete(spark, f"{self.path}/batch={n:012d}")
        for n in was:
            if n != f"base={done[-1]:012d}":
                delete(spark, f"{self.path}/{n}")
