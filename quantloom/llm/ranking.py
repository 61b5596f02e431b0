"""Ranks within groups when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_within(df: DataFrame, keys: list[str], count: str, order: list[Column], *, split_rows: int = 50_000, out: str = "rank", place: str | None = None) -> DataFrame:
    """Adds the rank from 0 of every row within its group, in an order that depends on ``order`` only.

    ``count`` names a column with the size of the row's group. A group above ``split_rows`` is cut
    by hash into parts of about that size; parts are ranked apart and shifted by the rows of the
    parts before, so no task sorts a whole hot group: rows are dealt by group and part, whatever
    dealt them before. The order is by part, then by ``order``. Rows that agree in ``order`` rank in
    any order among themselves. ``place`` names a column that tells rows apart: a part that is still
    above twice its size, since its rows agree in ``order``, is cut further by it.
    """
    parts = F.ceil(F.col(count) / F.lit(split_rows)).cast("int")
    df = df.withColumn("_part", F.when(F.col(count) > split_rows, F.pmod(F.xxhash64(F.lit("part"), *order), parts)).otherwise(F.lit(0)).cast("int"))
    if place:
        whole = df.where(F.col(count) > split_rows).groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_whole")).where(F.col("_whole") > 2 * split_rows)
        cut = F.pmod(F.xxhash64(F.lit("place"), place), F.ceil(F.col("_whole") / F.lit(split_rows)).cast("int"))
        # parts of parts follow one another: a part's number is multiplied by more than any number of cuts
        df = df.join(whole, [*keys, "_part"], "left").withColumn("_part", F.col("_part").cast("long") * F.lit(1 << 31) + F.coalesce(cut, F.lit(0))).drop("_whole")
    sizes = df.where(F.col(count) > split_rows).groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    ranked = df.repartition(*keys, "_part").withColumn("_own", own).join(shift, [*keys, "_part"], "left")
    return ranked.withColumn(out, (F.col("_own") + F.coalesce("_shift", F.lit(0))).cast("long")).drop("_own", "_shift", "_part")
