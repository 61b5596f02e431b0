"""Mixing sources to target weights by subset-sum budget fitting.

Every document is available ``most_epochs`` times. How many copies of each exact document size are
taken is fitted on the histogram of sizes: an even share of every size first, then large leftovers
until the open budget is small, then bounded-knapsack dynamic programming for the rest. Documents
of one size are interchangeable for the budget: all get the whole part of copies / documents, and
a seeded hash selects those that get one more.

Defined results: null text has size 0; documents of size 0 take no words; null is a source of its
own and sorts last; a table without words gets targets of 0; repeated rows are separate documents
of one size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.ranking import rank_within
from quantloom.llm.workspace import Workspace, small_table

#: Up to so many sources the driver works out the targets; more are shared out on Spark.
DRIVER_SOURCES = 100_000
#: Open budget left to the dynamic programme; what is above it goes to whole documents first.
DP_BUDGET = 1 << 16
#: Up to so many (source, size) counts are broadcast; more meet the documents in a join.
BROADCAST_COUNTS = 200_000


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: Sequence[float]) -> list[float]:
    """Shares of ``budget`` by weight, each at most ``most``; the excess is reshared by weight."""
    n = len(sizes)
    out, free, left = [0.0] * n, list(range(n)), float(budget)
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total > most[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most[i])
        left -= sum(most[i] for i in full)
        free = [i for i in free if i not in full]
    return out


def targets_on_spark(ws: Workspace, totals: DataFrame, weights: Sequence[float], share: float, most_epochs: int) -> DataFrame:
    """As ``targets`` for a table (skey, t) of any length: the sources are numbered in their order by
    range, and each round that fills some of them is an aggregate."""
    spark = totals.sparkSession
    ranged = ws.save(totals.withColumn("late", F.col("skey") == "n").repartitionByRange("late", "skey").withColumn("p", F.spark_partition_id()), "sources")
    within = F.row_number().over(Window.partitionBy("p").orderBy("late", "skey")) - 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    starts = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", before.alias("start"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights)).cast("int"))
    rows = ranged.withColumn("own", within).join(F.broadcast(starts), "p").withColumn("i", F.col("own") + F.col("start"))
    rows = ws.save(rows.select("skey", "t", weight.alias("w"), (F.col("t") * most_epochs).cast("double").alias("most")), "sources")
    left = share * (rows.agg(F.sum("t")).first()[0] or 0)
    level, full = F.lit(0.0), F.lit(False)
    while True:
        total = rows.where(~full).agg(F.sum("w")).first()[0]
        if total is None:
            break
        level = F.lit(float(left)) * F.col("w") / F.lit(float(total))
        more = ~full & (level > F.col("most"))
        filled = rows.where(more).agg(F.sum("most")).first()[0]
        if filled is None:
            break
        left -= filled
        rows = ws.save(rows.withColumn("done", full | more), "sources")
        full = F.col("done")
    return rows.select("skey", F.col("t").alias("source_size"), F.when(full, F.col("most")).otherwise(level).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to ``budget`` or just below."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    take = (counts * float(budget) / total).astype(np.int64)
    while (over := int((take * sizes).sum()) - budget) > 0:  # only by rounding of the division
        i = int(np.argmax(take > 0))
        take[i] -= min(take[i], -(-over // int(sizes[i])))
    left, rest = counts - take, budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= dp_budget:
            break
        n = min(int(left[i]), (rest - dp_budget // 2) // int(sizes[i]))
        if n > 0:
            take[i] += n
            left[i] -= n
            rest -= n * int(sizes[i])
    if rest <= 0:
        return take
    # items: binary parts of every size's leftover count
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    by = np.full(rest + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        n, part = int(min(left[i], rest // max(int(sizes[i]), 1))), 1
        while n > 0 and not reach[rest]:
            part = min(part, n)
            w = part * int(sizes[i])
            if w <= rest:
                new = np.flatnonzero(reach[: rest + 1 - w] & ~reach[w:]) + w
                reach[new] = True
                by[new] = len(items)
                items.append((int(i), part))
            n -= part
            part *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        i, part = items[by[at]]
        take[i] += part
        at -= part * int(sizes[i])
    return take


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                most_epochs: int = 2, seed: int = 0, split_rows: int = 50_000, carry: bool = False, driver_sources: int = DRIVER_SOURCES, broadcast_counts: int = BROADCAST_COUNTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    With ``carry`` also row: the input row with all its columns, whatever their names. Documents are
    then chosen by a hash of the whole row, so ids may be null or repeat.

    Weights are dealt to the sources in code-point order, repeating. Words are counted once; the
    counts (id, source, size) are written, and only they are shuffled: rows meet the fitted counts by
    broadcast, or in a join whose hot groups are split, and rank by hash in parts of hot groups.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "mixing")
    skey = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = docs.select(F.col(doc_id).alias("doc_id"), skey.alias("skey"), size.alias("size"), *([F.struct(*docs.columns).alias("row")] if carry else []), F.monotonically_increasing_id().alias("place"))
    if not carry:
        base = ws.save(base, "sizes")
    hist = ws.save(base.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    by_source = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("t"))
    totals = by_source.limit(driver_sources + 1).collect()
    if len(totals) > driver_sources:
        plan = targets_on_spark(ws, by_source, weights, share, most_epochs)
    else:
        totals = sorted(((r["skey"], int(r["t"])) for r in totals), key=lambda x: (x[0] == "n", x[0]))
        sizes = [t for _, t in totals]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share * sum(sizes), [most_epochs * t for t in sizes])
        plan = small_table(spark, [(k, t, g) for (k, t), g in zip(totals, goal)], pa.schema([("skey", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())]))

    def fit(key, pdf):
        pdf = pdf.sort_values("size", ignore_index=True)
        copies = pdf["n"].to_numpy() * most_epochs
        pdf["copies"] = fit_counts(pdf["size"].to_numpy(), copies, round(float(pdf.target.iloc[0])))
        return pdf[["skey", "size", "n", "source_size", "target", "copies"]]

    fitted = ws.save(hist.join(plan, "skey").groupBy("skey").applyInPandas(fit, "skey string, size long, n long, source_size long, target double, copies long"), "fitted")
    if fitted.count() <= broadcast_counts:
        fitted = F.broadcast(fitted)
    own = F.xxhash64(F.lit(seed), F.col("doc_id"), *([F.to_json("row", {"ignoreNullFields": "false"})] if carry else []))
    order = [own, F.col("doc_id")]
    ranked = rank_within(base.join(fitted, ["skey", "size"]), ["skey", "size"], "n", order, split_rows=split_rows, place="place")
    taken = (F.floor(F.col("copies") / F.col("n")) + (F.col("rank") < F.col("copies") % F.col("n")).cast("long")) * F.col("size")
    return ranked.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else []))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
