"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product. Vectors scaled to norm at most 1 get one more component
sqrt(1 - |x|^2), queries are unit vectors with a zero there; Euclidean order is then inner-product
order, and the p-stable hash floor((a.x + b) / w) with Gaussian a applies. Each table has
``hashes`` such functions. A query visits its own bucket and perturbed ones of each table (offsets
-1, 0, 1) in estimated success order: ascending sum of squared distances to the crossed borders.
Candidates of all tables are merged and reranked by exact inner products in double precision.

How far a query goes is estimated twice. A first look at ``first`` buckets of one table gives it an
upper bound of its k-th distance d. A point that near moves by N(0, (d / w)^2) in each function, so
its bucket's score exceeds (d / w)^2 times a quantile of chi-squared with chance ``miss`` in each
table. The query stops there, and at its ``probes`` first buckets in any case. Where neighbours are
much nearer than other points few buckets are left; without such structure the budget decides.

Within a region a query names its perturbed buckets in success order and looks them up, so what it costs
there does not grow with the number of buckets. Only points of visited buckets are multiplied with the query, each once: what an earlier table or
the first look has met is left out by its buckets there, before any product.

Work is dealt by region, the first two hash values of a table, so a query goes to at most nine
regions of a table; a region above ``region_rows`` points is split and its queries are sent to all
parts. Equal vectors are one point that carries its smallest ``k`` + 1 ids, which is all that any
answer can use, and equal queries are searched once; hot vectors cost one point.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part;
vectors meet only vectors of their own dimension; with fewer candidates than k a query returns all
that it finds; ties go to the smaller id; null ids take no part; rows that repeat an id with equal
vectors are one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.textnp import lean
from quantloom.llm.workspace import Workspace

TABLES, HASHES, WIDTH, PROBES = 2, 8, 2.2, 1000
FIRST, MISS = 6, 0.1
REGION_ROWS = 20_000


def _functions(dim: int, table: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, table])
    return rng.normal(size=(dim + 1, hashes)), rng.uniform(0, width, hashes)


def hashed(x: np.ndarray, table: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """Real-valued hash positions of augmented vectors; their floor is the bucket."""
    a, b = _functions(x.shape[1] - 1, table, hashes, width, seed)
    return (x @ a + b) / width


def thresholds(z: np.ndarray, probes: int) -> np.ndarray:
    """The largest perturbation score among the ``probes`` first in success order."""
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=z.shape[1])), np.int8)
    f = z - np.floor(z)
    low, high = (steps == -1).astype(float), (steps == 1).astype(float)
    out = np.empty(len(z))
    probes = min(probes, len(steps))
    for s in range(0, len(z), 64):
        score = f[s : s + 64] ** 2 @ low.T + (1 - f[s : s + 64]) ** 2 @ high.T
        out[s : s + 64] = np.partition(score, probes - 1, axis=1)[:, probes - 1]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def costs(names: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Perturbation scores (queries x buckets) of buckets, infinite beyond one step in a function."""
    base = np.floor(z)
    f = z - base
    step = names[None, :, :] - base.astype(np.int32)[:, None, :]
    return np.where(step == -1, f[:, None, :] ** 2, np.where(step == 1, (1 - f[:, None, :]) ** 2, np.where(step == 0, 0.0, np.inf))).sum(2)


class Buckets:
    """The buckets of a part of a region, found by their coordinates: points of a bucket are in a row.

    A query's perturbed buckets are named in success order and looked up, at most 3^(hashes - 2) of them in
    a region, so a query costs the same whatever the number of buckets; where there are fewer buckets than
    that, these are scored instead."""

    def __init__(self, z: np.ndarray):
        names, which = np.unique(z, axis=0, return_inverse=True)
        self.order = np.argsort(which.ravel(), kind="stable")
        self.edge = np.searchsorted(which.ravel()[self.order], np.arange(len(names) + 1))
        self.steps = np.array(list(itertools.product((-1, 0, 1), repeat=z.shape[1] - 2)), np.int32)
        self.low, self.high = (self.steps == -1).astype(float), (self.steps == 1).astype(float)
        self.names = names
        code = self._code(names[:, 2:])
        self.by = np.argsort(code)
        self.codes = code[self.by]

    @staticmethod
    def _code(x: np.ndarray) -> np.ndarray:
        """Coordinates as a number; different ones may share it, so names are compared."""
        out = np.zeros(len(x), np.uint64)
        for j in range(x.shape[1]):
            out = (out ^ x[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def scores(self, z: np.ndarray) -> np.ndarray:
        """Perturbation scores of queries: of their possible buckets here, or of all buckets."""
        if len(self.names) <= len(self.steps):
            return costs(self.names, z)
        base = np.floor(z)
        f = z - base
        first = self.names[0, :2] - base[:, :2]
        start = np.where(first == -1, f[:, :2] ** 2, np.where(first == 1, (1 - f[:, :2]) ** 2, np.where(first == 0, 0.0, np.inf))).sum(1)
        return start[:, None] + f[:, 2:] ** 2 @ self.low.T + (1 - f[:, 2:]) ** 2 @ self.high.T

    def points(self, z: np.ndarray, score: np.ndarray, most: float, seen: float) -> np.ndarray:
        """The points of a query's buckets with scores above ``seen`` up to ``most``, in success order."""
        at = np.flatnonzero((score <= most + SLACK) & (score > seen - SLACK))
        at = at[np.argsort(score[at], kind="stable")]
        if len(self.names) > len(self.steps):
            wanted = np.floor(z[2:]).astype(np.int32) + self.steps[at]
            code = self._code(wanted)
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            here = np.flatnonzero(self.codes[place] == code)
            at = self.by[place[here]]
            at = at[(self.names[at, 2:] == wanted[here]).all(1)]
        many = self.edge[at + 1] - self.edge[at]
        upto = np.cumsum(many) - many
        return self.order[np.repeat(self.edge[at] - upto, many) + np.arange(many.sum())]


#: Scores are worked out in two ways; buckets at a bound by so little are visited rather than left out.
SLACK = 1e-9


def chi_squared(dof: int, tail: float) -> float:
    """The value that chi-squared exceeds with chance ``tail`` (Wilson and Hilferty)."""
    z = NormalDist().inv_cdf(1 - tail)
    return dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3


def nearest(table: DataFrame, *, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH,
            probes: int = PROBES, first: int = FIRST, miss: float = MISS, region_rows: int = REGION_ROWS, seed: int = 11, with_work: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every row where ``is_query``.

    With ``with_work`` instead: qid, looked (inner products worked out), scored (bucket scores worked out),
    one row per distinct query."""
    spark = table.sparkSession
    ws = Workspace(spark, "neighbours")
    v = F.col(vector).cast("array<double>")
    sound = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(sound).select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), is_query.alias("q")).distinct()
    rows = rows.withColumn("vh", F.xxhash64("v"))
    rank = F.row_number().over(Window.partitionBy("vh", "v").orderBy("id"))
    few = rows.select("vh", "v", "id").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    points = ws.save(few.groupBy("vh", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", F.size("v").alias("dim"), "ids"), "points")
    norms = {r["dim"]: r["m"] for r in points.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("m")).collect()}
    asked = ws.save(rows.where("q").groupBy("vh", "v").agg(F.min("id").alias("qid")).select("v", F.size("v").alias("dim"), "qid"), "asked")
    far = chi_squared(hashes, miss)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                x = _matrix(own.column("v")) / norms[int(d)]
                x = np.hstack([x, np.sqrt(np.clip(1 - (x * x).sum(1, keepdims=True), 0, None))])
                z = np.stack([np.floor(hashed(x, t, hashes, width, seed)).astype(np.int32) for t in range(tables)], 1)
                buckets = pa.array([r.tobytes() for r in z], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(np.full(len(z), t, np.int32)), pa.array(z[:, t, 0].copy()), pa.array(z[:, t, 1].copy()), buckets, own.column("v"), own.column("ids")], names=["dim", "t", "c0", "c1", "buckets", "v", "ids"])

    region = ["dim", "t", "c0", "c1"]
    placed = ws.save(points.mapInArrow(lean(place), "dim int, t int, c0 int, c1 int, buckets binary, v array<double>, ids array<long>"), "placed")
    parts = ws.save(placed.groupBy(*region).agg(F.ceil(F.count(F.lit(1)) / region_rows).cast("int").alias("parts")), "regions")

    def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(column)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.hstack([x / n, np.zeros((len(x), 1))]), n[:, 0]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to their regions, with the largest score that they visit in each table (``most``),
        and the largest that their first look has visited in table 0 (``seen``)."""
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                q, length = unit(own.column("v"))
                kth = own.column("kth").to_numpy(zero_copy_only=False).astype(float)
                again = bool(own.column("again")[0].as_py())
                z = [hashed(q, t, hashes, width, seed) for t in range(tables if again else 1)]
                most = np.stack([thresholds(x, probes if again else first) for x in z], 1)
                seen = thresholds(z[0], first) if again else np.full(len(q), -1.0)
                if again:
                    gap = np.clip(2 - 2 * kth / (norms[int(d)] * length), 0, None)  # squared distance of what is k-th so far
                    most = np.fmin(most, (gap / width**2 * far)[:, None])
                for t, x in enumerate(z):
                    base = np.floor(x).astype(np.int32)
                    for s0, s1 in itertools.product((-1, 0, 1), repeat=2):
                        at = base[:, :2] + np.array([s0, s1], np.int32)
                        f = x[:, :2] - base[:, :2]
                        go = sum({-1: f[:, j] ** 2, 0: 0 * f[:, j], 1: (1 - f[:, j]) ** 2}[s] for j, s in enumerate((s0, s1))) <= most[:, t]
                        if go.any():
                            keep = pa.array(go)
                            yield pa.RecordBatch.from_arrays([own.column("dim").filter(keep), pa.array(np.full(int(go.sum()), t, np.int32)), pa.array(at[go, 0].copy()), pa.array(at[go, 1].copy()), own.column("qid").filter(keep), own.column("v").filter(keep), pa.array([r.tobytes() for r in most[go]], pa.binary()), pa.array(seen[go])], names=[*region, "qid", "v", "most", "seen"])

    cell = [*region, "part"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pend, index = None, [], None

        def build(t: int) -> tuple:
            vec = np.concatenate([_matrix(b.column("v")) for b in pend])
            z = np.stack([np.frombuffer(x, np.int32) for b in pend for x in b.column("buckets").to_pylist()]).reshape(len(vec), tables, hashes)
            ids = [x for b in pend for x in b.column("ids").to_pylist()]
            return vec, Buckets(z[:, t]), z, ids, np.array([x[0] for x in ids])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in [*cell, "kind"]])
            edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(edge[:-1], edge[1:]):
                key, kind, run = tuple(keys[:-1, s]), keys[-1, s], b.slice(s, e - s)
                if key != here:
                    here, pend, index = key, [], None
                if kind == 0:
                    pend.append(run)
                    continue
                if not pend:
                    continue
                t = int(key[1])
                index = index or build(t)
                vec, buckets, z, ids, least = index
                each = 128
                for at in range(0, run.num_rows, each):
                    part = run.slice(at, each)
                    q, seen = _matrix(part.column("v")), part.column("seen").to_numpy()
                    most = [np.frombuffer(x, float) for x in part.column("most").to_pylist()]
                    own = [hashed(unit(part.column("v"))[0], j, hashes, width, seed) for j in range(t + 1)]
                    cost = buckets.scores(own[t])
                    qs, found, scores, looked, scored = [], [], [], [], []
                    for i, qid in enumerate(part.column("qid").to_pylist()):
                        c = buckets.points(own[t][i], cost[i], most[i][t], seen[i] if t == 0 else -np.inf)
                        for j in range(t):  # met in an earlier table, or in the first look
                            c = c[costs(z[c, j], own[j][i : i + 1])[0] > max(most[i][j], seen[i] if j == 0 else -1.0) - SLACK]
                        if with_work:
                            qs.append(qid)
                            found.append([])
                            scores.append(None)
                            looked.append(len(c))
                            scored.append(cost.shape[1])
                        if not len(c):
                            continue
                        dots = vec[c] @ q[i]
                        if len(c) > k + 8:  # equal values at the border are all looked at
                            edge_at = np.partition(dots, len(c) - k - 1)[len(c) - k - 1]
                            c = c[dots >= edge_at - 1e-9 * max(1.0, abs(edge_at))]
                        exact = (vec[c] * q[i]).sum(1)
                        for j in np.lexsort((least[c], -exact))[: k + 1]:
                            qs.append(qid)
                            found.append(ids[c[j]])
                            scores.append(float(exact[j]))
                            looked.append(0)
                            scored.append(0)
                    yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.float64()), pa.array(looked, pa.int64()), pa.array(scored, pa.int64())], names=["qid", "ids", "score", "looked", "scored"])

    def look(queries: DataFrame, own: DataFrame, name: str) -> DataFrame:
        routed = queries.select("dim", "v", "qid", "kth", "again").mapInArrow(lean(route), "dim int, t int, c0 int, c1 int, qid long, v array<double>, most binary, seen double")
        left = own.join(parts, region).select(*region, F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "buckets", "ids", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("binary").alias("most"), F.lit(None).cast("double").alias("seen"), "v")
        right = routed.join(parts, region).select(*region, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("buckets"), F.lit(None).cast("array<long>").alias("ids"), "qid", "most", "seen", "v")
        cols = [*cell, "kind", "buckets", "ids", "qid", "most", "seen", "v"]
        dealt = left.select(*cols).unionAll(right.select(*cols)).repartition(*cell).sortWithinPartitions(*cell, "kind")
        return ws.save(dealt.mapInArrow(lean(search), "qid long, ids array<long>, score double, looked long, scored long"), name)

    start = look(asked.withColumns({"kth": F.lit(None).cast("double"), "again": F.lit(False)}), placed.where("t = 0"), "first-look")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    kth = start.where("score IS NOT NULL").withColumn("r", order).where(F.col("r") == k + 1).select("qid", F.col("score").alias("kth"))  # the query's own vector is among them
    got = start.unionAll(look(asked.join(kth, "qid", "left").withColumn("again", F.lit(True)), placed, "found"))
    if with_work:
        return got.groupBy("qid").agg(F.sum("looked").alias("looked"), F.sum("scored").alias("scored"))
    got = got.groupBy("qid", F.col("ids")[0].alias("pid")).agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pid"))
    top = got.withColumn("r", best).where(F.col("r") <= k + 1).select("qid", "score", F.explode("ids").alias("vec_id"))
    top = ws.save(top.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).select("qid", "score", "vec_id"), "top")
    asks = rows.where("q").select("id", "v", "vh").join(asked.withColumn("vh", F.xxhash64("v")).withColumnRenamed("v", "qv"), "vh").where(F.col("v") == F.col("qv")).select(F.col("id").alias("query_id"), "qid").distinct()
    final = asks.join(top, "qid").where("query_id <> vec_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), is_query=F.col("vec_id") % 20 == 0, k=20)
