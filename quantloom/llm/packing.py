"""Packing into fixed-length sequences, shortest pack first over the length histogram.

Documents are cut into whole sequences and one remainder. Remainder lengths are placed longest
first, each into the shortest pack that has room for it, working on counts of equal packs
(patterns) instead of documents, so planning costs the same at any corpus size. Patterns return to
documents by rank within a length.

Defined results: null or empty text is the single end id; repeated rows are packed as rows of
their own; texts of any length are cut; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.ranking import rank_within
from quantloom.llm.textnp import chunks, lean
from quantloom.llm.tokens import default_tokenizer, encoder
from quantloom.llm.workspace import Workspace, small_table

#: Lengths that share one sequence, as runs (length, how many) in the order in which they are placed.
Pattern = tuple[tuple[int, int], ...]


def plan_patterns(hist: dict[int, int], size: int) -> dict[Pattern, int]:
    """How often each pattern occurs. A length ends with at most two patterns more than there were
    before it, so there are at most 2 * size of them, each of at most sqrt(2 * size) runs."""
    by_used: dict[int, dict[Pattern, int]] = defaultdict(dict)
    done: dict[Pattern, int] = defaultdict(int)

    def put(p: Pattern, n: int, used: int) -> None:
        if used == size:
            done[p] += n
        else:
            by_used[used][p] = by_used[used].get(p, 0) + n

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left > 0:
            used = min((u for u, ps in by_used.items() if ps), default=size)
            if used + length > size:
                each = 1 + (size - length) // length  # a run of equal lengths opens packs that already hold several
                full, odd = divmod(left, each)
                if full:
                    put(((length, each),), full, each * length)
                if odd:
                    put(((length, odd),), 1, odd * length)
                break
            packs = by_used[used]
            p, n = packs.popitem()
            fit = (size - used) // length
            if n * fit <= left:  # every such pack takes as many as fit
                put((*p, (length, fit)), n, used + fit * length)
                left -= n * fit
                continue
            full, odd = divmod(left, fit)
            if full:
                put((*p, (length, fit)), full, used + fit * length)
            if odd:
                put((*p, (length, odd)), 1, used + odd * length)
            if n - full - bool(odd):
                put(p, n - full - bool(odd), used)
            left = 0
    for ps in by_used.values():
        for p, n in ps.items():
            done[p] += n
    return dict(done)


def slots(patterns: dict[Pattern, int]) -> np.ndarray:
    """Rows (length, first rank, packs, first sequence, offset), ordered by length and rank: a row's
    ranks fill the run's first place in all packs of a pattern, then its second, and so on."""
    at: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for p in sorted(patterns, reverse=True):
        n, offset = patterns[p], 0
        for length, many in p:
            out.append((length, at[length], n, sequence, offset))
            at[length] += n * many
            offset += length * many
        sequence += n
    a = np.array(out, np.int64).reshape(-1, 5)
    return a[np.lexsort((a[:, 1], a[:, 0]))]


def cut(docs: DataFrame, tokenizer: str, *, size: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        for b in chunks(batches, "text"):
            which, start, length, crc, total = [], [], [], [], []
            flat, edge = enc.encode(b.column("text"))
            for i in range(b.num_rows):
                ids = np.append(flat[edge[i] : edge[i + 1]], end)
                n = len(ids)
                for s in range(0, n, size):
                    e = min(s + size, n)
                    which.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e]))
                    total.append(n)
            arrays = [b.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(pieces), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", seed: int = 0, split_rows: int = 50_000) -> DataFrame:
    """One row per piece, with sequence_id and offset.

    Texts are tokenised where they are read and never shuffled; ranks move 6 numbers a piece. The
    histogram that reaches the driver has at most ``size`` rows; the slot table that tasks get has at
    most 2 * size * sqrt(2 * size) (10 MB for 2,048, were all lengths that unlike; kilobytes as a rule).
    """
    spark = docs.sparkSession
    got = Workspace(spark, "packing").save(cut(docs, tokenizer, size=size, end_id=end_id, doc_id=doc_id, text=text), "pieces")
    hist = {int(r["length"]): int(r["n"]) for r in got.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan_patterns(hist, size))
    counts = small_table(spark, sorted(hist.items()), pa.schema([("length", pa.int64()), ("n", pa.int64())]))
    order = [F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    ranked = rank_within(got.join(F.broadcast(counts), "length"), ["length"], "n", order, split_rows=split_rows)
    key = table[:, 0] << 44 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
            own = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 3] + (rank - row[:, 1]) % row[:, 2]), pa.array(row[:, 4] + (rank - row[:, 1]) // row[:, 2] * length)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*cols, "rank").mapInArrow(lean(place), ", ".join(f"{c} long" for c in [*cols, "sequence_id", "offset"]))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_tokenizer())
