"""Order MinHash fingerprints, sensitive to edit distance.

Every k-mer of code points is numbered by its occurrence within the text. One hash deals the
numbered k-mers into ``size`` buckets; in each bucket the ``tuple_size`` smallest are taken, put
back into text order, and the tuple is hashed into one 16-bit entry. Two texts agree in an entry
only if they share the minimal k-mers and their order. One hash per k-mer replaces ``size``
permutations, so cost does not grow with the signature.

Defined results: null text is empty; a text shorter than k is a single k-mer; empty texts have the
fingerprint of zeros, alike (1.0) to each other and to nothing else; equal texts have equal
fingerprints; null ids sort first; rows that share an id are ordered by a hash of the text, then
the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.textnp import U, chunks, lean, long_grams, mix
from quantloom.llm.workspace import small_table

K, SIZE, TUPLE = 16, 64, 2
_LEAST = -(2**63)


def _entries(e: np.ndarray, pos: np.ndarray, size: int, l: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, elements per bucket) from element hashes and text positions."""
    order = np.argsort(e)
    e, pos = e[order], pos[order]
    shift = U(64 - size.bit_length() + 1)
    edge = np.searchsorted(e >> shift, np.arange(size + 1, dtype=U))
    count = np.diff(edge)
    at = edge[:-1, None] + np.arange(l)
    there = np.arange(l) < count[:, None]
    at = np.minimum(at, len(e) - 1)
    p = np.where(there, pos[at], np.int64(2**62))
    v = np.where(there, e[at], U(0))
    rank = np.argsort(p, axis=1)
    v = np.take_along_axis(v, rank, 1)
    h = np.full(size, 0x51ED270B, U)
    for j in range(l):
        h = mix(h * U(0x9E3779B97F4A7C15) + v[:, j])
    h = (h >> U(48)) % U(65535) + U(1)
    h[count == 0] = 0
    return h.astype(np.uint16), count


def fingerprint(text: str, k: int = K, size: int = SIZE, l: int = TUPLE) -> np.ndarray:
    """``size`` 16-bit entries; 0 marks a bucket without k-mers. ``size`` is a power of two."""
    if not text:
        return np.zeros(size, np.uint16)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    code = mix(code + U(0x9E3779B97F4A7C15))
    g = long_grams(code, k) if len(code) >= k else long_grams(code, len(code)) ^ U(len(code))
    n = len(g)
    if n < 1 << 20:
        key = g >> U(20) << U(20) | np.arange(n, dtype=U)
        key.sort()
        g, pos = key >> U(20), (key & U(0xFFFFF)).astype(np.int64)
    else:
        g >>= U(20)
        pos = np.argsort(g, kind="stable")
        g = g[pos]
    new = np.ones(n, bool)
    new[1:] = g[1:] != g[:-1]
    at = np.arange(n)
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    e = mix(g * U(0xD1B54A32D192ED03) + mix(occurrence.astype(U) + U(1)))
    expected = 12 * size * l
    if n > 2 * expected:  # the smallest of a bucket are, as a rule, among these
        small = e << U(size.bit_length() - 1) < U(int(2**64 * (expected / n)))
        out, count = _entries(e[small], pos[small], size, l)
        if count.min() >= l:
            return out
    return _entries(e, pos, size, l)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries among those that either fingerprint has; 1.0 if both are empty."""
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def text_form(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def edit(text: str, other: str) -> str:
    """The last quarter of the code points replaced by the first as many of the other text."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


#: Text bytes of a block, about; there are no fewer blocks than shuffle partitions, and no more than
#: MOST_BLOCKS: a task reads its block in order and holds one batch of it, so blocks may be of any size.
BLOCK_BYTES, MOST_BLOCKS = 128 << 20, 20_000


def fingerprint_with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None, k: int = K, size: int = SIZE, l: int = TUPLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other and the next text's.

    Texts move once, into blocks of neighbouring ids, each of which is one task. The number of blocks
    follows the bytes up to ``MOST_BLOCKS``; an id that holds more than a block is cut by its texts' hashes. The first
    document of each block is also sent to the block before as its look-ahead, so neighbours meet
    without a global order in one task. The driver sees three numbers per block, so a bounded table; a task
    holds one batch of texts.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("key"), F.shiftrightunsigned(F.xxhash64(body), 32).alias("th"), body.alias("text"))
    if blocks is None:
        volume = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-volume // BLOCK_BYTES), MOST_BLOCKS))
    cuts = rows.select(F.percentile_approx("key", [i / blocks for i in range(1, blocks)] or [0.5], max(10_000, 4 * blocks))).first()[0] or []
    cuts = np.sort(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def block(key: pd.Series, th: pd.Series) -> pd.Series:
        """What lies between two cuts is a block; an id on several cuts has as many blocks, by hash."""
        low, high = (np.searchsorted(cuts, key.to_numpy(), side) for side in ("left", "right"))
        many = high - low
        return pd.Series(np.where(many > 0, low + 1 + (th.to_numpy() * many >> 32), low).astype(np.int32))

    least = rows.select("key", "th", block("key", "th").alias("block")).groupBy("block").agg(F.min(F.struct("key", "th")).alias("first")).collect()
    firsts = sorted((r["block"], r["first"]["key"], r["first"]["th"]) for r in least)
    ahead = small_table(spark, [(firsts[i][1], firsts[i][2], firsts[i - 1][0]) for i in range(len(firsts))], pa.schema([("key", pa.int64()), ("th", pa.int64()), ("to", pa.int32())]))  # one row a block; the last is followed by the first
    own = rows.withColumn("block", block("key", "th"))
    places = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("ahead")))
    both = own.join(F.broadcast(ahead), ["key", "th"], "left").withColumn("to", F.explode(F.when(F.col("to").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("to").alias("block"), F.lit(True).alias("ahead")))))))
    both = both.select("doc_id", "key", "th", "text", F.col("to.block").alias("block"), F.col("to.ahead").alias("ahead"))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (id, text, its fingerprint) that waits for its next document
        held_block = None
        for b in chunks(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc, t, blk, ahead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "block", "ahead"))):
                if ahead and (held is None or blk != held_block):
                    continue  # a second look-ahead row
                own = fingerprint(t, k, size, l)
                if held is not None and blk == held_block:
                    new = edit(held[1], t)
                    changed = fingerprint(new, k, size, l)
                    for o, x in zip(out, (held[0], len(held[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_form(held[2]), text_form(changed), likeness(held[2], changed), likeness(held[2], own))):
                        o.append(x)
                held, held_block = (None, None) if ahead else ((doc, t, own), blk)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(o, y) for o, y in zip(out, types)], names=names)

    dealt = both.repartitionById(blocks, "block").sortWithinPartitions("block", "ahead", "key", "th", "text")
    return dealt.select("doc_id", "text", "block", "ahead").mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
