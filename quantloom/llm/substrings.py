"""Exact substring de-duplication through difference-cover anchors.

A window is ``window`` consecutive words. Every word of a window whose word sequence also starts
earlier (smaller id, or same document and earlier start) is removed, judged on the input.

Anchors are ``window - period + 1`` words long and are hashed only at positions whose remainder
modulo ``period`` lies in a difference cover. For any two positions some shift below ``period``
brings both into the cover, so two equal windows always share an anchor at the same shift. Windows
that contain no shared anchor are therefore unique. The others are extended to full windows, known
by two independent 64-bit hashes of their words, of which only the earliest start of each stays.
Anchors have one hash: there a false match costs work, not words.

Both rounds move packed arrays instead of rows. A mapper settles what it can within its batch and
asks about one position per distinct hash, so a passage that a third of all documents share costs
one entry per batch, whatever its number of copies. Buckets of hashes and parts of the documents are
tasks of their own, and there are more of them for more text.

Defined results: null text has no words; a text with fewer words than a window keeps all; windows
with the same id and start (repeated rows) are one window and do not remove each other; null ids
sort first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.textnp import Powers, U, chunks, gram_starts, lean, long_grams, strings, word_hashes, words
from quantloom.llm.workspace import Workspace

#: Difference covers (fixed values): every remainder modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_LEAST = -(2**63)
#: Hashes that a mapper gathers before it settles and sends them.
FLUSH = 400_000
_ASK = "bucket int, known boolean, docs binary, at binary, pos binary, hash binary, more binary"
#: Text bytes for each bucket of hashes and part of the documents, about.
BUCKET_BYTES = 32 << 20


def _pack(bucket: int, known: bool, keys: np.ndarray, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, h: np.ndarray | None, more: np.ndarray | None) -> tuple:
    """A message: the documents it speaks of, then per entry a document index, a position and its hashes."""
    used, at = np.unique(doc, return_inverse=True)
    small = np.uint16 if len(used) < 65536 else np.uint32
    return bucket, known, np.stack([keys[used], ids[used]]).tobytes(), at.astype(small).tobytes(), pos.astype(np.uint32).tobytes(), *(b"" if x is None else x.tobytes() for x in (h, more))


def _unpack(docs: bytes, at: bytes, pos: bytes, h: bytes, more: bytes) -> tuple:
    keys, ids = np.frombuffer(docs, np.int64).reshape(2, -1)
    p = np.frombuffer(pos, np.uint32)
    i = np.frombuffer(at, np.uint16 if len(at) == 2 * len(p) else np.uint32)
    return keys[i], ids[i], p, np.frombuffer(h, U), np.frombuffer(more, U)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "known", "docs", "at", "pos", "hash", "more"])


def _order(h: np.ndarray, more: np.ndarray, ids: np.ndarray, pos: np.ndarray, earliest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order of the entries by hash, and by start if the earliest is asked for; which of them begin a hash)."""
    order = np.lexsort((pos, ids, more, h)) if earliest else np.argsort(h)
    a, b = h[order], more[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    if earliest:
        first[1:] |= b[1:] != b[:-1]
    return order, first


class _Gather:
    """Collects (hash, document, position) over chunks and turns them into messages."""

    def __init__(self, buckets: int, earliest: bool):
        self.buckets, self.earliest = buckets, earliest
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, h: np.ndarray, more: np.ndarray | None = None) -> None:
        self.parts.append((keys, ids, doc, pos, h, h if more is None else more))
        self.n += len(h)

    def flush(self) -> list[tuple]:
        if not self.n:
            self.parts = []
            return []
        base = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        keys, ids = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        doc = np.concatenate([p[2] + b for p, b in zip(self.parts, base)])
        pos, h, more = (np.concatenate([p[i] for p in self.parts]) for i in (3, 4, 5))
        self.parts, self.n = [], 0
        order, first = _order(h, more, ids[doc], pos, self.earliest)
        doc, pos, h, more = doc[order], pos[order], h[order], more[order] if self.earliest else None
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        if self.earliest:  # later than the batch's earliest: settled, removed
            known = (ids[doc] != ids[doc[head]]) | (pos != pos[head])
        else:  # shared within the batch: settled
            known = ~first
            known[head[known]] = True
        ask = np.flatnonzero(first)
        bucket = ((h[ask] >> U(32)) * U(self.buckets) >> U(32)).astype(np.int64)
        edge = np.searchsorted(bucket, np.arange(self.buckets + 1))
        out = [_pack(b, False, keys, ids, doc[ask[s:e]], pos[ask[s:e]], h[ask[s:e]], more if more is None else more[ask[s:e]]) for b, (s, e) in enumerate(zip(edge[:-1], edge[1:])) if e > s]
        if known.any():
            out.append(_pack(int(h[0] & U(0x7FFFFFFF)) % self.buckets, True, keys, ids, doc[known], pos[known], None, None))
        return out


def _answers(earliest: bool, buckets: int) -> Callable:
    """The reducer: per bucket, finds the positions to mark and returns them by part of the documents."""

    def settle(rows: list[tuple]) -> tuple:
        got = [_unpack(*r) for r in rows]
        keys, ids, pos, h, more = (np.concatenate([g[i] for g in got]) for i in range(5))
        order, first = _order(h, more if earliest else h, ids, pos, earliest)
        keys, ids, pos = keys[order], ids[order], pos[order]
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        if earliest:
            mark = (ids != ids[head]) | (pos != pos[head])
        else:
            mark = ~first
            mark[head[mark]] = True
        return keys[mark], ids[mark], pos[mark]

    def by_part(keys: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch | None:
        """One row per part of the documents: its marked rows (key and id), positions per row, positions."""
        if not len(keys):
            return None
        part = keys % buckets
        order = np.lexsort((ids, keys, part))
        part, keys, ids, pos = part[order], keys[order], ids[order], pos[order].astype(np.uint32)
        head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        count = np.diff(np.append(head, len(keys))).astype(np.uint32)
        rows = []
        for i in np.split(np.arange(len(head)), np.flatnonzero(np.diff(part[head])) + 1):
            s, e = head[i[0]], head[i[-1]] + count[i[-1]]
            rows.append((int(part[s]), keys[head[i]].tobytes(), ids[head[i]].tobytes(), count[i].tobytes(), pos[s:e].tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "keys", "ids", "counts", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for b in batches:
            for bucket, known, *rest in zip(*(b.column(c).to_pylist() for c in ("bucket", "known", "docs", "at", "pos", "hash", "more"))):
                if held and bucket != at:
                    if (out := by_part(*settle(held))) is not None:
                        yield out
                    held = []
                at = bucket
                if known:
                    keys, ids, pos, *_ = _unpack(*rest)
                    if (out := by_part(keys, ids, pos)) is not None:
                        yield out
                else:
                    held.append(tuple(rest))
        if held and (out := by_part(*settle(held))) is not None:
            yield out

    return run


def _meet(rows: DataFrame, messages: DataFrame, buckets: int, earliest: bool, use: Callable, schema: str) -> DataFrame:
    """``use(batch, marks)`` over the rows (with a column key), where ``marks`` maps the key and id of
    marked rows to their positions. Answers come packed, one row per part and message bucket, ahead of the
    part's rows; memory holds the answers of one part."""
    answers = messages.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "known").mapInArrow(lean(_answers(earliest, buckets)), "part int, keys binary, ids binary, counts binary, pos binary")
    packed, own = ["keys", "ids", "counts", "pos"], rows.schema
    left = answers.select("part", F.lit(0).alias("kind"), *packed, *[F.lit(None).cast(f.dataType).alias(f.name) for f in own])
    right = rows.select(F.pmod("key", F.lit(buckets)).cast("int").alias("part"), F.lit(1).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in packed], *own.names)
    dealt = left.unionAll(right).repartitionById(buckets, "part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, marks = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            part, kind = b.column("part").to_numpy(), b.column("kind").to_numpy()
            edge = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
            for s, e in zip(edge[:-1], edge[1:]):
                if part[s] != at:
                    at, marks = part[s], {}
                if kind[s]:
                    for c in chunks(iter([b.slice(s, e - s)]), "text"):
                        yield use(c, marks)
                    continue
                for keys, ids, counts, pos in zip(*(b.column(c).slice(s, e - s).to_pylist() for c in packed)):
                    pos = np.frombuffer(pos, np.uint32)
                    ends = np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64)).tolist()
                    for row, i, j in zip(zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(ids, np.int64).tolist()), [0, *ends], ends):
                        marks.setdefault(row, []).append(pos[i:j])

    return dealt.mapInArrow(lean(run), schema)


def _windows(marks: np.ndarray, n: int, window: int, anchor: int) -> np.ndarray:
    """Starts of the windows of an n-word text that contain a marked anchor."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, np.maximum(marks - (window - anchor), 0), 1)
    np.add.at(d, np.minimum(marks, n - window) + 1, -1)
    return np.flatnonzero(np.cumsum(d[: n - window + 1]) > 0)


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 20, period: int = 13, buckets: int | None = None, with_text: bool = False, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text
    (the kept words joined by one space). Texts move twice: all to meet their shared anchors, those
    that have any to meet their repeated windows. A row is known by its id and a hash of its text.
    ``hash_bits`` cuts the first hash, for tests of what collisions do."""
    if period not in COVERS or period >= window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and below the window")
    spark, anchor, cover = docs.sparkSession, window - period + 1, np.array(COVERS[period])
    ws = Workspace(spark, "substrings")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(F.col(doc_id).cast("long"), body).alias("key"))
    if buckets is None:
        volume = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // BUCKET_BYTES))
    lost = U(64 - hash_bits)
    in_cover = np.isin(np.arange(period), cover)

    def ids_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column("doc_id").fill_null(_LEAST).to_numpy(zero_copy_only=False)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, g = Powers(), _Gather(buckets, False)
        for b in chunks(batches, "text"):
            off, data = strings(b.column("text"))
            begin, end, first = words(off, data)
            h = long_grams(word_hashes(data, begin, end, pows, False), anchor) >> lost << lost
            at, doc = gram_starts(first, anchor)
            pos = at - first[doc]
            keep = in_cover[pos % period] & (np.diff(first)[doc] >= window)
            g.add(b.column("key").to_numpy(), ids_of(b), doc[keep], pos[keep], h[at[keep]])
            if g.n > FLUSH and (out := g.flush()):
                yield _batch(out)
        if out := g.flush():
            yield _batch(out)

    def first_pass(b: pa.RecordBatch, marked: dict) -> pa.RecordBatch:
        """Settles texts without shared anchors; the others go on with their marks."""
        n, sha, texts, marks, kept = [], [], [], [], []
        for t, row in zip(b.column("text").to_pylist(), zip(b.column("key").to_pylist(), ids_of(b).tolist())):
            w = t.encode().split()
            m = marked.get(row)
            joined_words = b" ".join(w)
            n.append(len(w))
            sha.append(None if m else hashlib.sha256(joined_words).hexdigest())
            kept.append(None if m else joined_words.decode())
            texts.append(t if m else None)
            marks.append(np.unique(np.concatenate(m)).tobytes() if m else None)
        cols = {"doc_id": b.column("doc_id"), "key": b.column("key"), "n_words": pa.array(n, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "text": pa.array(texts, pa.string()), "marks": pa.array(marks, pa.binary())}
        return pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    kept_too = ", kept_text string" if with_text else ""
    first = _meet(rows, rows.mapInArrow(lean(anchors), _ASK), buckets, False, first_pass, f"doc_id long, key long, n_words long, kept_sha256 string, text string, marks binary{kept_too}")
    passed = ws.save(first, "passed")
    affected = passed.where(F.col("text").isNotNull())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, g = Powers(), _Gather(buckets, True)
        for b in chunks(batches, "text"):
            off, data = strings(b.column("text"))
            begin, end, first = words(off, data)
            h = long_grams(word_hashes(data, begin, end, pows, False), window) >> lost << lost
            more = long_grams(word_hashes(data, begin, end, pows, False, True), window)
            starts = [_windows(np.frombuffer(m, np.uint32).astype(np.int64), int(n), window, anchor) for m, n in zip(b.column("marks").to_pylist(), np.diff(first))]
            doc = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
            pos = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            g.add(b.column("key").to_numpy(), ids_of(b), doc, pos, h[first[:-1][doc] + pos], more[first[:-1][doc] + pos])
            if g.n > FLUSH and (out := g.flush()):
                yield _batch(out)
        if out := g.flush():
            yield _batch(out)

    def remove(b: pa.RecordBatch, marked: dict) -> pa.RecordBatch:
        gone, kept, sha = [], [], []
        for t, row in zip(b.column("text").to_pylist(), zip(b.column("key").to_pylist(), ids_of(b).tolist())):
            w = w2 = t.encode().split()
            if m := marked.get(row):
                d = np.zeros(len(w) + 1, np.int32)
                at = np.concatenate(m).astype(np.int64)
                np.add.at(d, at, 1)
                np.add.at(d, at + window, -1)
                w2 = [x for x, k in zip(w, (np.cumsum(d[:-1]) == 0).tolist()) if k]
            body = b" ".join(w2)
            gone.append(len(w) - len(w2))
            kept.append(body.decode())
            sha.append(hashlib.sha256(body).hexdigest())
        cols = {"doc_id": b.column("doc_id"), "n_words": b.column("n_words"), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    asked = affected.mapInArrow(lean(candidates), _ASK)
    cut = _meet(affected.select("doc_id", "key", "n_words", "text"), asked, buckets, True, remove, f"doc_id long, n_words long, n_removed long, kept_sha256 string{kept_too}")
    whole = passed.where(F.col("text").isNull()).withColumn("n_removed", F.lit(0).cast("long")).select(*cut.columns)
    return whole.unionAll(cut)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
