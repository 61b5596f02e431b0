"""Benchmark passages in training text, found with an FM-index per training shard.

A shard is some megabytes of documents. Its words become symbols, its suffixes are sorted, and the
wavelet tree of its Burrows-Wheeler transform answers rank queries: every benchmark window is searched
backward, all windows at once, and its occurrences are located by walking to the next sampled suffix
position. Documents enter the index in pieces of ``PIECE`` words that overlap by all but one word of the
longest window, so copies of any length cost a bounded depth of sorting and no window is lost.

Defined results: null texts have no words; an item without words or text has no windows; items without
an id take no part; items that share an id count once. Ids of documents may be null or repeat; every
row comes out once. Words are known by a 64-bit hash while searching, and every word of an occurrence is
confirmed by a second one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.textnp import Powers, chunks, lean, strings, word_hashes, words
from quantloom.llm.workspace import Workspace

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Words of a piece, bytes of text of a shard and symbols of one index.
PIECE, SHARD_BYTES, INDEX_SYMBOLS = 128, 4 << 20, 1 << 20
#: Every so many words a suffix position is kept.
SAMPLE = 32
#: Benchmark text that one pass over the documents searches for; more takes more passes.
PASS_BYTES = 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.ones(256, bool)  # bytes that separate words
_APART[48:58] = _APART[97:123] = _APART[128:] = False


def sort_suffixes(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order. Symbol 0 ends a piece; a 0 further left is smaller, so
    no comparison goes beyond one. Groups of equal beginnings are sorted by the group that follows them,
    and the sorted length doubles; what is alone in its group is done."""
    n = len(s)
    width = max(1, int(s.max(initial=1)).bit_length())
    h = max(1, min(62 // width, 16))
    ends = np.flatnonzero(s == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end of the piece
    key = np.zeros(n, np.int64)
    for k in range(min(h, n)):
        part = s[k:] if k else s
        key[: n - k] |= np.where(left[: n - k] >= k, part, 0) << (width * (h - 1 - k))
    order = np.argsort(key)
    at = np.arange(n)  # places in the order that are not settled
    head = np.append(True, key[order][1:] != key[order][:-1]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    while True:
        group = np.maximum.accumulate(np.where(head, at, 0))
        rank[order[at]] = group
        alone = head & np.append(head[1:], True)
        at, group = at[~alone], group[~alone]
        if not len(at):
            return order
        suffix = order[at]
        nxt = np.where(left[suffix] >= h, rank[np.minimum(suffix + h, n - 1)], suffix)
        by = np.argsort(group * n + nxt)
        order[at] = suffix[by]
        nxt = nxt[by]
        head = np.append(True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1]))
        h *= 2


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FmIndex:
    """Backward search and location over symbols 1 to ``most``; every piece ends with a 0."""

    def __init__(self, s: np.ndarray, most: int):
        order = sort_suffixes(s)
        self.n = len(s)
        last = s[order - 1]  # before the first suffix comes the final 0
        counts = np.bincount(s, minlength=most + 1)
        self.below = np.cumsum(counts) - counts
        bits = max(1, int(most).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        rows = last
        for b in range(bits - 1, -1, -1):
            one = (rows >> b & 1).astype(bool)
            zero = rows[~one]
            self.levels.append((b, Bits(one), len(zero)))
            rows = np.concatenate([zero, rows[one]])
        turned = np.zeros(most + 1, np.int64)  # the tree's leaves follow the symbols read from the lowest bit
        for b in range(bits):
            turned |= (np.arange(most + 1) >> b & 1) << (bits - 1 - b)
        by = np.argsort(turned)
        self.leaf = np.empty(most + 1, np.int64)
        self.leaf[by] = np.cumsum(counts[by]) - counts[by]
        kept = (order % SAMPLE == 0) | (last == 0)  # the first of a piece is kept, so no walk leaves a piece
        self.kept, self.position = Bits(kept), order[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs in the first i rows of the transform."""
        for b, ones, zeros in self.levels:
            r = ones.rank(i)
            i = np.where(c >> b & 1, zeros + r, i - r)
        return i - self.leaf[c]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer than row i's."""
        c = np.zeros(len(i), np.int64)
        for b, ones, zeros in self.levels:
            one, r = ones.get(i), ones.rank(i)
            c |= one.astype(np.int64) << b
            i = np.where(one, zeros + r, i - r)
        return self.below[c] + i - self.leaf[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after) of every pattern: rows of symbols filled up at the left with -1."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = live[patterns[live, k] >= 0]
            c = patterns[live, k]
            low[live] = self.below[c] + self.rank(c, low[live])
            high[live] = self.below[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            done = self.kept.get(rows)
            out[todo[done]] = self.position[self.kept.rank(rows[done])] + walked
            todo, rows, walked = todo[~done], self.back(rows[~done]), walked + 1
        return out


def pieces(first: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(word at every place of the index, -1 where a piece ends; places where pieces begin and the total)
    for texts whose words are first[i] to first[i + 1]."""
    n = np.diff(first)
    step = PIECE - overlap
    count = np.where(n > 0, np.maximum(1, -(-(n - overlap) // step)), 0)
    text = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    size = np.minimum(begin + PIECE, first[1:][text]) - begin
    edge = np.append(0, np.cumsum(size + 1))
    at = np.repeat(begin - edge[:-1], size + 1) + np.arange(edge[-1])
    at[edge[1:] - 1] = -1
    return at, edge


class Windows:
    """The distinct windows of a part of the benchmark: words by hash, windows as rows of word numbers
    (filled up at the left with -1), and the items of each."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        column = pa.array([t for _, t in items], pa.string())
        off, data = strings(column)
        data = _LOWER[data]
        begin, end, first = words(off, data, _APART)
        h, g = (word_hashes(data, begin, end, Powers(), False, other) for other in (False, True))
        self.hash, where, number = np.unique(h, return_index=True, return_inverse=True)
        self.other = g[where]
        if (self.other[number] != g).any():
            raise ValueError("two words of the benchmark share a hash")
        made: dict[tuple[int, ...], set[int]] = {}
        self.ids = sorted({i for i, _ in items})
        place = {x: i for i, x in enumerate(self.ids)}
        for (name, _), x, y in zip(items, first[:-1].tolist(), first[1:].tolist()):
            own = number[x:y].tolist()
            for at in range(max(1, len(own) - n + 1) if own else 0):
                made.setdefault(tuple(own[at : at + n]), set()).add(place[name])
        self.rows = np.full((len(made), n), -1, np.int64)
        for i, w in enumerate(made):
            self.rows[i, n - len(w) :] = w
        self.length = (self.rows >= 0).sum(1)
        self.item_edge = np.append(0, np.cumsum([len(x) for x in made.values()])).astype(np.int64)
        self.item = np.array([i for x in made.values() for i in sorted(x)], np.int64)

    def find(self, off: np.ndarray, data: np.ndarray, pows: Powers) -> tuple[np.ndarray, ...]:
        """(first word of every text and the total, first and last byte of words, whether a word is hit,
        texts of hits, items of hits) for texts in lower case."""
        begin, end, first = words(off, data, _APART)
        h = word_hashes(data, begin, end, pows, False)
        vocabulary, symbol = np.unique(h, return_inverse=True)
        number = np.searchsorted(vocabulary, self.hash)
        there = number < len(vocabulary)
        there[there] = vocabulary[number[there]] == self.hash[there]
        number = np.where(there, number + 1, -2)  # the symbol of each benchmark word, if the shard has it
        rows = np.where(self.rows >= 0, number[np.maximum(self.rows, 0)], -1)
        may = np.flatnonzero((rows != -2).all(1))
        hit = np.zeros(len(begin) + 1, np.int64)
        found, n = [], self.rows.shape[1]
        at, edge = pieces(first, n - 1)
        x = 0
        while x < len(edge) - 1 and len(may):
            y = max(x + 1, int(np.searchsorted(edge, edge[x] + INDEX_SYMBOLS, "right")) - 1)
            part = at[edge[x] : edge[y]]
            index = FmIndex(np.where(part >= 0, symbol[part] + 1, 0), len(vocabulary))
            low, high = index.search(rows[may])
            many = high - low
            which = np.repeat(may, many)
            upto = np.cumsum(many) - many
            where = part[index.locate(np.repeat(low - upto, many) + np.arange(many.sum()))]
            found.append(np.stack([where, which], 1))
            x = y
        where, which = np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0).T
        if len(where):
            again = word_hashes(data, begin, end, pows, False, True)
            good = np.ones(len(where), bool)
            for k in range(n):
                w = self.rows[which, k]
                place = np.minimum(where + k - (n - self.length[which]), len(begin) - 1)
                good &= (w < 0) | (again[place] == self.other[w])
            where, which = where[good], which[good]
            np.add.at(hit, where, 1)
            np.add.at(hit, where + self.length[which], -1)
        text = np.searchsorted(first, where, "right") - 1
        many = self.item_edge[which + 1] - self.item_edge[which]
        upto = np.cumsum(many) - many
        item = self.item[np.repeat(self.item_edge[which] - upto, many) + np.arange(many.sum())]
        return first, begin, end, np.cumsum(hit[:-1]) > 0, np.repeat(text, many), item


_FOUND = "doc_id long, n_words long, n_hit long, spans array<struct<begin: long, end: long>>, item_ids array<string>"
_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _finder(w: Windows, row: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in chunks(batches, "text", SHARD_BYTES):
            off, data = strings(b.column("text"))
            first, begin, end, hit, text, item = w.find(off, _LOWER[data], pows)
            sums = np.append(0, np.cumsum(hit))
            starts = hit & ~np.append(False, hit[:-1])
            starts[first[:-1][np.diff(first) > 0]] |= hit[first[:-1][np.diff(first) > 0]]  # a span ends with its text
            ends = hit & ~np.append(hit[1:], False)
            lasts = first[1:][np.diff(first) > 0] - 1
            ends[lasts] |= hit[lasts]
            s, e = np.flatnonzero(starts), np.flatnonzero(ends)
            owner = np.searchsorted(first, s, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin[s] - off[owner]), pa.array(end[e] - off[owner])], ["begin", "end"])
            offsets = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            seen = np.unique(text * (len(w.ids) + 1) + item)
            ids: list[list[str]] = [[] for _ in range(b.num_rows)]
            for t, i in zip((seen // (len(w.ids) + 1)).tolist(), (seen % (len(w.ids) + 1)).tolist()):
                ids[t].append(w.ids[i])
            columns = [b.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(sums[first])), pa.ListArray.from_arrays(offsets, spans).cast(_SPAN), pa.array(ids, pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "n_hit", "spans", "item_ids"]
            yield pa.RecordBatch.from_arrays([*columns, b.column("row")] if row else columns, names=[*names, "row"] if row else names)

    return run


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (merged, bytes of UTF-8) and item_ids (sorted) of every row.

    One pass over the documents without a shuffle searches for ``pass_bytes`` of benchmark text, which
    travels with the tasks; a larger benchmark is searched in parts, whose spans are then merged by row.
    """
    ws = None
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = -(-size // pass_bytes) or 1
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def part(i: int) -> Windows:
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i)
        return Windows([(r["item"], r["text"]) for r in mine.collect()], n)

    if parts == 1:
        return source.mapInArrow(lean(_finder(part(0), False)), _FOUND)
    ws = Workspace(docs.sparkSession, "contamination")
    rows = ws.save(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = None
    for i in range(parts):
        got = ws.save(rows.mapInArrow(lean(_finder(part(i), True)), f"{_FOUND}, row long"), f"part-{i}")
        found = got if found is None else found.unionAll(got)
    flat = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    text_of = rows.select("row", "text")
    return flat.join(text_of, "row").mapInArrow(_merge, _FOUND)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins spans that overlap or leave no word between them, and counts the words within."""
    for b in batches:
        spans, hits = [], []
        for own, t in zip(b.column("spans").to_pylist(), b.column("text").to_pylist()):
            data = _LOWER[np.frombuffer((t or "").encode(), np.uint8)]
            begin, end, _ = words(np.array([0, len(data)]), data, _APART)
            mark = np.zeros(len(begin) + 1, np.int64)
            for x in own:
                mark[np.searchsorted(begin, x["begin"])] += 1
                mark[np.searchsorted(end, x["end"]) + 1] -= 1
            hit = np.cumsum(mark[:-1]) > 0
            s, e = np.flatnonzero(hit & ~np.append(False, hit[:-1])), np.flatnonzero(hit & ~np.append(hit[1:], False))
            spans.append([{"begin": int(begin[i]), "end": int(end[j])} for i, j in zip(s, e)])
            hits.append(int(hit.sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array(spans, _SPAN), b.column("item_ids")], names=[f.split()[0] for f in ("doc_id", "n_words", "n_hit", "spans", "item_ids")])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = benchmark_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, len(w[p:p + 9]) AS n, array_to_string(w[p:p + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT doc_id, p, n, item_id FROM g JOIN win USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
