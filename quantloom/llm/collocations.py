"""Collocations: phrases of words that stay together more than their parts would.

Words are counted first. Then, level by level, occurrences are counted in 2^32 hashed buckets, but only where
both phrases that are one word shorter lie in buckets of ``least`` or more; a phrase of a smaller bucket, or
with such a part, cannot be frequent. What is left are the candidates. A minimal perfect hash gives each of
them a slot, every mapper counts its share of the corpus into a numpy array by slot (a key that is stored
there tells candidates from other phrases), the arrays are summed as a tree, and the counts of both sides of
every cut are read by slot.

Bounds: a level is known to the mappers by a bitmap of at most 2^27 bits, at any size; one pass over the corpus
counts ``SLOTS`` candidates, more candidates take more passes; arrays, keys and bitmaps never grow with the
corpus. Buckets and exact candidates of any number stay in Spark tables.

Defined results: null texts have no words; a null language is ``und``; repeated rows count as often as
they occur; ids and other columns are ignored; an empty table gives no rows. Phrases are known by 128 bits
of hashes (languages apart).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.llm.contamination import Bits
from quantloom.llm.textnp import Powers, U, chunks, lean, mix, strings, word_hashes, words
from quantloom.llm.workspace import Workspace

#: Words of the longest phrase.
LONGEST = 5
#: Candidates that one pass counts, and slots of one row on the way to their sum.
SLOTS, ROW_SLOTS = 2_000_000, 1 << 16
#: Most bits of a level's bitmap (as a power of two); positions a mapper holds before it emits their buckets; mappers' sums per first node of the tree.
MAP_BITS, HELD, FAN = 27, 500_000, 16
#: Words that the corpus has a two-byte code for: the most frequent ones; others keep their eight bytes.
CODED = 65_534
#: Bytes of text read at a time, words of a row of the corpus, rows of an emitted batch.
CHUNK, ROW_WORDS, BATCH = 2 << 20, 2048, 50_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)  # . , ; : ! ? and the line ends
_BREAK[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True
_ONE, _TWO = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)


def language_hash(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


def first_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on."""
    n = max(0, len(w) - k + 1)
    g = w[:n].copy()
    for j in range(1, k):
        g = mix(g * _ONE + w[j : j + n])
    return g if k > 1 else mix(g)


def second_hashes(w: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(w) - k + 1)
    g = mix(w[:n] + _TWO)
    for j in range(1, k):
        g = mix(g * _TWO ^ w[j : j + n])
    return g


class PerfectHash:
    """Slots 0 to n - 1 for n keys of two 64-bit numbers. At each level the keys that are alone in their
    place are settled there, the others go on to the next; a slot is the number of settled places before."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.levels: list[tuple[int, Bits, int]] = []
        left, before = np.arange(len(one)), 0
        while len(left):
            size = max(64, 2 * len(left))
            at = self._place(one[left], two[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, Bits(alone), before))
            before += int(alone.sum())
            left = left[~alone[at]]
        self.one, self.two = np.zeros(len(one), U), np.zeros(len(two), U)
        slot = self.slots(one, two)
        self.one[slot], self.two[slot] = one, two

    @staticmethod
    def _place(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(one ^ mix(two + U((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))) % U(size)).astype(np.int64)

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of every key; for other keys any slot, or -1."""
        out, todo = np.full(len(one), -1, np.int64), np.arange(len(one))
        for i, (size, bits, before) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._place(one[todo], two[todo], i, size)
            here = bits.get(at)
            out[todo[here]] = before + bits.rank(at[here])
            todo = todo[~here]
        return out

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for those that are not stored."""
        slot = self.slots(one, two)
        good = slot >= 0
        good[good] = (self.one[slot[good]] == one[good]) & (self.two[slot[good]] == two[good])
        return np.where(good, slot, -1)


def _words(b: pa.RecordBatch, pows: Powers) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Of each language of a batch: (language, words by hash with a 0 wherever a piece ends, first and
    last byte of each, the bytes). Words of different languages have different hashes."""
    langs = np.array([x if x is not None else "und" for x in b.column("lang").to_pylist()], object)
    for lang in sorted(set(langs)):
        own = b.column("text").filter(pa.array(langs == lang))
        off, data = strings(own)
        data = _LOWER[data]
        begin, end, first = words(off, data, _APART)
        h = mix(word_hashes(data, begin, end, pows, False) ^ language_hash(lang))
        h[h == 0] = U(1)
        breaks = np.append(0, np.cumsum(_BREAK[data]))
        new = np.ones(len(begin) + 1, bool)
        new[1:-1] = breaks[begin[1:]] > breaks[end[:-1]] if len(begin) else False
        new[first] = True
        size = len(begin) + int(new[:-1].sum()) + 1
        at = np.arange(len(begin)) + np.cumsum(new[:-1])
        w, s, e = np.zeros(size, U), np.zeros(size, np.int64), np.zeros(size, np.int64)
        w[at], s[at], e[at] = h, begin, end
        yield lang, w, s, e, data.tobytes()


def _in_map(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    fold = h >> U(32) & U(64 * len(bitmap) - 1)
    return (bitmap[(fold >> U(6)).astype(np.int64)] >> (fold & U(63)) & U(1)).astype(bool)


def _frequent(w: np.ndarray, k: int, bitmap: np.ndarray) -> np.ndarray:
    """Whether the k words from each place on are in one piece and may be frequent."""
    if len(w) < k:
        return np.zeros(0, bool)
    h = first_hashes(w, k)
    whole = w[: len(h)] != 0
    for j in range(1, k):
        whole &= w[j : j + len(h)] != 0
    whole[whole] = _in_map(bitmap, h[whole])
    return whole


def _slices(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(next(iter(columns.values()))), BATCH):
        yield pa.RecordBatch.from_arrays([x.slice(i, BATCH) for x in columns.values()], names=list(columns))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words, and the words of each language."""
    pows, total, held, n = Powers(), {}, [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        word, many = np.unique(np.concatenate([*held, np.zeros(0, U)]), return_counts=True)
        yield from _slices({"lang": pa.nulls(len(word), pa.string()), "word": pa.array(word.view(np.int64)), "n": pa.array(many)})

    for b in chunks(batches, "text", CHUNK):
        for lang, w, *_ in _words(b, pows):
            w = w[w != 0]
            total[lang] = total.get(lang, 0) + len(w)
            held.append(w)
            n += len(w)
        if n > HELD:
            yield from counted()
            held, n = [], 0
    yield from counted()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "n"])


def _word_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = first_hashes(b.column("word").to_numpy().view(U), 1)
        yield pa.RecordBatch.from_arrays([pa.array((h >> U(32)).astype(np.uint32).view(np.int32))], names=["bucket"])


_CORPUS = "codes binary, rest binary, lang string, word long, text string"


def _write_words(bitmap: np.ndarray, coded: np.ndarray):
    """The corpus as words (rows with ``codes``: numbers in ``coded``, 1 to its length, 0 where a piece ends,
    65535 for the words in ``rest``) and what they are (rows with ``word``, each once a mapper or so). Words
    that cannot be frequent end a piece."""
    by = np.argsort(coded)
    ordered = coded[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, seen = Powers(), np.zeros(0, U)
        for b in chunks(batches, "text", CHUNK):
            rows, rest, named = [], [], []
            for lang, w, s, e, data in _words(b, pows):
                may = _frequent(w, 1, bitmap)
                own, at = np.unique(w[may], return_index=True)
                new = seen[np.minimum(np.searchsorted(seen, own), max(len(seen) - 1, 0))] != own if len(seen) else np.ones(len(own), bool)
                where = np.flatnonzero(may)[at[new]]
                named.extend((lang, int(i), data[x:y].decode()) for i, x, y in zip(own[new].view(np.int64).tolist(), s[where].tolist(), e[where].tolist()))
                seen = np.union1d(seen if len(seen) < HELD else np.zeros(0, U), own[new])
                w = np.where(may, w, U(0))
                w = w[(w != 0) | np.append(True, w[:-1] != 0)]
                code = np.zeros(len(w), np.uint16)
                if len(ordered):
                    near = np.minimum(np.searchsorted(ordered, w), len(ordered) - 1)
                    code = np.where(ordered[near] == w, by[near] + 1, 65535)
                else:
                    code = np.full(len(w), 65535)
                code = np.where(w == 0, 0, code).astype("<u2")
                ends = np.flatnonzero(w == 0)  # rows begin where a piece does
                cuts = np.unique(np.append(ends[np.minimum(np.searchsorted(ends, np.arange(0, len(w), ROW_WORDS)), len(ends) - 1)], len(w))).tolist()
                rows.extend(code[x:y].tobytes() for x, y in zip(cuts, cuts[1:]))
                rest.extend(w[x:y][code[x:y] == 65535].tobytes() for x, y in zip(cuts, cuts[1:]))
            n, m = len(rows), len(named)
            langs, ids, texts = zip(*named) if m else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([*rows, *[None] * m], pa.binary()), pa.array([*rest, *[None] * m], pa.binary()), pa.array([*[None] * n, *langs], pa.string()), pa.array([*[None] * n, *ids], pa.int64()), pa.array([*[None] * n, *texts], pa.string())], names=[f.split()[0] for f in _CORPUS.split(", ")])

    return run


def _rows(batches: Iterator[pa.RecordBatch], coded: np.ndarray) -> Iterator[np.ndarray]:
    """The words of a batch's rows in a row; pieces stay apart."""
    table = np.concatenate([np.zeros(1, U), coded, np.zeros(65535 - len(coded), U)])
    for b in batches:
        code = np.frombuffer(b"".join(b.column("codes").to_pylist()), "<u2")
        w = table[code]
        w[code == 65535] = np.frombuffer(b"".join(b.column("rest").to_pylist()), U)
        yield np.append(w, U(0))


def _count_level(k: int, bitmap: np.ndarray, coded: np.ndarray):
    """Buckets of k-word phrases whose parts may be frequent by the bitmap of k - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            bucket, many = np.unique((np.concatenate([*held, np.zeros(0, U)]) >> U(32)).astype(np.uint32), return_counts=True)
            yield from _slices({"bucket": pa.array(bucket.view(np.int32)), "n": pa.array(many)})

        for w in _rows(batches, coded):
            part = _frequent(w, k - 1, bitmap)
            at = np.flatnonzero(part[:-1] & part[1:])
            held.append(first_hashes(w, k)[at])
            n += len(at)
            if n > HELD:
                yield from counted()
                held, n = [], 0
        yield from counted()

    return run


def _collect(bitmaps: list[np.ndarray], coded: np.ndarray):
    """The distinct phrases of the mapper's rows that may be frequent, as their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U)
        for w in _rows(batches, coded):
            part, out, fresh = None, [], []
            for k, bitmap in enumerate(bitmaps, 1):
                may = _frequent(w, k, bitmap)
                if part is not None:
                    may &= part[:-1] & part[1:]
                part = may
                at = np.flatnonzero(may)
                one, index = np.unique(first_hashes(w, k)[at], return_index=True)
                new = seen[np.minimum(np.searchsorted(seen, one), max(len(seen) - 1, 0))] != one if len(seen) else np.ones(len(one), bool)
                fresh.append(one[new])
                raw = w[at[index[new]][:, None] + np.arange(k)].astype("<u8").tobytes()
                out.extend(raw[i : i + 8 * k] for i in range(0, len(raw), 8 * k))
            seen = np.sort(np.concatenate([seen if len(seen) < 4 * HELD else np.zeros(0, U), *fresh]))
            yield from _slices({"words": pa.array(out, pa.binary())})

    return run


_CANDIDATE = "words binary, k int, one long, two long, bucket int"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases with their length, keys and bucket."""
    for b in batches:
        raw = b.column("words").to_pylist()
        k = np.array([len(x) // 8 for x in raw], np.int32)
        one, two = np.zeros(len(raw), U), np.zeros(len(raw), U)
        for n in range(1, LONGEST + 1):
            at = np.flatnonzero(k == n)
            w = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), U)
            one[at], two[at] = first_hashes(w, n)[::n], second_hashes(w, n)[::n]
        columns = [b.column("words"), pa.array(k), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array((one >> U(32)).astype(np.uint32).view(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _CANDIDATE.split(", ")])


def _count_slots(table: PerfectHash, bitmaps: list[np.ndarray], coded: np.ndarray):
    """The mapper's counts by slot, in rows of ``ROW_SLOTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(table.one), np.int64)
        for w in _rows(batches, coded):
            for k, bitmap in enumerate(bitmaps, 1):
                at = np.flatnonzero(_frequent(w, k, bitmap))
                slot = table.find(first_hashes(w, k)[at], second_hashes(w, k)[at])
                slot, n = np.unique(slot[slot >= 0], return_counts=True)
                total[slot] += n
        yield from _as_rows({i: total[i * ROW_SLOTS : (i + 1) * ROW_SLOTS] for i in range(-(-len(total) // ROW_SLOTS))})

    return run


_SUMS = "part int, branch int, counts binary"


def _as_rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    branch = TaskContext.get().partitionId() // FAN
    for i, x in sums.items():
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([branch], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["part", "branch", "counts"])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node of the tree: the sum of what its branches counted, part by part."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, raw in zip(b.column("part").to_pylist(), b.column("counts")):
            x = np.frombuffer(raw.as_buffer(), "<i8")
            sums[i] = sums[i] + x if i in sums else x
    yield from _as_rows(sums)


_CUTS = [f"{side}{j}" for j in range(1, LONGEST) for side in "lr"]
_READ = "one long, two long, a long, " + ", ".join(f"{x} long" for x in _CUTS) + ", head_one long, head_two long, tail_one long, tail_two long"


def _read_cuts(table: PerfectHash, counts: np.ndarray):
    """Counts of candidates and of both sides of each of their cuts, as far as this table has them."""

    def look(one: np.ndarray, two: np.ndarray) -> pa.Array:
        slot = table.find(one, two)
        return pa.array(counts[np.maximum(slot, 0)] if len(counts) else np.zeros(len(slot), np.int64), mask=slot < 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        for b in batches:
            ks = b.column("k").to_numpy()
            for k in range(2, LONGEST + 1):
                own = b.filter(pa.array(ks == k))
                if not own.num_rows:
                    continue
                w = np.frombuffer(b"".join(own.column("words").to_pylist()), "<u8").reshape(-1, k).astype(U)
                key = lambda x, y: [f(w[:, x:y].ravel(), y - x)[:: y - x] for f in (first_hashes, second_hashes)]  # noqa: E731, B023
                part = {"one": own.column("one"), "two": own.column("two"), "a": look(*key(0, k))}
                for j in range(1, LONGEST):
                    part[f"l{j}"], part[f"r{j}"] = (look(*key(0, j)), look(*key(j, k))) if j < k else (pa.nulls(own.num_rows, pa.int64()),) * 2
                for name, (x, y) in (("head", (0, k - 1)), ("tail", (1, k))):
                    for number, v in zip(("one", "two"), key(x, y)):
                        part[f"{name}_{number}"] = pa.array(v.view(np.int64))
                yield pa.RecordBatch.from_arrays([part[x] for x in names], names=names)

    return run


def _bitmap(heavy: DataFrame) -> np.ndarray:
    """The buckets of a level folded to 16 bits a bucket or so, a power of two of at most 2^MAP_BITS: at
    most 2^(MAP_BITS - 6) words reach the driver and the mappers."""
    bits = min(MAP_BITS, max(10, (16 * heavy.count()).bit_length()))
    fold = F.col("bucket").cast("long").bitwiseAND((1 << bits) - 1)
    got = heavy.select(F.shiftright(fold, 6).alias("word"), F.expr("shiftleft(1L, cast(bucket & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, U)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U)
    return out


def scored(rows: DataFrame, least: int) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut (ties: the smallest) to rows with a, n, k and the
    counts of all cuts. Products are decimals of 38 digits."""
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    cut = lambda j: F.when(F.col("k") > j, F.struct(F.expr(f"(cast(1000 AS decimal(38,0)) * a * n) div (cast(l{j} AS decimal(38,0)) * r{j})").cast("long").alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
    rows = rows.where((F.col("a") >= least) & (F.col("k") > 1)).withColumns({x: wide(x) for x in ("a", "n")})
    best = rows.withColumn("best", F.array_min(F.filter(F.array(*[cut(j) for j in range(1, LONGEST)]), lambda x: x.isNotNull())))
    return best.withColumns({"l": F.col("best.l"), "r": F.col("best.r"), "score": F.col("best.score"), **{x: F.col(x).cast("long") for x in ("a", "n")}}).drop("best")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(one, two, place, word) of every word of phrases."""
    for b in batches:
        raw = b.column("words").to_pylist()
        k = np.array([len(x) // 8 for x in raw], np.int64)
        at = np.repeat(np.arange(len(raw)), k)
        place = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
        yield pa.RecordBatch.from_arrays([b.column("one").take(pa.array(at)), b.column("two").take(pa.array(at)), pa.array(place.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i8"))], names=["one", "two", "place", "word"])


def collocations(docs: DataFrame, *, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score (see the module
    and ``scored``). A phrase goes if a candidate one word longer that holds it occurs as often; one that
    is longer still would make the one between as frequent."""
    spark = docs.sparkSession
    ws = Workspace(spark, "collocations")
    source = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL")
    sums = ws.save(source.mapInArrow(lean(_count_words), "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("lang").isNotNull()), "words")
    totals = sums.where("lang IS NOT NULL").select("lang", "n")
    frequent = sums.where("word IS NOT NULL")
    coded = np.array([r["word"] for r in frequent.orderBy(F.col("n").desc(), "word").limit(CODED).select("word").collect()], np.int64).view(U)
    levels = [ws.save(frequent.select("word").mapInArrow(_word_buckets, "bucket int").distinct(), "heavy-1")]
    bitmaps = [_bitmap(levels[0])]
    corpus = ws.save(source.mapInArrow(lean(_write_words(bitmaps[0], coded)), _CORPUS), "corpus")
    spelling = corpus.where("word IS NOT NULL").groupBy("word").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    corpus = corpus.where("codes IS NOT NULL").select("codes", "rest")
    for k in range(2, LONGEST + 1):
        counted = corpus.mapInArrow(lean(_count_level(k, bitmaps[-1], coded)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        levels.append(ws.save(counted.where(F.col("n") >= least).select("bucket"), f"heavy-{k}"))
        bitmaps.append(_bitmap(levels[-1]))
    found = corpus.mapInArrow(lean(_collect(bitmaps, coded)), "words binary").distinct().mapInArrow(_keyed, _CANDIDATE)
    known = reduce(DataFrame.unionAll, [x.select(F.lit(k).alias("k"), "bucket") for k, x in enumerate(levels, 1)])
    candidates = ws.save(found.join(known, ["k", "bucket"], "left_semi"), "candidates")
    passes = -(-candidates.count() // SLOTS) or 1
    read = None
    for i in range(passes):
        mine = candidates.where(F.pmod(F.col("one"), F.lit(passes)) == i).select("one", "two").toArrow()
        table = PerfectHash(*(mine.column(x).to_numpy().view(U) for x in ("one", "two")))
        nodes = corpus.mapInArrow(lean(_count_slots(table, bitmaps, coded)), _SUMS).repartition("part", "branch").mapInArrow(_sum_rows, _SUMS)
        nodes = nodes.repartition(F.col("part")).mapInArrow(_sum_rows, _SUMS)
        counts = np.zeros(len(table.one), np.int64)
        for row in nodes.select("part", "counts").collect():
            at = row["part"] * ROW_SLOTS
            counts[at : at + len(row["counts"]) // 8] += np.frombuffer(row["counts"], "<i8")
        got = ws.save(candidates.where("k > 1").mapInArrow(_read_cuts(table, counts), _READ), f"cuts-{i}")
        read = got if read is None else read.unionAll(got)
    cuts = read.groupBy("one", "two").agg(*[F.max(x).alias(x) for x in ("a", *_CUTS)], *[F.first(f"{x}_{y}").alias(f"{x}_{y}") for x in ("head", "tail") for y in ("one", "two")])
    full = ws.save(candidates.where("k > 1").join(cuts, ["one", "two"]).where(F.col("a") >= least), "counted")
    # a part of k - 1 words: the head is the left side of the last cut, the tail the right side of the first
    last_left = F.element_at(F.array(*[F.col(f"l{j}") for j in range(1, LONGEST)]), F.col("k") - 1)
    longer = full.where("k > 2")
    held = longer.where(last_left == F.col("a")).select(F.col("head_one").alias("one"), F.col("head_two").alias("two"))
    held = held.unionAll(longer.where("r1 = a").select(F.col("tail_one").alias("one"), F.col("tail_two").alias("two"))).distinct()
    kept = ws.save(full.join(held, ["one", "two"], "left_anti"), "kept")
    spelled = kept.mapInArrow(_spelled, "one long, two long, place int, word long").join(spelling, "word")
    phrases = spelled.groupBy("one", "two").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("phrase"))
    totals = F.broadcast(totals) if totals.count() <= 10_000 else totals
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = scored(kept.join(phrases, ["one", "two"]).join(totals, "lang"), least).withColumn("salt", F.pmod(F.col("one"), F.lit(64)))
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
s AS MATERIALIZED (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS MATERIALIZED (SELECT lang, ph, len(ph) AS k, count(*) AS c FROM (
    SELECT lang, unnest([w[i:i + m] FOR m IN range(0, least(5, len(w) - i + 1))]) AS ph FROM s) GROUP BY 1, 2, 3),
t AS (SELECT lang, count(*) AS n FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT lang, ph, k, c AS a FROM f WHERE k > 1 AND c >= 100),
cut AS (SELECT lang, ph, k, a, unnest(range(1, k)) AS j FROM c),
sc AS (SELECT cut.lang, cut.ph, cut.a, j, x.c AS l, y.c AS r, t.n, CAST(CAST(1000 AS HUGEINT) * a * t.n // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.ph = cut.ph[1:j] JOIN f y ON y.lang = cut.lang AND y.ph = cut.ph[j + 1:cut.k] JOIN t ON t.lang = cut.lang),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
held AS (SELECT DISTINCT lang, unnest([ph[1:k - 1], ph[2:k]]) AS ph, a FROM c WHERE k > 2),
kept AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM best b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = b.lang AND h.ph = b.ph AND h.a >= b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
