"""Near-duplicate documents by HyperMinHash.

A document is the set of its k-word shingles (64-bit hashes). Its sketch has one 16-bit register
per bucket: the leading-zero count of the bucket's smallest hash and the mantissa bits after its
first one, i.e. a tiny floating-point number. Bands of compressed registers propose candidates, the
collision-corrected Jaccard estimate thins them, and links count only when the full sets confirm
them. The result is the connected components of all confirmed links.

Finding every component does not take every pair:
1. Equal sets are one class, found by a 128-bit digest. Classes are the nodes of the graph, and have
   numbers of their own; one row stands for the texts of a class.
2. Star rounds: in each band bucket members meet a hashed leader of another component. A class
   verifies one leader a round, the one it meets in most bands, so copies collapse in a few rounds
   and in linear work.
3. What is still in several components within a bucket is compared in full, in cells of bounded
   size: members outside the bucket's largest component against all members. Only pairs that pass the
   estimate and join different components are verified, in parts whose sets are bounded together.
No partner is capped, and buckets of any size are split into cells.

Defined results: null or wordless text has no shingles, is linked with nothing and is kept; with
fewer than k words the whole sequence is one shingle. Every row is judged by its own text: rows that
share an id but not their sets are separate nodes, rows of one class are together whatever their
ids. A null id is kept; its component is named by the smallest id that is not null, if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.components import components
from quantloom.llm.textnp import Powers, U, chunks, grams, lean, mix, strings, word_hashes, words
from quantloom.llm.workspace import Workspace

REGISTERS, ROWS, MANTISSA = 128, 4, 10
_LAST = 2**63 - 1  # in place of a null id
#: Most members on either side of a comparison cell.
CELL_MINOR, CELL_ALL = 1024, 1024
#: Pairs of members whose bands and estimates are worked out together.
PAIRS_AT_ONCE = 1 << 15
#: Most shingle hashes that one part of a cell holds for verification (a larger pair is a part of its own).
PART_HASHES = 4_000_000
STAR_ROUNDS = 3


def shingle_sets(column: pa.Array, k: int, pows: Powers, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    off, data = strings(column)
    begin, end, first = words(off, data)
    h = word_hashes(data, begin, end, pows, lower)
    g = grams(h, k)
    n = np.diff(first)
    out = []
    for i in range(len(n)):
        if n[i] >= k:
            out.append(np.unique(g[first[i] : first[i + 1] - k + 1]))
        elif n[i]:
            out.append(grams(h[first[i] : first[i + 1]], int(n[i])) ^ U(int(n[i])))
        else:
            out.append(np.zeros(0, U))
    return out


def sketch(sets: list[np.ndarray], registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Registers of every set, 0 where a bucket is empty; equal minima give equal registers."""
    bits = registers.bit_length() - 1
    edges = np.arange(registers, dtype=U) << U(64 - bits)
    low = np.zeros((len(sets), registers), U)
    there = np.zeros((len(sets), registers), bool)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        at = np.searchsorted(s, edges)
        found = np.minimum(at, len(s) - 1)
        ok = (at < len(s)) & (s[found] >> U(64 - bits) == edges >> U(64 - bits))
        low[i], there[i] = s[found], ok
    rest = (low << U(bits)) | U(1 << (bits - 1))  # never zero
    _, exponent = np.frexp((rest >> U(11)).astype(np.float64))  # 53 bits are exact
    exponent = np.maximum(exponent, 1)
    zeros = 53 - exponent
    tail = (rest >> U(11)) << (U(64) - exponent.astype(U)) << U(1)  # what follows the first one, left-aligned
    register = (zeros.astype(np.uint32) << mantissa) + (tail >> U(64 - mantissa)).astype(np.uint32) + 1
    return np.where(there, register, 0).astype(np.uint16)


def collision_rate(n: np.ndarray, m: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Chance that registers of two disjoint sets of sizes n and m agree: over the exponential
    densities of both minima, integrated octave by octave with cells of 2^-mantissa of an octave."""
    a, b = np.asarray(n, float)[:, None] / registers, np.asarray(m, float)[:, None] / registers
    top = 2.0 ** -np.arange(0, 40)
    s = a + b
    cell = top / 2 / 2**mantissa
    return np.clip((a * b / s * cell * (np.exp(-s * top / 2) - np.exp(-s * top))).sum(1), 0, 0.5)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, registers it rests on) of paired sketches."""
    used = ((x != 0) | (y != 0)).sum(-1)
    same = ((x == y) & (x != 0)).sum(-1)
    c = collision_rate(n, m)
    return np.clip((same / np.maximum(used, 1) - c) / (1 - c), 0, 1), used


def passes(est: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keeps what can reach num/den: five standard deviations below it, sizes close enough."""
    j = num / den
    return (est >= j - 5 * np.sqrt(j * (1 - j) / np.maximum(used, 1))) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def confirmed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(keys by document and band, which bands have a register at all)."""
    parts = sig.reshape(len(sig), -1, rows).astype(U)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=U) + U(0x1234567), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64), parts.any(2)


def _sig(column: pa.Array) -> np.ndarray:
    _, data = strings(column)
    return data.view(np.uint16).reshape(len(column), -1)


def _set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, U)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit words that name each set, as int64 rows."""
    d = np.array([[s.sum(dtype=U) ^ U(len(s)), mix(s).sum(dtype=U)] if len(s) else [0, 0] for s in sets], U).reshape(-1, 2)
    d[:, 0] = mix(d[:, 0])
    return d.view(np.int64)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, star_rounds: int = STAR_ROUNDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, kept, and the columns in ``carry``.

    Linked are texts with den * |intersection| >= num * |union|. ``class_id`` is the smallest id with
    the same set, ``component_id`` the smallest id that links lead to. ``group`` names the component
    by a number, for rows of any id; it is null for texts without words.
    """
    ws = Workspace(docs.sparkSession, "nearduplicates")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("th"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    carried = rows.schema["carried"].dataType.simpleString()

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in chunks(batches, "text"):
            sets = shingle_sets(b.column("text"), k, pows)
            d = digests(sets)
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([s.tobytes() for s in sketch(sets)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), b.column("carried"), *own], names=["doc_id", "th", "carried", "n", "d1", "d2", "sig"])

    sigs = ws.save(rows.mapInArrow(lean(sketches), f"doc_id long, th long, carried {carried}, n long, d1 long, d2 long, sig binary"), "sketches")
    row = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "th")
    classes = sigs.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.min(row).alias("row"), F.min("n").alias("n"), F.first("sig").alias("sig"))
    classes = ws.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, there = band_keys(_sig(b.column("sig")))
            ids = np.broadcast_to(b.column("id").to_numpy()[:, None], key.shape)
            yield pa.RecordBatch.from_arrays([pa.array(key[there]), pa.array(ids[there])], names=["g", "id"])

    banded = classes.select("id", "sig").mapInArrow(lean(bands), "g long, id long")
    shared = banded.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("g", "c")
    members = ws.save(banded.join(shared, "g"), "members")
    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select(F.col("row.id").alias("key"), F.col("row.th").alias("th"), "id", "d1", "d2")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = Powers()
        for b in chunks(batches, "text"):
            sets = shingle_sets(b.column("text"), k, pows)
            ok = (digests(sets) == np.stack([b.column(c).to_numpy() for c in ("d1", "d2")], 1)).all(1)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), pa.array([s.tobytes() for s, o in zip(sets, ok) if o], pa.binary())], names=["id", "words"])

    texts = rows.select(F.coalesce("doc_id", F.lit(_LAST)).alias("key"), "th", "text").groupBy("key", "th").agg(F.first("text").alias("text"))
    sets = ws.save(texts.join(wanted, ["key", "th"]).select("id", "d1", "d2", "text").mapInArrow(lean(full_sets), "id long, words binary"), "sets")
    small = classes.select("id", "n", "sig")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
                est, used = estimate(_sig(b.column("sig_a")), _sig(b.column("sig_b")), n, m)
                yield b.select(["a", "b"]).filter(pa.array(passes(est, used, n, m, num, den)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [confirmed(_set(x), _set(y), num, den) for x, y in zip(b.column("words_a").to_pylist(), b.column("words_b").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in table.columns]), side)
        return pairs

    links, comp = None, None
    for r in range(star_rounds):
        now = members.select("g", "id") if comp is None else members.join(comp, "id", "left").select("g", "id", F.coalesce("component", "id").alias("component"))
        if comp is None:
            now = now.withColumn("component", F.col("id"))
        # a hashed leader that differs from round to round, but is common to many buckets
        lead = now.groupBy("g").agg(F.min_by(F.struct("id", "component"), F.xxhash64(F.lit(r), "id")).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g", "lead")
        met = now.join(lead, "g").where(F.col("component") != F.col("lead.component")).groupBy("id", F.col("lead.id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        pick = met.groupBy("id").agg(F.max_by("b", F.struct("n", F.xxhash64(F.lit(r), "b"))).alias("b")).select(F.col("id").alias("a"), "b")
        pairs = beside(pick, small).select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(lean(near), "a long, b long")
        new = ws.save(beside(pairs, sets).select("a", "b", "words_a", "words_b").mapInArrow(lean(verify), "a long, b long"), "links")
        if links is not None and new.isEmpty():
            break  # the cells take it from here
        if links is None:  # a link goes to a smaller hash, so two steps along them lead most of the way
            links, on = new, new.select(F.col("a").alias("component"), F.col("b").alias("further"))
            step = new.select(F.col("a").alias("id"), F.col("b").alias("component")).join(on, "component", "left")
            comp = ws.save(step.select("id", F.coalesce("further", "component").alias("component")), "labels")
        else:
            links = links.unionAll(new)
            comp = components(ws, links)
    links = links.unionAll(_cells(ws, members, comp, small, sets, num, den))
    comp = components(ws, links)
    rooted = classes.select("id", "d1", "d2", "class_id").join(comp, "id", "left").select("d1", "d2", "class_id", F.coalesce("component", "id").alias("group"))
    named = rooted.join(rooted.groupBy("group").agg(F.min("class_id").alias("least")), "group")
    out = sigs.select("doc_id", "n", "d1", "d2", "carried").join(named, ["d1", "d2"], "left")
    alone = F.col("n") == 0
    label = F.when(alone, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), label.alias("component_id"),
                      F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept"), F.when(~alone, F.col("group")).alias("group"), *[F.col(f"carried.`{c}`").alias(c) for c in carry])


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """The rows of ``docs`` with one of each group of near duplicates: that with the smallest id, nulls
    last, then with the smallest digest of the whole row. Rows equal in all columns are one."""
    whole = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.lit(1), whole).alias("r1"), F.xxhash64(F.lit(2), whole).alias("r2"))
    found = near_duplicates(rows.select("doc_id", "text", "r1", "r2"), k=k, carry=("r1", "r2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    stay = found.groupBy("group", *[F.when(F.col("group").isNull(), F.col(c)).alias(f"own_{c}") for c in ("r1", "r2")]).agg(F.min(order).alias("row")).select("row.r1", "row.r2")
    return rows.groupBy("r1", "r2").agg(F.first("row").alias("row")).join(stay, ["r1", "r2"], "left_semi").select("row.*")


class _Forest:
    """Union-find over the components that meet in one cell."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, whatever the batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys])
        edge = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for s, e in zip(edge[:-1], edge[1:]):
            key = tuple(k[:, s])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _parts(who: list[int], partners: list[list[int]], weight: dict[int, int], most: int = PART_HASHES) -> Iterator[dict[int, list[int]]]:
    """The pairs dealt into parts (member to partners) whose members weigh at most ``most`` together."""
    of: dict[int, list[int]] = {}
    have: set[int] = set()
    load = 0
    for x, ps in zip(who, partners):
        at_once = [ps] if load + sum(weight[i] for i in {x, *ps} - have) <= most else [[p] for p in ps]
        for some in at_once:
            more = sum(weight[i] for i in {x, *some} - have)
            if of and load + more > most:
                yield of
                of, have, load = {}, set(), 0
                more = sum(weight[i] for i in {x, *some})
            of.setdefault(x, []).extend(some)
            have |= {x, *some}
            load += more
    if of:
        yield of


def _cells(ws: Workspace, members: DataFrame, comp: DataFrame, small: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links across components that star rounds left open, found in cells of bounded size."""
    now = members.join(comp, "id", "left").select("g", "id", F.coalesce("component", "id").alias("component"))
    sizes = now.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    lead = sizes.groupBy("g").agg(F.max_by("component", F.struct("n", "component")).alias("lead"), F.sum("n").alias("c"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("g", "lead", "c")
    open_ = now.join(lead, "g").withColumn("minor", F.col("component") != F.col("lead"))
    minors = open_.groupBy("g").agg(F.sum(F.col("minor").cast("long")).alias("minors"))
    part = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    placed = open_.join(minors, "g").withColumns({"rows": part("minors", CELL_MINOR), "cols": part("c", CELL_ALL)})
    placed = placed.withColumns({"i": F.pmod(F.xxhash64(F.lit("i"), "id"), F.col("rows")).cast("int"), "j": F.pmod(F.xxhash64(F.lit("j"), "id"), F.col("cols")).cast("int")})
    key = ["g", "i", "j"]
    as_minor = placed.where("minor").select("g", "i", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("left"), "id", "component")
    as_any = placed.select("g", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), "j", F.lit(False).alias("left"), "id", "component")
    cells = as_minor.unionAll(as_any).select(*[F.col(c).cast("long").alias(c) for c in key], "left", "id", "component")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a cell that some pair of different components needs, with their partners."""
        for t in _groups(batches, key):
            left = t.column("left").to_numpy()
            if not left.any() or left.all():
                continue
            ids, com, n = (t.column(c).to_numpy() for c in ("id", "component", "n"))
            sig = _sig(t.column("sig").combine_chunks())
            minor, rest = np.flatnonzero(left), np.flatnonzero(~left)
            g, (rk, _) = t.column("g")[0].as_py(), band_keys(sig[rest])
            who, partners = [], []
            each = max(1, PAIRS_AT_ONCE // len(rest))
            for at in range(0, len(minor), each):
                some = minor[at : at + each]
                xk, there = band_keys(sig[some])
                both = (rk[None, :, :] == xk[:, None, :]) & there[:, None, :]
                i, j = np.nonzero(both.any(2) & (com[rest][None, :] != com[some][:, None]))
                first = xk[i, both[i, j].argmax(1)] == g  # a pair counts in its first common band
                i, j = i[first], j[first]
                x, y = some[i], rest[j]
                ok = passes(*estimate(sig[x], sig[y], n[x], n[y]), n[x], n[y], num, den)
                i, y = i[ok], y[ok]
                edge = np.searchsorted(i, np.arange(len(some) + 1))
                for k in np.flatnonzero(np.diff(edge)):
                    who.append(int(ids[some[k]]))
                    partners.append(np.unique(ids[y[edge[k] : edge[k + 1]]]).tolist())
            back, weight = dict(zip(ids.tolist(), com.tolist())), dict(zip(ids.tolist(), n.tolist()))
            k = [t.column(c)[0].as_py() for c in key]
            for no, of in enumerate(_parts(who, partners, weight)):
                need = sorted(set(of).union(*of.values()))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(len(need), x, np.int64)) for x in (*k, no)), pa.array(need, pa.int64()), pa.array([back[i] for i in need], pa.int64()), pa.array([np.array(of[i], np.int64).tobytes() if i in of else None for i in need], pa.binary())],
                    names=[*key, "part", "id", "component", "partners"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verifies the pairs of a cell that still join different components."""
        for t in _groups(batches, [*key, "part"]):
            sets_of = dict(zip(t.column("id").to_pylist(), t.column("words").to_pylist()))
            com = dict(zip(t.column("id").to_pylist(), t.column("component").to_pylist()))
            forest, a, b = _Forest(), [], []
            for x, p in zip(t.column("id").to_pylist(), t.column("partners").to_pylist()):
                if p is None:
                    continue
                sx = _set(sets_of[x])
                for y in np.frombuffer(p, np.int64).tolist():
                    if y in sets_of and forest.find(com[x]) != forest.find(com[y]) and confirmed(sx, _set(sets_of[y]), num, den):
                        forest.join(com[x], com[y])
                        a.append(x)
                        b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    full = cells.join(small, "id").select(*key, "left", "id", "component", "n", "sig")
    screened = full.repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(screen), "g long, i long, j long, part long, id long, component long, partners binary")
    screened = ws.save(screened, "screened")
    ready = screened.join(sets, "id").select(*key, "part", "id", "component", "partners", "words")
    return ws.save(ready.repartition(*key, "part").sortWithinPartitions(*key, "part").mapInArrow(lean(settle), "a long, b long"), "links")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4).drop("group")
