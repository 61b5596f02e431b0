"""Language identification by nearest centroid over TF-IDF character n-grams.

Texts become L2-normalised vectors of hashed byte 1- to 3-grams of their letters (lower case),
weighted by log term frequency and learned inverse document frequency. Each language has several
centroids from spherical k-means; a text gets the language of the centroid with the largest
cosine. A text is rejected if its distance 1 - cosine to every centroid exceeds ``reject_distance``,
or if its cosine is below the floor of the language found. Floors are learned: ``MARGIN`` of a low
quantile of the training texts' scores, each scored without its own share in its centroid. The
cosine of a short text is small by nature, so below ``FULL_GRAMS`` distinct n-grams floors shrink
with the square root of their number; a few words of an unlearned language
or a few characters over and over may stay.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; with
no labelled rows every text is ``und``; ties go to the first language in code-point order; repeated
rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quantloom.llm.textnp import chunks, lean, strings
from quantloom.llm.workspace import Workspace

DIMS, ROWS = 4096, 256
#: Bound of the labelled sample that the classifier is fitted on: rows of one language.
SAMPLE_PER_LANG = 800
#: Languages whose centroids a pass over the texts compares at once; more take more passes.
LANGS_AT_ONCE = 500
#: Up to so many languages their row counts are broadcast; more meet the rows in a join.
BROADCAST_LANGS = 10_000
#: Floors of the score: quantile of the training scores, part of it, distinct n-grams of a full-size text.
LOW_QUANTILE, MARGIN, FULL_GRAMS = 0.05, 0.4, 250
_LETTERS = np.arange(256)
_LETTERS = np.where((_LETTERS >= 128) | ((_LETTERS >= 97) & (_LETTERS <= 122)), _LETTERS, 32).astype(np.uint32)


def gram_counts(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams, one row per text (null as empty)."""
    off, data = strings(pc.utf8_lower(column))
    n = len(off) - 1
    c = _LETTERS[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    out = np.zeros(n * dims, np.float32)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    code = np.zeros(len(c), np.uint32)
    for size in (1, 2, 3):
        m = len(c) - size + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | c[size - 1 :]
        ok = doc[size - 1 :] == doc[:m]
        if size == 1:
            ok &= c != 32
        else:  # grams with two blanks in a row say nothing
            blank = c == 32
            for j in range(size - 1):
                ok &= ~(blank[j : j + m] & blank[j + 1 : j + 1 + m])
        bucket = ((code + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> shift
        out += np.bincount((doc[:m] * dims + bucket)[ok], minlength=n * dims).astype(np.float32)
    return out.reshape(n, dims)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


@dataclass
class Block:
    """Centroids of some languages, in order of the languages."""

    centroids: np.ndarray  # unit rows
    langs: list[str]  # of each centroid
    floors: np.ndarray  # of each centroid's language, for a text of full size

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the best centroid, score, floor for a full-size text) of every vector."""
        cos = x @ self.centroids.T
        best = cos.argmax(1)
        return best, np.clip(cos[np.arange(len(cos)), best], 0, 1).astype(np.float64), self.floors[best]


@dataclass
class Model:
    """``table``: lang, at (0 to the language's centroids), vector (float32), floor, on shared storage."""

    idf: np.ndarray
    langs: list[str]
    table: DataFrame

    def blocks(self, at_once: int) -> Iterator[Block]:
        for i in range(0, len(self.langs), at_once):
            rows = self.table.where(F.col("lang").between(self.langs[i], self.langs[min(i + at_once, len(self.langs)) - 1])).collect()
            rows.sort(key=lambda r: (r["lang"], r["at"]))
            yield Block(np.stack([np.frombuffer(r["vector"], np.float32) for r in rows]), [r["lang"] for r in rows], np.array([r["floor"] for r in rows]))


def full_size(counts: np.ndarray) -> np.ndarray:
    """What a text's size leaves of the score that a long text of its language has: 1 from FULL_GRAMS on."""
    return np.sqrt(np.minimum((counts > 0).sum(1), FULL_GRAMS) / FULL_GRAMS)


def floor_of(own: np.ndarray, cents: np.ndarray, size: np.ndarray) -> float:
    """The floor learned from a language's unit vectors; a text does not vouch for itself."""
    cos = own @ cents.T
    at, i = cos.argmax(1), np.arange(len(own))
    total = np.array([own[at == j].sum(0) for j in range(len(cents))])
    dot = (own * total[at]).sum(1)
    rest = (total * total).sum(1)[at] - 2 * dot + 1
    cos[i, at] = np.where(rest > 1e-3, (dot - 1) / np.sqrt(np.maximum(rest, 1e-3)), 0)
    return MARGIN * float(np.quantile(np.clip(cos.max(1) / np.maximum(size, 1e-3), 0, 1), LOW_QUANTILE))


def fit(own: np.ndarray, size: np.ndarray, centroids: int = 4, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """(centroids, floor) of one language by spherical k-means over its unit vectors."""
    k = min(centroids, len(own))
    rng = np.random.default_rng(seed)
    c = [own.sum(0)]  # the mean direction first, then far-off texts
    while len(c) < k:
        d = np.clip(1 - (own @ _unit(np.array(c)).T).max(1), 0, None).astype(float)
        c.append(own[rng.choice(len(own), p=d / d.sum())] if d.sum() > 0 else own[0])
    c = _unit(np.array(c))
    for _ in range(rounds):
        at = (own @ c.T).argmax(1)
        c = _unit(np.array([own[at == j].sum(0) if (at == j).any() else c[j] for j in range(k)]))
    return c.astype(np.float32), floor_of(own, c, size)


def sample(docs: DataFrame, ws: Workspace, *, use: Column, doc_id: str, text: str, lang: str, sample_per_lang: int) -> DataFrame:
    """(lang, doc_id, text) of the ``sample_per_lang`` labelled rows of each language, with a letter in their
    text, that have the smallest hashes of id and text.

    Counts come first; then only rows below a hash threshold that leaves about twice the sample are
    shuffled and ranked, so a task gets the same number of rows at any size of the corpus. Equal rows share
    a hash: the threshold of a language that has too few rows below it is raised until it has enough, so
    none is lost, and rows are ranked in 64 parts first, so that many equal rows are not one task's."""
    keyed = docs.where(use & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = ws.save(keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("below", F.lit(2.0 * sample_per_lang + 50)), "counts")
    hint = F.broadcast if counts.count() <= BROADCAST_LANGS else lambda x: x
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    hashed = keyed.withColumn("share", share)

    def near(counts: DataFrame) -> DataFrame:
        return hashed.join(hint(counts), "lang").where(F.col("share") * F.col("n") <= F.col("below"))

    while True:
        have = near(counts).groupBy("lang").agg(F.count(F.lit(1)).alias("have"))
        short = F.coalesce("have", F.lit(0)) < F.least("n", F.lit(sample_per_lang))
        seen = ws.save(counts.join(have, "lang", "left").withColumn("short", short), "near")
        if seen.where("short").isEmpty():
            break
        counts = seen.select("lang", "n", F.when(F.col("short"), F.col("below") * 16).otherwise(F.col("below")).alias("below"))
    order = ["share", "doc_id", F.xxhash64("text")]
    some = near(counts).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= sample_per_lang)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("r", rank).where(F.col("r") <= sample_per_lang).select("lang", "doc_id", "text")


def train(docs: DataFrame, *, use: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, dims: int = DIMS) -> Model | None:
    """Fits each language in a task of its own; the driver gets the document frequencies of the n-grams
    (``dims`` numbers) and the languages' names."""
    ws = Workspace(docs.sparkSession, "langid")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", rows=ROWS):
            keep = b.filter(pa.array(has_letter(b.column("text"))))
            x = gram_counts(keep.column("text"), dims)
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays([keep.column("lang"), keep.column("doc_id"), pa.array([i.tolist() for i in at], pa.list_(pa.int32())), pa.array([r[i].astype("<f4").tobytes() for r, i in zip(x, at)], pa.binary())], names=["lang", "doc_id", "at", "n"])

    chosen = sample(docs, ws, use=use, doc_id=doc_id, text=text, lang=lang, sample_per_lang=sample_per_lang)
    table = ws.save(chosen.mapInArrow(lean(features), f"lang string, doc_id {docs.schema[doc_id].dataType.simpleString()}, at array<int>, n binary"), "features")
    rows = table.count()
    if not rows:
        return None
    df = np.zeros(dims)
    for r in table.select(F.explode("at").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["i"]] = r["n"]
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)

    def fit_one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=[tuple(a) for a in pdf["at"]]).sort_values(["doc_id", "order"], ignore_index=True)
        counts = np.zeros((len(pdf), dims), np.float32)
        for i, (at, n) in enumerate(zip(pdf["at"], pdf["n"])):
            counts[i, at] = np.frombuffer(n, "<f4")
        c, floor = fit(vectors(counts, idf), full_size(counts))
        return pd.DataFrame({"lang": key[0], "at": range(len(c)), "vector": [r.tobytes() for r in c], "floor": floor})

    fitted = ws.save(table.groupBy("lang").applyInPandas(fit_one, "lang string, at int, vector binary, floor double"), "centroids")
    return Model(idf, sorted(r["lang"] for r in fitted.select("lang").distinct().collect()), fitted)


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", reject_distance: float = 0.97, dims: int = DIMS, at_once: int = LANGS_AT_ONCE, prefix: str = "") -> DataFrame:
    """Adds lang_pred, score and rejected (each with ``prefix``) to every row; texts stay where they are.

    Columns of these names that the table has already are refused. Beyond ``at_once`` languages each
    pass over the table meets the centroids of so many, and keeps what is nearest so far."""
    new = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"the table has {', '.join(sorted(clash))} already; use another prefix")
    if model is None:
        return docs.select("*", F.lit("und").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(True).alias(new[2]))
    idf, n, names = model.idf, len(docs.columns), [*docs.columns, *new]
    schema = StructType(list(docs.schema.fields)).add(new[0], "string").add(new[1], "double").add(new[2], "boolean")

    def against(block: Block, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, text, rows=ROWS):
                letters = has_letter(b.column(text))
                counts = gram_counts(b.column(text), dims)
                best, score, floor = block.predict(vectors(counts, idf))
                score = np.where(letters, score, 0.0)
                pred = [block.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters)]
                out = ~letters | (score < np.maximum(1 - reject_distance, floor * full_size(counts)))
                if not first:
                    was = b.column(n + 1).to_numpy()
                    stay = ~letters | (was >= score)
                    pred = [old if s else p for old, p, s in zip(b.column(n).to_pylist(), pred, stay)]
                    score, out = np.where(stay, was, score), np.where(stay, b.column(n + 2).to_numpy(zero_copy_only=False), out)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(pred, pa.string()), pa.array(score), pa.array(out.astype(bool))], names=names)

        return lean(run)

    got = docs
    for i, block in enumerate(model.blocks(at_once)):
        if i:
            got = Workspace(docs.sparkSession, "langid").save(got, "so-far")
        got = got.mapInArrow(against(block, i == 0), schema)
    return got


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, use=F.col("doc_id").isNotNull() & ~held)
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
