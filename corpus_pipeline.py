"""A corpus pipeline of five stages over ``documents``.

Every stage gets what its predecessor kept, written as Parquet to the shared folder and read back.
All stages but the last return the columns of ``documents``; the last one returns packed pieces.
Stages work on rows: ids may be null or repeat, extra columns of any name come through unchanged,
empty tables give empty tables, and results do not depend on how the rows are partitioned. SQL
cannot express the stages (n-gram centroids, sketches, keyed permutations, a tokenizer), so
``ORACLE_SQL`` is None and tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import langid, mixing, nearduplicates, packing, pii, tokens
from quantloom.llm.workspace import Workspace

KEY = "quantloom pipeline key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: null texts, texts without letters,
    texts unlike every learned language. The classifier learns from the labelled documents that have
    an id; without any, no language is known and every document goes."""
    model = langid.train(docs, use=F.col("doc_id").isNotNull())
    return langid.identify(docs, model, prefix="__langid_").where(~F.col("__langid_rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8): the one
    with the smallest id, of equal ids (or none) the one with the smallest row digest. Documents
    without words are near nothing and stay, repeated rows of them once."""
    return nearduplicates.one_of_each(docs, k=5)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows a text that changed. Null texts stay null,
    and every row stays."""
    out = pii.pseudonymise(docs.select(F.struct(*docs.columns).alias("row"), "text"), KEY)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_pseudonyms") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 90 % of all words at the target weights, no row twice. Documents without words take no
    part in the mix and go."""
    return mixing.mix_sources(docs, share=0.9, most_epochs=1, carry=True).where("taken > 0").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; a null or empty text is its end id."""
    return packing.pack(docs.select("doc_id", "text"), tokens.default_tokenizer())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pseudonyms", pseudonyms), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
