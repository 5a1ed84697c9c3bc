"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing and BPE encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all that the stage before has kept
and returns a DataFrame with the columns of ``documents``, the last one the encoded documents. ``run`` writes every stage
as Parquet to the shared scratch folder and reads it again as the next one's input, so a lost executor never costs more
than the stage that runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, language_id, line_dedup, mixing, near_dedup
from emberline.llm.common import as_documents, documents, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    return language_id.keep_identified(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on more than a tenth of a source's documents go."""
    return line_dedup.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest identifier stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target weights; a document is there once per epoch that takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every document."""
    docs = as_documents(docs)
    lexicon = bpe.build_lexicon(docs)
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    return bpe.encode(keyed, lexicon, key="key").select("key.doc_id", "key.source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: A trained classifier and sampled signatures have no SQL twin; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
