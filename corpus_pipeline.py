"""A corpus pipeline: from raw documents to packed token windows.

Each stage calls one operator of ``curate.llm`` on all that the stage before it kept. All but the last return
the columns of ``documents``; a stage's result is written as Parquet and read again as input of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curate.llm import exact, jaccard, mixing, packing, toxicity
from curate.llm.frames import bounded_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment model, learned from the labels, rejects go."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, ~toxicity.held_out()))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    bounded_batches(spark)
    return exact.drop_exact(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more) stays."""
    bounded_batches(spark)
    return jaccard.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, some more than once, until each source meets its share of the words."""
    bounded_batches(spark)
    return mixing.take(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in windows of 1024 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("ngram_jaccard", drop_similar),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A trained model decides in the first stage, so no SQL gives the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
