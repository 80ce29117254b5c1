"""From raw documents to packed training sequences, one stage per operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Stages handle nulls, empty tables, repeated rows and further columns as
their operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staygrid.llm import jaccard, packing, repetition, toxicity
from staygrid.llm.frames import read_table
from staygrid.session import work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; learns from the labelled ones."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits."""
    return repetition.keep_clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates.

    Linked are documents whose sets of five-word shingles have a Jaccard similarity of 0.8
    or more. SimHash finds the pairs within seven bits, an exact join those beyond; three
    words and two bits are the contract of ``op5_simhash`` alone.
    """
    return jaccard.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with their ids, one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_repetitive),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

# Learned scores, suffix arrays and byte-pair ids cannot be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            path = work_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
