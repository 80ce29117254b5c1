"""Exact histogram of encoded lengths and what suffix sums over it answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, id_and_text, map_batches
from staygrid.llm.tokens import byte_pairs, default_paths
from staygrid.session import stored

# Lengths are summed within blocks of this many, then over the blocks.
BLOCK = 4096


def length_histogram(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length.

    Null and empty texts have length 0; every row counts, repeated or not, and equal
    lengths are one row; no rows give no rows; other columns of ``docs`` are not read.
    Very long texts are encoded whole. Tasks count their own rows first, so the shuffle
    carries one row per length and task. Stored once, so that what is asked of it does
    not encode the documents again.
    """
    ranks_path, tokenizer_path = paths or default_paths()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pairs(ranks_path, tokenizer_path)
        for batch in batches:
            lengths = [len(ids) for ids in encoder.encode(batch["text"])]
            if lengths:
                value, count = np.unique(np.array(lengths, np.int64), return_counts=True)
                yield batch_of(n_tokens=pa.array(value), n_docs=pa.array(count.astype(np.int64)))

    counts = map_batches(id_and_text(docs).select("text"), counted, "n_tokens long, n_docs long")
    return stored(counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: documents and ids at or above it, the total if all are cut there.

    Suffix sums are taken within blocks of lengths and over the blocks, so no task sees
    more than ``BLOCK`` lengths or one row per block. Columns added: ``docs_at_least``,
    ``tokens_at_least``, ``docs_at_most``, ``truncated_total`` (sum of the smaller of
    each document's length and this one), ``total_tokens``, ``total_docs``.
    """
    rows = histogram.select(
        "n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).cast("long").alias("_block"),
        (F.col("n_tokens") * F.col("n_docs")).alias("_tokens"),
    )
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    # One row per block: the longest document / BLOCK at most.
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    carried = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_d").over(everything).alias("total_docs"),
        F.sum("_t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens"))
    joined = rows.join(carried, "_block").select(
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.sum("n_docs").over(inside) + F.col("_docs_above")).alias("docs_at_least"),
        (F.sum("_tokens").over(inside) + F.col("_tokens_above")).alias("tokens_at_least"),
    )
    return joined.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (
            F.col("total_tokens") - F.col("tokens_at_least")
            + F.col("n_tokens") * F.col("docs_at_least")
        ).alias("truncated_total"),
        "total_tokens", "total_docs",
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut) for any limits, from the suffix sums.

    The first length at or above a limit tells how many documents reach it; ids below
    it are the total less those at least as long.
    """
    asked = sums.select(F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit"), "*")
    longer = F.col("n_tokens") > F.col("context_limit")
    return asked.groupBy("context_limit").agg(
        (
            F.max("total_tokens")
            - F.coalesce(F.max(F.when(longer, F.col("tokens_at_least"))), F.lit(0))
            + F.col("context_limit") * F.coalesce(F.max(F.when(longer, F.col("docs_at_least"))), F.lit(0))
        ).alias("truncated_total"),
        F.coalesce(F.max(F.when(longer, F.col("docs_at_least"))), F.lit(0)).alias("docs_cut"),
    )


def length_quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents keep to."""
    asked = sums.select(F.explode(F.array(*[F.lit(x).cast("double") for x in shares])).alias("share"), "*")
    return (
        asked.where(F.col("docs_at_most") >= F.col("share") * F.col("total_docs"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
