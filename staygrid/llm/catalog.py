"""The operators and the pipeline as named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staygrid.llm import (
    alignment, conversations, decontamination, html_crf, lengths, licenses, ordermin, packing, pieces, repetition,
    simhash, toxicity, urls,
)
from staygrid.llm.frames import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.with_suffix_sums(lengths.length_histogram(read_table(spark, sf_dir, "documents")))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition.quality_rules(read_table(spark, sf_dir, "documents"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "covered_words", "longest_repeat",
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(urls.by_unwanted_words(pages)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    found = html_crf.extract(pages, html_crf.train(pages))
    return found.select("page_id", "url", "text", "n_chars", "n_blocks", "n_main")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a sampled segmentation, and the length and hash of what they decode to."""
    decoded = pieces.decode(pieces.encode(read_table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"),
        F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compared(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measured(read_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damaged(read_table(spark, sf_dir, "conversations"))
    return conversations.audit(damaged, damaged["dropped"])


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_packing, op2_token_counts, op3_license_scans, op4_quality_rules, op5_simhash,
        op6_url_filters, op7_html_extraction, op8_sentencepiece, op9_fingerprints, op10_toxicity,
        op11_alignment, op12_decontamination, op13_conversations,
    )
}

# None of these can be put as SQL; tests/llm holds each against a brute-force version.
ORACLE: dict[str, str] = {}
