"""Order MinHash: document fingerprints that follow the edit distance.

The k-mers of a text are numbered by occurrence, so a repeated k-mer counts as often as
it occurs. Each of many hash orders picks the least of them, the picked ones keep their
order in the text, and the tuple is hashed. Two texts agree in a tuple if they share the
k-mers in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, id_and_text, map_batches

KMER = 12
PICKED = 2
ORDERS = 32
# k-mers ranked under all orders at a time.
KMERS_TOGETHER = 1 << 16

MIX_1, MIX_2, MIX_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of each value."""
    x = (x ^ (x >> np.uint64(30))) * MIX_2
    x = (x ^ (x >> np.uint64(27))) * MIX_3
    return x ^ (x >> np.uint64(31))


FACTORS = mixed(np.arange(1, ORDERS + 1, dtype=np.uint64) * MIX_1) | np.uint64(1)


def occurrence(hashes: np.ndarray) -> np.ndarray:
    """How many equal values come before each one."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.arange(len(hashes))
    number = np.empty(len(hashes), np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return number


def signature(text: str) -> np.ndarray:
    """``ORDERS`` hashed tuples. A text shorter than a k-mer is one; an empty one has zeros."""
    if not text:
        return np.zeros(ORDERS, np.uint64)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = min(KMER, len(code))
    count = len(code) - size + 1
    kmer = np.full(count, size, np.uint64)
    for k in range(size):
        kmer *= MIX_1
        kmer += code[k : k + count]
    kmer = mixed(kmer)
    numbered = mixed(kmer + occurrence(kmer) * MIX_1)

    picked = min(PICKED, count)
    best = np.full((ORDERS, picked), ~np.uint64(0))
    where = np.zeros((ORDERS, picked), np.int64)
    rows = np.arange(ORDERS)
    for start in range(0, count, KMERS_TOGETHER):
        ranks = FACTORS[:, None] * numbered[None, start : start + KMERS_TOGETHER]
        found, at = [best], [where]
        for _ in range(min(picked, ranks.shape[1])):
            least = ranks.argmin(axis=1)
            found.append(ranks[rows, least][:, None])
            at.append(least[:, None] + start)
            ranks[rows, least] = ~np.uint64(0)
        values, places = np.hstack(found), np.hstack(at)
        keep = np.argsort(values, axis=1, kind="stable")[:, :picked]
        best, where = np.take_along_axis(values, keep, 1), np.take_along_axis(places, keep, 1)
    where.sort(axis=1)
    out = FACTORS.copy()
    for k in range(picked):
        out = mixed(out * MIX_1 + kmer[where[:, k]])
    return out


def written(signature_: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits per tuple."""
    return (signature_ >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, without a shuffle.

    Null and empty texts have the fingerprint of zeros. Repeated rows are kept, a null
    doc_id stays null, no rows give no rows, other columns of ``docs`` are not read. A
    long text is ranked in blocks of k-mers.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield batch_of(
                doc_id=batch["doc_id"],
                n_chars=pa.array([len(t) for t in texts], pa.int64()),
                fingerprint=pa.array([written(signature(t)) for t in texts], pa.string()),
            )

    return map_batches(id_and_text(docs), signed, "doc_id long, n_chars long, fingerprint string")


class Row(NamedTuple):
    doc_id: int | None
    text: str
    signature: np.ndarray


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_neighbour_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows by descending doc_id in ``parts`` ranges, each with the first row of the next.

    Adds ``part``, ``guest`` (a copy from the following range, placed last) and
    ``turn``. Ranges come from approximate quantiles of doc_id: ``parts`` numbers on the
    driver, and as many highest ids. Null ids form the last range; equal ids, and the
    nulls, are ordered by the hash of their text, so every row has a place.
    """
    rows = id_and_text(docs).withColumn("turn", F.xxhash64("text"))
    ids = rows.select("doc_id").where(F.col("doc_id").isNotNull())
    cuts = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    # Part 0 has the largest ids, the last part the null ids.
    bucketed = Bucketizer(splits=splits, inputCol="_id", outputCol="_b", handleInvalid="keep").transform(
        rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))
    )
    last = len(splits) - 1
    part = F.when(F.col("doc_id").isNull(), last).otherwise(last - 1 - F.col("_b")).cast("int")
    placed = bucketed.select("doc_id", "text", "turn", part.alias("part"))
    heads = (
        placed.groupBy("part")
        .agg(F.max("doc_id").alias("head"), F.max(F.when(F.col("doc_id").isNull(), F.col("turn"))).alias("turn"))
        .orderBy("part").collect()  # one row per part
    )
    guest_in = [
        (h["head"], h["turn"], heads[k - 1]["part"], h["part"]) for k, h in enumerate(heads)
    ]
    hosts = docs.sparkSession.createDataFrame(guest_in, "head long, head_turn long, host int, part int")
    # One row per part.
    joined = placed.join(F.broadcast(hosts), "part", "left")
    first = F.when(F.col("doc_id").isNull(), F.col("turn") == F.col("head_turn")).otherwise(
        F.col("doc_id") == F.col("head")
    )
    here = F.struct(F.col("part"), F.lit(False).alias("guest"))
    there = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    return joined.select(
        "doc_id", "text", "turn",
        F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("_at"),
    ).select("doc_id", "text", "turn", "_at.part", "_at.guest")


def compared(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to both that and
    the next document's; next means the following row by descending doc_id, after the
    last the first.

    One shuffle moves the rows into ranges of doc_id; a task holds two texts at a time. A
    single row is its own next one. Equal ids follow each other by the hash of their
    text and then the text, null ids come last. Null and empty texts are empty;
    repeated rows are kept; no rows give no rows; other columns are not read.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_neighbour_order(docs, parts)
    ordered = rows.repartitionById(parts + 2, F.col("part")).sortWithinPartitions(
        "part", "guest", F.desc_nulls_last("doc_id"), F.desc("turn"), F.desc("text")
    )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        before: Row | None = None
        part = None
        out: list[tuple] = []

        def pair(row: Row, following: Row) -> tuple:
            changed = edited(row.text, following.text)
            again = signature(changed)
            return (
                row.doc_id, len(row.text), hashlib.sha256(changed.encode()).hexdigest(),
                written(row.signature), written(again),
                likeness(row.signature, again), likeness(row.signature, following.signature),
            )

        def given() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[
                "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                "near_edited", "near_next",
            ])

        for batch in batches:
            columns = (batch[n].to_pylist() for n in ("part", "guest", "doc_id", "text"))
            for at, guest, doc_id, text in zip(*columns, strict=True):
                if at != part:
                    part, before = at, None
                if guest and before is None:
                    continue  # a further row with the id of the first guest
                row = Row(doc_id, text, signature(text))
                if before is not None:
                    out.append(pair(before, row))
                before = None if guest else row
            yield given()
            out.clear()

    return map_batches(
        ordered.select("part", "guest", "doc_id", "text"), signed,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
