"""Benchmark decontamination by winnowing.

Every stretch of ``SPAN`` words is a window of SPAN - GRAM + 1 word k-grams; the least
k-gram hash of the window is its fingerprint. Equal stretches have equal fingerprints, so
a stretch that documents and benchmark share is never missed. Documents keep only the
fingerprints that some benchmark item has (a bit map of fixed size tells most of the
others apart, the join decides), and a hit is extended to the whole windows the
fingerprint stands for, which are joined with the items' windows. An item shorter than a
window is compared as a whole.

Windows that the same items hold share the number of that set of items, and documents hit
by the same sets share one list, so a passage that many documents and many items have is
not paired up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, id_and_text, map_batches, text_of
from staygrid.llm.ordermin import mixed
from staygrid.session import stored

# Words of a window, and of the k-grams whose least hash is its fingerprint.
SPAN = 10
GRAM = 5
# Bits of the map of the items' fingerprints: half a megabyte, whatever their number.
MAP_BITS = 22
SEED = 42
WORDS_KNOWN, LONGEST_KNOWN = 500_000, 64
# A longer text is split into words in stretches of this many bytes.
BYTES_TOGETHER = 1 << 24

# Words keep ASCII digits and letters, in lower case, and everything beyond ASCII.
KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
KEY = ["length", "fingerprint", "window"]


class Words(dict):
    """Hash of each word, computed once for the usual ones."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST_KNOWN:
            if len(self) >= WORDS_KNOWN:
                self.clear()
            self[word] = value
        return value


def codes_of(text: str, known: Words) -> list[np.ndarray]:
    """Hashes of the words of a text, in order, a stretch at a time."""
    raw, at, found = text.encode().translate(KEPT), 0, []
    while at < len(raw):
        stop = len(raw)
        if stop - at > BYTES_TOGETHER:
            stop = (raw.rfind(b" ", at, at + BYTES_TOGETHER) + 1) or (raw.find(b" ", at + BYTES_TOGETHER) + 1) or stop
        words = raw[at:stop].split()
        found.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = stop
    return found


def factors(n: int, turn: int) -> np.ndarray:
    return mixed(np.arange(1 + 1000 * turn, n + 1 + 1000 * turn, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def grams(codes: np.ndarray, size: int, turn: int) -> np.ndarray:
    """A hash of each ``size`` consecutive codes; ``turn`` picks the function."""
    count = max(0, len(codes) - size + 1)
    out = np.full(count, size, np.uint64)
    for k, factor in enumerate(factors(size, turn)):
        out += codes[k : k + count] * factor
    return mixed(out)


def grams_at(codes: np.ndarray, at: np.ndarray, size: int, turn: int) -> np.ndarray:
    out = np.full(len(at), size, np.uint64)
    for k, factor in enumerate(factors(size, turn)):
        out += codes[at + k] * factor
    return mixed(out)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def fingerprints(codes: np.ndarray, length: int, span: int, gram: int) -> np.ndarray:
    """Of each window of ``length`` words: the least k-gram hash of a full window; a short
    item's window is one gram."""
    if length < span:
        return grams(codes, length, 1)
    return least_of(grams(codes, gram, 1), span - gram + 1) if len(codes) >= span else np.zeros(0, np.uint64)


def item_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(item_id, length, fingerprint, window): the different windows of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                codes = np.concatenate([np.zeros(0, np.uint64), *codes_of(text, known)])
                if not len(codes):
                    continue
                length = min(span, len(codes))
                prints = fingerprints(codes, length, span, gram)
                for k in range(0, len(prints), 100_000):
                    some = prints[k : k + 100_000]
                    yield batch_of(
                        item_id=pa.array([item] * len(some), pa.string()),
                        length=pa.array(np.full(len(some), length, np.int32)),
                        fingerprint=pa.array(some.view(np.int64)),
                        window=pa.array(grams_at(codes, np.arange(k, k + len(some)), length, 2).view(np.int64)),
                    )

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_of().alias("text"))
    schema = "item_id string, length int, fingerprint long, window long"
    return map_batches(named, cut, schema).distinct()


def map_of(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bit map of all fingerprints and the lengths of short windows (below ``SPAN``)."""
    bit = F.shiftrightunsigned("fingerprint", 64 - MAP_BITS)
    lit = windows.select("length", F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
    rows = lit.groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"), F.collect_set("length").alias("lengths")
    ).collect()  # at most 2^16 rows of at most SPAN lengths
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in rows:
        bits[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF
    return bits, sorted({n for r in rows for n in r.lengths})


def scanned(rows: DataFrame, bits: np.ndarray, lengths: list[int], span: int, gram: int) -> DataFrame:
    """(row_id, doc_id, n_words, found): every row, with its windows whose fingerprints are
    in the map. Rows of a batch are searched together."""

    def in_map(prints: np.ndarray) -> np.ndarray:
        place = prints >> np.uint64(64 - MAP_BITS)
        return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def candidates(codes: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Starts of windows that do not reach beyond their text (``last`` word + 1)."""
        for length in lengths:
            prints = fingerprints(codes, length, span, gram)
            if not len(prints):
                continue
            new = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            kept = in_map(prints[new])  # each run of equal fingerprints is one
            run = np.diff(np.concatenate([new, [len(prints)]]))[kept]
            at = np.repeat(new[kept], run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
            yield at[last[np.searchsorted(last, at, "right")] >= at + length], length

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            words = [codes_of(text, known) for text in batch["text"].to_pylist()]
            sizes = np.array([sum(map(len, w)) for w in words], np.int64)
            codes = np.concatenate([np.zeros(0, np.uint64), *(c for w in words for c in w)])
            del words
            last = np.cumsum(sizes)
            parts = [(at, np.full(len(at), length), codes, length) for at, length in candidates(codes, last)]
            start = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
            none = np.zeros(0, np.uint64)
            length = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
            prints = [fingerprints(codes, n, span, gram)[at] for at, _, _, n in parts]
            whole = [grams_at(codes, at, n, 2) for at, _, _, n in parts]
            row = np.searchsorted(last, start, "right")
            order = np.lexsort((start, row))
            fields = {
                "start": start[order] - (last - sizes)[row[order]] if len(row) else start,
                "length": length[order].astype(np.int32),
                "fingerprint": np.concatenate([none, *prints])[order].view(np.int64),
                "window": np.concatenate([none, *whole])[order].view(np.int64),
            }
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
            yield batch_of(
                row_id=batch["row_id"], doc_id=batch["doc_id"], n_words=pa.array(sizes),
                found=pa.ListArray.from_arrays(pa.array(ends), structs),
            )

    found = "array<struct<start:long,length:int,fingerprint:long,window:long>>"
    return map_batches(rows, searched, f"row_id long, doc_id long, n_words long, found {found}")


def set_number(member: str) -> Column:
    """A number of the set of different members, whatever their order."""
    return F.concat_ws(
        "-", F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(F.lit(1), member))), F.hex(F.bit_xor(F.xxhash64(F.lit(2), member)))
    )


def hits_of(found: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, start, length, items) of all windows that are an item's, ``items`` being
    the number of the set of items; and those sets as (items, item_id)."""
    numbered = stored(held.groupBy(*KEY).agg(set_number("item_id").alias("items")), "leak-windows")
    first = numbered.groupBy("items").agg(F.min(F.struct(*KEY)).alias("w")).select("items", "w.*")
    # A hot window has one row on the other side; the join's size decides how it is done.
    exploded = found.select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    return exploded.join(numbered, KEY).select("row_id", "start", "length", "items"), held.join(first, KEY).select("items", "item_id")


def spans_of(hits: DataFrame) -> DataFrame:
    """(row_id, start, stop): hit words of a document as stretches that do not touch."""
    mine = Window.partitionBy("row_id").orderBy("start", "stop")
    ends = hits.select("row_id", "start", (F.col("start") + F.col("length")).alias("stop"))
    before = F.max("stop").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ends.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    placed = fresh.withColumn("_span", F.sum("_new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy("row_id", "_span").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_span")


def _searched(docs: DataFrame, items: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    held = stored(item_windows(items, span, gram), "leak-items")
    bits, lengths = map_of(held)
    rows = id_and_text(docs).withColumn("row_id", F.monotonically_increasing_id())
    found = stored(scanned(rows, bits, lengths, span, gram), "leak-found")
    hits, sets = hits_of(found, held)
    return found, stored(hits, "leak-hits"), sets


def spans(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, stop): the stretches of words of each document that lie in a window
    of some item, largest stretches first joined. Rows without one are not listed; for odd
    rows see ``decontaminate``."""
    found, hits, _ = _searched(docs, items, span, gram)
    return found.select("row_id", "doc_id").join(spans_of(hits), "row_id").drop("row_id")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``span`` consecutive words of an item, or all words of a shorter one. A
    word inside an occurrence of a window is hit; ``n_items`` are the items whose windows
    occur, and the hash is that of their ids, sorted as text, with commas.

    Null texts have no words, in either table; an item without words has no window. Equal
    item ids are one item, a null item id is written as an empty one. Repeated rows and
    rows of null or equal doc_id are judged one by one; no rows give no rows; without
    items nothing is hit; other columns are not read. Long texts are split in stretches;
    their hashes, eight bytes a word, are held together. Windows are compared by two
    64-bit hashes. Jobs run while the plan is built.
    """
    found, hits, sets = _searched(docs, items, span, gram)
    hit = spans_of(hits).groupBy("row_id").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"))

    mine = stored(hits.select("row_id", "items").distinct(), "leak-sets")
    lists = stored(mine.groupBy("row_id").agg(set_number("items").alias("list")), "leak-lists")
    first = lists.groupBy("list").agg(F.min("row_id").alias("row_id"))
    # One row per different list of sets, not per document.
    named = first.join(mine, "row_id").join(sets, "items").select("list", "item_id").distinct()
    named = named.groupBy("list").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).select(
        "list", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")
    )
    judged = hit.join(lists, "row_id").join(named, "list").drop("list")
    return found.select("row_id", "doc_id", "n_words").join(judged, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
