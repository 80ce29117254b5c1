"""Packing of documents into training windows by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from staygrid.llm.frames import batch_of, id_and_text, map_batches
from staygrid.llm.tokens import byte_pairs, default_paths

WINDOW = 1024
SEPARATOR = 0
# Remainders are gathered until they hold this many ids (four bytes each), then placed.
GROUP_IDS = 6_000_000
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)


class OpenWindows:
    """Open windows by remaining room, in a segment tree over the rooms 0 .. window.

    A node counts the open windows below it. The tightest window for a piece is the
    leftmost non-empty leaf at or right of its length.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.at[room].append(number)
        node = room + self.leaves
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove the window with the least room of at least ``length``."""
        node, tree = length + self.leaves, self.tree
        while not tree[node]:
            while node & 1:  # a right child has nothing further right below its parent
                node >>= 1
                if node <= 1:
                    return None
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not tree[node]:
                node += 1
        room = node - self.leaves
        while node:
            tree[node] -= 1
            node >>= 1
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (1 <= length <= window), and the windows used.

    Longer pieces go first, equal lengths in the order given.
    """
    number = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    rooms, used = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        found = rooms.take(length)
        if found is None:
            found, used = (window, used), used + 1
        room, where = found
        number[k], offset[k] = where, window - room
        if room > length:
            rooms.add(room - length, where)
    return number, offset, used


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    separator: int = SEPARATOR,
    group_ids: int = GROUP_IDS,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """Sequences of at most ``window`` ids, one row per piece of a document.

    A document is its byte-pair ids and the separator. It is first cut into full
    windows; the remainders are packed by best-fit decreasing. Packing needs no
    shuffle: a task packs its own rows, ``group_ids`` remaining ids at a time, and a
    group leaves at most a few windows unfilled. ``ids`` holds the piece's ids as
    little-endian 32-bit integers. A sequence number is the task's number and a count
    within it, so the input must come in repeatable partitions (a scan does).

    Null and empty texts are one separator. Repeated rows and equal ids are packed row
    by row. A null doc_id is kept as null. Empty input gives no rows. Other columns of
    ``docs`` are not read.
    """
    ranks_path, tokenizer_path = paths or default_paths()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pairs(ranks_path, tokenizer_path)
        sequence = TaskContext.get().partitionId() << 36
        waiting: list[tuple] = []
        held = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, number, offset = zip(*pieces, strict=True)
            return batch_of(
                doc_id=pa.array(doc, pa.int64()),
                start=pa.array(start, pa.int64()),
                length=pa.array([len(x) for x in ids], pa.int64()),
                ids=pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                doc_tokens=pa.array(total, pa.int64()),
                sequence_id=pa.array(number, pa.int64()),
                offset=pa.array(offset, pa.int64()),
            )

        def placed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, waiting, held
            lengths = np.fromiter((len(x[2]) for x in waiting), np.int64, len(waiting))
            number, offset, used = best_fit_decreasing(lengths, window)
            done = [
                (*piece, sequence + int(n), int(o))
                for piece, n, o in zip(waiting, number, offset, strict=True)
            ]
            sequence, waiting, held = sequence + used, [], 0
            for k in range(0, len(done), 2000):
                yield rows(done[k : k + 2000])

        for batch in batches:
            full = []
            end = np.array([separator], np.uint32)
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                ids = np.concatenate([ids, end])
                total = len(ids)
                for start in range(0, total - window + 1, window):
                    full.append((doc, start, ids[start : start + window], total, sequence, 0))
                    sequence += 1
                rest = total % window
                if rest:
                    waiting.append((doc, total - rest, ids[total - rest :], total))
                    held += rest
                if len(full) >= 2000:
                    yield rows(full)
                    full = []
                if held >= group_ids:
                    yield from placed()
            if full:
                yield rows(full)
        if waiting:
            yield from placed()

    return map_batches(id_and_text(docs), packed, PIECES)
