"""Repetition rules from the suffix array of each document's words.

The suffixes of a batch of documents are sorted together by prefix doubling; a word of
one document never equals a word of another, so a repeat always lies in one document.
The ranks of every doubling step are kept and give the longest common prefix of
neighbours in the array. A suffix lies in an LCP interval of depth d if a neighbour
shares d words with it; the deepest such interval is the longest repeat starting there,
and the repeats that cannot be extended to the left are the maximal ones. Their spans,
first occurrence included, are united.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from staygrid.llm.frames import id_and_text, ready, text_of

# Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW_WORDS = 3
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"

# Limits of the method: repeats of at least this many words count; a document may have
# this share of its words in them, and no repeat may be longer than this. Words in such
# repeats count for the base rule too, so only a share below its half can decide anything.
MIN_REPEAT = 8
MAX_COVERED = 0.25
MAX_LONGEST = 100

# Documents are sorted together up to this many words; a longer one is sorted alone.
WORDS_TOGETHER = 60_000

MEASURES = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,covered_words:bigint,longest_repeat:bigint,"
    "spans:array<struct<start:bigint,stop:bigint>>,base_failed:boolean,kept:boolean>"
)


class Limits(NamedTuple):
    min_repeat: int = MIN_REPEAT
    max_covered: float = MAX_COVERED
    max_longest: int = MAX_LONGEST


def suffix_order(codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks by their first 1, 2, 4, ... words.

    ``stop`` is the end of the document a position lies in; what lies past it sorts
    first. Equal ranks at step k mean equal first 2**k words. Only suffixes that still
    share a rank are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.ones(n, bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, step = [rank.copy()], 1
    while True:
        tied = np.zeros(n, bool)
        tied[:-1] = ~new[1:]
        tied |= ~new
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, levels
        at = order[slots]
        ahead = at + step
        inside = ahead < stop[at]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        group = first[slots]
        turn = np.argsort(group * (n + 1) + second + 1, kind="stable")
        at, second, group = at[turn], second[turn], group[turn]
        order[slots] = at
        split = np.ones(len(slots), bool)
        split[1:] = (second[1:] != second[:-1]) | (group[1:] != group[:-1])
        new[slots] = split
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = rank.copy()
        rank[at] = first[slots]
        levels.append(rank)
        step *= 2


def neighbour_lcp(order: np.ndarray, stop: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words shared by each suffix in order with the one before it (0 for the first)."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    near = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    left, right = order[near - 1], order[near]
    length = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        inside = (a < stop[left]) & (b < stop[right])
        rank = levels[k]
        equal = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        length[equal] += 1 << k
    shared[near] = length
    return shared


def longest_repeats(words: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For every word position of all documents, back to back: the length of the longest
    substring that starts there and occurs again in the same document; and the bounds."""
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    n = int(bounds[-1])
    reach = np.zeros(n, np.int64)
    if not n:
        return reach, bounds
    known: dict[bytes, int] = {}
    number = known.setdefault
    plain = np.fromiter((number(w, len(known)) for doc in words for w in doc), np.int64, n)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(words)), sizes)
    stop = np.repeat(bounds[1:], sizes)
    order, levels = suffix_order(doc * len(known) + plain, stop)
    shared = neighbour_lcp(order, stop, levels)
    deepest = shared.copy()
    deepest[:-1] = np.maximum(deepest[:-1], shared[1:])
    reach[order] = deepest
    return reach, bounds


def covered_by(reach: np.ndarray, least: int) -> np.ndarray:
    """Whether each position lies in a repeat of at least ``least`` words.

    A start whose left neighbour reaches one word further is not maximal and adds nothing.
    """
    starts = np.flatnonzero(reach >= least)
    longer = np.zeros(len(starts), bool)
    inner = starts > 0
    longer[inner] = reach[starts[inner] - 1] > reach[starts[inner]]
    starts = starts[~longer]
    change = np.zeros(len(reach) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + reach[starts], -1)
    return np.cumsum(change[:-1]) > 0


def per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: Sequence[str], limits: Limits) -> list[dict]:
    """All counts, the united spans and the verdict for each text."""
    words = [text.encode().split() for text in texts]  # splits at the six ASCII characters
    out: list[dict] = []
    start = 0
    while start < len(texts):
        stop, held = start + 1, len(words[start])
        while stop < len(texts) and held + len(words[stop]) <= WORDS_TOGETHER:
            held += len(words[stop])
            stop += 1
        reach, bounds = longest_repeats(words[start:stop])
        small = per_document(covered_by(reach, WINDOW_WORDS), bounds)
        large = covered_by(reach, limits.min_repeat)
        covered = per_document(large, bounds)
        for k in range(stop - start):
            text, a, b = texts[start + k], int(bounds[k]), int(bounds[k + 1])
            lines = [x for x in text.split("\n") if x.strip(WHITE)]
            n, longest = b - a, int(reach[a:b].max(initial=0))
            failed = n < MIN_WORDS or 100 * int(small[k]) > MAX_REPEAT_PERCENT * n
            edges = np.flatnonzero(np.diff(large[a:b].astype(np.int8), prepend=0, append=0))
            within = covered[k] <= limits.max_covered * n and longest <= limits.max_longest
            out.append(
                {
                    "n_words": n,
                    "word_chars": len(text) - sum(map(text.count, WHITE)),
                    "n_symbols": sum(map(text.count, SYMBOLS)),
                    "n_dup_lines": len(lines) - len(set(lines)),
                    "n_repeat_words": int(small[k]),
                    "covered_words": int(covered[k]),
                    "longest_repeat": longest,
                    "spans": [{"start": int(x), "stop": int(y)} for x, y in edges.reshape(-1, 2)],
                    "base_failed": bool(failed),
                    "kept": bool(not failed and within),
                }
            )
        start = stop
    return out


def repetition(text: Column, limits: Limits = Limits()) -> Column:
    """Measures of a text column, as a struct; see ``quality_rules`` for the cases."""
    kind = pa.struct(
        [(name, pa.int64()) for name in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "covered_words", "longest_repeat",
        )]
        + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
        + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    @arrow_udf(MEASURES)
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(measure(texts.to_pylist(), limits), kind)

    return measured(text)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id and all measures of every document, one row per row, without a shuffle.

    Null and empty texts have no words and fail the base rule. A text of one word over
    and over is one long repeat. Repeated rows are judged row by row; a null doc_id
    stays null; no rows give no rows; other columns of ``docs`` are not read. A very
    long text is sorted alone, in memory proportional to its own length.
    """
    ready(docs.sparkSession)
    rows = id_and_text(docs).withColumn("_m", repetition(F.col("text"), limits))
    return rows.select("doc_id", "_m.*")


def keep_clean(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text passes."""
    ready(docs.sparkSession)
    return docs.where(repetition(text_of(text), limits)["kept"])
