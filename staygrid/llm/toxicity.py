"""Toxicity by a linear classifier over character n-grams scaled by log-count ratios.

A text is the set of the character n-grams of its words (with a mark at either end),
hashed. From the labelled texts each n-gram gets the naive Bayes log ratio of its counts
in toxic and in other texts; a logistic regression is fitted on the sets scaled by these
ratios. The score is its probability.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from staygrid.llm.frames import batch_of, id_and_text, least_by, map_batches, ready, text_of

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
SMOOTHING = 1.0
# The model is fitted on at most this many labelled texts of each class: those whose
# doc_id has the smallest hash.
TEXTS_PER_CLASS = 2500
# An n-gram counts if at least this many of them have it.
LEAST_TEXTS = 4
# and its log-count ratio is at least this far from 0; the rest would be scaled away.
LEAST_RATIO = 0.3
RIDGE = 3.0
ROUNDS = 100
THRESHOLD = 0.7

class Model(NamedTuple):
    """Weight per bucket, log-count ratio included, and the bias."""

    weights: np.ndarray
    bias: float


# Odd multipliers of the rolling hash and of its last step.
STEP, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
BITS = BUCKETS.bit_length() - 1


def grams_of(text: str) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of a text; none if it has no words.

    The different words are set out with a blank on either side and hashed together, one
    array operation per n-gram size. What holds two blanks spans two words and is left out.
    """
    words = set(text.lower().split())
    if not words:
        return np.zeros(0, np.int32)
    line = f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(line, np.uint32)
    n = len(code)
    # blanks[i]: neighbouring blanks at places before i
    blanks = np.zeros(n + 1, np.int32)
    np.cumsum((code[1:] == 32) & (code[:-1] == 32), out=blanks[1:n])
    found = []
    for size in SIZES:
        count = n - size + 1
        if count < 1:
            continue
        hashed = np.full(count, size, np.uint32)
        for k in range(size):
            hashed *= STEP
            hashed ^= code[k : k + count] * SPREAD
        hashed ^= hashed >> np.uint32(15)
        hashed *= SPREAD
        inside = blanks[size - 1 : size - 1 + count] == blanks[:count]
        found.append((hashed >> np.uint32(32 - BITS))[inside])
    return np.unique(np.concatenate(found)).astype(np.int32)


class Sets(NamedTuple):
    """Bucket sets back to back: those of text k are ``buckets[bounds[k]:bounds[k + 1]]``."""

    buckets: np.ndarray
    bounds: np.ndarray


def log_count_ratios(sets: Sets, toxic: np.ndarray) -> np.ndarray:
    """Per bucket: log of its smoothed share in toxic texts over that in the others.

    Buckets in few texts or with a ratio near 0 get 0 and so play no part.
    """
    owner = np.repeat(toxic.astype(bool), np.diff(sets.bounds))
    bad = np.bincount(sets.buckets[owner], minlength=BUCKETS)
    good = np.bincount(sets.buckets[~owner], minlength=BUCKETS)
    p, q = bad + SMOOTHING, good + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(bad + good < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0.0
    return ratio


def fit(sets: Sets, toxic: Sequence[int]) -> Model:
    """Ridge logistic regression on the scaled sets, by accelerated gradient steps.

    Both classes weigh the same in the loss. Without texts of both classes the model
    knows nothing and gives every text the share of toxic ones (a half without any).
    """
    y = np.asarray(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    ratio = log_count_ratios(sets, y)
    counts = ratio[sets.buckets] != 0
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(sets.bounds))[counts]
    used, column = np.unique(sets.buckets[counts], return_inverse=True)
    scale = ratio[used]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)

    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, (w * scale)[column], minlength=len(y)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.bincount(column, error[row], minlength=len(used)) * scale + RIDGE * w
        grad_b = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
        rate = 0.02 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = w * scale
    return Model(weights, float(b))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 modulo 3 (null: no)."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled texts of either class that are not held out.

    Rows without an id or a label of 0 or 1 are left aside. An id with several labels
    counts as toxic if one of them says so. Which texts are taken depends on the hash of
    their ids only. Runs a few jobs; the sets of at most ``2 * per_class`` texts come to
    the driver.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    chosen = least_by(marked.where("toxic = 1"), "turn", per_class).unionByName(
        least_by(marked.where("toxic = 0"), "turn", per_class)
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams_of(t) for t in batch["text"].to_pylist()]
            yield batch_of(
                doc_id=batch["doc_id"], toxic=batch["toxic"], grams=pa.array(found, pa.list_(pa.int32()))
            )

    # One row per chosen id: at most 2 * per_class narrow rows.
    texts = id_and_text(docs).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    one_each = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    table = map_batches(one_each, sets, "doc_id long, toxic int, grams array<int>").toArrow().sort_by("doc_id")
    grams = table["grams"].combine_chunks()
    sizes = grams.value_lengths().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return fit(Sets(grams.flatten().to_numpy(), bounds), table["toxic"].to_pylist())


def toxicity(text: Column, model: Model) -> Column:
    """Probability that a text is toxic; a text without words gets the model's bias."""
    # Only the buckets that count travel with the task.
    used = np.flatnonzero(model.weights).astype(np.int32)
    values, bias = model.weights[used], model.bias

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        weights = np.zeros(BUCKETS)
        weights[used] = values
        raw = np.array([weights[grams_of(t)].sum() for t in texts.to_pylist()]) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))), pa.float64())

    return scored(text)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, without a shuffle.

    Only the text is looked at. Null and empty texts get the score of a text without
    words; repeated rows score alike; a null doc_id stays null and is not held out; no
    rows give no rows; other columns of ``docs`` are not read. A very long text is scored
    whole, by the set of its n-grams; a score at the threshold is predicted toxic.
    """
    ready(docs.sparkSession)
    rows = id_and_text(docs).withColumn("score", toxicity(F.col("text"), model))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    ready(docs.sparkSession)
    return docs.where(toxicity(text_of(text), model) < threshold)
