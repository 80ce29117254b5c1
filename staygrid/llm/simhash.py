"""SimHash near-duplicates through a hierarchical index in Gray order.

Upper nodes are masked bit patterns: a fingerprint is cut into four blocks of 16 bits,
and two fingerprints that differ in at most two bits agree on two whole blocks. So each
fingerprint goes to six nodes (mask, pattern), and every link lies inside a node. A node
with many members is divided further by masks over its free bits, so no node that is
searched grows with the data. Inside a node the members are sorted by Gray rank and
factored level by level into groups; a group keeps the bits all its members share, and
two groups are dropped as soon as the differences on bits both share exceed the limit.

``nearest`` searches the same index at a wider radius for an operator that checks the pairs
itself: seven of nine slices may differ, so two are whole, and a fingerprint goes to 36 nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, id_and_text, map_batches
from staygrid.session import stored

# Fixed values of the contract.
SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2

BITS = 64
# A node with more members than this is divided by the finer masks.
NODE_MEMBERS = 4096
# Members or groups factored into one group of the next level.
FANOUT = 32
# The wider radius, and the slices of which it leaves two or more whole.
WIDE_BITS, WIDE_SLICES = 7, 9
SHINGLES_TOGETHER = 65_536


def fingerprint_of(text: str) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half the shingle hashes."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - SHINGLE_WORDS + 1
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    return fingerprint_over(np.fromiter(map(partial(xxhash.xxh64_intdigest), shingles, repeat(SEED)), np.uint64, n))


def fingerprint_over(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of shingle hashes; of none it is zero."""
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, SHINGLES_TOGETHER):
        part = hashes[k : k + SHINGLES_TOGETHER].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, row_id: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long.

    Null and empty texts have fingerprint zero; texts of one or two words are one
    shingle. With ``row_id`` a column numbers the rows; it is repeatable only where the
    partitions of ``docs`` are, as those of a scan.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint_of(t) for t in batch["text"].to_pylist()], pa.int64())
            kept = {n: batch[n] for n in batch.schema.names if n != "text"}
            yield batch_of(**kept, fp=found)

    rows = id_and_text(docs)
    if row_id:
        rows = rows.withColumn("row_id", F.monotonically_increasing_id())
        return map_batches(rows, hashed, "doc_id long, row_id long, fp long")
    return map_batches(rows, hashed, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def factor(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (pattern, mask): members first, then groups of ``FANOUT`` each.

    A mask has the bits on which all members below agree; the pattern holds them.
    """
    levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
    while len(levels[-1][0]) > FANOUT:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FANOUT)
        same = ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts))
        shared = same & np.bitwise_and.reduceat(mask, starts)
        levels.append((pattern[starts] & shared, shared))
    return levels


def linked_pairs(codes: np.ndarray, most: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a < b) of members that differ in at most ``most`` bits.

    ``codes`` are in Gray order. Pairs of groups are compared from the top down; a pair
    whose differences on the bits both share exceed ``most`` is dropped with all below.
    """
    levels = factor(codes)

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pattern, mask = levels[level]
        keep = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
        if not level:
            keep &= a < b
        a, b = a[keep], b[keep]
        if not level:
            if len(a):
                yield a, b
            return
        below = len(levels[level - 1][0])
        for k in range(0, len(a), 512):
            left = (a[k : k + 512, None] * FANOUT + np.arange(FANOUT))[:, :, None]
            right = (b[k : k + 512, None] * FANOUT + np.arange(FANOUT))[:, None, :]
            left, right = (x.ravel() for x in np.broadcast_arrays(left, right))
            inside = (left < below) & (right < below) & (left <= right)
            yield from descend(level - 1, left[inside], right[inside])

    yield from descend(len(levels) - 1, *np.triu_indices(len(levels[-1][0])))


def forest(codes: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """For each code the position of the first member of its class within the node."""
    label = np.arange(len(codes))
    for a, b in linked_pairs(codes, most):
        while True:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != (up := label[label])).any():
                label = up
            if (label[a] == label[b]).all():
                break
    return label


def masks_over(free: int, parts: int, most: int = MAX_BITS) -> list[int]:
    """Masks that keep all but ``most`` of ``parts`` equal slices of the bits in ``free``."""
    bits = [k for k in range(BITS) if free >> k & 1]
    size = len(bits) // parts
    slices = [sum(1 << k for k in bits[i * size : (i + 1) * size]) for i in range(parts)]
    return [sum(kept) for kept in combinations(slices, parts - most)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


EVERY_BIT = (1 << BITS) - 1
COARSE = masks_over(EVERY_BIT, 4)
# Per coarse mask: that mask and all but two of eight slices of what it leaves free, so
# a fine node has at most 2**8 different members.
FINE = [[coarse | fine for fine in masks_over(EVERY_BIT ^ coarse, 8)] for coarse in COARSE]


def dealt(nodes: DataFrame, mask: Column) -> DataFrame:
    """Rows (mask, pattern, fp), each node's rows together and in order in one task."""
    keyed = nodes.select(mask.alias("mask"), "fp").withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    return keyed.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "fp")


def search(keyed: DataFrame, most_members: int | None) -> DataFrame:
    """(fp, root, mask): each member that is linked inside its node, with its class's root.

    Members of a node above ``most_members`` come back with a null root instead; at most
    that many fingerprints are held at a time.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_mask = held_pattern = None
        held: list[np.ndarray] = []
        size, large = 0, False
        fp_out: list[np.ndarray] = []
        root_out: list[np.ndarray] = []
        mask_out: list[np.ndarray] = []

        def give_large() -> None:
            found = np.concatenate(held)
            fp_out.append(found)
            root_out.append(np.full(len(found), -1))  # marked, replaced by null below
            mask_out.append(np.full(len(found), held_mask))

        def close() -> None:
            if not held:
                return
            if large:
                give_large()
            elif size > 1:
                codes = np.concatenate(held).view(np.uint64)
                codes = codes[np.argsort(gray_rank(codes), kind="stable")]
                label = forest(codes)
                moved = np.flatnonzero(label != np.arange(len(codes)))
                if len(moved):
                    fp_out.append(codes[moved].view(np.int64))
                    root_out.append(codes[label[moved]].view(np.int64))
                    mask_out.append(np.zeros(len(moved), np.int64))

        def rows() -> pa.RecordBatch:
            fp, root, mask = (np.concatenate(x) for x in (fp_out, root_out, mask_out))
            fp_out.clear(), root_out.clear(), mask_out.clear()
            return batch_of(fp=pa.array(fp), root=pa.array(root, mask=mask != 0), mask=pa.array(mask))

        for batch in batches:
            mask, pattern, fp = (batch[n].to_numpy() for n in ("mask", "pattern", "fp"))
            if not len(fp):
                continue
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
                if (mask[a], pattern[a]) != (held_mask, held_pattern):
                    close()
                    held_mask, held_pattern, held, size, large = mask[a], pattern[a], [], 0, False
                held.append(fp[a:b])
                size += b - a
                if most_members is not None and size > most_members:
                    large = True
                    give_large()
                    held = []
            if sum(map(len, fp_out)) > 20_000:
                yield rows()
        close()
        if fp_out:
            yield rows()

    return map_batches(keyed.select("mask", "pattern", "fp"), searched, "fp long, root long, mask long")


def links(nodes: DataFrame, most_members: int = NODE_MEMBERS) -> DataFrame:
    """(fp, root): a forest over distinct fingerprints whose trees span all links.

    ``nodes`` has one row per distinct ``fp``. Links found in several nodes may repeat. A
    node above ``most_members`` is divided; the links found are the same for any number.
    """
    coarse = F.explode(F.array(*[F.lit(signed(m)) for m in COARSE]))
    found = stored(search(dealt(nodes, coarse), most_members), "simhash-links")
    large = found.where(F.col("root").isNull()).select("fp", F.col("mask").alias("coarse"))
    finer = F.create_map(
        *[x for c, fine in zip(COARSE, FINE, strict=True)
          for x in (F.lit(signed(c)), F.array(*[F.lit(signed(m)) for m in fine]))]
    )
    fine = search(dealt(large, F.explode(finer[F.col("coarse")])), None)
    return found.where(F.col("root").isNotNull()).select("fp", "root").unionByName(fine.select("fp", "root"))


def nearest_in_nodes(node: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of members with another within ``most`` bits in their node, and of the nearest.

    ``node`` is sorted, and ``codes`` are in Gray order within a node. Nodes too small for an
    upper level are compared together, larger ones level by level.
    """
    none = np.iinfo(np.int64).max
    best = np.full(len(node), none)

    def take(a: np.ndarray, b: np.ndarray) -> None:
        bits = np.bitwise_count(codes[a] ^ codes[b]).astype(np.int64)
        ok = bits <= most
        a, b, bits = a[ok], b[ok], bits[ok] << 32
        np.minimum.at(best, a, bits | b)
        np.minimum.at(best, b, bits | a)

    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[starts, len(node)])
    after = np.repeat(starts + sizes, sizes)
    a = np.flatnonzero(np.repeat(sizes <= FANOUT, sizes))
    for step in range(1, FANOUT):
        a = a[a + step < after[a]]
        take(a, a + step)
    for k in np.flatnonzero(sizes > FANOUT).tolist():
        for a, b in linked_pairs(codes[starts[k] : starts[k] + sizes[k]], most):
            take(starts[k] + a, starts[k] + b)
    found = np.flatnonzero(best != none)
    return found, best[found] & 0xFFFFFFFF


def nearest(nodes: DataFrame, most: int = WIDE_BITS, slices: int = WIDE_SLICES, run: int = NODE_MEMBERS) -> DataFrame:
    """(fp, other): for each fingerprint the nearest within ``most`` bits in each of its nodes.

    ``nodes`` has one row per distinct ``fp``. Nodes lie in Gray order over the tasks. One above
    ``run`` members is searched in runs of that many, and borders of tasks cut a node too, so a
    crowded fingerprint may get a near one in place of the nearest; whoever needs every link
    must find those that are left by other means, as ``jaccard`` does.
    """
    size = BITS // slices
    kept = list(combinations(range(slices), slices - most))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["fp"].to_numpy().view(np.uint64)
            turn = gray_rank(codes).view(np.int64)
            for index, whole in enumerate(kept):
                node = np.full(len(codes), index, np.uint64)
                for k in whole:
                    node = node << np.uint64(size) | codes >> np.uint64(k * size) & np.uint64((1 << size) - 1)
                yield batch_of(node=pa.array(node.view(np.int64)), turn=pa.array(turn))

    dealt = map_batches(nodes.select("fp"), placed, "node long, turn long")
    dealt = dealt.repartitionByRange("node", "turn").sortWithinPartitions("node", "turn")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, turn = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in chain(batches, [None]):
            stop = len(node)
            if batch is not None:
                node = np.concatenate([node, batch["node"].to_numpy()])
                turn = np.concatenate([turn, batch["turn"].to_numpy()])
                if not len(node):
                    continue
                stop = int(np.searchsorted(node, node[-1]))  # the last node may go on
                if len(node) - stop >= run:
                    stop = len(node)
            if stop:
                rank = turn[:stop].view(np.uint64)
                codes = rank ^ rank >> np.uint64(1)
                found, other = nearest_in_nodes(node[:stop], codes, most)
                yield batch_of(fp=pa.array(codes[found].view(np.int64)), other=pa.array(codes[other].view(np.int64)))
                node, turn = node[stop:], turn[stop:]

    return map_batches(dealt, searched, "fp long, other long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): every vertex of ``edges`` but the roots, with the least vertex it reaches.

    Alternates two steps until no edge changes: every vertex hands its larger neighbours,
    then its smaller ones, to the least neighbour. The rounds grow with the logarithm of
    the longest chain; each is one job whose result is written to the shared folder.
    """
    now = stored(
        edges.where(F.col("fp") != F.col("root"))
        .select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b")).distinct(),
        "simhash-edges",
    )
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        seen = state
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b")).distinct()
        )
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b"),
        )
        now = stored(small.where(F.col("a") != F.col("b")).distinct(), "simhash-edges")


def grouped(prints: DataFrame) -> DataFrame:
    """``prints`` with ``component_id``: the smallest doc_id of the fingerprint's class."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes, "simhash-nodes")
    joined = nodes.join(components(links(nodes.select("fp"))), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    classes = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(joined.join(classes, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Documents link when their fingerprints differ in at most two bits; exact copies
    share a fingerprint and are one vertex. component_id is the smallest doc_id that
    can be reached, nulls aside; it is null only if no member has an id. Texts without a
    word have fingerprint zero and link like any other; a very long text is counted
    whole, a bit set in exactly half of the shingles is 0. No rows give no rows; repeated
    rows stay; other columns of ``docs`` are not read. Jobs run while the plan is built.
    """
    prints = stored(fingerprints(docs), "simhash-prints")
    return grouped(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicates, with all columns: that of the least doc_id.

    Null ids come last and equal ids are decided by the row number, so exactly one row
    of a class stays, also among repeated rows. ``docs`` is read twice and must come in
    repeatable partitions, as a table does.
    """
    prints = stored(fingerprints(docs, row_id=True), "simhash-prints")
    nodes = prints.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_id")).alias("first")
    )
    nodes = stored(nodes, "simhash-nodes")
    joined = nodes.join(components(links(nodes.select("fp"))), "fp", "left")
    stay = joined.groupBy(F.coalesce("root", "fp").alias("_root")).agg(F.min("first").alias("_first"))
    name = "_row_number"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    kept = numbered.join(stay.select(F.col("_first.row_id").alias(name)), name, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
