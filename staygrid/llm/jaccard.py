"""Near-duplicates by SimHash and the exact Jaccard similarity of their word shingles.

For stages that have no contract of their own. First every set gets a SimHash fingerprint of
its shingles, the index of ``simhash`` gives each the nearest ones within seven bits, and the
pairs that reach the similarity make the first classes. Sets of similarity 0.8 differ in about
ten bits, so fingerprints alone cannot hold every link: what they miss between different
classes is found by a prefix-filtered join, which loses none. There shingles have one global order, and two sets that reach the similarity
share one of the first n - ceil(0.8 n) + 1 shingles of either, n being the set's size. A
pair must pass the length and position filters at its first common shingle and is then
compared set by set. Shingles that many documents of a bounded sample hold come last in
the order; the sample decides about the work, never about the result.

Each set also has a map of two to four bits a shingle, in which every shingle flips one bit.
Two maps never differ in more bits than the sets differ in shingles, and sets of similarity 0.8 differ in
at most a ninth of their sizes' sum, so pairs whose maps differ more are dropped before any
text moves; none that reaches the similarity is. Texts of the pairs left are sent once per
block of pairs.

A shingle held by many sets is first used to link each of them to a few others. Members
that are still in different classes after that are compared by their maps all with all, in
squares of bounded side that lie in different tasks: first each is linked to the few others
whose maps are nearest, then whatever is left open.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import Scratch, batch_of, id_and_text, least_by, map_batches
from staygrid.llm.simhash import components, fingerprint_over, nearest

SHINGLE_WORDS = 5
# Least similarity, as a fraction of two integers: comparisons are exact.
PART, WHOLE = 4, 5

# A shingle in the prefixes of more sets than this is used in two rounds. In a smaller group
# all meet all, so this also bounds how fast pairs grow: groups grow with the input.
GROUP_MEMBERS = 8
# Sets each member of such a group is compared with in the first round.
HUBS = 3
# The sample for the order, the count that makes a shingle frequent, and most such shingles.
SAMPLE_DOCS = 8_000
FREQUENT = 4
MOST_FREQUENT = 50_000
# Least and most 64-bit words of a set's map; beyond, a map only drops less.
MAP_WORDS, MOST_MAP_WORDS = 16, 1 << 11
# Others a member of a large group is compared with in each of the rounds for nearest maps.
NEAREST, NEAREST_ROUNDS = 3, 2
# Side of the squares members of a large group are compared in, and pairs compared at a time.
SQUARE = 4096
PAIRS_TOGETHER = 1 << 16
# Shingles of the hubs one block of pairs holds, and partners of a hub in one block.
BLOCK_SHINGLES = 6_000_000
HUB_PARTNERS = 2_000

WORDS_KNOWN = 500_000
WANTED_BITS = 22
SEED = 42


class _Words(dict):
    """Hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: str, known: _Words, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles; a shorter text is one shingle.

    Words are those of the fingerprints: ASCII white space, only A-Z lowered.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(codes) - words + 1)
    out = np.full(n, min(len(codes), words), np.uint64)
    for k in range(min(len(codes), words)):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(out)


def set_code(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED) - (1 << 63)


def map_of(shingles: np.ndarray) -> np.ndarray:
    """64-bit words, a power of two by the set's size, in which each shingle flips a bit."""
    words = 1 << max(0, 2 * len(shingles) - 1).bit_length() >> 6
    words = min(max(words, MAP_WORDS), MOST_MAP_WORDS)
    odd = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(map_: np.ndarray, words: int) -> np.ndarray:
    """The map of the same set in fewer words."""
    while len(map_) > words:
        map_ = map_[: len(map_) // 2] ^ map_[len(map_) // 2 :]
    return map_


def may_reach(map_a: np.ndarray, n_a: np.ndarray, map_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether maps of one size allow the similarity: sets that reach it differ in at most
    (WHOLE - PART) / (WHOLE + PART) of their sizes' sum."""
    return (PART + WHOLE) * differing(map_a, map_b) <= (WHOLE - PART) * (n_a + n_b)


def differing(map_a: np.ndarray, map_b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(map_a ^ map_b).sum(axis=-1, dtype=np.int64)


def pair_may_reach(map_a: bytes, n_a: int, map_b: bytes, n_b: int) -> bool:
    a, b = np.frombuffer(map_a, "<u8"), np.frombuffer(map_b, "<u8")
    words = min(len(a), len(b))
    return bool(may_reach(folded(a, words), n_a, folded(b, words), n_b))


def prefix_of(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of the prefix, in the global order: those not frequent by hash, then
    the frequent ones from the rarest on. ``frequent`` is (2, n): hashes up, and places."""
    n = len(shingles)
    size = n - -(-PART * n // WHOLE) + 1 if n else 0
    if not frequent.shape[1]:
        return shingles[:size]
    at = np.minimum(np.searchsorted(frequent[0], shingles), frequent.shape[1] - 1)
    place = np.where(frequent[0][at] == shingles, frequent[1][at] + np.uint64(1), np.uint64(0))
    return shingles[np.argsort(place, kind="stable")[:size]]


def frequent_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """Shingles that at least ``FREQUENT`` documents of the sample hold, and their places."""

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for text in batch["text"].to_pylist():
                yield batch_of(shingle=pa.array(shingles_of(text, known, words).view(np.int64)))

    few = least_by(rows.select("row_id", F.xxhash64("row_id").alias("turn")), "turn", SAMPLE_DOCS)
    bound = few.agg(F.max("turn")).first()[0]
    if bound is None:
        return np.zeros((2, 0), np.uint64)
    sample = rows.where(F.xxhash64("row_id") <= bound).select("text")
    held = map_batches(sample, shown, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    most = held.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect()
    if not most:
        return np.zeros((2, 0), np.uint64)
    code = np.array([r.shingle for r in reversed(most)], np.int64).view(np.uint64)
    turn = np.argsort(code)
    return np.stack([code[turn], turn.astype(np.uint64)])


def described(rows: DataFrame, words: int, frequent: np.ndarray) -> DataFrame:
    """One row per row with its set's code, fingerprint, size, map and prefix."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [shingles_of(t, known, words) for t in batch["text"].to_pylist()]
            first = [prefix_of(s, frequent).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *first])
            yield batch_of(
                doc_id=batch["doc_id"], row_id=batch["row_id"],
                fp=pa.array([set_code(s) for s in sets], pa.int64()),
                print=pa.array([fingerprint_over(s) for s in sets], pa.int64()),
                n=pa.array([len(s) for s in sets], pa.int32()),
                map=pa.array([map_of(s).tobytes() for s in sets], pa.binary()),
                prefix=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            )

    return map_batches(rows, found, "doc_id long, row_id long, fp long, print long, n int, map binary, prefix array<long>")


def compatible(n_a: np.ndarray, at_a: np.ndarray, n_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Length and position filters; the latter holds at the first common shingle."""
    most = 1 + np.minimum(n_a - at_a, n_b - at_b) - 1
    return (WHOLE * np.minimum(n_a, n_b) >= PART * np.maximum(n_a, n_b)) & (
        (PART + WHOLE) * most >= PART * (n_a + n_b)
    )


def in_groups(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple]:
    """Columns of each run of equal ``key``, across batches."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        left.append(batch)
        whole = pa.Table.from_batches(left).combine_chunks()
        values = whole[key].to_numpy()
        if not len(values):
            continue
        cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()]
        for i, j in zip(cut, cut[1:], strict=False):
            yield tuple(whole[n].slice(i, j - i) for n in names)
        left = whole.slice(cut[-1]).to_batches()
    if left and sum(map(len, left)):
        whole = pa.Table.from_batches(left).combine_chunks()
        yield tuple(whole[n] for n in names)


def near_prints(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): sets with one fingerprint, each with the least of them, and the least ones of
    fingerprints that are nearest to each other in the index."""
    heads = scratch.stored(nodes.groupBy("print").agg(F.min("fp").alias("head")), "jaccard-heads")
    of = lambda end, name: heads.select(F.col("print").alias(end), F.col("head").alias(name))
    alike = nodes.join(heads, "print").where(F.col("fp") != F.col("head")).select(F.col("head").alias("a"), F.col("fp").alias("b"))
    near = nearest(heads.select(F.col("print").alias("fp"))).join(of("fp", "x"), "fp").join(of("other", "y"), "other")
    return alike.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different classes so far."""
    of = lambda end: linked.select(F.col("fp").alias(end), F.col("root").alias(f"root_{end}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def candidates(postings: DataFrame, most_members: int) -> DataFrame:
    """(a, b, shingle): pairs of sets that share a shingle of their prefixes.

    ``postings`` has (shingle, fp, n, at). In a group above ``most_members`` each set meets
    ``HUBS`` others only, and the group's sets come back too, with null in ``b``.
    """
    dealt = postings.repartition("shingle").sortWithinPartitions("shingle", "fp")
    names = ("shingle", "fp", "n", "at")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0

        def give() -> pa.RecordBatch:
            a, b, shingle, whole = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return batch_of(a=pa.array(a), b=pa.array(b, mask=whole), shingle=pa.array(shingle))

        left = [np.zeros(0, np.int64)] * 4
        for columns in (*([b[c].to_numpy() for c in names] for b in batches), None):
            last = columns is None
            columns = left if last else [np.concatenate(x) for x in zip(left, columns, strict=True)]
            shingle = columns[0]
            cut = np.flatnonzero(shingle[1:] != shingle[:-1]) + 1
            starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(shingle)]])
            if not last:  # the last group may go on
                left = [c[starts[-1] :] for c in columns]
                starts, stops = starts[:-1], stops[:-1]
            several = stops - starts > 1
            for i, j in zip(starts[several].tolist(), stops[several].tolist(), strict=True):
                fp = columns[1][i:j]
                one = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])  # exact copies meet once
                size = len(one)
                if size < 2:
                    continue
                fp, n, at = fp[one], columns[2][i:j][one], columns[3][i:j][one]
                large = size > most_members
                if large:
                    zero = np.full(size, shingle[i])
                    out.append((fp, fp, zero, np.ones(size, bool)))
                    held += size
                # The hubs are the least codes, so all groups of a family choose the same.
                for k in range(HUBS if large else size - 1):
                    own = slice(k + 1, size)
                    ok = compatible(n[k], at[k], n[own], at[own])
                    other = fp[own][ok]
                    if len(other):
                        zero = np.zeros(len(other), np.int64)
                        out.append((np.full(len(other), fp[k]), other, zero, zero.astype(bool)))
                        held += len(other)
                    if held > 100_000:
                        yield give()
                        held = 0
        if out:
            yield give()

    return map_batches(dealt.select(*names), searched, "a long, b long, shingle long")


def close_by_maps(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose maps allow the similarity, with the size of ``a``."""
    of = lambda end: nodes.select(F.col("fp").alias(end), F.col("n").alias(f"n_{end}"), F.col("map").alias(f"map_{end}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("map_a", "n_a", "map_b", "n_b"))
            ok = [pair_may_reach(*pair) for pair in zip(*columns, strict=True)]
            yield batch.select(["a", "b", "n_a"]).filter(pa.array(ok, pa.bool_()))

    return map_batches(met.select("a", "b", "n_a", "n_b", "map_a", "map_b"), filtered, "a long, b long, n_a int")


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """The pairs (fp, root) whose sets reach the similarity.

    ``pairs`` is dealt into blocks by its hubs (``a``), so that the hubs' sets of a block
    fit into memory; a hub with many partners is in several blocks. Only rows whose bit is
    set in a map of fixed size are read, and each goes to each of its blocks once.
    """
    close = scratch.stored(close_by_maps(pairs, nodes), "jaccard-close")
    hubs = close.groupBy("a").agg(F.count(F.lit(1)).alias("partners"), F.max("n_a").alias("n"))
    shingles = hubs.agg(F.sum("n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BLOCK_SHINGLES))
    several = hubs.where(F.col("partners") > HUB_PARTNERS).select(
        "a", F.ceil(F.col("partners") / HUB_PARTNERS).alias("splits")
    )
    turn = F.pmod(F.xxhash64("b"), F.coalesce("splits", F.lit(1)))
    dealt = close.join(several, "a", "left").select(
        "a", "b", (F.pmod(F.xxhash64("a"), F.lit(parts)) + turn * parts).alias("block")
    )
    dealt = scratch.stored(dealt, "jaccard-dealt")
    ends = dealt.select("block", F.col("a").alias("fp"), F.lit(None).cast("array<long>").alias("hubs")).distinct().unionByName(
        dealt.groupBy("block", F.col("b").alias("fp")).agg(F.collect_set("a").alias("hubs"))
    )
    wanted = scratch.stored(nodes.select("fp", "row_id").join(ends, "fp"), "jaccard-wanted")
    bit = F.shiftrightunsigned(F.xxhash64("row_id"), 64 - WANTED_BITS)
    bits = np.zeros(1 << (WANTED_BITS - 6), np.uint64)
    lit = wanted.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
    for r in lit.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")).collect():
        bits[r.word] = r.bits & 0xFFFFFFFFFFFFFFFF

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["at"].to_numpy()
            here = bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select(["row_id", "text"]).filter(pa.array(here.astype(bool)))

    texts = map_batches(rows.select("row_id", "text", bit.alias("at")), read, "row_id long, text string")
    sent = texts.join(wanted, "row_id").select("block", "fp", "hubs", "text")
    sent = sent.repartition("block").sortWithinPartitions("block", F.col("hubs").isNotNull())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, sets = _Words(), None, {}
        for batch in batches:
            left, right = [], []
            for block, fp, hubs, text in zip(*(batch[c].to_pylist() for c in ("block", "fp", "hubs", "text")), strict=True):
                if block != at:
                    at, sets = block, {}
                own = shingles_of(text, known, words)
                if hubs is None:
                    sets[fp] = own
                    continue
                for a in hubs:
                    other = sets[a]
                    place = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    common = int((other[place] == own).sum())
                    if (PART + WHOLE) * common >= PART * (len(own) + len(other)):
                        left.append(fp)
                        right.append(a)
            yield batch_of(fp=pa.array(left, pa.int64()), root=pa.array(right, pa.int64()))

    return map_batches(sent, compared, "fp long, root long")


def open_pairs(
    large: DataFrame, linked: DataFrame, nodes: DataFrame, square: int, nearest: int | None
) -> DataFrame:
    """(a, b): members of a large group that are in different classes and whose maps allow
    the similarity; of each member's only the ``nearest`` by their maps, unless None. A
    group is cut into squares of ``square`` members a side. Groups with the same members, as
    the shingles of one passage have, are compared once."""
    member = large.join(linked, "fp", "left").select("shingle", "fp", F.coalesce("root", "fp").alias("root"))
    groups = member.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("members"), F.min("root").alias("least"), F.max("root").alias("most"),
        F.bit_xor(F.xxhash64("fp")).alias("code"),
    ).where(F.col("least") != F.col("most"))
    sides = groups.groupBy("code", "members").agg(F.min("shingle").alias("shingle")).select(
        "shingle", F.ceil(F.col("members") / square).cast("int").alias("sides")
    )
    met = member.join(sides, "shingle").join(nodes.select("fp", "n", "map"), "fp").withColumn(
        "side", F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int")
    )
    placed = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select(
        "shingle", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "fp", "root", "n", "map"
    )
    key = F.xxhash64("shingle", "x", "y")
    dealt = placed.withColumn("key", key).repartition("key").sortWithinPartitions("key", "shingle", "x", "y", "side", "fp")
    names = ("x", "y", "side", "fp", "root", "n", "map")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, side, fp, root, n, maps in in_groups(batches, "key", names):
            fp, root, n, side = (c.to_numpy() for c in (fp, root, n.cast(pa.int64()), side))
            full = maps.to_pylist()
            maps = np.stack([folded(np.frombuffer(m, "<u8"), MAP_WORDS) for m in full])
            x, y = x[0].as_py(), y[0].as_py()
            mine, others = (np.flatnonzero(side == end) for end in (x, y))
            step = max(1, PAIRS_TOGETHER // max(1, len(others)))
            for start in range(0, len(mine), step):
                i, j = (v.ravel() for v in np.broadcast_arrays(mine[start : start + step, None], others))
                ok = (root[i] != root[j]) & (WHOLE * np.minimum(n[i], n[j]) >= PART * np.maximum(n[i], n[j]))
                if x == y:
                    ok &= i < j
                i, j = i[ok], j[ok]
                ok = may_reach(maps[i], n[i], maps[j], n[j])
                i, j = i[ok], j[ok]
                if nearest is not None:
                    turn = np.lexsort((differing(maps[i], maps[j]) / (n[i] + n[j]), i))
                    i, j = i[turn], j[turn]
                left, right, met = [], [], Counter()
                for k, o in zip(i.tolist(), j.tolist(), strict=True):
                    if met[k] != nearest and pair_may_reach(full[o], int(n[o]), full[k], int(n[k])):
                        met[k] += 1
                        left.append(k)
                        right.append(o)
                if left:
                    yield batch_of(
                        a=pa.array(np.minimum(fp[left], fp[right])), b=pa.array(np.maximum(fp[left], fp[right]))
                    )

    return map_batches(dealt.select("key", *names), searched, "a long, b long").distinct()


def classes(
    rows: DataFrame, words: int, scratch: Scratch, most_members: int = GROUP_MEMBERS, square: int = SQUARE
) -> tuple[DataFrame, DataFrame]:
    """Nodes (fp, first, row_id, print, n, map), one per distinct set, and the components (fp, root).

    The result is the same for any ``most_members`` and ``square``. Jobs run while the plan
    is built; tables go when they have been read for the last time.
    """
    prints = scratch.stored(described(rows, words, frequent_shingles(rows, words)), "jaccard-prints")
    nodes = prints.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_id")).alias("first"),
        F.first("print").alias("print"), F.first("n").alias("n"), F.first("map").alias("map"),
    )
    nodes = scratch.stored(nodes.withColumn("row_id", F.col("first.row_id")), "jaccard-nodes")
    alike = scratch.stored(near_prints(nodes, scratch), "jaccard-alike")
    edges = scratch.stored(verified(alike, nodes, rows, words, scratch), "jaccard-near")
    scratch.discard("jaccard-heads", "jaccard-close", "jaccard-dealt", "jaccard-wanted")
    linked = components(edges)

    postings = prints.select("fp", "n", F.posexplode("prefix").alias("at", "shingle"))
    found = scratch.stored(candidates(postings, most_members), "jaccard-found")
    scratch.discard("jaccard-prints")
    pairs = found.where(F.col("b").isNotNull()).select("a", "b").distinct().join(alike, ["a", "b"], "left_anti")
    pairs = scratch.stored(apart(pairs, linked), "jaccard-pairs")
    large = scratch.stored(found.where(F.col("b").isNull()).select(F.col("a").alias("fp"), "shingle"), "jaccard-large")
    scratch.discard("jaccard-found")
    edges = edges.unionByName(scratch.stored(verified(pairs, nodes, rows, words, scratch), "jaccard-links"))
    pairs = pairs.unionByName(alike)
    scratch.discard("jaccard-close", "jaccard-dealt", "jaccard-wanted")

    linked = components(edges)
    for nearest in (*[NEAREST] * NEAREST_ROUNDS, None):
        again = open_pairs(large, linked, nodes, square, nearest)
        # Pairs of earlier rounds were compared already.
        again = scratch.stored(again.join(pairs, ["a", "b"], "left_anti"), "jaccard-open")
        if again.isEmpty():
            # Nothing but compared pairs: the nearest may all be among them, so go on.
            continue
        pairs = pairs.unionByName(again)
        edges = edges.unionByName(scratch.stored(verified(again, nodes, rows, words, scratch), "jaccard-more"))
        scratch.discard("jaccard-close", "jaccard-dealt", "jaccard-wanted")
        linked = components(edges)
    scratch.discard("jaccard-alike", "jaccard-near", "jaccard-pairs", "jaccard-large", "jaccard-links")
    return nodes, linked


def keep_one(
    docs: DataFrame, words: int = SHINGLE_WORDS, most_members: int = GROUP_MEMBERS, square: int = SQUARE
) -> DataFrame:
    """One row of each class of near-duplicates, with all columns: that of the least doc_id.

    Documents link when the Jaccard similarity of their sets of shingles is 0.8 or more;
    classes are what links connect. Texts shorter than a shingle are one shingle; texts
    without a word are copies of each other. Null ids come last and equal ids are decided
    by the row number, so exactly one row of a class stays, also among repeated rows.
    No rows give no rows. ``docs`` is read several times and must come in repeatable
    partitions, as a table does. Shingles are compared by 64-bit hashes; the set of a very
    long text, eight bytes a word, is held whole.
    """
    rows = id_and_text(docs).withColumn("row_id", F.monotonically_increasing_id())
    nodes, linked = classes(rows, words, Scratch(docs.sparkSession), most_members, square)
    joined = nodes.join(linked, "fp", "left")
    stay = joined.groupBy(F.coalesce("root", "fp").alias("_root")).agg(F.min("first").alias("_first"))
    name = "_row_number"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    kept = numbered.join(stay.select(F.col("_first.row_id").alias(name)), name, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
