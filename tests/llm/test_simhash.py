import random
import re

import numpy as np
import pytest
import xxhash
from samples import MESSY, SMALL, documents

from staygrid.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Class of each fingerprint by comparing all with all."""
    codes = sorted(set(prints))
    values = np.array(codes, np.uint64)
    root = list(range(len(codes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = sorted((find(int(i)), find(int(j))))
        root[b] = a
    return {c: find(k) for k, c in enumerate(codes)}


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    classes = plain_classes(prints)
    least = {}
    for (doc, _), p in zip(rows, prints, strict=True):
        if doc is not None:
            least[classes[p]] = min(doc, least.get(classes[p], doc))
    return sorted((str(d), f"{p:016x}", str(least.get(classes[p]))) for (d, _), p in zip(rows, prints, strict=True))


def chained_prints(n, seed):
    """Fingerprints in chains, clusters and alone, many with equal halves."""
    turn = random.Random(seed)
    out = {turn.getrandbits(64) for _ in range(n // 3)}
    for _ in range(6):
        at = turn.getrandbits(64)
        for _ in range(n // 18):
            at ^= 1 << turn.randrange(64)
            at ^= 1 << turn.randrange(64)
            out.add(at)
    center = turn.getrandbits(64)
    out |= {center ^ turn.getrandbits(12) for _ in range(n // 4)}
    out |= {center ^ turn.getrandbits(12) << 50 for _ in range(n // 8)}
    return sorted(out)


def test_index_finds_exactly_the_links():
    for seed in range(3):
        codes = np.array(chained_prints(2500, seed), np.uint64)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        got = {p for a, b in simhash.linked_pairs(codes) for p in zip(a.tolist(), b.tolist(), strict=True)}
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    assert list(simhash.linked_pairs(np.zeros(0, np.uint64))) == []


def test_gray_rank_inverts_the_gray_code():
    ranks = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_every_pair_of_masks_leaves_room_for_two_bits():
    turn = random.Random(2)
    for _ in range(3000):
        flip = (1 << turn.randrange(64)) | (1 << turn.randrange(64))
        nodes = [k for k, mask in enumerate(simhash.COARSE) if not mask & flip]
        assert nodes
        assert all(any(not fine & flip for fine in simhash.FINE[k]) for k in nodes)


def test_components_with_whole_and_divided_nodes(spark):
    codes = chained_prints(1500, 9)
    classes = plain_classes(codes)
    signed = [(simhash.signed(c),) for c in codes]
    nodes = spark.createDataFrame(signed, "fp long")
    for most in (simhash.NODE_MEMBERS, 20):
        found = {r.fp: r.root for r in simhash.components(simhash.links(nodes, most)).collect()}
        roots = {}
        for c in codes:
            s = simhash.signed(c)
            roots.setdefault(classes[c], set()).add(found.get(s, s))
        assert all(len(r) == 1 for r in roots.values())
        assert len({min(r) for r in roots.values()}) == len(roots)


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)], "fp long, root long")
    assert {(r.fp, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, 401)}


def test_messy_documents(spark):
    got = simhash.near_duplicates(documents(spark, MESSY)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected(MESSY)
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected(rows)


def test_one_row_of_each_class_stays(spark):
    docs = documents(spark, MESSY)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [plain_print(t) for _, t in MESSY]
    classes = plain_classes(prints)
    got = [(r.doc_id, classes[plain_print(r.text)]) for r in kept.collect()]
    assert sorted(c for _, c in got) == sorted(set(classes[p] for p in prints))
    for doc, c in got:
        ids = [d for (d, _), p in zip(MESSY, prints, strict=True) if classes[p] == c and d is not None]
        assert doc == min(ids, default=None)
    assert simhash.keep_one(documents(spark, [])).collect() == []


@pytest.mark.parametrize("run", [simhash.NODE_MEMBERS, 50])
def test_nearest_within_the_wider_radius(spark, run):
    turn = np.random.default_rng(5)
    base = turn.integers(0, 2**63, 400, np.int64).astype(np.uint64)
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << turn.integers(0, 64, (n, k)).astype(np.uint64), axis=1)
    codes = np.unique(np.concatenate([base, base[:150] ^ flips(150, 7), base[:1] ^ flips(300, 3), base[200:300] ^ flips(100, 12)]))
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).astype(int)
    np.fill_diagonal(apart, 65)
    at = {c: k for k, c in enumerate(codes.view(np.int64).tolist())}
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # no borders of tasks
    try:
        found = simhash.nearest(spark.createDataFrame([(c,) for c in at], "fp long"), run=run).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    least = np.full(len(codes), 65)
    for r in found:
        bits = apart[at[r.fp], at[r.other]]
        assert bits <= simhash.WIDE_BITS
        least[at[r.fp]] = min(least[at[r.fp]], bits)
    want = np.where(apart.min(axis=1) <= simhash.WIDE_BITS, apart.min(axis=1), 65)
    assert (least >= want).all()
    if run > len(codes):
        assert (least == want).all()
