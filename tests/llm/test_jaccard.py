import random
import re

import numpy as np
import pytest
from samples import MESSY, documents

import corpus_pipeline
from staygrid.llm import jaccard

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_classes(texts):
    """Class of each text by comparing all with all."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def families(seed):
    """Edited copies around similarity 0.8, a large family, and a passage many texts share."""
    turn = random.Random(seed)
    fresh = lambda n: ["".join(turn.choices("abcdefgh", k=6)) for _ in range(n)]
    passage, out = fresh(40), []
    for n, copies in [(30, 6), (90, 8), (200, 8), (400, 5), (120, 60)]:
        base = fresh(n)
        for k in range(copies):
            words = list(base)
            for _ in range(turn.randint(0, max(1, n // 30))):
                words[turn.randrange(n)] = "X%d" % turn.randrange(10**6)
            out.append(" ".join(words[: n - turn.randint(0, n // 12)]))
    out += [" ".join(fresh(turn.randint(5, 12)) + passage + fresh(turn.randint(0, 9))) for _ in range(40)]
    turn.shuffle(out)
    return [(k, t) for k, t in enumerate(out)]


def kept_of(rows):
    found = plain_classes([t for _, t in rows])
    least = {}
    for (doc, _), c in zip(rows, found, strict=True):
        least[c] = min(least.get(c, (True, 0)), (doc is None, doc or 0))
    return sorted("None" if late else str(doc) for late, doc in least.values())


@pytest.mark.parametrize("most,frequent", [(jaccard.GROUP_MEMBERS, jaccard.FREQUENT), (3, 10**9)])
def test_against_brute_force(spark, monkeypatch, most, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    for rows in (families(1), MESSY):
        docs = documents(spark, rows)
        kept = jaccard.keep_one(docs, most_members=most, square=most)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == kept_of(rows)


def test_stage_of_the_pipeline_finds_edited_copies(spark):
    turn = random.Random(7)
    base = ["".join(turn.choices("abcdefgh", k=6)) for _ in range(200)]
    edited = [*base[:60], "changed", *base[61:140], "again", *base[141:]]  # similarity 0.90
    other = [w if k % 9 else "other" for k, w in enumerate(base)]
    docs = documents(spark, [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(other))])
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3]
    assert stage(spark, documents(spark, []), "").collect() == []


def test_maps_never_drop_a_pair():
    turn = np.random.default_rng(3)
    for _ in range(300):
        n = int(turn.integers(1, 3000))
        own = np.unique(turn.integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2))
        change = int(turn.integers(0, max(2, n // 5)))
        other = np.unique(np.concatenate([own[change:], turn.integers(0, 2**63, change // 2, np.int64).astype(np.uint64)]))
        common = len(np.intersect1d(own, other))
        reached = 9 * common >= 4 * (len(own) + len(other))
        allowed = jaccard.pair_may_reach(jaccard.map_of(own).tobytes(), len(own), jaccard.map_of(other).tobytes(), len(other))
        assert allowed or not reached
    for n in (400, 40_000):
        a, b = (np.unique(turn.integers(0, 2**63, n, np.int64).astype(np.uint64)) for _ in range(2))
        assert not jaccard.pair_may_reach(jaccard.map_of(a).tobytes(), n, jaccard.map_of(b).tobytes(), n)


def test_one_passage_in_thousands_of_texts(spark, monkeypatch):
    """A frequent shingle in all prefixes, thousands of classes: only near copies go."""
    turn = random.Random(9)
    fresh = lambda n: ["".join(turn.choices("abcdefgh", k=7)) for _ in range(n)]
    passage = fresh(30)
    texts = [passage + fresh(8) for _ in range(3000)]  # similarity of two: 26 / 42
    copies = [t[:-1] + ["edited"] for t in texts[:300]]  # 33 / 35
    rows = [(k, " ".join(t)) for k, t in enumerate(texts + copies)]
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    kept = jaccard.keep_one(documents(spark, rows, clashes=False), square=500)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(3000))


def test_fingerprints_find_edited_copies_before_the_join(spark, monkeypatch):
    """Without the join's candidates SimHash links what is within seven bits and reaches 0.8."""
    turn = random.Random(11)
    fresh = lambda n: ["".join(turn.choices("abcdefgh", k=6)) for _ in range(n)]
    bases = [fresh(300) for _ in range(40)]
    texts = [" ".join(b) for b in bases] + [" ".join([*b[:-1], "edited"]) for b in bases]
    short = fresh(9)  # 5 shingles against 3: near or not, they do not reach 0.8
    rows = [(k, t) for k, t in enumerate([*texts, " ".join(short), " ".join(short[:7])])]
    none = spark.createDataFrame([], "a long, b long, shingle long")
    monkeypatch.setattr(jaccard, "candidates", lambda postings, most: none)
    kept = jaccard.keep_one(documents(spark, rows, clashes=False))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 80, 81]


def test_pairs_grow_with_the_members_of_a_group(spark):
    """Five times the sets that share a shingle make about five times the pairs."""

    def pairs_of(members):
        rows = [(shingle, 100 * shingle + k, 90, 0) for shingle in range(20) for k in range(members)]
        postings = spark.createDataFrame(rows, "shingle long, fp long, n int, at int")
        return jaccard.candidates(postings, jaccard.GROUP_MEMBERS).where("b is not null").count()

    assert 0 < pairs_of(60) <= 6 * pairs_of(12)


def test_groups_of_tens_of_texts_lose_no_link(spark, monkeypatch):
    """Near copies among texts that share a passage, most of them far from the group's hubs."""
    turn = random.Random(13)
    fresh = lambda n: ["".join(turn.choices("abcdefgh", k=7)) for _ in range(n)]
    texts = []
    for members in (5, 9, 20, 45):
        passage = fresh(30)
        own = [passage + fresh(8) for _ in range(members)]
        texts += own + [[*t[:-1], "edited"] for t in own[::3]] + [["first", "second", *t] for t in own[::4]]
    turn.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    kept = jaccard.keep_one(documents(spark, rows, clashes=False))
    assert sorted(str(r.doc_id) for r in kept.collect()) == kept_of(rows)
