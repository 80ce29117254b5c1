import math
from collections import Counter

import numpy as np
import pytest
from samples import MESSY, SMALL, documents

from staygrid.llm import pieces

ODD = ["", " ", "   a  b ", "▁", "x ▁▁ y", "é😀\n\t\x00", "a" * 300, "日本語 テスト", "   end", "<s> </s> <0x41>"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.default_model(), 1.0)


def all_segmentations(vocabulary, text):
    """Every way to cut a text into pieces, with its weight."""
    by_bytes = {}
    for k, own in enumerate(vocabulary.bytes):
        if len(own) > 1 or own and k > 258:
            by_bytes.setdefault(own, k)
    line, out = " " + text, []

    def walk(at, ids, weight):
        if at == len(line):
            out.append((tuple(ids), weight))
        for end in range(at + 1, len(line) + 1):
            k = by_bytes.get(line[at:end].encode())
            if k is not None:
                walk(end, [*ids, k], weight + vocabulary.weight[k])

    walk(0, [], 0.0)
    top = max(w for _, w in out)
    total = sum(math.exp(w - top) for _, w in out)
    return {ids: math.exp(w - top) / total for ids, w in out}


@pytest.mark.parametrize("text", ["ther", "in on", "a", "  x"])
def test_draws_follow_the_distribution_over_all_segmentations(vocabulary, text):
    n = 30_000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7919)
    seen = Counter(tuple(x.tolist()) for x in vocabulary.encode([text] * n, keys))
    share = all_segmentations(vocabulary, text)
    assert set(seen) <= set(share)
    for ids, p in share.items():
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_round_trip(vocabulary):
    texts = ODD + [t or "" for _, t in MESSY]
    for k in range(3):
        keys = np.arange(len(texts), dtype=np.uint64) + np.uint64(k)
        assert [vocabulary.decode(x) for x in vocabulary.encode(texts, keys)] == texts


def test_batches_do_not_matter(vocabulary, monkeypatch):
    texts = [t or "" for _, t in MESSY]
    keys = np.arange(len(texts), dtype=np.uint64)
    whole = vocabulary.encode(texts, keys)
    monkeypatch.setattr(pieces, "TEXT_TOGETHER", 50)
    assert all((a == b).all() for a, b in zip(whole, vocabulary.encode(texts, keys), strict=True))


def test_rows_are_lossless_and_reproducible(spark):
    docs = documents(spark, MESSY)
    first = pieces.encode(docs)
    back = pieces.decode(first).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t in MESSY)
    again = pieces.encode(docs.repartition(7)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in again) == Counter((r.doc_id, tuple(r.ids)) for r in back)
    other = pieces.encode(docs, seed=2).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in other) != Counter((r.doc_id, tuple(r.ids)) for r in back)
    assert pieces.decode(pieces.encode(documents(spark, []))).collect() == []


def test_table_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    back = pieces.decode(pieces.encode(docs)).select("doc_id", "text")
    assert docs.exceptAll(back).count() == 0 and back.exceptAll(docs).count() == 0
