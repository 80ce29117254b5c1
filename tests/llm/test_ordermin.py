import hashlib
import random

import numpy as np
import pytest
from samples import MESSY, documents

from staygrid.llm import ordermin
from staygrid.llm.ordermin import KMER, ORDERS, PICKED, likeness, signature, written

M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_signature(text):
    if not text:
        return [0] * ORDERS
    k = min(KMER, len(text))
    seen, kmers = {}, []
    for i in range(len(text) - k + 1):
        own = text[i : i + k]
        number = seen.get(own, 0)
        seen[own] = number + 1
        h = k
        for c in own:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M64
        h = mix(h)
        kmers.append((h, mix((h + number * 0x9E3779B97F4A7C15) & M64)))
    out = []
    for j in range(1, ORDERS + 1):
        factor = mix(j * 0x9E3779B97F4A7C15 & M64) | 1
        best = sorted(range(len(kmers)), key=lambda i: (kmers[i][1] * factor & M64, i))[:PICKED]
        h = factor
        for i in sorted(best):
            h = mix((h * 0x9E3779B97F4A7C15 + kmers[i][0]) & M64)
        out.append(h)
    return out


def test_signature_against_plain_code(monkeypatch):
    turn = random.Random(3)
    texts = ["", "a", "ab", "aaaa" * 9, "é😀" * 7] + ["".join(turn.choices("abc ", k=turn.randint(0, 90))) for _ in range(60)]
    for together in (1 << 16, 7, 1):
        monkeypatch.setattr(ordermin, "KMERS_TOGETHER", together)
        for text in texts:
            assert signature(text).tolist() == plain_signature(text)


def test_order_and_repeats_matter():
    turn = random.Random(1)
    words = ["".join(turn.choices("abcdefghijklmnop", k=7)) for _ in range(200)]
    text = " ".join(words)
    typo = text[:700] + "#" + text[701:]
    swapped = " ".join(words[100:] + words[:100])
    other = " ".join("".join(turn.choices("abcdefghijklmnop", k=7)) for _ in range(200))
    own = signature(text)
    assert likeness(own, own) == 1
    assert likeness(own, signature(typo)) > 0.7
    # The same k-mers in another order: tuples over the seam no longer agree.
    assert likeness(own, signature(swapped)) < 0.85
    assert likeness(own, signature(text * 3)) < 0.7
    assert likeness(own, signature(other)) == 0


def plain_rows(rows, hashes):
    order = sorted(
        ((d, t or "") for d, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]), reverse=True,
    )
    out = []
    for k, (doc, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = signature(text), signature(changed), signature(following)
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(a), written(b),
                    float(np.mean(a == b)), float(np.mean(a == c))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_next_rows_in_ranges(spark, parts):
    from pyspark.sql import functions as F

    for rows in (MESSY, MESSY[3:4], [(None, "b"), (None, "a"), (None, None)], [(k, f"text {k}") for k in range(200)], []):
        docs = documents(spark, rows)
        text = F.coalesce("text", F.lit(""))
        hashes = {r[0]: r[1] for r in docs.select(text, F.xxhash64(text)).collect()}
        got = [tuple(r) for r in ordermin.compared(docs, parts).collect()]
        assert sorted(got, key=str) == plain_rows(rows, hashes)


def test_fingerprints_alone(spark):
    got = ordermin.fingerprints(documents(spark, MESSY)).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted(
        (str(d), written(signature(t or ""))) for d, t in MESSY)
