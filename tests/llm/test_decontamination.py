import hashlib
import random
import re

import numpy as np
import pytest
from samples import MESSY, SMALL, documents

from staygrid.llm import decontamination as leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(rows, items, span=leaks.SPAN):
    held = {}
    for item, text in items:
        own = words(text)
        for k in range(max(0, len(own) - span) + 1 if own else 0):
            held.setdefault(tuple(own[k : k + span]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in held}
    out = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in held:
                    hit.update(range(k, k + size))
                    found |= held[tuple(own[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, bool(hit)))
    return out


def benchmark(spark, rows):
    schema = "item_id long, text string, row_id string, length string, fingerprint string"
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], schema)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def planted():
    """Items of any length, shared and repeated windows; texts made of parts of them."""
    turn = random.Random(5)
    vocabulary = ["".join(turn.choices("abé0", k=turn.randint(1, 3))) for _ in range(60)]
    items = [(k, " ".join(turn.choices(vocabulary, k=turn.randint(1, 30)))) for k in range(25)]
    common = " ".join(turn.choices(vocabulary, k=14))
    items += [(100 + k, f"{common}, {' '.join(turn.choices(vocabulary, k=k))}") for k in range(6)]
    items += [(None, None), (None, "lone Word"), (7, "same id " * 7), (200, ""), (201, " .,- "), (202, "Z"), (203, "z")]
    rows = []
    for k in range(60):
        parts = [" ".join(turn.choices(vocabulary, k=turn.randint(0, 40)))]
        for _ in range(turn.randint(0, 3)):
            own = (turn.choice(items)[1] or "").split()
            a = turn.randint(0, len(own))
            parts += [" ".join(own[a : a + turn.randint(0, 20)]).upper(), turn.choice(vocabulary)]
        rows.append((k, "; ".join(parts)))
    return [*rows, (0, common), (None, common + "!"), *[(300, common)] * 40], items


@pytest.mark.parametrize("items", ["planted", "none", "empty"])
def test_against_brute_force(spark, items):
    rows, held = planted()
    held = {"planted": held, "none": [], "empty": [(1, ""), (2, None)]}[items]
    rows = [*MESSY, *rows]
    got = [tuple(r) for r in leaks.decontaminate(documents(spark, rows), benchmark(spark, held)).collect()]
    assert in_order(got) == in_order(plain(rows, held))
    assert leaks.decontaminate(documents(spark, []), benchmark(spark, held)).collect() == []


def test_other_sizes_and_spans(spark):
    rows, held = planted()
    for span, gram in ((4, 2), (3, 3), (1, 1)):
        docs, items = documents(spark, rows[:40]), benchmark(spark, held)
        got = [tuple(r) for r in leaks.decontaminate(docs, items, span, gram).collect()]
        assert in_order(got) == in_order(plain(rows[:40], held, span))
    stretches = {}
    for r in leaks.spans(documents(spark, rows), benchmark(spark, held)).collect():
        stretches.setdefault((r.doc_id, r.start), r.stop - r.start)
    for doc, _, n_hit, *_ in plain(rows[:60], held)[1:]:
        assert sum(n for (d, _), n in stretches.items() if d == doc) == n_hit


def test_winnowing_guarantee():
    turn = np.random.default_rng(1)
    for _ in range(50):
        shared = turn.integers(0, 2**63, leaks.SPAN, np.int64).astype(np.uint64)
        a, b = (turn.integers(0, 2**63, n, np.int64).astype(np.uint64) for n in turn.integers(0, 50, 2))
        left, right = (leaks.fingerprints(np.concatenate([x, shared, x]), 10, 10, 5) for x in (a, b))
        assert left[len(a)] == right[len(b)]
    values = turn.integers(0, 99, 40)
    for width in range(1, 12):
        assert leaks.least_of(values, width).tolist() == [min(values[k : k + width]) for k in range(41 - width)]


def test_given_tables_and_long_texts(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs += [(-1, f"{'w ' * 700_000} {items[3][1]} {'x' * 1_000_000} {items[4][1]}"), (-2, "é" * 1_000_000)]
    got = leaks.decontaminate(documents(spark, docs, clashes=False), benchmark(spark, items)).collect()
    assert in_order(map(tuple, got)) == in_order(plain(docs, items))
    assert any(r.contaminated for r in got if r.doc_id >= 0)
    monkeypatch.setattr(leaks, "BYTES_TOGETHER", 7)
    text = "one two  threefourfive six, " * 3
    assert len(np.concatenate(leaks.codes_of(text, leaks.Words()))) == len(words(text))
