import random
import re

import pytest
from samples import MESSY, SMALL, documents

from staygrid.llm import repetition
from staygrid.llm.repetition import Limits, covered_by, longest_repeats, measure

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_reach(words):
    n = len(words)
    reach = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                reach[i] = max(reach[i], k)
    return reach


def plain_covered(reach, least):
    covered = set()
    for i, k in enumerate(reach):
        if k >= least:
            covered.update(range(i, i + k))
    return covered


def plain_measure(text, limits):
    words = WORD.findall(text or "")
    reach = plain_reach(words)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, failed = len(words), len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    covered = plain_covered(reach, limits.min_repeat)
    return {
        "n_words": n, "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": sum(x in lines[:k] for k, x in enumerate(lines)), "n_repeat_words": len(repeated),
        "covered_words": len(covered), "longest_repeat": max(reach, default=0), "base_failed": failed,
        "kept": not failed and len(covered) <= limits.max_covered * n and max(reach, default=0) <= limits.max_longest,
    }


def test_longest_repeats_of_many_documents_at_once():
    turn = random.Random(1)
    docs = [
        [turn.choice([b"a", b"b", b"c"][: turn.randint(1, 3)]) for _ in range(turn.randint(0, 40))]
        for _ in range(120)
    ]
    reach, bounds = longest_repeats(docs)
    covered = covered_by(reach, 4)
    for k, words in enumerate(docs):
        own = reach[bounds[k] : bounds[k + 1]].tolist()
        assert own == plain_reach(words)
        got = {i for i, c in enumerate(covered[bounds[k] : bounds[k + 1]]) if c}
        assert got == plain_covered(own, 4)


@pytest.mark.parametrize("limits", [Limits(), Limits(3, 0.1, 5)])
def test_measures_against_plain_counting(spark, limits):
    rows = [(d, t) for d, t in MESSY if len(t or "") < 5000]
    got = repetition.quality_rules(documents(spark, rows), limits).collect()
    key = lambda r: str(sorted(r.items()))
    have = sorted(
        ({k: v for k, v in r.asDict().items() if k != "spans"} for r in got), key=key
    )
    want = sorted(({"doc_id": d, **plain_measure(t, limits)} for d, t in rows), key=key)
    assert have == want
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.covered_words


def test_table_against_plain_counting(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 2500}
    for r in repetition.quality_rules(docs).collect():
        if r.doc_id in texts:
            have = {k: v for k, v in r.asDict().items() if k not in ("doc_id", "spans")}
            assert have == plain_measure(texts[r.doc_id], Limits())


def test_one_word_over_and_over_and_long_texts():
    found = measure(["same " * 30_000, "a b " * 10_000, ""], Limits())
    assert [f["longest_repeat"] for f in found] == [29_999, 19_998, 0]
    assert [f["covered_words"] for f in found] == [30_000, 20_000, 0]
    assert not any(f["kept"] for f in found)


def test_filter_keeps_columns_and_clean_rows(spark):
    turn = random.Random(3)
    fresh = " ".join("".join(turn.choices("abcdefgh", k=6)) for _ in range(300))
    block = " ".join("".join(turn.choices("abcdefgh", k=6)) for _ in range(250))
    docs = documents(spark, [(1, fresh), (2, f"{block} {fresh} {block}"), (3, None), (None, fresh)])
    kept = repetition.keep_clean(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert repetition.keep_clean(documents(spark, [])).collect() == []


@pytest.mark.parametrize(
    "passage,n,kept",
    [(190, 800, False), (60, 400, False), (120, 1200, False), (40, 400, True), (0, 400, True)],
)
def test_each_limit_rejects_what_the_base_rules_pass(passage, n, kept):
    words = [f"w{k}" for k in range(n - passage)]
    found = measure([" ".join([*words, *words[:passage]])], Limits())[0]
    assert not found["base_failed"] and found["kept"] == kept
    assert found["longest_repeat"] == passage and found["covered_words"] == 2 * passage
    # (190, 800) breaks both limits, (60, 400) the share alone, (120, 1200) the length alone.
    assert (2 * passage > 0.25 * n, passage > 100) == {
        190: (True, True), 60: (True, False), 120: (False, True), 40: (False, False), 0: (False, False),
    }[passage]
