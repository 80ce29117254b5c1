import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from samples import MESSY, documents
from tokenizers import Tokenizer

from staygrid.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    """The byte each character of a byte-level entry stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(c): b for b, c in [*((b, b) for b in shown), *((b, 256 + k) for k, b in enumerate(rest))]}


LETTERS = letters()


def bytes_a(k):
    return bytes(LETTERS[c] for c in A.id_to_token(k))


def bytes_b(k):
    piece = B.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(k) else piece.replace("▁", " ").encode()


def plain_groups(text):
    """Groups by walking both byte strings, or None."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
        return None
    groups, left, right, i, j = [], [], [], 0, 0
    at_a = at_b = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(bytes_a(a[i]))
            left.append(a[i])
            i += 1
        else:
            at_b += len(bytes_b(b[j]))
            right.append(b[j])
            j += 1
        if at_a == at_b:
            groups.append((left, right))
            left, right = [], []
    return a, b, groups


def plain_measures(rows):
    found = [plain_groups(t) for _, t in rows]
    links = [Counter((x, y) for a, b in f[2] for x in a for y in b) if f else Counter() for f in found]
    count = Counter(p for link in links for p in link)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for (doc, _), f, link in zip(rows, found, links, strict=True):
        if not f:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups = f
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc, len(a), len(b), len(groups), sum(link.values()),
            sum(n for p, n in link.items() if count[p] == top[p[0]]),
            sum(n * count[p] for p, n in link.items()), hashlib.sha256(line.encode()).hexdigest(),
        ))
    return out


ODD = [
    (50, "<|endoftext|> <s> </s> <unk> <0x41>"), (51, "a▁b"), (52, "\x00\x01 zero"), (53, " lead  and trail "),
    (54, "日本語のテキスト 한국어 العربية"), (55, "🙂" * 50), (56, "a" * 3000), (57, " " * 500), (58, "\r\n\t x"),
]


def by_place(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("sizes", [None, (3, 5, 20)])
def test_measures_against_brute_force(spark, monkeypatch, sizes):
    if sizes:  # sizes only shape the work; the tasks run in this process' children
        for name, value in zip(("WINDOW", "LINKS_TOGETHER", "BLOCK_PAIRS"), sizes, strict=True):
            monkeypatch.setattr(alignment, name, value)
        rows = [(k, t) for k, t in [*MESSY, *ODD] if len(t or "") < 400]
        both = alignment.Aligner(*alignment.default_files())
        for _, text in rows:
            want = plain_groups(text)
            assert (want is None) == (alignment.words_of(both, [text or ""]) == [None])
            if want:
                a, b = both.encode(text)
                cuts = list(both.cuts(a, b))
                assert b"".join(both.written(a, b, *c) for c in cuts)[:-1].decode() == ";".join(
                    ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want[2]
                )
                code, n = alignment.added([alignment.added(list(alignment.pairs_between(a, b, *c))) for c in cuts])
                link = Counter((x, y) for g, h in want[2] for x in g for y in h)
                assert {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(m) for c, m in zip(code, n, strict=True)} == link
        return
    rows = [*MESSY, *ODD]
    got = [tuple(r) for r in alignment.measured(documents(spark, rows)).collect()]
    assert by_place(got) == by_place(plain_measures(rows))


def test_lists_and_cuts(spark):
    rows = [*ODD, (None, None), (1, ""), (1, "tie"), (1, "tie")]
    got = alignment.aligned(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(ODD)
    for r in got:
        want = plain_groups(text.get(r.doc_id)) if r.doc_id in text else plain_groups("tie" if r.ids_a else "")
        if want is None:
            assert (r.ids_a, r.ids_b, r.stops_a, r.stops_b) == ([], [], [], [])
            continue
        assert (r.ids_a, r.ids_b) == (want[0], want[1])
        assert r.stops_a == np.cumsum([len(x) for x, _ in want[2]]).tolist()
        assert r.stops_b == np.cumsum([len(y) for _, y in want[2]]).tolist()


def test_words_are_those_of_the_whole_text():
    """No token goes across the blank between two words, in either list."""
    for piece in map(B.id_to_piece, range(B.get_piece_size())):
        assert "▁" not in piece.lstrip("▁")
    both = alignment.Aligner(*alignment.default_files())
    turn = random.Random(8)
    for _ in range(3000):
        text = "".join(turn.choices(["a", "the", " ", " ", "  ", "\n", "\t ", "'s", " 12", "é", "日本", "\x1c", "\u3000", "\xa0", ".", "<s>"], k=12))
        want, words = plain_groups(text), alignment.words_of(both, [text])[0]
        assert (want is None) == (words is None)
        if want:
            line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want[2])
            assert b"".join(w.digits for w in words)[:-1].decode() == line


def test_no_rows_and_pair_counts(spark):
    assert alignment.measured(documents(spark, [])).collect() == []
    rows = [(1, "one two"), (1, "one two"), (None, "two one one")]
    got = {(r.a, r.b): r.n_docs for r in alignment.pair_counts(documents(spark, rows)).collect()}
    want = Counter()
    for _, text in rows:
        want.update({(x, y) for a, b in plain_groups(text)[2] for x in a for y in b})
    assert got == want


def test_a_very_long_text(spark):
    """White space, one letter, and bytes without a common end, of a million each."""
    rows = [(1, " " * 1_000_000), (2, "b" * 1_000_000), (3, "\n" * 1_000_000)]
    got = {r.doc_id: r for r in alignment.measured(documents(spark, rows, clashes=False)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert all(r.n_groups > 0 and r.n_links >= r.n_groups for r in got.values())
    assert got[3].n_b == 1_000_001
