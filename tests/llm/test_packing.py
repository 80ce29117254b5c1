import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from samples import MESSY, SMALL, documents
from tokenizers import Tokenizer

from staygrid.llm import catalog, lengths, packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def plain_best_fit(sizes, window):
    """Bins by looking at every open bin."""
    rooms, where = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [b for b, room in enumerate(rooms) if room >= sizes[k]]
        if fits:
            b = min(fits, key=lambda b: rooms[b])
        else:
            b = len(rooms)
            rooms.append(window)
        where[k] = (b, window - rooms[b])
        rooms[b] -= sizes[k]
    return rooms


def test_best_fit_takes_the_tightest_window():
    turn = random.Random(1)
    for window in (1, 7, 64, 1024):
        for n in (0, 1, 5, 200):
            sizes = np.array([turn.randint(1, window) for _ in range(n)], np.int64)
            number, offset, used = packing.best_fit_decreasing(sizes, window)
            rooms = plain_best_fit(sizes.tolist(), window)
            fill = np.bincount(number, sizes, minlength=used).astype(int) if n else np.zeros(0, int)
            assert sorted(window - fill) == sorted(rooms)
            assert len(rooms) == used
            taken = defaultdict(list)
            for b, o, s in zip(number, offset, sizes, strict=True):
                taken[b].append((o, s))
            for spans in taken.values():
                spans.sort()
                assert [o for o, _ in spans] == list(np.cumsum([0, *[s for _, s in spans]])[:-1])


def check_pieces(rows, pieces, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= window
        by_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
        assert sum(n for _, n in spans) <= window
    expected = defaultdict(list)
    for doc, text in rows:
        expected[doc].append([*ids_of(text), 0])
    for doc, lists in expected.items():
        got = sorted(x for _, ids, _ in by_doc[doc] for x in ids)
        assert got == sorted(x for ids in lists for x in ids)
        if len(lists) == 1:
            parts = sorted(by_doc[doc])
            assert [x for _, ids, _ in parts for x in ids] == lists[0]
            assert {n for _, _, n in parts} == {len(lists[0])}
    return by_sequence


def test_messy_documents_are_packed_whole(spark):
    for group in (200, packing.GROUP_IDS):
        pieces = packing.pack(documents(spark, MESSY), window=64, group_ids=group).collect()
        check_pieces(MESSY, pieces, 64)
    assert packing.pack(documents(spark, [])).collect() == []


def test_special_token_text_and_white_space_runs(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "x   \n\n  y"), (3, "   "), (4, "it's 12,345   z")]
    check_pieces(rows, packing.pack(documents(spark, rows)).collect(), 1024)


def test_query_over_the_table_wastes_little(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sequences = check_pieces(rows, packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet")).collect(), 1024)
    filled = sum(n for spans in sequences.values() for _, n in spans)
    assert filled > 0.97 * 1024 * len(sequences)
    assert catalog.op1_packing(spark, SMALL).columns[:7] == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_length_sums_against_every_document(spark):
    sizes = np.array([len(ids_of(t)) for _, t in MESSY])
    sums = lengths.with_suffix_sums(lengths.length_histogram(documents(spark, MESSY))).cache()
    for r in sums.collect():
        n = r.n_tokens
        assert r.n_docs == (sizes == n).sum()
        assert (r.docs_at_least, r.docs_at_most) == ((sizes >= n).sum(), (sizes <= n).sum())
        assert r.tokens_at_least == sizes[sizes >= n].sum()
        assert r.truncated_total == np.minimum(sizes, n).sum()
        assert (r.total_docs, r.total_tokens) == (len(sizes), sizes.sum())
    limits = [0, 1, 3, 50, 10**6]
    asked = {r.context_limit: r for r in lengths.truncated_totals(sums, limits).collect()}
    for limit in limits:
        assert asked[limit].truncated_total == np.minimum(sizes, limit).sum()
        assert asked[limit].docs_cut == (sizes > limit).sum()
    for r in lengths.length_quantiles(sums, [0.0, 0.25, 0.5, 1.0]).collect():
        assert (sizes <= r.n_tokens).sum() >= r.share * len(sizes)
        assert (sizes < r.n_tokens).sum() < max(1e-9, r.share * len(sizes)) or r.n_tokens == sizes.min()
    sums.unpersist()
    assert lengths.with_suffix_sums(lengths.length_histogram(documents(spark, []))).collect() == []


def test_length_blocks(spark):
    histogram = spark.createDataFrame([(n, 1 + n % 3) for n in range(0, 60_000, 37)], "n_tokens long, n_docs long")
    rows = {r.n_tokens: r for r in lengths.with_suffix_sums(histogram).collect()}
    docs = total = 0
    for n in sorted(rows, reverse=True):
        docs, total = docs + 1 + n % 3, total + n * (1 + n % 3)
        assert (rows[n].docs_at_least, rows[n].tokens_at_least) == (docs, total)


def test_very_long_texts_without_breaks(spark):
    """Runs of white space beyond what the fast library's pattern can hold, and one letter."""
    rows = [(1, " " * 2_000_000), (2, "\n" * 2_000_000), (3, "a" * 2_000_000), (4, "x" + " \n" * 300_000 + "y")]
    docs = documents(spark, rows, clashes=False)
    got = {}
    for r in packing.pack(docs).select("doc_id", "length").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    want = {k: len(ids_of(t)) + 1 for k, t in rows}
    assert got == want
    assert {r.n_tokens: r.n_docs for r in lengths.length_histogram(docs).collect()} == dict(Counter(n - 1 for n in want.values()))
