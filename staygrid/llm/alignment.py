"""Alignment of two tokenizers' tokens over the bytes they share.

Both id lists of a text are turned into the byte offsets their tokens end at. The offsets
go into dictionaries from end to index; the intersection of the two key sets, sorted, cuts
both lists into groups that cover the same bytes. All tokens of a group are linked across
the lists.

Neither list has a token across a blank between two characters that are not white space: A
cuts its words there, and no piece of B goes on after a blank that follows a character. So
a text is aligned word by word, and a worker aligns a word it has seen once only.

An id pair is counted by the documents that hold it linked, over the whole corpus. A task
gathers documents into blocks and numbers the different pairs of a block, so what is
counted and answered is one row per block and pair; a document only keeps the places of
its pairs in the block's list.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, id_and_text, map_batches
from staygrid.llm.tokens import byte_pairs, default_paths
from staygrid.session import stored

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
# Words kept by a worker, and characters of the longest it keeps.
WORDS_KNOWN, LONGEST_KNOWN = 200_000, 100
# Words aligned in one pass, and characters of the texts looked at together.
WORDS_TOGETHER, CHARS_TOGETHER = 5_000, 1 << 21
# Tokens of either list put into a dictionary at a time.
WINDOW = 1 << 11
# Links expanded at a time, and pairs (one per document and pair) of a block.
LINKS_TOGETHER = 1 << 21
BLOCK_PAIRS = 1 << 21
# Pairs in one row of a block's list, documents in one batch that is given back.
PAIRS_PER_ROW = 50_000
DOCS_PER_BATCH = 2_000

MEASURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
Paths = tuple[str, str, str]


def default_files() -> Paths:
    """Rank and tokenizer file of A, model file of B."""
    import public_tokenizers

    return (*default_paths(), public_tokenizers.path(MODEL))


class Tokens:
    """Bytes, lengths and decimal digits of the ids of one vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(e) for e in entries], np.int64)
        width = len(str(len(entries)))
        self.digits = np.array([str(k).encode() for k in range(len(entries))], f"S{width}")
        self.digits = self.digits.view(np.uint8).reshape(len(entries), width)

        self.first = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(size.sum()) + np.repeat(self.first[ids] - (ends - size), size)].tobytes()


class Word(NamedTuple):
    """A word's tokens and links."""

    n_a: int
    n_b: int
    groups: int
    links: int
    digits: bytes  # the groups as text, each with its semicolon
    codes: bytes  # one 64-bit code per link, unless it has ``pairs``
    pairs: tuple[np.ndarray, np.ndarray] | None = None  # codes and times of a long word


class Aligner:
    """Both tokenizers of one Python worker."""

    def __init__(self, ranks_path: str, tokenizer_path: str, model_path: str):
        import sentencepiece

        self.encoder = byte_pairs(ranks_path, tokenizer_path)
        with open(ranks_path, "rb") as lines:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        self.a = Tokens([ranks.get(k, b"") for k in range(max(ranks) + 1)])
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        entries = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            byte = bytes([int(piece[3:-1], 16)]) if self.model.is_byte(k) else None
            entries.append(piece.replace(BLANK, " ").encode() if byte is None else byte)
        self.b = Tokens(entries)
        self.words: dict[str, Word | None] = {}

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both lists; None if a list does not spell the text byte by byte."""
        whole = (" " + text).encode()
        a = self.encoder.encode_text(" " + text, special_as_text=True).astype(np.int64)
        b = np.array(self.model.encode(text), np.int64)
        if self.a.joined(a) != whole or self.b.joined(b) != whole:
            return None
        return a, b

    def cuts(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """How many tokens of either list end by each common end, in windows.

        Each window starts with the counts the one before ended with. A window without a
        common end is widened, so memory follows the longest stretch without one.
        """
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        i, j, wide = 0, 0, WINDOW
        while i < len(a):
            part_a, part_b = ends_a[i : i + wide].tolist(), ends_b[j : j + wide].tolist()
            at_a = dict(zip(part_a, range(i + 1, i + 1 + len(part_a)), strict=True))
            at_b = dict(zip(part_b, range(j + 1, j + 1 + len(part_b)), strict=True))
            common = sorted(at_a.keys() & at_b.keys())
            if not common:
                wide *= 2
                continue
            cut_a = np.fromiter(map(at_a.__getitem__, common), np.int64, len(common))
            cut_b = np.fromiter(map(at_b.__getitem__, common), np.int64, len(common))
            yield np.concatenate([[i], cut_a]), np.concatenate([[j], cut_b])
            i, j, wide = int(cut_a[-1]), int(cut_b[-1]), WINDOW

    def written(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """The groups between the cuts as ``a1,a2|b1;``, each with its semicolon."""
        first_a, first_b = cut_a[0], cut_b[0]
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        ids_a, ids_b = a[first_a : cut_a[-1]], b[first_b : cut_b[-1]]
        at_a = np.arange(len(ids_a)) + np.repeat(cut_b[:-1] - first_b, n_a)
        at_b = np.arange(len(ids_b)) + np.repeat(cut_a[1:] - first_a, n_b)
        wide_a, wide_b = self.a.digits.shape[1], self.b.digits.shape[1]
        out = np.zeros((len(ids_a) + len(ids_b), max(wide_a, wide_b) + 1), np.uint8)
        out[:, -1] = ord(",")
        out[at_a, :wide_a] = self.a.digits[ids_a]
        out[at_b, :wide_b] = self.b.digits[ids_b]
        out[at_a[cut_a[1:] - first_a - 1], -1] = ord("|")
        out[at_b[cut_b[1:] - first_b - 1], -1] = ord(";")
        return out[out > 0].tobytes()


def expanded(
    a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray
) -> np.ndarray:
    """Codes of all links of the slices, in their order."""
    size = n_a * n_b
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    across = np.repeat(n_b, size)
    return a[np.repeat(start_a, size) + place // across] << 32 | b[np.repeat(start_b, size) + place % across]


def pairs_between(
    a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Codes of the linked id pairs, and how often each is meant (None: once), slice by slice."""
    n_a, n_b = np.diff(cut_a), np.diff(cut_b)
    single = (n_a == 1) & (n_b == 1)
    codes = a[cut_a[:-1][single]] << 32 | b[cut_b[:-1][single]]
    yield codes, None
    start_a, start_b, n_a, n_b = (x[~single] for x in (cut_a[:-1], cut_b[:-1], n_a, n_b))
    links = n_a * n_b
    large = links > LINKS_TOGETHER
    for i, j, x, y in zip(*(v[large].tolist() for v in (start_a, start_b, n_a, n_b)), strict=True):
        own, times = np.unique(a[i : i + x], return_counts=True)
        other, held = np.unique(b[j : j + y], return_counts=True)
        for code, n in zip(own.tolist(), times.tolist(), strict=True):
            yield code << 32 | other, n * held
    start_a, start_b, n_b, links = (x[~large] for x in (start_a, start_b, n_b, links))
    turn = np.cumsum(links) // LINKS_TOGETHER
    for k in range(int(turn[-1]) + 1 if len(turn) else 0):
        some = turn == k
        yield expanded(a, b, start_a[some], start_b[some], n_a[~large][some], n_b[some]), None


def added(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, ascending, and the sum of their times."""
    single = [codes for codes, times in parts if times is None]
    code, total = np.unique(np.concatenate([np.zeros(0, np.int64), *single]), return_counts=True)
    rest = [(codes, times) for codes, times in parts if times is not None]
    if not rest:
        return code, total
    codes, times = (np.concatenate(x) for x in zip((code, total), *rest, strict=True))
    code, inverse = np.unique(codes, return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, inverse, times)
    return code, total


def long_word(both: Aligner, a: np.ndarray, b: np.ndarray) -> Word:
    groups, links, digits, parts = 0, 0, [], []
    for cut_a, cut_b in both.cuts(a, b):
        digits.append(both.written(a, b, cut_a, cut_b))
        groups += len(cut_a) - 1
        links += int((np.diff(cut_a) * np.diff(cut_b)).sum())
        parts.append(added(list(pairs_between(a, b, cut_a, cut_b))))
    return Word(len(a), len(b), groups, links, b"".join(digits), b"", added(parts) if len(parts) > 1 else parts[0])


def learn(both: Aligner, words: list[str]) -> None:
    """Align words that neither start nor end with white space; they share one pass."""
    spelt = [(" " + w).encode() for w in words]
    lists = both.model.encode(words, num_threads=1)
    n_b = np.fromiter(map(len, lists), np.int64, len(lists))
    b = np.fromiter(chain.from_iterable(lists), np.int64, n_b.sum())
    if both.b.joined(b) != b"".join(spelt):
        good = [both.b.joined(np.array(x, np.int64)) == y for x, y in zip(lists, spelt, strict=True)]
        both.words.update((w, None) for w, ok in zip(words, good, strict=True) if not ok)
        words = [w for w, ok in zip(words, good, strict=True) if ok]
        if words:
            learn(both, words)
        return
    a = both.encoder.encode_text(" " + " ".join(words), special_as_text=True).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))
    stop_a = np.searchsorted(np.cumsum(both.a.length[a]), ends) + 1
    stop_b = np.cumsum(n_b)
    cuts = list(both.cuts(a, b))
    cut_a, cut_b = (np.concatenate([[0], *(c[k][1:] for c in cuts)]) for k in (0, 1))
    stop = np.searchsorted(cut_a, stop_a)  # groups up to the end of each word
    digits = both.written(a, b, cut_a, cut_b)
    semicolons = np.flatnonzero(np.frombuffer(digits, np.uint8) == ord(";")) + 1
    links = np.cumsum(np.diff(cut_a) * np.diff(cut_b))
    codes = expanded(a, b, cut_a[:-1], cut_b[:-1], np.diff(cut_a), np.diff(cut_b)).tobytes()
    ends = zip(*(x.tolist() for x in (stop_a, stop_b, stop, semicolons[stop - 1], links[stop - 1])), strict=True)
    i = j = g = d = n = 0
    for word, (stop_i, stop_j, stop_g, stop_d, stop_n) in zip(words, ends, strict=True):
        both.words[word] = Word(
            stop_i - i, stop_j - j, stop_g - g, stop_n - n, digits[d:stop_d], codes[8 * n : 8 * stop_n]
        )
        i, j, g, d, n = stop_i, stop_j, stop_g, stop_d, stop_n


def words_of(both: Aligner, texts: list[str]) -> list[list[Word] | None]:
    """The words of each text; None if it is empty or a list does not spell it."""
    split = [BETWEEN_WORDS.split(text) if text else [] for text in texts]
    known = both.words
    if len(known) > WORDS_KNOWN:
        known.clear()
    fresh = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]
    usual = [w for w in fresh if len(w) <= LONGEST_KNOWN and not (w[0].isspace() or w[-1].isspace())]
    for k in range(0, len(usual), WORDS_TOGETHER):
        learn(both, usual[k : k + WORDS_TOGETHER])
    rest = [w for w in fresh if w not in known]
    for word in rest:
        lists = both.encode(word)
        known[word] = lists and long_word(both, *lists)
    found = [list(map(known.__getitem__, words)) or None for words in split]
    for word in rest:  # seldom seen again, and may be long
        del known[word]
    return [None if words and None in words else words for words in found]


def pairs_of(words: list[Word]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of all links of the words, ascending, and how many links each has."""
    codes = np.frombuffer(b"".join([w.codes for w in words]), np.int64)
    return added([(codes, None), *(w.pairs for w in words if w.pairs is not None)])


_worker: dict[Paths, Aligner] = {}


def aligner(paths: Paths) -> Aligner:
    """One pair of tokenizers per Python worker, kept between tasks."""
    if paths not in _worker:
        _worker[paths] = Aligner(*paths)
    return _worker[paths]


def aligned(docs: DataFrame, paths: Paths | None = None) -> DataFrame:
    """(doc_id, ids_a, ids_b, stops_a, stops_b): both id lists of each row and their cuts.

    Group k holds ``ids_a[stops_a[k-1]:stops_a[k]]`` and ``ids_b[stops_b[k-1]:stops_b[k]]``.
    No shuffle. Null and empty texts, and texts that a list does not spell byte by byte
    (a text with U+2581, say), have empty lists. Repeated rows are kept, a null doc_id
    stays null, no rows give no rows, other columns are not read. A long text is cut in
    windows; its id lists are whole.
    """
    paths = paths or default_files()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(paths)
        none = np.zeros(0, np.int64)
        for batch in batches:
            lists: list[list[np.ndarray]] = [[], [], [], []]
            for text in batch["text"].to_pylist():
                row: list[list[np.ndarray]] = [[none], [none], [none], [none]]
                words = [both.encode(word) for word in BETWEEN_WORDS.split(text)] if text else []
                n_a = n_b = 0
                for a, b in words if None not in words else ():
                    stops = list(both.cuts(a, b))
                    row[0].append(a)
                    row[1].append(b)
                    row[2] += [n_a + cut_a[1:] for cut_a, _ in stops]
                    row[3] += [n_b + cut_b[1:] for _, cut_b in stops]
                    n_a, n_b = n_a + len(a), n_b + len(b)
                for out, values in zip(lists, row, strict=True):
                    out.append(np.concatenate(values))
            arrays = [pa.array([v.astype(np.int32) for v in x], pa.list_(pa.int32())) for x in lists]
            yield batch_of(
                doc_id=batch["doc_id"], **dict(zip(("ids_a", "ids_b", "stops_a", "stops_b"), arrays, strict=True))
            )

    lists = "ids_a array<int>, ids_b array<int>, stops_a array<int>, stops_b array<int>"
    return map_batches(id_and_text(docs), cut, f"doc_id long, {lists}")


def blocks_of(docs: DataFrame, paths: Paths) -> DataFrame:
    """Rows of two kinds: a document with its measures and the places of its pairs, and,
    with null in ``body``, a stretch of a block's pairs with the documents that hold each."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(paths)
        block = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        held = 0

        def measured(doc_id: int | None, words: list[Word] | None) -> tuple:
            if words is None:
                return (doc_id, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
            n_a, n_b, groups, links, digits, _, _ = zip(*words, strict=True)
            digest = hashlib.sha256(b"".join(digits)[:-1]).hexdigest()
            return (doc_id, sum(n_a), sum(n_b), sum(groups), sum(links), digest, *pairs_of(words))

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal block, waiting, held
            sizes = [len(w[6]) for w in waiting]
            code, place, n = np.unique(
                np.concatenate([w[6] for w in waiting]), return_inverse=True, return_counts=True
            )
            for k in range(0, len(code), PAIRS_PER_ROW):
                some = code[k : k + PAIRS_PER_ROW]
                columns = [some >> 32, some & 0xFFFFFFFF, n[k : k + PAIRS_PER_ROW]]
                yield rows([None] * 6, [None], [k], [pa.array([c.astype(np.int32)], pa.list_(pa.int32())) for c in columns])
            ends = np.cumsum(sizes)
            for k in range(0, len(waiting), DOCS_PER_BATCH):
                some = waiting[k : k + DOCS_PER_BATCH]
                body = []
                for size, end, w in zip(sizes[k : k + DOCS_PER_BATCH], ends[k : k + DOCS_PER_BATCH], some, strict=True):
                    steps = np.diff(place[end - size : end], prepend=0).astype("<u4")
                    body.append(zlib.compress(steps.tobytes() + w[7].astype("<i8").tobytes(), 1))
                nothing = pa.nulls(len(some), pa.list_(pa.int32()))
                yield rows([[w[c] for w in some] for c in range(6)], body, [None] * len(some), [nothing] * 3)
            block, waiting, held = block + 1, [], 0

        def rows(measures: list, body: list, start: list, lists: list[pa.Array]) -> pa.RecordBatch:
            measures = [[None]] * 6 if measures[0] is None else measures
            kinds = [pa.int64()] * 5 + [pa.string()]
            named = zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), measures, kinds, strict=True)
            return batch_of(
                block=pa.array([block] * len(body), pa.int64()),
                **{name: pa.array(values, kind) for name, values, kind in named},
                body=pa.array(body, pa.binary()), start=pa.array(start, pa.int64()),
                a=lists[0], b=lists[1], docs=lists[2],
            )

        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            turn = np.cumsum([len(t) for t in texts]) // CHARS_TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(texts)]
            for i, j in zip(edges, edges[1:], strict=False):
                for doc_id, words in zip(ids[i:j], words_of(both, texts[i:j]), strict=True):
                    waiting.append(measured(doc_id, words))
                    held += len(waiting[-1][6]) + 100
                    if held >= BLOCK_PAIRS:
                        yield from given()
        if waiting:
            yield from given()

    lists = "a array<int>, b array<int>, docs array<int>"
    return map_batches(id_and_text(docs), encoded, f"block long, {MEASURES}, body binary, start long, {lists}")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, place, a, b, docs): one row per block and pair."""
    lists = blocks.where(F.col("body").isNull()).select(
        "block", "start", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "pair")
    )
    return lists.select("block", (F.col("start") + F.col("at")).alias("place"), "pair.a", "pair.b", "pair.docs")


def counted(pairs: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): documents that hold each pair linked; whether that is the most
    of its A id. Stored once."""
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("n_docs")), "alignment-counts")
    # At most one row per id of A's vocabulary.
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    return counts.join(F.broadcast(top), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, paths: Paths | None = None) -> DataFrame:
    """(a, b, n_docs, best) of every id pair linked anywhere in ``docs``.

    Rows count as documents, also repeated ones and those with a null or equal doc_id.
    """
    return counted(block_pairs(blocks_of(docs, paths or default_files())))


def measured(docs: DataFrame, paths: Paths | None = None) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is held by as many documents as any pair of its A
    id (ties count), ``count_sum`` adds up their documents over all links. Null and empty
    texts, and texts that a list does not spell byte by byte, have zeros and an empty
    hash. Every row is a document, also repeated rows and rows of null or equal doc_id;
    no rows give no rows; other columns are not read. A long text is cut in windows and
    may fill a block of its own. Two jobs run while the plan is built; texts are encoded
    once.
    """
    blocks = stored(blocks_of(docs, paths or default_files()), "alignment-blocks")
    pairs = block_pairs(blocks)
    answers = pairs.join(counted(pairs), ["a", "b"]).select("block", "place", "n_docs", "best")
    wanted = blocks.where(F.col("body").isNotNull()).drop("start", "a", "b", "docs")
    met = answers.unionByName(wanted, allowMissingColumns=True)
    dealt = met.repartition("block").sortWithinPartitions("block", F.col("body").isNotNull(), "place")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, ready = None, [], None
        for batch in batches:
            at = batch["block"].to_numpy()
            answer = batch["body"].is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((at[1:] != at[:-1]) | (answer[1:] != answer[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                if i == j:
                    continue
                if at[i] != block:
                    block, known, ready = at[i], [], None
                part = batch.slice(i, j - i)
                if answer[i]:
                    known.append((part["n_docs"].to_numpy(), part["best"].to_numpy(zero_copy_only=False)))
                    continue
                if ready is None:
                    empty = (np.zeros(0, np.int64), np.zeros(0, bool))
                    ready = [np.concatenate(x) for x in zip(empty, *known, strict=True)]
                    known = []
                n_best, total = [], []
                for body in part["body"].to_pylist():
                    raw = zlib.decompress(body)
                    size = len(raw) // 12
                    place = np.cumsum(np.frombuffer(raw, "<u4", size), dtype=np.int64)
                    times = np.frombuffer(raw, "<i8", size, 4 * size)
                    n_best.append(int(times[ready[1][place]].sum()))
                    total.append(int((times * ready[0][place]).sum()))
                yield batch_of(
                    doc_id=part["doc_id"], n_a=part["n_a"], n_b=part["n_b"], n_groups=part["n_groups"],
                    n_links=part["n_links"], n_best=pa.array(n_best, pa.int64()),
                    count_sum=pa.array(total, pa.int64()), groups_sha256=part["groups_sha256"],
                )

    return map_batches(dealt, answered, f"{MEASURES.replace('groups_sha256', 'n_best long, count_sum long, groups_sha256')}")
