"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The piece lattice of a text is filtered forward (the weight of all segmentations of each
prefix) and sampled backward (a piece is drawn in proportion to the segmentations it ends),
which draws a whole segmentation from the distribution over all of them. Draws depend on
the row's key and the place only, so they are the same wherever and however often a row is
encoded. A piece is never cut by the blank that starts a word, so the lattice falls apart
into units, and equal units of a batch share one lattice; all units of a batch advance
together in array operations.

The model file is a merge list: it ranks pieces but gives no probabilities. A piece of
rank r weighs as 1 / (r + 100), the usual fall-off of frequencies by rank; single
characters, which come last in the file, weigh like the rarest pieces. A character
without a piece is spelt in byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, id_and_text, map_batches
from staygrid.llm.ordermin import MIX_1, MIX_2, mixed

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
RANK_OFFSET = 100
SEED = 1
TEXT_TOGETHER = 1 << 19
UNIT = re.compile(" *[^ ]+| +")
MAX_CODE = 0x110000


class Lattice(NamedTuple):
    """Edges of many units, ordered by the node they end at; nodes are numbered through."""

    source: np.ndarray  # node an edge comes from
    piece: np.ndarray  # its piece, or -1 - character for one spelt in bytes
    reach: np.ndarray  # share of the end node's segmentations up to and with this edge
    entry: np.ndarray  # first edge into each node
    first: np.ndarray  # first and last node of each unit
    last: np.ndarray


class Pieces:
    """Vocabulary of one Python worker: a trie over character numbers, weights and bytes."""

    def __init__(self, model_path: str, temper: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int64)
        texts: dict[str, int] = {}
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:-1], 16)] = k
                self.bytes[k] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                texts[piece] = k
                self.bytes[k] = piece.replace(BLANK, " ").encode()
        self.weight = -temper * np.log(np.arange(size) + float(RANK_OFFSET))
        self.byte_weight = -temper * np.log(float(size + RANK_OFFSET))
        alphabet = sorted({c for t in texts for c in t})
        # 0 is every character that begins no piece; a blank stands for the model's mark,
        # and the mark itself, if a text has it, is spelt in bytes.
        self.number = np.zeros(MAX_CODE, np.int64)
        for k, c in enumerate(alphabet, 1):
            self.number[ord(" " if c == BLANK else c)] = k
        self.width = len(alphabet) + 1
        child: dict[int, int] = {}
        ends = {0: -1}
        for text, k in texts.items():
            node = 0
            for c in text:
                key = node * self.width + int(self.number[ord(" " if c == BLANK else c)])
                node = child.setdefault(key, len(child) + 1)
                ends.setdefault(node, -1)
            ends[node] = k
        self.fill(np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))
        self.ends = np.fromiter((ends[k] for k in range(len(child) + 1)), np.int64, len(child) + 1)

    def fill(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        """Hash table from (node, character) to the next node, an eighth full; -1 is free."""
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_node = np.full(1 << bits, -1), np.full(1 << bits, -1)
        slots = self.slots(keys)
        for key, node, slot in zip(keys.tolist(), nodes.tolist(), slots.tolist(), strict=True):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) % len(self.slot_key)
            self.slot_key[slot], self.slot_node[slot] = key, node

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX_1) >> self.shift).astype(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The node each (node, character) leads to, -1 if the trie has no such edge."""
        slot = self.slots(keys)
        held = self.slot_key[slot]
        found = np.where(held == keys, self.slot_node[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.slot_key)
            held = self.slot_key[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.slot_node[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found

    def lattice(self, units: list[str]) -> Lattice:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        start = np.cumsum(sizes) - sizes
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(code)
        unit = np.repeat(np.arange(len(units)), sizes)
        stop = (start + sizes)[unit]
        number = self.number[code]

        # All pieces that start at each place, one character further at a time.
        sources, lengths, found = [], [], []
        place, node, length = np.flatnonzero(number), None, 0
        node = np.zeros(len(place), np.int64)
        single = np.zeros(n, bool)
        while len(place):
            node = self.step(node * self.width + number[place + length])
            known = node >= 0
            place, node = place[known], node[known]
            length += 1
            piece = self.ends[node]
            ending = piece >= 0
            sources.append(place[ending])
            lengths.append(np.full(int(ending.sum()), length))
            found.append(piece[ending])
            if length == 1:
                single[place[ending]] = True
            inside = place + length < stop[place]
            place, node = place[inside], node[inside]
        spelt = np.flatnonzero(~single)
        sources.append(spelt)
        lengths.append(np.ones(len(spelt), np.int64))
        found.append(-1 - code[spelt])
        source, length, piece = (np.concatenate(x) for x in (sources, lengths, found))
        size = np.where(code[spelt] < 0x80, 1, np.where(code[spelt] < 0x800, 2, np.where(code[spelt] < 0x10000, 3, 4)))
        weight = np.empty(len(piece))
        plain = piece >= 0
        weight[plain] = self.weight[piece[plain]]
        weight[~plain] = size * self.byte_weight

        # Nodes: one more than characters in every unit.
        from_node = source + unit[source]
        to_node = from_node + length
        depth = source - start[unit[source]] + length
        # One key in place of three: no two edges into a node have the same length.
        order = np.argsort((depth * (n + len(units)) + to_node) * (int(length.max(initial=0)) + 1) + length)
        from_node, to_node, piece, weight, depth = (x[order] for x in (from_node, to_node, piece, weight, depth))
        head = np.ones(len(order), bool)
        head[1:] = to_node[1:] != to_node[:-1]
        heads = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        total = np.zeros(n + len(units))
        share = np.empty(len(order))
        # Forward: the units advance together, one character a step.
        steps = np.flatnonzero(np.diff(depth[heads], prepend=-1))
        for a, b in zip(steps, [*steps[1:], len(heads)], strict=True):
            lo, hi = heads[a], heads[b] if b < len(heads) else len(order)
            value = total[from_node[lo:hi]] + weight[lo:hi]
            cut = heads[a:b] - lo
            mine = group[lo:hi] - a
            top = np.maximum.reduceat(value, cut)
            part = np.exp(value - top[mine])
            whole = np.add.reduceat(part, cut)
            total[to_node[heads[a:b]]] = top + np.log(whole)
            share[lo:hi] = part / whole[mine]
        running = np.cumsum(share)
        running -= np.concatenate([[0.0], running])[heads][group]
        running[np.append(heads[1:], len(order)) - 1] = 1.0
        entry = np.full(n + len(units), -1, np.int64)
        entry[to_node[heads]] = heads
        first = start + np.arange(len(units))
        return Lattice(from_node, piece, running, entry, first, first + sizes)

    def sample(self, lattice: Lattice, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one segmentation for each (unit, key), back to back, and their counts.

        Backward: from the end of every unit a piece is drawn and its start is next.
        """
        node, first = lattice.last[unit].copy(), lattice.first[unit]
        active = np.arange(len(unit))
        owners, edges = [], []
        step = 0
        while len(active):
            step += 1
            draw = (mixed(key[active] + np.full(1, step, np.uint64) * MIX_2) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = lattice.entry[node[active]]
            # On to the edge whose share the draw falls in; the last one reaches 1.
            beyond = np.flatnonzero(draw >= lattice.reach[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[draw[beyond] >= lattice.reach[edge[beyond]]]
            owners.append(active)
            edges.append(edge)
            node[active] = lattice.source[edge]
            active = active[node[active] != first[active]]
        if not owners:
            return np.zeros(0, np.int64), np.zeros(len(unit), np.int64)
        count = np.bincount(np.concatenate(owners), minlength=len(unit))
        end = np.cumsum(count)
        piece = np.empty(int(end[-1]), np.int64)
        for k, (owner, edge) in enumerate(zip(owners, edges, strict=True)):
            piece[end[owner] - 1 - k] = lattice.piece[edge]
        if (piece >= 0).all():
            return piece, count
        ids: list[int] = []
        more = np.ones(len(piece), np.int64)
        for k in np.flatnonzero(piece < 0):
            more[k] = len(chr(-1 - int(piece[k])).encode())
        out = np.repeat(np.maximum(piece, 0), more)
        begin = np.cumsum(more) - more
        for k in np.flatnonzero(piece < 0):
            ids = self.byte_id[list(chr(-1 - int(piece[k])).encode())]
            out[begin[k] : begin[k] + more[k]] = ids
        owner = np.repeat(np.arange(len(unit)), count)
        return out, np.bincount(owner, more, minlength=len(unit)).astype(np.int64)

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each text; an empty text has none."""
        out: list[np.ndarray] = []
        a = 0
        while a < len(texts):
            b, held = a + 1, len(texts[a])
            while b < len(texts) and held + len(texts[b]) <= TEXT_TOGETHER:
                held += len(texts[b])
                b += 1
            out += self.encode_together(texts[a:b], keys[a:b])
            a = b
        return out

    def encode_together(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        # Blanks in a row belong to one unit; else every blank starts one.
        spaced = [bool(t) and (t[0] == " " or "  " in t) for t in texts]
        plain = pc.split_pattern(pa.array(["" if s else t for s, t in zip(spaced, texts, strict=True)]), " ")
        split = [UNIT.findall(" " + t) if s else [] for s, t in zip(spaced, texts, strict=True)]
        counts = np.where(spaced, np.fromiter(map(len, split), np.int64, len(texts)), plain.value_lengths())
        counts[[not t for t in texts]] = 0
        coded = plain.flatten().dictionary_encode()
        known = {" " + u: k for k, u in enumerate(coded.dictionary.to_pylist())}
        owner = np.repeat(np.arange(len(texts)), plain.value_lengths())
        skip = np.array([s or not t for s, t in zip(spaced, texts, strict=True)])
        unit = np.empty(int(counts.sum()), np.int64)
        fast = np.repeat(~skip, counts)
        unit[fast] = coded.indices.to_numpy(zero_copy_only=False)[~skip[owner]]
        number = known.setdefault
        unit[~fast] = [number(u, len(known)) for units in split for u in units]
        if not len(unit):
            return [np.zeros(0, np.int64) for _ in texts]
        place = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = np.repeat(keys, counts) + (place + 1).astype(np.uint64) * MIX_1
        ids, sizes = self.sample(self.lattice(list(known)), unit, mixed(key))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text the ids were made from: their bytes without the blank put in front."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_worker: dict[tuple[str, float], Pieces] = {}


def pieces_of(model_path: str, temper: float) -> Pieces:
    """One vocabulary per Python worker, kept between tasks."""
    if (model_path, temper) not in _worker:
        _worker[model_path, temper] = Pieces(model_path, temper)
    return _worker[model_path, temper]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(
    docs: DataFrame, seed: int = SEED, temper: float = 1.0, model_path: str | None = None
) -> DataFrame:
    """(doc_id, ids): one sampled segmentation of every text.

    ``temper`` sharpens (above 1) or flattens the distribution. The row's key is its
    doc_id with the seed, so repeated rows get the same ids; rows without an id are
    keyed by their text. Null and empty texts have no ids. No rows give no rows, other
    columns of ``docs`` are not read. Nothing is shuffled. All of a text is encoded; its
    lattice takes memory in proportion to its length.
    """
    path = model_path or default_model()
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(
        F.xxhash64(F.lit(seed), "doc_id")
    )
    rows = id_and_text(docs).withColumn("key", key)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, temper)
        for batch in batches:
            ids = pieces.encode(batch["text"].to_pylist(), batch["key"].to_numpy().view(np.uint64))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
            yield batch_of(doc_id=batch["doc_id"], ids=pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)))

    return map_batches(rows, encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) from any segmentation; null and no ids give the empty text."""
    path = model_path or default_model()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, 1.0)
        for batch in batches:
            bounds = batch["ids"].offsets.to_numpy()
            flat = batch["ids"].values.to_numpy()
            texts = [pieces.decode(flat[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield batch_of(doc_id=batch["doc_id"], ids=batch["ids"], text=pa.array(texts, pa.string()))

    rows = encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    )
    return map_batches(rows, decoded, "doc_id long, ids array<int>, text string")
