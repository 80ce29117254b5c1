"""Repair of conversations: the cheapest edits that make turns alternate.

A repaired conversation is an optional system turn and then pairs of user and assistant.
The search is a Viterbi over four states (nothing yet, after system, after user, after
assistant). Survivors of the states hang in a tree of back pointers whose nodes count their
references; what all survivors share is emitted and forgotten, so memory follows the
unresolved end of a conversation and not its length. Of equally cheap edits the
alphabetically least win, for which the whole unresolved ends of both are compared.

A survivor also goes if another one can follow any of its futures for less: at the cost of
an insert or two, or of a deleted system turn. Otherwise the state that deletes everything
would tie the tree to the first row for ever.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, map_batches

# Fixed values of the contract: costs of the edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK, DUPLICATE, CUT = 1, 2, 3

START, SYSTEM, USER, ASSISTANT = range(4)
# The state an inserted or reroled turn leads to, and one that is kept, by its initial.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
# Most it costs the state of the row to follow any future of the state of the column.
FOLLOW = (
    (0, 0, INSERT, 0),
    (2 * INSERT, 0, INSERT, 2 * INSERT),
    (INSERT + DELETE, INSERT, 0, INSERT),
    (DELETE, 0, INSERT, 0),
)
LEGAL = {"su", "ua", "au"}
# Unresolved rows before the shared part is looked for.
SETTLE = 32
SPACE = "[^\\x20\\x09-\\x0D]"


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: int


class Edit(NamedTuple):
    edit: str
    turn: int | None
    role: str
    text: str


class Node:
    """The edits of one row, below those of the rows before."""

    __slots__ = ("parent", "label", "references")

    def __init__(self, parent: Node | None, label: str):
        self.parent, self.label, self.references = parent, label, 0


class Path(NamedTuple):
    cost: int
    node: Node
    label: str  # edits after the node


def comes_first(x: Path, y: Path) -> bool:
    """Cheaper, or as cheap with the less edits in ASCII order."""
    if x.cost != y.cost:
        return x.cost < y.cost
    left, right, a, b = [x.label], [y.label], x.node, y.node
    while a is not b:  # both have a node for each row
        left.append(a.label)
        right.append(b.label)
        a, b = a.parent, b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Repair:
    """The search over one conversation; ``push`` and ``finish`` give edits that are sure."""

    def __init__(self) -> None:
        self.root = Node(None, "")
        self.root.references = 1
        self.alive = {START: Path(0, self.root, "")}
        self.rows: deque[Turn] = deque()
        self.state = START  # of what has been emitted
        self.limit = SETTLE

    @staticmethod
    def best(paths: dict[int, Path], state: int, path: Path) -> None:
        if state not in paths or comes_first(path, paths[state]):
            paths[state] = path

    def with_inserts(self) -> dict[int, Path]:
        """Survivors with up to two turns inserted after them; a third repeats a state."""
        reached = dict(self.alive)
        last = reached
        for _ in range(2):
            more: dict[int, Path] = {}
            for state, path in last.items():
                self.best(more, NEXT[state], Path(path.cost + INSERT, path.node, path.label + "I"))
            for state, path in more.items():
                self.best(reached, state, path)
            last = more
        return reached

    def push(self, row: Turn) -> list[Edit]:
        found: dict[int, Path] = {}
        extra = TRUNCATED if row.fault == CUT else 0
        for state, (cost, node, label) in self.with_inserts().items():
            self.best(found, state, Path(cost + DELETE, node, label + "D"))
            if row.fault in (BLANK, DUPLICATE):
                continue
            kept = KEPT.get(row.role[:1], {}).get(state)
            if kept is not None:
                self.best(found, kept, Path(cost + extra, node, label + "K"))
            self.best(found, NEXT[state], Path(cost + REROLE + extra, node, label + "R"))
        alive = {}
        for state, path in found.items():
            for other, rival in found.items():
                cost = rival.cost + FOLLOW[other][state]
                if other != state and (cost < path.cost or cost == path.cost and comes_first(rival._replace(cost=0), path._replace(cost=0))):
                    break
            else:
                alive[state] = path
        self.survive(alive)
        self.rows.append(row)
        return self.settle() if len(self.rows) >= self.limit else []

    def survive(self, alive: dict[int, Path]) -> None:
        before = [path.node for path in self.alive.values()]
        self.alive = {}
        for state, path in alive.items():
            node = Node(path.node, path.label)
            node.references = 1
            path.node.references += 1
            self.alive[state] = Path(path.cost, node, "")
        for node in before:
            self.release(node)

    def release(self, node: Node) -> None:
        node.references -= 1
        while not node.references and node is not self.root:
            node = node.parent
            node.references -= 1

    def settle(self) -> list[Edit]:
        """Emit what all survivors share."""
        chain, node = [], next(iter(self.alive.values())).node
        while node is not self.root:
            chain.append(node)
            node = node.parent
        out: list[Edit] = []
        while chain and self.root.references == 1:
            self.root = chain.pop()
            self.root.parent = None
            out += self.edits(self.root.label)
        self.limit = max(SETTLE, 2 * len(self.rows))
        return out

    def edits(self, label: str) -> list[Edit]:
        out = []
        for edit in label:
            if edit == "I":
                self.state = NEXT[self.state]
                out.append(Edit(edit, None, ROLE[self.state], ""))
                continue
            row = self.rows.popleft()
            role = row.role
            if edit == "K":
                self.state = KEPT[role[:1]][self.state]
            elif edit == "R":
                self.state = NEXT[self.state]
                role = ROLE[self.state]
            out.append(Edit(edit, row.turn, role, row.text))
        return out

    def finish(self) -> tuple[list[Edit], int]:
        """The remaining edits, and the cost of all."""
        reached = self.with_inserts()
        end = reached.get(START)
        if ASSISTANT in reached and (end is None or comes_first(reached[ASSISTANT], end)):
            end = reached[ASSISTANT]
        labels, node = [end.label], end.node
        while node is not self.root:
            labels.append(node.label)
            node = node.parent
        return self.edits("".join(reversed(labels))), end.cost


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by a checksum of their key.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it is marked), 1 empties its
    text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user. Nulls, also those
    in the key, count as one space. Expressions only.
    """

    def spelt(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spelt("text"), "[.!?]", "")).otherwise(spelt("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spelt("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def in_turn(conversations: DataFrame, dropped: Column | None) -> DataFrame:
    """Rows of each conversation together and in order, with the turn their role and text
    were first seen at where they are seen more than once."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.lit(False) if dropped is None else dropped).alias("dropped"),
    )
    key = (F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)), F.length("role"), "role", "text")
    rows = rows.withColumns({"_k": F.xxhash64(F.lit(1), *key), "_l": F.xxhash64(F.lit(2), *key)})
    # Counted before they meet: a text that fills a conversation is one row per task here.
    seen = rows.where(~F.col("dropped")).groupBy("_k", "_l").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first")
    )
    marked = rows.join(seen.where(F.col("_n") > 1).drop("_n"), ["_k", "_l"], "left")
    return marked.select("conv_id", "turn", "role", "text", "dropped", "first").repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.desc("dropped"), F.asc_nulls_first("turn"), "role", "text"
    ).select("conv_id", "turn", "role", "text", "dropped", F.col("first").isNotNull().alias("again"), F.col("first.turn").alias("first_turn"))


class Conversation:
    """Running figures of one conversation and its repair."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.repair = Repair()
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.least = self.most = None
        self.turns = 0
        self.before: tuple | None = None

    def push(self, turn: int | None, role: str, text: str, again: bool, first_turn: int | None) -> list[Edit]:
        own = (turn, role, text)
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        if not bare:
            fault = BLANK
        elif again and (turn != first_turn or own == self.before):
            fault = DUPLICATE
        else:
            fault = 0 if bare[-1] in ".!?" else CUT
        self.faults[fault] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        self.before = own
        return self.repair.push(Turn(turn, role, text, fault))

    def gaps(self) -> int:
        return 0 if self.most is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, list[Edit], int | None]]:
    """Each conversation with edits as they become sure; the last time with the cost."""
    talk: Conversation | None = None
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "again", "first_turn")]
        for conv_id, turn, role, text, dropped, again, first_turn in zip(*columns, strict=True):
            if talk is None or talk.conv_id != conv_id:
                if talk is not None:
                    yield (talk, *talk.repair.finish())
                talk = Conversation(conv_id)
            if not dropped:
                edits = talk.push(turn, role, text, again, first_turn)
                if edits:
                    yield talk, edits, None
    if talk is not None:
        yield (talk, *talk.repair.finish())


def repaired(conversations: DataFrame, dropped: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the edits of every conversation in order.

    ``edit`` is K (kept), R (another role), D (deleted) or I (inserted, without a text or
    turn); the repaired conversation is the rows but D. For costs, ties and odd rows see
    ``audit``.
    """

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, place, out = None, 0, []

        def given() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            names = ("conv_id", "place", "edit", "turn", "role", "text")
            made = {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}
            out.clear()
            return batch_of(**made)

        for current, edits, _ in walked(batches):
            if current is not talk:
                talk, place = current, 0
            for e in edits:
                out.append((talk.conv_id, place, e.edit, e.turn, e.role, e.text))
                place += 1
                if len(out) >= 1000:
                    yield given()
        if out:
            yield given()

    schema = "conv_id long, place long, edit string, turn long, role string, text string"
    return map_batches(in_turn(conversations, dropped), edited, schema)


def audit(conversations: DataFrame, dropped: Column | None = None) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows are taken by turn, nulls first, and rows of one turn by role and text. A row has
    its first fault: blank (white space only), duplicate (role and text seen earlier in the
    conversation), truncated (does not end in ``.!?``). ``gaps`` are turn numbers missing
    between the first and the last; ``illegal`` counts neighbours that may not follow each
    other. ``audit`` has the initials of the cheapest edits, ``repaired_sha256`` hashes the
    repaired lines ``role:text``.

    Null roles and texts are one space; rows with a null conv_id are one conversation;
    repeated rows are duplicates; rows for which ``dropped`` holds only name their
    conversation, and one without other rows has zeros, an empty audit and the hash of
    nothing. No rows give no rows; other columns are not read. The hash of a conversation
    is a chain, so each is read in order by one task, however long; that task holds the
    unresolved rows and one letter per edit.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        letters: list[str] = []
        digest, lines = hashlib.sha256(), 0

        def given() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            made = {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}
            out.clear()
            return batch_of(**made)

        for talk, edits, cost in walked(batches):
            letters.append("".join(e.edit for e in edits))
            for e in edits:
                if e.edit != "D":
                    digest.update(f"{'' if not lines else chr(10)}{e.role}:{e.text}".encode())
                    lines += 1
            if cost is not None:
                faults = talk.faults
                out.append((
                    talk.conv_id, talk.gaps(), faults[BLANK], faults[DUPLICATE], faults[CUT], talk.illegal, cost,
                    "".join(letters), digest.hexdigest(),
                ))
                letters, digest, lines = [], hashlib.sha256(), 0
                if len(out) >= 1000:
                    yield given()
        if out:
            yield given()

    schema = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string"
    )
    return map_batches(in_turn(conversations, dropped), judged, schema)
