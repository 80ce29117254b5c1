import hashlib
import itertools
import random
import re
import zlib

import pytest
from samples import SMALL

from staygrid.llm import conversations as talks

SHAPE = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def fault_of(text, role, seen):
    bare = text.rstrip(SPACE)
    if not bare:
        return talks.BLANK
    if (role, text) in seen:
        return talks.DUPLICATE
    return 0 if bare[-1] in ".!?" else talks.CUT


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        out.append(fault_of(text, role, seen))
        seen.add((role, text))
    return out


def outcome(script, rows, marks):
    """Cost and lines of a script with roles for I and R spelt as u or a, or None."""
    cost, lines, at = 0, [], 0
    for edit in script:
        if edit in "iI":
            cost += 2
            lines.append(("user" if edit == "i" else "assistant", ""))
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "D":
            cost += 3
            continue
        if marks[at - 1] in (talks.BLANK, talks.DUPLICATE):
            return None
        cost += (marks[at - 1] == talks.CUT) + (0 if edit == "K" else 2)
        lines.append((role if edit == "K" else "user" if edit == "r" else "assistant", text))
    if not SHAPE.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
        return None
    return cost, "".join(script).upper(), "\n".join(f"{r}:{t}" for r, t in lines)


def exhaustive(rows):
    """Every script with at most two inserts in a gap."""
    marks, best = faults(rows), None
    inserts = ["", *"iI", *map("".join, itertools.product("iI", repeat=2))]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("DKrR", repeat=len(rows)):
            script = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:], strict=True))
            found = outcome(script, rows, marks)
            if found and (best is None or found < best):
                best = found
    return best


def by_strings(rows):
    """Dynamic programme with a whole string and all lines in every state, nothing pruned."""
    marks = faults(rows)
    states = {"": (0, "", ())}

    def better(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def closed(states):
        for _ in range(3):
            for key, (cost, script, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    if (key or "-") + role[0] in ("-u", "su", "ua", "au"):
                        better(states, role[0], (cost + 2, script + "I", (*lines, f"{role}:")))
        return states

    for (_, role, text), mark in zip(rows, marks, strict=True):
        fresh = {}
        for key, (cost, script, lines) in closed(states).items():
            better(fresh, key, (cost + 3, script + "D", lines))
            if mark in (talks.BLANK, talks.DUPLICATE):
                continue
            for edit, new in (("K", role), ("R", "user"), ("R", "assistant")):
                if (key or "-") + new[:1] in ("-s", "-u", "su", "ua", "au") and new[:1]:
                    price = cost + (mark == talks.CUT) + (2 if edit == "R" else 0)
                    better(fresh, new[0], (price, script + edit, (*lines, f"{new}:{text}")))
        states = fresh
    ends = [v for k, v in closed(states).items() if k in ("", "a")]
    cost, script, lines = min(ends)
    return cost, script, "\n".join(lines)


def repaired(rows, settle=None):
    repair, edits = talks.Repair(), []
    most = 0
    for (turn, role, text), mark in zip(rows, faults(rows), strict=True):
        edits += repair.push(talks.Turn(turn, role, text, mark))
        most = max(most, len(repair.rows))
    rest, cost = repair.finish()
    edits += rest
    lines = "\n".join(f"{e.role}:{e.text}" for e in edits if e.edit != "D")
    return (cost, "".join(e.edit for e in edits), lines), most


def drawn(turn, n, texts=("", " ", "a.", "b", "c!", "d")):
    return [(k, turn.choice(["user", "assistant", "system", "tool", ""]), turn.choice(texts)) for k in range(n)]


def test_search_against_every_script():
    turn = random.Random(2)
    for n in (0, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = drawn(turn, n)
        assert repaired(rows)[0] == exhaustive(rows) == by_strings(rows)


@pytest.mark.parametrize("settle", [1, 32])
def test_search_against_whole_strings(monkeypatch, settle):
    monkeypatch.setattr(talks, "SETTLE", settle)
    turn = random.Random(3)
    for n in (5, 9, 17, 40, 120):
        for _ in range(60):
            rows = drawn(turn, n, [f"{k}{turn.choice('.x')}" for k in range(n)] + [""])
            assert repaired(rows)[0] == by_strings(rows)


def test_memory_follows_the_unresolved_end():
    turn = random.Random(4)
    rows = [(k, turn.choice(["user", "assistant"]), f"{k}{turn.choice('.x')}") for k in range(20_000)]
    assert repaired(rows)[1] < 200
    same = [(k, "user", "same." if k % 2 else "") for k in range(20_000)]
    assert repaired(same)[0][1].count("D") == 19_999


def table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, dropped string, first string, again string"
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema)


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def plain_audit(rows):
    out = []
    for conv, own in plain_damage(rows).items():
        marks = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, script, lines = by_strings(own)
        out.append((
            conv, gaps, *(marks.count(k) for k in (1, 2, 3)), illegal, cost, script,
            hashlib.sha256(lines.encode()).hexdigest(),
        ))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def odd_rows():
    turn = random.Random(6)
    rows = []
    for conv in range(60):
        for k in range(turn.randint(0, 30)):
            role = turn.choice(["user", "assistant", "user", "assistant", "system", None, "", "Éa"])
            rows.append((conv, turn.choice([k, k, k, None, 7]), role, turn.choice([f"{k}.", "x", "same!", None, "\n", "é?"])))
    rows += [(None, k % 3, "user", "t.") for k in range(50)] + [(None, None, None, None)] * 3
    rows += [(500, -(2**63), "user", "a."), (500, 2**63 - 1, "assistant", "b " * 500_000)]
    return rows


@pytest.mark.parametrize("which", ["odd", "given"])
def test_audit_against_brute_force(spark, which):
    rows = odd_rows()
    if which == "given":
        rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damage = talks.damaged(table(spark, rows))
    got = [tuple(r) for r in talks.audit(damage, damage["dropped"]).collect()]
    want = plain_audit(rows)
    want = [(*r[:1], min(r[1], 2**63 - 1), *r[2:]) for r in want]
    assert in_order(got) == in_order(want)


def test_repaired_rows_and_no_rows(spark):
    rows = [r for r in odd_rows() if r[0] is None or r[0] < 60]
    edits = {}
    for r in sorted(talks.repaired(table(spark, rows)).collect(), key=lambda r: r.place):
        edits.setdefault(r.conv_id, []).append(r)
    for r in talks.audit(table(spark, rows)).collect():
        own = edits.get(r.conv_id, [])
        assert "".join(e.edit for e in own) == r.audit
        left = [e for e in own if e.edit != "D"]
        assert SHAPE.fullmatch("".join(e.role[:1] for e in left))
        assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in left).encode()).hexdigest() == r.repaired_sha256
    for function in (talks.audit, talks.repaired):
        assert function(table(spark, [])).collect() == []
    assert talks.audit(talks.damaged(table(spark, []))).collect() == []
