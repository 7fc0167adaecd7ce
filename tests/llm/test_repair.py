"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest

from trajlake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, place int, `first` string, chunk int, of int"
NEXT = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """The least (cost, audit) and the rows it leaves, by best-first search; rows: (role, text, must go, truncated)."""
    heap, seen = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, s, out = heapq.heappop(heap)
        if i == len(rows) and s in "0A":
            return cost, audit, out
        if (i, s) in seen:
            continue
        seen.add((i, s))

        def go(more, letter, j, symbol, row):
            if (s, symbol) in NEXT:
                heapq.heappush(heap, (cost + more, audit + letter, j, NEXT[s, symbol], out + (row,)))

        for name in ("user", "assistant"):
            go(2, "I", i, name[0], (name, ""))
        if i < len(rows):
            role, text, must, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, out))
            if not must:
                go(cut, "K", i + 1, role[:1], (role, text))
                for name in ("user", "assistant"):
                    go(2 + cut, "R", i + 1, name[0], (name, text))


def plain(rows):
    """conv_id -> report and repaired rows."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [r[0] for r in own if r[0] is not None]
        seen, flagged, n = set(), [], [0, 0, 0]
        for _, r, x in own:
            end = x.rstrip(BLANKS)
            fault = 0 if not end else 1 if (r, x) in seen else 2 if end[-1] not in ".!?" else 3
            seen.add((r, x))
            if fault < 3:
                n[fault] += 1
            flagged.append((r, x, fault < 2, int(fault == 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, left = cheapest(flagged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *n, illegal, cost, audit), list(left)
    return out


def made(seed, convs=40, longest=9):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut off", " \t\n", "", None, "Why?", "Well. \x0b", "é…", "a.\nb"]
    rows = []
    for c in range(convs):
        turns = sorted(rng.sample(range(-3, 30), rng.randint(1, longest)))
        for t in turns:
            row = (c if c else None, t if t != 5 else None, rng.choice(roles), rng.choice(texts))
            rows += [row] * (2 if rng.random() < 0.1 else 1)
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 3, 1024])
def test_repair_equals_search(make, chunk):
    # No two different rows of one turn: their order is this library's own.
    rows = made(chunk)
    rng = random.Random(1)
    shuffled = rng.sample(rows, len(rows))
    table = make([(*r, 9, 9, "x", 9, 9) for r in shuffled], SCHEMA)
    mended = repair.repair(table, chunk=chunk)
    want = plain(rows)
    report = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in mended.report.collect()}
    assert report == {c: v[0] for c, v in want.items()}
    left = {c: [] for c in want}
    for r in sorted(mended.rows.collect(), key=lambda r: r.place):
        assert r.place == len(left[r.conv_id])
        left[r.conv_id].append((r.role, r.text))
    assert left == {c: v[1] for c, v in want.items()}
    for c, own in left.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in own))
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digests(mended.rows).collect()}
    for c, own in left.items():
        if own:
            assert digests[c] == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in own).encode()).hexdigest()


def test_one_conversation_of_many_chunks(make):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant"]), f"t{i}{rng.choice(['.', '', '!'])}") for i in range(1500)]
    mended = repair.repair(make(rows, "conv_id long, turn long, role string, text string"), chunk=64)
    report, left = plain(rows)[1]
    got = mended.report.collect()[0]
    assert (got.gaps, got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit) == report
    assert [(r.role, r.text) for r in sorted(mended.rows.collect(), key=lambda r: r.place)] == left


def test_damage(make):
    rows = [(c, t, r, "One. Two! Three?") for c in range(20) for t, r in ((None, "system"), (0, "user"), (1, "assistant"), (2, None))]
    rows += [(None, 7, "user", None)]
    got = repair.damaged(make(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        k = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        row = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
        want += [] if k == 0 else [row, row] if k == 3 else [row]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table_and_string_ids(make):
    none = make([], "conv_id string, turn int, role string, text string")
    mended = repair.repair(none)
    assert mended.report.collect() == [] and mended.rows.collect() == [] and repair.digests(mended.rows).collect() == []
    one = repair.repair(make([("x", 1, "assistant", "Hi.")], "conv_id string, turn int, role string, text string"))
    assert [(r.conv_id, r.cost, r.audit) for r in one.report.collect()] == [("x", 2, "IK")]


def test_the_graph_has_four_tops():
    assert {top.state for node in repair.TOPS.values() for symbol in "sua" for top in repair.push(node, symbol)} <= set(repair.TOPS)
    assert repair.push(repair.START, "a") == () and repair.push(repair.TURNS, "s") == ()
