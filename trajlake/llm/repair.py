"""Repair of damaged conversations by generalised LR parsing over the role grammar.

A conversation is whole if its role initials read ``(s?(ua)+)?``. The parser walks its rows with a
graph-structured stack and may keep, rerole or delete each row and insert rows anywhere, at a cost; equal
stack tops merge, and the least (cost, audit) stays. There are four tops between rows, so a run of rows is
summed up by the best path from each top to each other: long conversations are parsed in chunks, side by
side, and the chunks' paths are put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trajlake.llm.common import stored
from trajlake.operators.grouping import join_group_values, with_positions

# Rows of a conversation that a task parses at a time.
CHUNK = 1024
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

# The role grammar: C -> (nothing) | s T | T;  T -> T P | P;  P -> u a.
# States: 0 start, 1 after s, 2 after u, 3 after T; 4 (u a), 5 (P) and 6 (T P) reduce at once.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 4}
REDUCE = {4: ("P", 2), 5: ("T", 1), 6: ("T", 2)}
GOTO = {(0, "P"): 5, (1, "P"): 5, (3, "P"): 6, (0, "T"): 3, (1, "T"): 3}
ACCEPT = (0, 3)


class Node(NamedTuple):
    """A stack top and the tops that lie right below it in the graph."""

    state: int
    below: frozenset[Node]


START = Node(0, frozenset())
AFTER_SYSTEM = Node(1, frozenset([START]))
TURNS = Node(3, frozenset([START, AFTER_SYSTEM]))
# The four tops found between rows, with all that can lie below them.
TOPS = {0: START, 1: AFTER_SYSTEM, 2: Node(2, frozenset([START, AFTER_SYSTEM, TURNS])), 3: TURNS}

Heads = dict[int, tuple[int, str, Node]]


def _bases(node: Node, depth: int) -> set[Node]:
    """The nodes ``depth`` edges below."""
    level = {node}
    for _ in range(depth):
        level = {b for n in level for b in n.below}
    return level


@lru_cache(maxsize=None)
def push(node: Node, symbol: str) -> tuple[Node, ...]:
    """The tops after shifting ``symbol`` on a top and all reductions that follow; none if it may not follow."""
    state = SHIFT.get((node.state, symbol))
    tops = [] if state is None else [Node(state, frozenset([node]))]
    done: dict[int, Node] = {}
    while tops:
        top = tops.pop()
        if top.state in REDUCE:
            name, size = REDUCE[top.state]
            tops += [Node(GOTO[base.state, name], frozenset([base])) for base in _bases(top, size)]
        else:
            done[top.state] = _merged(done[top.state], top) if top.state in done else top
    return tuple(done.values())


@lru_cache(maxsize=None)
def _merged(a: Node, b: Node) -> Node:
    return a if a == b else Node(a.state, a.below | b.below)


def _put(heads: Heads, cost: int, audit: str, node: Node) -> bool:
    """Add a stack; equal tops merge, and the least (cost, audit) stays. Whether it is the new one."""
    held = heads.get(node.state)
    if held is None:
        heads[node.state] = cost, audit, node
        return True
    better = (cost, audit) < held[:2]
    heads[node.state] = *((cost, audit) if better else held[:2]), _merged(held[2], node)
    return better


def with_inserts(heads: Heads) -> Heads:
    """The heads and all that insertions reach from them."""
    todo = list(heads)
    while todo:
        cost, audit, node = heads[todo.pop()]
        for symbol in "ua":
            todo += [top.state for top in push(node, symbol) if _put(heads, cost + INSERT, audit + "I", top)]
    return heads


def step(heads: Heads, initial: str, deletable_only: bool, truncated: bool) -> Heads:
    """The heads after one row: kept, reroled or deleted, then insertions."""
    after: Heads = {}
    for cost, audit, node in heads.values():
        _put(after, cost + DELETE, audit + "D", node)
        if not deletable_only:
            kept = cost + TRUNCATED * truncated
            for top in push(node, initial):
                _put(after, kept, audit + "K", top)
            for symbol in "ua":
                for top in push(node, symbol):
                    _put(after, kept + REROLE, audit + "R", top)
    return with_inserts(after)


def best_paths(rows: list[tuple[str, bool, bool]], first: bool) -> list[dict]:
    """Least (cost, audit) of a run of (initial, must go, truncated) from each top before it to each after it.

    The run at the start of a conversation begins with the empty stack, and with what insertions make of it.
    """
    out = []
    for entry in (0,) if first else TOPS:
        heads = {entry: (0, "", TOPS[entry])}
        if first:
            with_inserts(heads)
        for row in rows:
            heads = step(heads, *row)
        out += [{"entry": entry, "exit": state, "cost": cost, "audit": audit} for state, (cost, audit, _) in heads.items()]
    return out


class Paths:
    """The best path to each top over the runs so far. What all of them begin with is kept once."""

    def __init__(self) -> None:
        self.decided: list[str] = []
        self.heads: dict[int, tuple[int, str]] = {0: (0, "")}

    def follow(self, paths: Iterable[dict]) -> None:
        after: dict[int, tuple[int, str]] = {}
        for p in paths:
            if p["entry"] in self.heads:
                cost, audit = self.heads[p["entry"]]
                new = cost + p["cost"], audit + p["audit"]
                after[p["exit"]] = min(new, after.get(p["exit"], new))
        shared = commonprefix([audit for _, audit in after.values()])
        self.decided.append(shared)
        self.heads = {state: (cost, audit[len(shared):]) for state, (cost, audit) in after.items()}

    def best(self) -> tuple[int, str]:
        cost, audit = min(self.heads[state] for state in ACCEPT if state in self.heads)
        return cost, "".join(self.decided) + audit


LEGAL = ("su", "ua", "au")


def _summed(rows: list[tuple], chunk: int) -> dict:
    """What a chunk contributes to its conversation. Rows: (turn, initial, blank, duplicate, truncated)."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1] for r in rows]
    return {
        "rows": len(rows), "blank": sum(r[2] for r in rows), "duplicate": sum(r[3] for r in rows),
        "truncated": sum(r[4] for r in rows), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0], "last": initials[-1],
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
        "paths": best_paths([(r[1], bool(r[2] or r[3]), bool(r[4])) for r in rows], chunk == 0)}


_CHUNK_FIELDS = """rows int, blank long, duplicate long, truncated long, illegal long, first string, last string,
low long, high long, turns long, paths array<struct<entry: int, exit: int, cost: long, audit: string>>"""
_REPORT_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_EDIT_FIELDS = "chunk long, odd boolean, edits array<struct<inserts: int, action: string, place: long>>"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _parsed(schema: pa.Schema):
    """Task over rows sorted by conversation and place: one row per (conversation, chunk)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[dict]:
            for (conv, chunk), own in groupby(_rows(batches), key=lambda r: r[:2]):
                yield {"conv_id": conv, "chunk": chunk, **_summed([r[2:] for r in own], chunk)}
        yield from _batches(chunks(), schema, 256)

    return task


def _edits(audit: str, sizes: list[int]) -> Iterator[dict]:
    """The audit dealt out to the chunks: for each row its action, the insertions before it, and its place afterwards.

    Insertions after the last row are an entry of their own with the action E.
    """
    place, inserts, edits, chunk = 0, 0, [], 0
    odd = sum(a != "D" for a in audit) % 2 == 1
    for letter in audit:
        if letter == "I":
            inserts += 1
            continue
        edits.append({"inserts": inserts, "action": letter, "place": place + inserts})
        place += inserts + (letter != "D")
        inserts = 0
        if len(edits) == sizes[chunk] and chunk < len(sizes) - 1:
            yield {"chunk": chunk, "odd": odd, "edits": edits}
            edits, chunk = [], chunk + 1
    if inserts:
        edits.append({"inserts": inserts, "action": "E", "place": place + inserts})
    yield {"chunk": chunk, "odd": odd, "edits": edits}


def _decided(schema: pa.Schema):
    """Task over the chunks of a conversation in order: its report, and the edits of each chunk."""
    def conversation(conv, chunks: Iterable[tuple]) -> Iterator[dict]:
        paths, sizes, last, high = Paths(), [], None, None
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        low, turns = None, 0
        for _, _, rows, blank, duplicate, truncated, illegal, first, final, own_low, own_high, own_turns, own in chunks:
            paths.follow(own)
            sizes.append(rows)
            total["blank"] += blank
            total["duplicate"] += duplicate
            total["truncated"] += truncated
            total["illegal"] += illegal + (last is not None and last + first not in LEGAL)
            last = final
            if own_turns:
                # Rows come by turn: one that goes on in the next chunk counts once.
                turns += own_turns - (high == own_low)
                low, high = own_low if low is None else low, own_high
        cost, audit = paths.best()
        gaps = 0 if low is None else high - low + 1 - turns
        yield {"conv_id": conv, "gaps": gaps, **total, "cost": cost, "audit": audit}
        for part in _edits(audit, sizes):
            yield {"conv_id": conv, **part}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for conv, own in groupby(_rows(batches), key=lambda r: r[0]) for row in conversation(conv, own))
        yield from _batches(found, schema, 256)

    return task


class Repaired(NamedTuple):
    """``report``: a row per conversation; ``rows``: its rows after repair, by ``place`` from 0."""

    report: DataFrame
    rows: DataFrame


def _arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def repair(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK
) -> Repaired:
    """Find and mend the faults of conversations, whose rows come by turn (nulls first), then by role and text.

    Faults of a row, the first of them counting: blank (nothing but blanks), duplicate (role and text seen
    earlier in the conversation), truncated (does not end in ``.``, ``!`` or ``?``). Blank and duplicate rows
    must go. Edits: Keep costs nothing, Rerole to user or assistant 2, Delete 3, Insert an empty row of user
    or assistant 2; a truncated row that stays adds 1. Of the edits that make the role initials read
    ``(s?(ua)+)?`` the cheapest are taken, of equally cheap ones those whose initials come first in ASCII.

    ``report``: conv_id, gaps (turn numbers missing), blank, duplicate, truncated, illegal (neighbours other
    than su, ua, au), cost, audit (the edits' initials in order). ``rows``: conv_id, place, role, text, edit.

    Null roles and texts count as one space (a role to be replaced, a blank row); null turns come first and
    fill no gap; rows with a null conv_id are one conversation. Repeated rows are duplicates, all but the first.
    Rows of one turn and role come by a hash of the text. An empty table gives none. Texts of any
    length pass through unread but for their ends and hashes; equal texts are told by 128 bits of hash.
    Other columns are ignored. No task holds more than ``chunk`` rows of a conversation, except that its audit,
    one letter a row, is put together in one.
    """
    conv = rows.schema[conv_col].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    clean = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"),
                        space(text_col).alias("text"))
    hashed = clean.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    placed = stored(with_positions(hashed, ["turn", "role", "h1", "h2"], keys=["conv_id"], name="pos"), "repair-rows")

    end = F.rtrim("text", F.lit(BLANKS))
    blank = end == ""
    narrow = placed.select("conv_id", "pos", "turn", "role", "h1", "h2", blank.alias("blank"),
                           F.right(end, F.lit(1)).isin(".", "!", "?").alias("ended"))
    same = ["conv_id", "role", "h1", "h2"]
    first = placed.groupBy(*same).agg(F.min("pos").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    marked = join_group_values(narrow, first, same, spread_by=["pos"], broadcast=False)
    repeated = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    flags = marked.select(
        "conv_id", F.call_function("div", F.col("pos"), F.lit(chunk).cast("long")).alias("chunk"), "pos", "turn",
        F.left("role", F.lit(1)).alias("initial"), F.col("blank").cast("int").alias("blank"),
        (~F.col("blank") & repeated).cast("int").alias("duplicate"),
        (~F.col("blank") & ~repeated & ~F.col("ended")).cast("int").alias("truncated"))

    chunk_schema = StructType.fromDDL(f"conv_id {conv}, chunk long, {_CHUNK_FIELDS}")
    by_chunk = flags.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").drop("pos")
    chunks = by_chunk.mapInArrow(_parsed(_arrow(chunk_schema)), chunk_schema)
    decided_schema = StructType.fromDDL(f"conv_id {conv}, {_REPORT_FIELDS}, {_EDIT_FIELDS}")
    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    decided = stored(ordered.mapInArrow(_decided(_arrow(decided_schema)), decided_schema), "repair-edits")

    report = decided.filter(F.col("chunk").isNull()).drop("chunk", "odd", "edits")
    edits = decided.filter(F.col("chunk").isNotNull()).select("conv_id", "chunk", "odd", F.posexplode("edits").alias("at", "edit")).select(
        F.col("conv_id").alias("of"), (F.col("chunk") * chunk + F.col("at")).alias("at"), "odd", "edit.*")
    # Where the row count is odd, a system row leads.
    turn_role = lambda place: F.when((place - F.col("odd").cast("int")) % 2 == 0, "user").otherwise("assistant")
    kept = edits.filter(F.col("action").isin("K", "R"))
    stay = placed.join(kept, placed["conv_id"].eqNullSafe(kept["of"]) & (placed["pos"] == kept["at"])).select(
        "conv_id", "place", F.when(F.col("action") == "K", F.col("role")).otherwise(turn_role(F.col("place"))).alias("role"),
        "text", F.col("action").alias("edit"))
    added = edits.filter("inserts > 0").withColumn("place", F.explode(F.sequence(F.col("place") - F.col("inserts"), F.col("place") - 1)))
    added = added.select(F.col("of").alias("conv_id"), "place", turn_role(F.col("place")).alias("role"), F.lit("").alias("text"),
                         F.lit("I").alias("edit"))
    return Repaired(report, stay.unionByName(added))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows: the SHA-256 of their ``role:text`` joined by newlines.

    Rows stream through in order; a digest is inherently a single pass, but holds one batch of rows at most.
    """
    schema = StructType.fromDDL(f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    arrow = _arrow(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for conv, own in groupby(_rows(batches), key=lambda r: r[0]):
                digest, gap = hashlib.sha256(), ""
                for _, line in own:
                    digest.update((gap + line).encode())
                    gap = "\n"
                yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}
        yield from _batches(found(), arrow, 1024)

    lines = rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("place").mapInArrow(task, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults dealt by the CRC-32 of ``conv_id:turn``; nulls count as one space.

    Of twenty remainders, 0 drops the row, 1 empties the text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text: Column = space("text")
    dealt = rows.select("conv_id", "turn", space("role").alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))
