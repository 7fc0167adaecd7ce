"""Best-fit packing of documents into token sequences of fixed capacity, by bin completion.

Lengths are whole numbers up to the capacity, so the whole packing problem is a histogram of at most
``capacity`` numbers, whatever the number of documents. The plan is searched on that histogram; each of
its patterns says which lengths share a sequence and how many such sequences there are. A document
piece finds its sequence from its length and its rank among the pieces of that length, which tasks
compute from per-partition counts. No document, id or rank passes through the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import binary_array, id_and_text, stored, text_buffers, trimmed
from trajlake.llm.tokens import encoder

# Search limits of the planner. They bound its time, never the rows: the incumbent is always a full plan.
FILLINGS_PER_NODE = 24
STEPS_PER_NODE = 4000
MAX_NODES = 2000

Pattern = tuple[tuple[int, int], ...]  # (length, how often) in one sequence


def cut_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int, end_id: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and cut: one row per piece with its ids (little-endian unsigned 32-bit) and its rank.

    A document longer than ``capacity`` is cut from its end, so its first piece may be shorter.
    ``part`` and ``rank`` number the pieces of one length within a task; store the rows before use.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first in range(0, batch.num_rows, 1024):
                last = min(first + 1024, batch.num_rows)
                ids, bounds = encode(data, offsets[first:last + 1])
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(last - first), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = total - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                order = np.argsort(length, kind="stable")
                at = length[order]
                rank = np.empty(len(row), np.int64)
                rank[order] = seen[at] + np.arange(len(row)) - np.searchsorted(at, at)
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), binary_array(ids.astype("<u4"), np.append(bounds[row] + start, len(ids)) * 4),
                    pa.array(np.full(len(row), part, np.int32)), pa.array(rank),
                ], ["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        trimmed(task), "doc_id long, piece int, start long, length long, ids binary, part int, rank long")


def _best_fit(counts: dict[int, int], sizes: list[int], largest: int, capacity: int) -> Pattern:
    """Best fit around ``largest``: again and again the longest piece that still fits."""
    n = min(counts[largest], capacity // largest)
    uses, room, bound = [(largest, n)], capacity - n * largest, largest - 1
    while (k := bisect_right(sizes, min(bound, room)) - 1) >= 0:
        size = sizes[k]
        n = min(counts[size], room // size)
        uses.append((size, n))
        room, bound = room - n * size, size - 1
    return tuple(uses)


def _fillings(counts: dict[int, int], sizes: list[int], largest: int, capacity: int) -> list[Pattern]:
    """Undominated fillings around ``largest``, least waste first.

    A filling is dominated if a longer piece that is left fits in place of one of its pieces, or of two:
    what it packs could then be packed in the places that the longer piece frees.
    """
    found: dict[Pattern, int] = {}
    steps = 0

    def dominated(uses: dict[int, int], slack: int) -> bool:
        own = [s for s in uses for _ in range(min(uses[s], 2))][1:]
        spare = lambda t: counts[t] - uses.get(t, 0) > 0
        for i, a in enumerate(own):
            for pair in (a, *(a + b for b in own[i + 1:])):
                low = pair + (pair == a)
                k = bisect_right(sizes, pair + slack) - 1
                while k >= 0 and sizes[k] >= low:
                    if spare(sizes[k]):
                        return True
                    k -= 1
        return False

    def extend(uses: dict[int, int], bound: int, room: int) -> None:
        nonlocal steps
        steps += 1
        if steps > STEPS_PER_NODE or len(found) >= 4 * FILLINGS_PER_NODE:
            return
        k, fits = bisect_right(sizes, min(bound, room)) - 1, False
        while k >= 0 and steps <= STEPS_PER_NODE:
            size = sizes[k]
            if counts[size] > uses.get(size, 0):
                fits = True
                extend({**uses, size: uses.get(size, 0) + 1}, size, room - size)
                if room == size:
                    break
            k -= 1
        # Longer pieces that were passed over may still fit: then this one is not full.
        if not fits and not dominated(uses, room):
            found[tuple(sorted(uses.items(), reverse=True))] = room

    extend({largest: 1}, largest, capacity - largest)
    return sorted(found, key=lambda p: (found[p], [-s for s, _ in p]))[:FILLINGS_PER_NODE]


def _apply(counts: dict[int, int], pattern: Pattern) -> int:
    times = min(counts[s] // n for s, n in pattern)
    for s, n in pattern:
        counts[s] -= times * n
        if not counts[s]:
            del counts[s]
    return times


def _complete(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit completion of what is left."""
    counts, out = dict(counts), []
    sizes = sorted(counts)
    while sizes:
        pattern = _best_fit(counts, sizes, sizes[-1], capacity)
        out.append((pattern, _apply(counts, pattern)))
        sizes = [s for s in sizes if s in counts]
    return out


def _steps(path: tuple | None) -> list[tuple[Pattern, int]]:
    """The steps of a chain of (earlier steps, step), first to last."""
    out = []
    while path is not None:
        path, step = path
        out.append(step)
    return out[::-1]


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences follow each, over all pieces of the histogram.

    Depth-first bin completion: the largest piece left gets each undominated filling in turn, best fit
    first, as often as the counts allow. The best-fit completion below each node is the incumbent; a
    node whose waste so far leaves no room for a plan with fewer sequences is cut. The search ends at
    the lower bound (all tokens over the capacity) or after MAX_NODES nodes.
    """
    histogram = {s: n for s, n in histogram.items() if n}
    total = sum(s * n for s, n in histogram.items())
    least = -(-total // capacity)
    best = _complete(histogram, capacity)
    best_n = sum(n for _, n in best)
    # A child is held as its parent's counts, shared with its siblings, and its own pattern; its path as a chain.
    stack: list[tuple[dict[int, int], Pattern | None, tuple | None, int, int]] = [(histogram, None, None, 0, 0)]
    nodes = 0
    while stack and best_n > least and nodes < MAX_NODES:
        counts, pattern, path, used, wasted = stack.pop()
        if pattern is not None:
            counts = dict(counts)
            times = _apply(counts, pattern)
            path, used = (path, (pattern, times)), used + times
            wasted += (capacity - sum(s * n for s, n in pattern)) * times
        nodes += 1
        if wasted > (best_n - 1) * capacity - total or not counts:
            continue
        rest = _complete(counts, capacity)
        if used + sum(n for _, n in rest) < best_n:
            best, best_n = _steps(path) + rest, used + sum(n for _, n in rest)
        sizes = sorted(counts)
        children = _fillings(counts, sizes, sizes[-1], capacity)
        stack.extend((counts, pattern, path, used, wasted) for pattern in reversed(children))
    return best


def _places(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Per pattern and length: the ranks it takes, its first sequence, and the place in the sequence."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for size, n in pattern:
            at = taken.get(size, 0)
            rows.append((size, at, sequence, n, offset))
            taken[size] = at + n * times
            offset += size * n
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "uses", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)} | {"sequences": np.array(sequence)}


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2,
                   payload: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the planner finds.

    One row per piece: doc_id, piece, start, length, sequence_id, offset, and ``payload``: its ids as
    little-endian unsigned 32-bit integers (column ``ids``) unless another expression over them is
    given. The pieces are written once to the shared folder, with their payload.

    Null text: empty, a document of the end id alone. Repeated rows are packed as often as they occur;
    a null doc_id stays null. Pieces of a full sequence need no plan and get negative sequence ids.
    An empty table gives no rows. Other columns are ignored.
    """
    payload = F.col("ids") if payload is None else payload
    pieces = stored(cut_documents(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
                    .select("doc_id", "piece", "start", "length", "part", "rank", payload), "op3-pieces")
    counts = pieces.filter(F.col("length") < capacity).groupBy("part", "length").agg(F.count("*").alias("n"))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # < capacity rows
    places = _places(plan_sequences(sizes, capacity))
    before = counts.select(
        F.col("part").alias("_part"), F.col("length").alias("_length"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("_before"))
    ranked = pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")), "left").select(
        *pieces.columns, F.coalesce("_before", F.lit(0)).alias("before"))
    extra = [c for c in pieces.columns if c not in ("part", "rank")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places["length"] * (1 << 48) + places["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            full = length == capacity
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence = -1 - (batch.column("part").to_numpy().astype(np.int64) << 40) - rank
            offset = np.zeros(len(length), np.int64)
            at = np.searchsorted(keys, length[~full] * (1 << 48) + rank[~full], side="right") - 1
            within, uses = rank[~full] - places["rank"][at], places["uses"][at]
            sequence[~full] = places["sequence"][at] + within // uses
            offset[~full] = places["offset"][at] + within % uses * length[~full]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in extra), pa.array(sequence), pa.array(offset)], [*extra, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in extra)
    return ranked.mapInArrow(trimmed(task), f"{schema}, sequence_id long, offset long")
