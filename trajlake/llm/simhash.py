"""Near-duplicate detection by SimHash, with a grid range join over segment popcounts.

A 64-bit fingerprint is embedded as 32 coordinates: how many bits are set in each of its two-bit segments.
The Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. So two
fingerprints that differ in ``DISTANCE`` bits lie within that Manhattan distance, and if the coordinates
are dealt into ``parts`` sub-grids, at least ``parts - DISTANCE`` of them see no distance at all: the pair
shares a cell in the product of those. Within a cell the total popcounts, too, lie within ``DISTANCE``;
what remains is compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import BROADCAST_ROWS, discard, id_and_text, not_broadcast, runs, spaced, stored, text_buffers, trim, word_bounds
from trajlake.llm.graph import components, thinned
from trajlake.operators.grouping import join_group_values

DISTANCE = 3
SEED = 42
# Shingles hashed at a time, however long a text is.
SHINGLES_AT_ONCE = 1 << 17
# Fingerprints of a cell that meet in one group at most twice this number.
BLOCK = 1024
# Sub-grids: as many as keep the fingerprints that share a cell by chance to so many for each, or the most.
CHANCE = 4.0
MOST_PARTS = 12
# A two-bit segment of a random fingerprint has a popcount of 0, 1 or 2: 1.5 bits of information.
_SEGMENTS, _BITS = 32, 48.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, XXH64) of all word shingles of each row, repeats included, in parts of bounded size.

    Words are parted by blanks and the control characters 9 to 13 and joined by a space, A-Z count as
    a-z. Fewer than ``words`` words make one shingle of all of them.
    """
    text, starts = spaced(data, offsets)
    s, e = word_bounds(text)
    # Words one after the other with a space between: a shingle is a slice.
    size = e - s
    at = np.cumsum(size + 1) - size - 1
    inside = np.zeros(len(text) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    solid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    packed = np.full(int((size + 1).sum()), 32, np.uint8)
    keep = np.ones(len(packed), bool)
    keep[at + size] = False
    packed[keep] = _LOWER[text[solid]]
    buffer = packed.tobytes()
    row = np.searchsorted(starts, s, side="right") - 1
    count = np.bincount(row, minlength=len(starts))
    whole = max(len(row) - words + 1, 0)
    first = np.flatnonzero(row[:whole] == row[words - 1:]) if whole else np.empty(0, np.int64)
    last = first + words - 1
    few = np.flatnonzero((count > 0) & (count < words))
    few_first = np.searchsorted(row, few)
    begin = np.concatenate([at[first], at[few_first]])
    end = np.concatenate([at[last] + size[last], at[few_first + count[few] - 1] + size[few_first + count[few] - 1]])
    of = np.concatenate([row[first], few])
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(of), SHINGLES_AT_ONCE):
        j = i + SHINGLES_AT_ONCE
        hashes = [digest(buffer[a:b], seed) for a, b in zip(begin[i:j].tolist(), end[i:j].tolist())]
        yield of[i:j], np.array(hashes, np.uint64)


def fingerprint_bits(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many hashes of each row have each bit set, bit 0 first. Rows need not be in order."""
    out = np.zeros((n, 64), np.int64)
    if len(row):
        order = np.argsort(row, kind="stable")
        row, hashes = row[order], hashes[order]
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[start]] = np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = 3, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each row: a bit is set if it is set in over half of the shingle hashes; 0 without words."""
    n = len(offsets) - 1
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for row, hashes in shingle_hashes(data, offsets, words, seed):
        ones += fingerprint_bits(row, hashes, n)
        total += np.bincount(row, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_rows(rows: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of (doc_id, text); the fingerprint as a signed long."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in runs(offsets, 1 << 20):
                fp = fingerprints(data, offsets[first:last + 1], words, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        trim()

    return rows.mapInArrow(task, "doc_id long, fp long")


def sub_grids(parts: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the embedding: the coordinates of each choice of ``parts - distance`` parts.

    A coordinate takes two bits of the packed embedding; its parts take turns.
    """
    own = [sum(3 << (2 * c) for c in range(p, _SEGMENTS, parts)) for p in range(parts)]
    return [sum(own[p] for p in chosen) for chosen in combinations(range(parts), parts - distance)]


def parts_for(n: int, distance: int = DISTANCE) -> int:
    """Parts that keep chance neighbours to ``CHANCE`` a fingerprint, for n random ones. Any number gives the same links."""
    for parts in range(distance + 1, MOST_PARTS):
        if n * len(sub_grids(parts, distance)) / 2 ** (_BITS * (parts - distance) / parts) <= CHANCE:
            return parts
    return MOST_PARTS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, packed into two bits each."""
    odd, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    # One bit set of two, and both: a sum without carry into the sign.
    return fp.bitwiseXOR(next_bit).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(odd), 1))


def _cells(distinct: DataFrame, parts: int, distance: int) -> DataFrame:
    """(grid, cell, fp, t) for each sub-grid; t is the fingerprint's total popcount."""
    e = embedding(F.col("fp"))
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("e").bitwiseAND(F.lit(_signed(m))).alias("cell"))
                      for i, m in enumerate(sub_grids(parts, distance))])
    return distinct.select("fp", e.alias("e")).select("fp", F.bit_count("fp").alias("t"), F.inline(grids))


def _compare(distance: int):
    """Links within groups of rows (group, fp) that come sorted by group; thinned out to a forest per batch."""
    def links(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        found = [np.empty((2, 0), np.int64)]
        at = np.arange(len(group))
        lag = 1
        while len(at):
            at = at[at + lag < len(group)]
            at = at[group[at] == group[at + lag]]
            near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance]
            found.append(np.stack([fp[near], fp[near + lag]]).view(np.int64))
            lag += 1
        a, b = np.concatenate(found, axis=1)
        a, b = thinned(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            group = np.concatenate([group, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            # The last group may go on in the next batch.
            done = len(group) - int((group[::-1] == group[-1]).argmin()) if len(group) and group[0] != group[-1] else 0
            if done:
                yield links(group[:done], fp[:done])
                group, fp = group[done:], fp[done:]
        yield links(group, fp)
        trim()

    return task


def fingerprint_links(distinct: DataFrame, *, distance: int = DISTANCE, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b) that connect all distinct fingerprints ``fp`` which differ in at most ``distance`` bits.

    Links are thinned out: every pair that is near ends up connected, not every pair has a row. Cells with
    one fingerprint are dropped by their count. A cell of more than ``block`` is cut into blocks of one
    total popcount and a hash; two blocks meet, in a group of their own, if their popcounts differ by no
    more than ``distance``. No group holds more than about twice ``block``, whatever the size of a cell.
    """
    parts = parts or parts_for(distinct.count(), distance)
    cells = _cells(distinct, parts, distance)
    bands = cells.groupBy("grid", "cell", "t").agg(F.count("*").alias("n"))
    held = bands.groupBy("grid", "cell").agg(F.sum("n").alias("n"), F.collect_list(F.struct("t", "n")).alias("bands")).filter("n > 1")
    # A cell has at most 65 bands. Only large ones carry them along.
    blocks = F.transform("bands", lambda x: F.struct(x["t"].alias("t"), F.ceil(x["n"] / F.lit(block)).cast("int").alias("blocks")))
    held = held.select("grid", "cell", F.when(F.col("n") > block, blocks).alias("bands"))
    placed = join_group_values(cells, held, ["grid", "cell"], how="inner", spread_by=["fp"], broadcast=False)
    band = F.array_max(F.filter("bands", lambda x: x["t"] == F.col("t")))["blocks"]
    own = F.struct(F.col("t").alias("t"), F.pmod(F.xxhash64("fp"), band).cast("int").alias("block"))
    near = F.filter("bands", lambda x: F.abs(x["t"] - F.col("t")) <= distance)
    others = F.flatten(F.transform(near, lambda x: F.transform(
        F.sequence(F.lit(0), x["blocks"] - 1), lambda i: F.struct(x["t"].alias("t"), i.alias("block")))))
    pair = F.when(F.col("bands").isNull(), F.array(F.lit(None).cast("struct<a:struct<t:int,block:int>,b:struct<t:int,block:int>>"))).otherwise(
        F.transform(others, lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"))))
    # Groups are told apart by a 64-bit hash; two that fall together cost time, not links.
    grouped = placed.withColumn("pair", F.explode(pair)).select(F.xxhash64("grid", "cell", "pair").alias("group"), "fp")
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_compare(distance), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 3,
    distance: int = DISTANCE,
    seed: int = SEED,
    parts: int | None = None,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fp (signed long), component_id (smallest doc_id reachable over near fingerprints) of every row.

    All links of at most ``distance`` differing bits are found, by any ``parts``. Each different fingerprint
    is worked on once, however many documents share it; a shared one holding a third of the table is
    spread when the components go back to the rows.

    Null, empty and blank texts have fingerprint 0 and are linked like others. A null id is no candidate
    for the smallest; a component of nulls alone has a null one. Repeated rows each get a row. An
    empty table gives no rows. A text of any length is hashed in parts. Other columns are ignored.
    """
    rows = stored(fingerprint_rows(id_and_text(docs, id_col, text_col), words, seed), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = components(fingerprint_links(distinct.select("fp"), distance=distance, parts=parts, block=block), "simhash-links")
    n = distinct.count()
    # Each of these sides has a row per fingerprint at most.
    grouped = not_broadcast(distinct, n).join(
        labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = stored(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    values = not_broadcast(grouped.select("fp", "label"), n).join(least, "label").select("fp", "component_id")
    values = stored(values, "simhash-values")
    discard(distinct)
    return join_group_values(rows, values, ["fp"], spread_by=["doc_id"], broadcast=None if n <= BROADCAST_ROWS else False)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
