"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit distances.

The embedding walks through a string and repeats or advances by random bits that depend on step and
byte; strings at a small edit distance fall into step again after an edit and end at a small Hamming
distance. Windows start at every word of a document and of an item. A few sampled places of the walk make a
key; a document window that shares a key with a window of an item, in any of several repetitions with
other walks, makes the item-sized stretch around it a candidate. Candidates are settled by exact edit
distance of the item to the best stretch there.

An item of n words has up to n windows per repetition, so one of them matches with high probability
even if single windows seldom do: README lists the measured recall. Shorter items have too few windows for
that and are looked up exactly: cut into one piece more than edits are allowed, one piece stands unchanged
wherever the item does, so none is missed. A walk goes on only where the bytes it has sampled occur in some
item, and shared 4-byte grams thin out the candidates of both ways before the distances; neither loses any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import id_and_text, mix, text_buffers, trimmed, runs

REPETITIONS = 3
STEPS = 64
# Items of fewer bytes are looked up by pieces; those below the least are left out.
SHORT = 200
LEAST = 8
SAMPLED = 11
MAX_EDIT_SHARE = 0.1
# Sampled bytes of a walk from which on it asks whether an item has the like; fewer occur nearly everywhere.
ASK_FROM = 4
# Items are sent to tasks in blocks of this many bytes at most, one pass over the documents per block.
BLOCK_BYTES = 16 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = _NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters, digits and bytes above 127 stay; other runs become one blank, ends have none.

    Returns the bytes, the n + 1 offsets of the rows and the place of each byte in ``data``.
    """
    at = offsets - offsets[0]
    text = _NORMAL[data[offsets[0]:offsets[-1]]]
    blank = text == 32
    keep = ~blank
    # A blank stays if a word ended before it and it is not the last of its row.
    keep[1:] |= ~blank[:-1]
    first = at[:-1][np.diff(at) > 0]
    keep[first] = ~blank[first]
    where = np.flatnonzero(keep)
    bounds = np.searchsorted(where, at)
    # A blank that ends a row goes.
    last = bounds[1:][np.diff(bounds) > 0] - 1
    last = last[blank[where[last]]]
    if len(last):
        where = np.delete(where, last)
        bounds = np.searchsorted(where, at)
    return text[where], bounds, where


def _starts(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    begins = np.zeros(len(text) + 1, bool)
    begins[1:] = np.append(text, 0)[:-1] == 32
    begins[bounds[:-1]] = True
    begins = begins[:len(text)]
    return np.flatnonzero(begins & (text != 32)) if len(text) else np.empty(0, np.int64)


class Walk:
    """One random walk of ``steps`` steps, and the places of it that make a key."""

    def __init__(self, steps: int, repetition: int, sampled: int = SAMPLED):
        rng = np.random.default_rng((steps, repetition, 8))
        self.moves = rng.integers(0, 2, (steps, 256), dtype=np.int32).astype(np.int64)
        self.places = sorted(rng.choice(steps, min(sampled, steps), replace=False).tolist())

    def _samples(self, text: np.ndarray, at: np.ndarray, key: np.ndarray, k: int) -> None:
        """Walk from the sampled place before the k-th on to it, and take its byte into the keys."""
        for step in range(self.places[k - 1] if k else 0, self.places[k]):
            at += self.moves[step].take(text.take(at))
        key *= np.uint64(0x100000001B3)
        key += text.take(at)

    def index(self, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys of the windows at ``start``, and a sieve of what they have sampled at each place from ``ASK_FROM`` on.

        ``text`` must go on for as many bytes as the walk has steps."""
        at, key = start.astype(np.int64), np.zeros(len(start), np.uint64)
        bits = min(max(16, (16 * len(start)).bit_length()), 20)
        sieves = []
        for k in range(len(self.places)):
            self._samples(text, at, key, k)
            if k + 1 >= ASK_FROM:
                sieves.append(_sieve(key * _ODD, bits))
        return mix(key), sieves

    def near(self, text: np.ndarray, start: np.ndarray, sieves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``start`` that may have the key of an indexed window, and their keys.

        Windows with an indexed key have sampled the same as that one at all places before, so they pass all sieves."""
        at, key = start.astype(np.int64), np.zeros(len(start), np.uint64)
        for k in range(len(self.places)):
            self._samples(text, at, key, k)
            if k + 1 >= ASK_FROM:
                left = _sifted(key * _ODD, sieves[k + 1 - ASK_FROM])
                start, at, key = start[left], at[left], key[left]
        return start, mix(key)


@dataclass
class Items:
    """Normalised items, per walk its sieves and the sorted keys of the windows of long ones with item and place,
    and per size the same of the pieces of short ones, with their last 8 bytes."""

    ids: list[int]
    texts: list[bytes]
    index: list[tuple[Walk, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]
    pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _sieve(keys: np.ndarray, bits: int = 20) -> np.ndarray:
    sieve = np.zeros(1 << bits, bool)
    sieve[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return sieve


def _sifted(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Places of the keys that may be among those of the sieve."""
    return np.flatnonzero(sieve.take((keys >> np.uint64(65 - len(sieve).bit_length())).astype(np.int64)))


def _words(padded: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places on, as one number."""
    return np.ndarray(n, "<u8", padded, strides=1).astype(np.uint64)


def _piece_keys(words: np.ndarray, size: int) -> np.ndarray:
    """Keys of the first ``size`` bytes, 8 at most."""
    return (words & np.uint64((1 << 8 * size) - 1)) * _ODD


def _piece_index(words: np.ndarray, bounds: np.ndarray, share: float) -> list:
    """Pieces of the short items, one more per item than edits are allowed, by the bytes in their keys."""
    item, place, length = [], [], []
    for i, n in enumerate(np.diff(bounds).tolist()):
        if LEAST <= n < SHORT:
            parts = min(int(share * n) + 1, n)
            cuts = [n * j // parts for j in range(parts + 1)]
            item += [i] * parts
            place += cuts[:-1]
            length += [b - a for a, b in zip(cuts[:-1], cuts[1:])]
    item, place, length = (np.array(x, np.int64) for x in (item, place, length))
    out = []
    for size in np.unique(np.minimum(length, 8)).tolist():
        own = np.flatnonzero(np.minimum(length, 8) == size)
        at = bounds[item[own]] + place[own]
        keys = _piece_keys(words[at], size)
        order = np.argsort(keys, kind="stable")
        skip = np.maximum(length[own] - 8, 0)
        last = _piece_keys(words[at + skip], size)
        out.append((size, _sieve(keys), *(x[order] for x in (keys, item[own], place[own], np.stack([skip.astype(np.uint64), last], 1)))))
    return out


def index_items(ids: list[int], texts: list[str], repetitions: int = REPETITIONS, share: float = MAX_EDIT_SHARE) -> Items:
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    norm, bounds, _ = normalise(data, offsets)
    length = np.diff(bounds)
    padded = np.append(norm, np.zeros(STEPS + 1, np.uint8))
    start = _starts(norm, bounds)
    item = np.searchsorted(bounds, start, side="right") - 1
    index = []
    own = (length[item] >= SHORT) & (bounds[item + 1] - start >= STEPS)
    for r in range(repetitions if own.any() else 0):
        walk = Walk(STEPS, r)
        keys, sieves = walk.index(padded, start[own])
        order = np.argsort(keys, kind="stable")
        index.append((walk, sieves, keys[order], item[own][order], (start[own] - bounds[item[own]])[order]))
    return Items(ids, [norm[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], index,
                 _piece_index(_words(padded, len(norm)), bounds, share))


def best_match(item: bytes, stretch: bytes, limit: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to a part of ``stretch`` and where that part ends; None above ``limit``.

    Bit-parallel columns of the distance table (Myers), one integer each.
    """
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, distance, best = full, 0, len(item), None
    for j, c in enumerate(stretch):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | ~(d0 | plus) & full, plus & d0
        distance += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(d0 | up) & full, up & d0
        if distance <= limit and (best is None or distance < best[0]):
            best = distance, j + 1
    return best


def _pairs(key: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``key`` and in the sorted ``keys`` that hold the same."""
    low, high = (np.searchsorted(keys, key, side=s) for s in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(key)), n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _grams(words: np.ndarray) -> np.ndarray:
    """12-bit hashes of the 4 bytes from each place on."""
    return ((words.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.uint16)


def _piece_hits(words: np.ndarray, bounds: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """(row, item, begin) where a piece of a short item stands."""
    for size, sieve, keys, item, place, tail in items.pieces:
        key = _piece_keys(words, size)
        near = _sifted(key, sieve)
        at, which = _pairs(key[near], keys)
        at = near[at]
        end = at + tail[which, 0].astype(np.int64)
        same = end < len(words)
        same[same] = _piece_keys(words[end[same]], size) == tail[which[same], 1]
        at, which = at[same], which[same]
        yield np.stack([np.searchsorted(bounds, at, side="right") - 1, item[which], at - place[which]], 1)


def _walk_hits(padded: np.ndarray, start: np.ndarray, bounds: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """(row, item, begin) where a window has the key of a window of a long item."""
    for walk, sieves, keys, item, place in items.index:
        near, key = walk.near(padded, start, sieves)
        at, which = _pairs(key, keys)
        at = near[at]
        yield np.stack([np.searchsorted(bounds, at, side="right") - 1, item[which], at - place[which]], 1)


def _likely(hits: np.ndarray, words: np.ndarray, bounds: np.ndarray, items: Items, share: float) -> Iterator[np.ndarray]:
    """(row, item, low, high) of the stretches around the hits that hold enough of their item's 4-byte grams.

    An edit changes 4 of the item's grams at most, so all others of them stand in a stretch that holds the item.
    """
    length = np.array([len(t) for t in items.texts], np.int64)[hits[:, 1]]
    limit = (share * length).astype(np.int64)
    low = np.maximum(bounds[hits[:, 0]], hits[:, 2] - limit)
    high = np.minimum(bounds[hits[:, 0] + 1], hits[:, 2] + length + limit)
    stretches = np.stack([hits[:, 0], hits[:, 1], low, high], 1)[high - low >= length - limit]
    stretches = stretches[np.argsort(stretches[:, 1], kind="stable")]
    grams = _grams(words)
    for own in np.split(stretches, np.flatnonzero(np.diff(stretches[:, 1])) + 1):
        if not len(own):
            continue
        item = items.texts[own[0, 1]]
        limit = int(share * len(item))
        least = len(item) - 3 - 4 * limit
        table = np.zeros(1 << 12, bool)
        table[_grams(_words(np.frombuffer(item + bytes(8), np.uint8), len(item) - 3))] = True
        width = int((own[:, 3] - own[:, 2]).max()) - 3
        rows = max(1, (1 << 20) // max(1, width))
        for part in np.split(own, range(rows, len(own), rows)):
            places = part[:, 2:3] + np.arange(width)
            inside = places < part[:, 3:] - 3
            near = table.take(grams.take(places, mode="clip")) & inside
            yield part[near.sum(1) >= least]


def find_items(data: np.ndarray, offsets: np.ndarray, items: Items, share: float = MAX_EDIT_SHARE) -> list[tuple[int, int, int, int]]:
    """(row, item, distance, end) of each item found in each row; ``end`` counts normalised bytes.

    ``share`` must be the one the items were indexed for."""
    text, bounds, _ = normalise(data, offsets)
    if not len(text):
        return []
    padded = np.append(text, np.zeros(STEPS + 1, np.uint8))
    words = _words(padded, len(text))
    hits = list(_piece_hits(words, bounds, items))
    if items.index:
        hits += _walk_hits(padded, _starts(text, bounds), bounds, items)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    if not hits:
        return []
    hits = list(_likely(np.unique(np.concatenate(hits), axis=0), words, bounds, items, share))
    if not hits:
        return []
    done: dict[tuple[bytes, bytes], tuple[int, int] | None] = {}
    for row, i, low, high in np.unique(np.concatenate(hits), axis=0).tolist():
        item = items.texts[i]
        limit = int(share * len(item))
        if (row, i) in out and out[row, i][0] == 0:
            continue
        stretch = text[low:high].tobytes()
        if (item, stretch) not in done:
            done[item, stretch] = best_match(item, stretch, limit)
        found = done[item, stretch]
        if found and ((row, i) not in out or found[0] < out[row, i][0]):
            out[row, i] = found[0], int(low - bounds[row]) + found[1]
    return [(row, i, d, end) for (row, i), (d, end) in out.items()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, share: float) -> Iterator[Items]:
    """Indexed items, a bounded block at a time. Items without a letter or digit, or null, match nothing."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield index_items([r["item_id"] for r in block], [r["text"] for r in block], share=share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", max_edit_share: float = MAX_EDIT_SHARE) -> DataFrame:
    """(doc_id, item_id, edit_distance, item_length) of every item found in every document.

    Compared are lower-cased letters, digits and bytes above 127, other runs as one blank. An item counts
    as found if some stretch of the document is within ``max_edit_share`` of the item's length in edits.
    An item is found once per row, at its least distance. Null texts match nothing; items shorter than 8
    compared bytes are left out, as they say too little. Repeated rows are reported each; null ids stay
    null. Empty tables give no rows.
    """
    out = None
    for items in _blocks(benchmark, item_id_col, item_text_col, max_edit_share):
        def task(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffers(batch.column(1))
                for first, last in runs(offsets):
                    found = find_items(data, offsets[first:last + 1], items, max_edit_share)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([first + f[0] for f in found], pa.int64())),
                        pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                        pa.array([len(items.texts[f[1]]) for f in found], pa.int64())],
                        ["doc_id", "item_id", "edit_distance", "item_length"])

        part = id_and_text(docs, id_col, text_col).mapInArrow(
            trimmed(task), "doc_id long, item_id long, edit_distance long, item_length long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", max_edit_share: float = MAX_EDIT_SHARE) -> DataFrame:
    """The documents in which ``find_leaks`` finds no item, with all their columns."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_id_col, item_text_col, max_edit_share):
        def task(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffers(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for first, last in runs(offsets):
                    for f in find_items(data, offsets[first:last + 1], items, max_edit_share):
                        keep[first + f[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(task), docs.schema)
    return docs
