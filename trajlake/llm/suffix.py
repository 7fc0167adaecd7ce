"""Removal of repeated byte strings by a hash-compared suffix sort.

Suffixes are compared by prefix polynomial hashes: binary search over the hashes finds their common
extension in a logarithmic number of steps, and a mergesort with that comparison orders them; equal
neighbours are verified byte by byte.

To sort only what can repeat, each window of ``width`` bytes is filed under its anchor: of its
``GRAM``-byte strings the one with the least hash. Equal windows have equal anchors, at equal places, so
windows need comparing only within an anchor. Anchors that occur in one document only drop out; of the others the
bytes around them (all that a window with that anchor can hold) are sorted, each distinct context once.
All steps pass packed arrays between units (rows by hash of id and text) and buckets (anchors by hash).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from trajlake.llm import units as U
from trajlake.llm.common import BYTE_VALUES, mix, prefix_hashes, segment_hashes, segment_powers, trim
from trajlake.llm.units import NO_ID, UNIT_BYTES, packed

GRAM = 20
# Positions per numpy step.
STEP = 1 << 20
NONE = np.iinfo(np.int64).max


def anchors(text: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of the anchors of all windows of ``width`` bytes within the rows of ``text``."""
    n = len(text)
    places = [np.empty(0, np.int64)]
    hashes = [np.empty(0, np.uint64)]
    span = width - GRAM + 1  # grams per window
    row_end = np.repeat(bounds[1:], np.diff(bounds)) if n else np.empty(0, np.int64)
    low = np.uint64((1 << 22) - 1)
    for a in range(0, max(n - width + 1, 0), STEP):
        b = min(a + STEP, n - width + 1)
        part = text[a:b + width - 1]
        prefix = prefix_hashes(part)
        at = np.arange(len(part) - GRAM + 1)
        gram = mix(segment_hashes(prefix, at, at + GRAM), 41)
        value = (gram & ~low) | at.astype(np.uint64)
        done, least = 1, value
        while done < span:  # least of ``done`` neighbours, doubled
            step = min(done, span - done)
            least = np.minimum(least[:len(least) - step], least[step:])
            done += step
        inside = row_end[a:b] >= np.arange(a, b) + width
        mark = np.zeros(len(at), bool)
        mark[(least[:b - a][inside] & low).astype(np.int64)] = True
        hit = np.flatnonzero(mark)
        places.append(a + hit)
        hashes.append(gram[hit])
    place, hashed = np.concatenate(places), np.concatenate(hashes)
    place, first = np.unique(place, return_index=True)  # steps overlap
    return np.searchsorted(bounds, place, side="right") - 1, place, hashed[first]


def _contexts(text: np.ndarray, bounds: np.ndarray, row: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that windows around each anchor can hold, zero-filled to a common length, and how many there are left and right."""
    left_max, total = width - GRAM, 2 * width - GRAM
    left = np.minimum(left_max, place - bounds[row])
    right = np.minimum(width, bounds[row + 1] - place)
    context = np.zeros((len(place), -(-total // 8) * 8), np.uint8)
    if len(place):
        padded = np.concatenate([np.zeros(left_max, np.uint8), text, np.zeros(width, np.uint8)])
        context[:, :total] = np.lib.stride_tricks.sliding_window_view(padded, total)[place]
        edge = np.flatnonzero((left < left_max) | (right < width))
        at = np.arange(-left_max, width)[None, :]
        context[edge, :total] *= (at >= -left[edge, None]) & (at < right[edge, None])
    return context, (left * 256 + right).astype(np.int32)


def _anchor_tags(context: np.ndarray, width: int) -> np.ndarray:
    """The lowest 32 bits of the anchors' hashes, from the contexts they stand in."""
    gram = context[:, width - GRAM:width]
    return (mix((BYTE_VALUES[gram] * segment_powers(GRAM)).sum(1, dtype=np.uint64), 41) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _context_keys(context: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    words = context.view(np.uint64)
    key = mix(ends.astype(np.uint64), seed)
    for k in range(words.shape[1]):
        key = mix(key ^ words[:, k], seed + k)
    return key


def _distinct(context: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry of each distinct context, and the class of each entry; equal keys are verified by bytes."""
    seed = 50
    while True:
        key = _context_keys(context, ends, seed)
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        if (context[first[at]] == context).all() and (ends[first[at]] == ends).all():
            return first, at
        seed += 100  # two contexts under one key: try other keys


def _send_contexts(width: int, buckets: int):
    """Per unit: its distinct contexts, packed per bucket, each with the least and greatest id that holds it."""
    def unit_task(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        ids, _, text, bounds, found = U.unpacked(table)
        row, place, hashed = anchors(text, bounds, width)
        hit = U.levels_of(U.names(hashed, buckets), U.known_names(found)) > 0
        row, place, hashed = row[hit], place[hit], hashed[hit]
        context, ends = _contexts(text, bounds, row, place, width)
        first, of = _distinct(context, ends)
        low, high = np.full(len(first), NONE), np.full(len(first), NO_ID)
        np.minimum.at(low, of, ids[row])
        np.maximum.at(high, of, ids[row])
        context, ends, hashed = context[first], ends[first], hashed[first]
        groups = U.groups_of(U.bucket_of(hashed, buckets))
        columns = {"bucket": pa.array([int(U.bucket_of(hashed[g[:1]], buckets)[0]) for g in groups], pa.int32()),
                   "unit": pa.array([unit] * len(groups), pa.int32())}
        for c, x in (("context", context), ("ends", ends), ("low", low), ("high", high)):
            columns[c] = pa.array([zstandard.compress(packed(x[g]), 1) for g in groups], pa.binary())
        trim()
        return pa.table(columns)

    return unit_task


class Suffixes:
    """Suffixes of the rows of a byte matrix that start at one column, compared over ``width`` bytes.

    Prefix hashes run from the start of each row, so two stretches at the same columns are equal if the
    differences of their prefix hashes are.
    """

    def __init__(self, rows: np.ndarray, column: int, width: int):
        self.rows, self.column, self.width = rows, column, width
        powers = np.multiply.accumulate(np.full(rows.shape[1], 0x9E3779B97F4A7C15, np.uint64))
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(mix(rows.astype(np.uint64), 43) * powers, axis=1, out=self.prefix[:, 1:])
        self.steps = [1 << k for k in range(width.bit_length() - 1, -1, -1)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, up to ``width``: binary search over hashes."""
        at = np.zeros(len(a), np.int64)
        base = self.prefix[a, self.column] - self.prefix[b, self.column]
        for step in self.steps:
            to = np.minimum(at + step, self.width)
            same = self.prefix[a, self.column + to] - self.prefix[b, self.column + to] == base
            at = np.where(same, to, at)
        return at

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a stands before b; equal ones where ``or_equal``."""
        n = self.common(a, b)
        at = self.column + np.minimum(n, self.width - 1)
        return np.where(n >= self.width, or_equal, self.rows[a, at] < self.rows[b, at])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (``group`` ascending): mergesort, all runs of a level at once.

        Each suffix finds its rank in the neighbouring run by binary search; place = own place + rank.
        """
        n = len(group)
        order = np.arange(n)
        start = np.searchsorted(group, group)
        size = np.searchsorted(group, group, side="right") - start
        run, largest = 1, int(size.max(initial=0))
        while run < largest:
            live = np.flatnonzero(size > run)
            inner = live - start[live]
            mine = inner // run
            right = mine % 2 == 1
            end = start[live] + size[live]
            low = np.minimum(start[live] + (mine ^ 1) * run, end)
            base, high = low.copy(), np.minimum(low + run, end)
            own = order[live]
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                # From the left run, what equals comes after; from the right run, before.
                before = self.less(order[middle], own[open_], right[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = start[live] + (mine // 2) * 2 * run + inner % run + (low - base)
            merged = order.copy()
            merged[place] = order[live]
            order, run = merged, run * 2
        return order


def least_ids(group: np.ndarray, context: np.ndarray, ends: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Per context and window around its anchor, the least id of a document that holds the window.

    ``group`` (ascending) names the anchor. Column l stands for the window that starts l bytes before
    the anchor; NONE if the document ends before. Contexts are sorted once by what follows their anchor:
    those that agree on ``width - l`` bytes from there stand next to each other. Among them, those with the
    same l bytes before the anchor hold the same window; their bytes are compared.
    """
    n, middle = len(context), width - GRAM
    out = np.full((n, middle + 1), NONE)
    if not n:
        return out
    left, right = ends // 256, ends % 256
    suffixes = Suffixes(context, middle, width)
    order = suffixes.sort(group)
    same_group = group[order][1:] == group[order][:-1]
    extension = np.where(same_group, suffixes.common(order[:-1], order[1:]), -1)
    context, low_, left, right, prefix = context[order], low[order], left[order], right[order], suffixes.prefix[order]
    result = np.full((n, middle + 1), NONE)
    for l in range(middle + 1):
        valid = np.flatnonzero((left >= l) & (right >= width - l))
        if not len(valid):
            continue
        segment = np.append(0, np.cumsum(extension < width - l))[valid]
        before = prefix[valid, middle] - prefix[valid, middle - l]
        key = mix(before, 44) ^ mix(segment.astype(np.uint64), 45)
        at = np.argsort(key)
        ranked = valid[at]
        new = np.append(True, key[at][1:] != key[at][:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(ranked)))
        many = np.repeat(size > 1, size)
        if many.any():  # verified by bytes; a row that differs from the head of its class stands alone
            rows, heads = ranked[many], np.repeat(ranked[head], size)[many]
            equal = (context[rows, middle - l:middle - l + width] == context[heads, middle - l:middle - l + width]).all(1)
            if not equal.all():
                wrong = rows[~equal]
                result[wrong, l] = low_[wrong]
                keep = np.ones(len(ranked), bool)
                keep[np.flatnonzero(many)[~equal]] = False
                ranked, new = ranked[keep], new[keep]
                head = np.flatnonzero(new)
                size = np.diff(np.append(head, len(ranked)))
        result[ranked, l] = np.repeat(np.minimum.reduceat(low_[ranked], head), size)
    out[order] = result
    return out


def _settle(width: int):
    """Per bucket: the answers for each unit's contexts, as keys and least ids per window."""
    stride = -(-(2 * width - GRAM) // 8) * 8

    def bucket_task(table: pa.Table) -> pa.Table:
        ends, context, low, high = (
            [np.frombuffer(zstandard.decompress(x), t) for x in table.column(c).to_pylist()]
            for c, t in (("ends", np.int32), ("context", np.uint8), ("low", np.int64), ("high", np.int64)))
        unit = np.repeat(np.array(table.column("unit").to_pylist(), np.int32), [len(x) for x in ends])
        ends, context, low, high = (np.concatenate(x) for x in (ends, context, low, high))
        context = context.reshape(-1, stride)
        first, of = _distinct(context, ends)
        least = np.full(len(first), NONE)
        np.minimum.at(least, of, low)
        gram = np.ascontiguousarray(context[first, width - GRAM:width])
        _, group = np.unique(gram.view(f"V{GRAM}").ravel(), return_inverse=True)
        order = np.argsort(group, kind="stable")
        answer = np.empty((len(first), width - GRAM + 1), np.int64)
        answer[order] = least_ids(group[order], context[first][order], ends[first][order], least[order], width)
        answer = answer[of]
        useful = np.flatnonzero(answer.min(1) < high)
        key = _context_keys(context[useful], ends[useful], 7)
        answer, unit = answer[useful], unit[useful]
        tag = _anchor_tags(context[useful], width)
        trim()
        return U.answers(unit, lambda g: packed(key[g]) + packed(tag[g]), lambda g: zstandard.compress(packed(answer[g]), 1))

    return bucket_task


def _remove(width: int, keep_text: bool):
    """Per unit: covered bytes of each row, and what is left."""
    span = width - GRAM + 1

    def unit_task(table: pa.Table) -> pa.Table:
        ids, _, text, bounds, found = U.unpacked(table)
        covered = np.zeros(len(text) + 1, np.int32)
        if found:
            cut = [len(x[0]) // 12 * 8 for x in found]
            key = np.concatenate([np.frombuffer(x[0][:n], np.uint64) for x, n in zip(found, cut)])
            tags = np.unique(np.concatenate([np.frombuffer(x[0][n:], np.uint32) for x, n in zip(found, cut)]))
            answer = np.concatenate([np.frombuffer(zstandard.decompress(x[1]), np.int64).reshape(-1, span) for x in found])
            order = np.argsort(key)
            key, answer = key[order], answer[order]
            row, place, hashed = anchors(text, bounds, width)
            tag = (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            named = tags[np.minimum(np.searchsorted(tags, tag), len(tags) - 1)] == tag
            row, place = row[named], place[named]
            for i in range(0, len(row), 1 << 16):
                r, p = row[i:i + (1 << 16)], place[i:i + (1 << 16)]
                context, ends = _contexts(text, bounds, r, p, width)
                own = _context_keys(context, ends, 7)
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                hit = np.flatnonzero(key[at] == own)
                k, l = np.nonzero(answer[at[hit]] < ids[r[hit]][:, None])
                begin = p[hit][k] - l
                covered += np.bincount(begin, minlength=len(covered)).astype(np.int32)
                covered -= np.bincount(begin + width, minlength=len(covered)).astype(np.int32)
        gone = np.cumsum(covered[:-1]) > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        inner = bounds[:-1][bounds[:-1] < len(text)]
        rise[inner] = gone[inner]
        upto, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(rise))
        digest, left = [], []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            kept = text[a:b] if upto[b] == upto[a] else text[a:b][~gone[a:b]]
            digest.append(hashlib.sha256(kept.tobytes()).hexdigest())
            if keep_text:
                left.append(kept.tobytes())
        trim()
        return pa.table({
            "doc_id": pa.array(ids, mask=ids == NO_ID), "n_bytes": pa.array(np.diff(bounds)),
            "n_removed": pa.array(upto[bounds[1:]] - upto[bounds[:-1]]), "n_spans": pa.array(spans[bounds[1:]] - spans[bounds[:-1]]),
            "kept_sha256": pa.array(digest, pa.string())} | ({"kept": pa.array(left, pa.binary())} if keep_text else {}))

    return unit_task


def remove_repeats(docs: DataFrame, *, width: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
                   unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Remove each byte that a ``width``-byte string covers which also starts in a document with a smaller id.

    Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``keep_text``, the kept bytes (which may end within a character). Texts are judged as read, as UTF-8
    bytes; null is empty. A null id is smaller than all others. Rows with one id do not touch each other,
    equal rows are treated alike. An empty table gives no rows. Other columns are ignored.
    """
    if not GRAM < width < 128:
        raise ValueError(f"width must lie between {GRAM} and 128")
    rows, units = U.dealt(docs, id_col, text_col, unit_bytes)

    def tags(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, _, hashed = anchors(data, bounds, width)
        return row, hashed

    texts = U.packed_texts(rows)
    contexts = texts.unionByName(U.shared_tags(rows, tags, units)).groupBy("unit").applyInArrow(
        _send_contexts(width, units), "bucket int, unit int, context binary, ends binary, low binary, high binary")
    answers = contexts.groupBy("bucket").applyInArrow(_settle(width), U.SCHEMA)
    return texts.unionByName(answers).groupBy("unit").applyInArrow(
        _remove(width, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", kept binary" if keep_text else ""))
