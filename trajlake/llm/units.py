"""Texts dealt out to units of bounded size, and hashes of their parts that several documents hold.

Two passes find what documents share without moving it all: in the first, tasks file short tags of the
parts' hashes by bucket, and each bucket tells every unit which of its tags occur in two documents; in
the second, a unit's texts meet those answers. Texts, tags and answers travel as packed arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import id_and_text, runs, text_buffers, trim

UNIT_BYTES = 8 << 20
# Text that a task packs at a time.
PACK_BYTES = 12 << 20
NO_ID = np.iinfo(np.int64).min
SCHEMA = "unit int, ids binary, hashes binary, lengths binary, body binary, tag binary, found binary"
_NAMES = ["unit", "ids", "hashes", "lengths", "body", "tag", "found"]
# A tag is 39 bits of a hash beside the bucket, which other bits give; a lowest bit makes it 5 bytes.
TAG_BITS = 39

MakeHashes = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def dealt(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, text_hash, unit, text), and the number of units: rows go by the hash of their id and text."""
    raw = id_and_text(docs, id_col, text_col)
    size = raw.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-size // unit_bytes))
    return raw.select("doc_id", F.xxhash64("text").alias("text_hash"),
                      F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int").alias("unit"), "text"), units


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def groups_of(key: np.ndarray) -> list[np.ndarray]:
    """Places of equal keys, one array per key."""
    order = np.argsort(key, kind="stable")
    if not len(order):
        return []
    cut = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    return [order[i:j] for i, j in zip(cut, [*cut[1:], len(order)])]


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, text hashes, units, bytes and bounds of some rows at a time."""
    data, offsets = text_buffers(batch.column(3))
    ids, hashes, units = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
    for a, b in runs(offsets, PACK_BYTES // 2):
        yield ids[a:b], hashes[a:b], units[a:b], data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        ids, hashes, units = (np.concatenate([h[k] for h in held]) for k in range(3))
        texts = [h[3][i:j] for h in held for i, j in zip(h[4][:-1].tolist(), h[4][1:].tolist())]
        out = []
        for own in groups_of(units):
            parts = [texts[i] for i in own.tolist()]
            out.append((int(units[own[0]]), packed(ids[own]), packed(hashes[own]),
                        packed(np.array([len(p) for p in parts], np.int64)), zstandard.compress(b"".join(p.tobytes() for p in parts), 3)))
        return pa.RecordBatch.from_arrays([
            pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, 5)),
            *[pa.nulls(len(out), pa.binary())] * 2], _NAMES)

    for part in (part for batch in batches for part in _columns(batch)):
        held.append(part)
        if sum(len(h[3]) for h in held) >= PACK_BYTES:
            yield done()
            held = []
    if held:
        yield done()
    trim()


def packed_texts(rows: DataFrame) -> DataFrame:
    """The rows of a unit as a few compressed rows."""
    return rows.mapInArrow(_pack, SCHEMA)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """ids, text hashes, bytes and bounds of a unit's rows, and the answers for it."""
    rows, found = [], []
    for ids, hashes, lengths, body, tag, hit in zip(*(table.column(c).to_pylist() for c in _NAMES[1:])):
        if body is None:
            found.append((tag, hit))
        else:
            rows.append((np.frombuffer(ids, np.int64), np.frombuffer(hashes, np.int64), np.frombuffer(lengths, np.int64),
                         np.frombuffer(zstandard.decompress(body), np.uint8)))
    if not rows:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint8), np.zeros(1, np.int64), found
    ids, hashes, lengths, text = (np.concatenate([r[k] for r in rows]) for k in range(4))
    return ids, hashes, text, np.append(0, np.cumsum(lengths)), found


def answers(unit: np.ndarray, tag: Callable[[np.ndarray], bytes], found: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One answer row per unit; ``tag`` and ``found`` pack its entries."""
    groups = groups_of(unit)
    none = pa.nulls(len(groups), pa.binary())
    return pa.table([pa.array([unit[g[0]] for g in groups], pa.int32()), none, none, none, none,
                     pa.array([tag(g) for g in groups], pa.binary()), pa.array([found(g) for g in groups], pa.binary())], _NAMES)


def names(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and tag of each hash as one number."""
    return (bucket_of(hashes, buckets).astype(np.uint64) << np.uint64(TAG_BITS)) | (hashes & np.uint64((1 << TAG_BITS) - 1))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _five(x: np.ndarray) -> bytes:
    return packed(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def shared_tags(rows: DataFrame, make: MakeHashes, buckets: int) -> DataFrame:
    """Answers for each unit: which tags of its documents' hashes occur in two documents, and how often.

    ``make`` gives (row, hash) of the parts of some rows. A tag passes once per unit and batch of rows,
    however many documents hold it.
    """
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, units, data, bounds in (part for batch in batches for part in _columns(batch)):
            row, hashed = make(data, bounds)
            name, unit = names(hashed, buckets), units[row]
            order = np.lexsort((row, name, unit))
            name, unit, row = name[order], unit[order], row[order]
            new = np.append(True, (name[1:] != name[:-1]) | (unit[1:] != unit[:-1]))[:len(name)]
            start = np.flatnonzero(new)
            more = np.zeros(len(start), np.uint64)
            if len(start):
                group = np.cumsum(new) - 1
                more[group[row != row[start][group]]] = 1
            name, unit = name[start], unit[start]
            tag = ((name & np.uint64((1 << TAG_BITS) - 1)) << np.uint64(1)) | more
            bucket = (name >> np.uint64(TAG_BITS)).astype(np.int32)
            out = []
            for own in groups_of(bucket):  # stable: by unit within the bucket
                first = np.flatnonzero(np.append(True, np.diff(unit[own]) != 0))
                out.append((int(bucket[own[0]]), _five(tag[own]), packed(unit[own][first].astype(np.int32)),
                            packed(np.diff(np.append(first, len(own))).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3))],
                ["bucket", "tags", "units", "counts"])
        trim()

    def tell(table: pa.Table) -> pa.Table:
        tag = np.concatenate([_from_five(x) for x in table.column("tags").to_pylist()])
        unit = np.concatenate([np.repeat(np.frombuffer(u, np.int32), np.frombuffer(n, np.int32))
                               for u, n in zip(table.column("units").to_pylist(), table.column("counts").to_pylist())])
        order = np.argsort(tag, kind="stable")
        tag, unit = tag[order], unit[order]
        plain = tag >> np.uint64(1)
        start = np.flatnonzero(np.append(True, plain[1:] != plain[:-1]))
        size = np.diff(np.append(start, len(tag)))
        # Documents at least: an entry stands for one, or for two or more.
        times = size + np.add.reduceat((tag & np.uint64(1)).astype(np.int64), start)
        level = np.minimum(np.log2(times), 255).astype(np.uint8)
        keep = np.repeat(times > 1, size)
        plain, unit, level = plain[keep], unit[keep], np.repeat(level, size)[keep]
        bucket = packed(np.array([table.column("bucket")[0].as_py()], np.int64))
        return answers(unit, lambda g: bucket + packed(level[g]), lambda g: _five(plain[g]))

    return rows.mapInArrow(file, "bucket int, tags binary, units binary, counts binary").groupBy("bucket").applyInArrow(tell, SCHEMA)


def known_names(found: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of the shared tags told to a unit, and the level (log2 of the documents counted) of each."""
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    name = np.concatenate([(np.frombuffer(t[:8], np.uint64) << np.uint64(TAG_BITS)) | _from_five(f) for t, f in found])
    level = np.concatenate([np.frombuffer(t[8:], np.uint8) for t, _ in found])
    name, first = np.unique(name, return_index=True)
    return name, level[first]


def levels_of(name: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Level of each name, 0 if no other document holds it."""
    if not len(known[0]):
        return np.zeros(len(name), np.uint8)
    at = np.minimum(np.searchsorted(known[0], name), len(known[0]) - 1)
    return np.where(known[0][at] == name, known[1][at], 0).astype(np.uint8)
