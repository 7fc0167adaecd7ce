"""What the training-data operators share: written work tables, Arrow batches as byte arrays, hashes.

Texts reach the Python tasks as Arrow buffers and are worked on as numpy byte arrays, a run of rows of
bounded size at a time. A null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.session import ensure_checkpoint_dir

# Bytes of text that one numpy step works on; arrays of 64-bit values take eight times as much, and a step holds several.
RUN_BYTES = 1 << 20
# Rows of a join's side that may be broadcast, at most.
BROADCAST_ROWS = 200_000
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later steps start from the files: a lost executor costs no recomputation, and values
    that depend on task order (row numbers) stay what they were.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished queries now.

    It deletes them once the driver's garbage collector finds their plans; a query over a large table fills the
    disks long before the driver's heap.
    """
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def not_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join whose smaller side has so many rows: beyond ``BROADCAST_ROWS`` Spark broadcasts neither side.

    Its own estimate is the size of compressed files, and takes no account of the rows that an explode adds.
    """
    return df if rows <= BROADCAST_ROWS else df.hint("merge")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator reads, under fixed names; others, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``limit`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; workers stay between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
        if release is not None:
            release(0)


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task over Arrow batches, with its worker's memory given back at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        trim()

    return run


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of ``data`` between byte offsets, as an Arrow binary column."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.view(np.uint8))])


_tables: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _tables.get(name)
    if table is None or len(table) < n:
        size = max(n, RUN_BYTES + 1)
        table = np.empty(size, np.uint64)
        table[0] = 1
        table[1:] = np.uint64(base)
        np.multiply.accumulate(table, out=table)
        _tables[name] = table
    return table[:n]


def byte_values(seed: int = 1) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


BYTE_VALUES = byte_values()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[_LOWER]


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums of value(byte) * base**position modulo 2**64; n + 1 entries."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values[data] * _power_table("powers", _ODD, len(data)), out=out[1:])
    return out


def segment_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of [start, end), the same wherever the bytes stand."""
    inverse = _power_table("inverse", pow(_ODD, -1, 1 << 64), len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def segment_powers(n: int) -> np.ndarray:
    """Factors of the bytes of a segment in its hash."""
    return _power_table("powers", _ODD, n)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93) & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copy rows with a space after each, so that no word spans two rows; starts of the rows."""
    lengths = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + np.arange(len(lengths))
    out = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[starts + lengths] = False
    out[keep] = data[offsets[0]:offsets[-1]]
    return out, starts


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not blank."""
    solid = np.zeros(len(text) + 2, np.int8)
    solid[1:-1] = ~_SPACE[text]
    edges = np.flatnonzero(np.diff(solid))
    return edges[::2], edges[1::2]
