"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Files hold the documents in ascending doc_id order, one range of ids each. Stripes are read in
parallel; the statistics of stripes and row groups and the Bloom filters let a lookup by doc_id skip
what cannot hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.common import id_and_text, text_buffers
from trajlake.llm.tokens import encoder

SCHEMA = "doc_id long, part int, seq long, local_start long, n_tokens long, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Token rows in ascending doc_id order (null first), cut into ranges of documents.

    Documents with one doc_id are ordered by the hash of their text; only equal rows tie.
    ``part`` is the range, ``seq`` the place in it, ``local_start`` the ids before it in the range.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("h"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("h")).select("doc_id", "text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        seq, base = 0, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first in range(0, batch.num_rows, 1024):
                last = min(first + 1024, batch.num_rows)
                ids, bounds = encode(data, offsets[first:last + 1])
                n = last - first
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:last], pa.array(np.full(n, part, np.int32)), pa.array(seq + np.arange(n)),
                    pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))),
                ], ["doc_id", "part", "seq", "local_start", "n_tokens", "ids"])
                seq, base = seq + n, base + len(ids)

    return ordered.mapInArrow(task, SCHEMA)


def write_tokens(rows: DataFrame, path: str, *, stripe_bytes: int = 64 << 20, index_rows: int = 1000,
                 bloom_fpp: float = 0.01) -> None:
    """Write token rows as ORC. ``index_rows`` documents make a row group of the indexes and Bloom filters."""
    (rows.write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", index_rows).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", bloom_fpp).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the files with their global start; a given list of ids is pushed down to the indexes.

    ``start`` is the number of ids of all documents before it. Ranges follow each other in the order of
    ``part``, so it is the place in the range plus the sum of the ranges before: a table with one row per
    written partition, small enough to broadcast however many documents it has.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select(F.col("part").alias("_part"),
                        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(bases), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Replace the ids by the CRC-32 of them as little-endian unsigned 32-bit integers."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")
            at = lists.offsets.to_numpy()
            raw = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc)],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_orc(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2, id_col: str = "doc_id",
                  text_col: str = "text", **layout: float) -> DataFrame:
    """Encode all documents, write the files and return what they hold.

    Null text: empty, so the end id alone. A null doc_id stands before all others. Rows with one doc_id
    are written next to each other, in the order of their texts' hashes. An empty table gives files
    without rows. Other columns are ignored.
    """
    write_tokens(encode_documents(docs, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col), path, **layout)
    return read_tokens(docs.sparkSession, path)
