"""Importance resampling towards a target distribution over hashed word n-grams.

Texts of a batch are joined with separator sentinels and searched for words in one regex pass; where the
words start tells their document (searchsorted over the document offsets), which masks the n-grams that
would cross documents before the buckets are counted (bincount).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import id_and_text, runs, stored, text_buffers, trim
from trajlake.operators.grouping import with_positions

BUCKETS = 10_000
# Words are runs of a-z, 0-9 and all that is not ASCII, in bytes of lower-cased UTF-8 text.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = 0
# Words held as Python objects at a time, however long a text is.
WORDS_AT_ONCE = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Features(NamedTuple):
    """n-grams of some words of a batch: document and bucket of each; and how many words each document got."""

    doc: np.ndarray
    bucket: np.ndarray
    words: np.ndarray


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Rows in lower case with a sentinel after each, and where each row starts."""
    lengths = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + np.arange(len(lengths))
    out = np.empty(int(lengths.sum()) + len(lengths), np.uint8)
    inside = np.ones(len(out), bool)
    inside[starts + lengths] = False
    out[inside] = _LOWER[data[offsets[0]:offsets[-1]]]
    out[~inside] = SENTINEL
    return out.tobytes(), starts


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[Features]:
    """All runs of 1 to ``longest`` words of each row, in parts of bounded size.

    A part carries the last words of the one before, so no n-gram is lost between parts. An n-gram's
    bucket is the crc32 of its words joined by a space, taken on from the n-gram one word shorter.
    """
    buffer, starts = joined(data, offsets)
    n = len(starts)
    found = WORD.finditer(buffer)
    words, doc = [], np.empty(0, np.int64)
    last = False
    while not last:
        part = list(islice(found, WORDS_AT_ONCE))
        last = len(part) < WORDS_AT_ONCE
        at = np.fromiter(map(re.Match.start, part), np.int64, len(part))
        new = np.searchsorted(starts, at, side="right") - 1
        words += map(re.Match.group, part)
        doc = np.concatenate([doc, new])
        # The last longest - 1 words begin no n-gram before the next part is there.
        begin = len(words) if last else len(words) - (longest - 1)
        docs, hashes = [], []
        crc = list(map(crc32, words))
        for k in range(1, longest + 1):
            if k > 1:
                crc = [crc32(word, crc32(b" ", c)) for word, c in zip(words[k - 1:], crc)]
            m = max(0, min(begin, len(words) - k + 1))
            own = doc[:m] == doc[k - 1:k - 1 + m]
            docs.append(doc[:m][own])
            hashes.append(np.fromiter(crc[:m], np.int64, m)[own])
        yield Features(np.concatenate(docs), np.concatenate(hashes) % buckets, np.bincount(new, minlength=n))
        words, doc = words[begin:], doc[begin:]


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for first, last in runs(offsets):
        yield first, last, data, offsets[first:last + 1]


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all n-grams of a table with a column ``text``; a task sends each bucket once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in _parts(batch.column(0)):
                for part in features(data, offsets, longest, buckets):
                    total += np.bincount(part.bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])
        trim()

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """1000 * ln of how much likelier a bucket is in the target than in the documents, floored.

    Each count is raised by one. Only the counts of the buckets, a fixed number, come to the driver.
    """
    sides = bucket_counts(documents, longest, buckets).withColumn("side", F.lit(0)).unionByName(
        bucket_counts(target, longest, buckets).withColumn("side", F.lit(1)))
    count = np.zeros((2, buckets))
    for row in sides.collect():
        count[row["side"], row["bucket"]] = row["n"]
    s, t = count
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


_WEIGHTED = "doc_id long, n_features long, n_words long, weight long"


def weights(documents: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_features, n_words, weight) per row of (doc_id, text): the floored mean gain of its n-grams, 0 without any."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in _parts(batch.column(1)):
                n = last - first
                total, count, words = (np.zeros(n, np.int64) for _ in range(3))
                for part in features(data, offsets, longest, buckets):
                    # Whole numbers below 2**53: sums of doubles are exact.
                    total += np.bincount(part.doc, gain[part.bucket], n).astype(np.int64)
                    count += np.bincount(part.doc, minlength=n)
                    words += part.words
                mean = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(count), pa.array(words), pa.array(mean)],
                    ["doc_id", "n_features", "n_words", "weight"])
        trim()

    return documents.mapInArrow(weigh, _WEIGHTED)


def gumbel(key: Column) -> Column:
    """Floored 1000-fold Gumbel noise from the first 32 bits of the SHA-256 of ``key``."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
    percent: int = 10,
    least_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rank the documents to draw so that their n-grams resemble those of ``target``.

    Returns doc_id, n_features, weight, score and rank of every document. Score is weight plus Gumbel
    noise, which makes the highest scores a draw without replacement by importance; of N documents with
    ``least_words`` words or more, floor(percent * N / 100) get a rank, 1 for the highest score, equal
    scores by the smaller id.

    Null or empty texts have no words: weight 0, never drawn. A null id counts as an empty one in the noise
    and comes first among equal scores. Repeated rows each get a row, with ranks one after the other. An
    empty table gives no rows; an empty target leaves all to the words the documents have in common. A text
    of any length is worked on in parts of ``WORDS_AT_ONCE`` words. Other columns, and other names for
    them in ``target``, are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    wanted = target.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    noise = gumbel(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    weighed = weights(rows, gains(rows, wanted, longest, buckets), longest)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = F.call_function("div", F.lit(percent) * eligible.agg(F.count("*")).scalar(), F.lit(100).cast("long"))
    ranked = with_positions(eligible.withColumn("_low", -F.col("score")), ["_low", "doc_id"], ties=["weight", "n_features"], name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return ranked.select(*columns).unionByName(rest.select(*columns))
