"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

One weight vector is shared by all grades; ordered thresholds cut the score into grades. From
P(grade <= k) = logistic(threshold_k - score) follow the expected grade and the tail probability by which
documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import (LOWER_VALUES, binary_array, id_and_text, mix, prefix_hashes, runs, segment_hashes,
                                 spaced, text_buffers, trim, trimmed, word_bounds)

BITS = 18
GRADES = 3
# Rated documents that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 16000

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _upto(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each row: (row, feature), in no order.

    Of each distinct word of a row: the word in lower case without marks at its ends and the first six
    bytes of that. Of each distinct run of marks that ends a word: the run. Of the row: the levels of
    words repeated, words in capitals, words with marks inside or more than one at their end.
    """
    text, starts = spaced(data, offsets)
    s, e = word_bounds(text)
    n = len(starts)
    row = np.searchsorted(starts, s, side="right") - 1
    prefix = prefix_hashes(text, LOWER_VALUES)
    whole = mix(segment_hashes(prefix, s, e))
    words = np.bincount(row, minlength=n)
    top = row.astype(np.uint64) << np.uint64(40)
    _, kept = np.unique(top | (whole >> np.uint64(24)), return_index=True)
    plain, upper, lower = _upto(_ALNUM[text]), _upto(_UPPER[text]), _upto(_LOWER[text])
    solid = plain[e] - plain[s]
    capitals = np.bincount(row, (upper[e] - upper[s] > 1) & (lower[e] == lower[s]), minlength=n)
    distinct = np.bincount(row[kept], minlength=n)
    # From here on once per distinct word. The core of a word is what lies between marks at its ends.
    s, e, row, solid = s[kept], e[kept], row[kept], solid[kept]
    inner = np.flatnonzero(_ALNUM[text])
    core = solid > 0
    cs, ce = s.copy(), s.copy()
    cs[core] = inner[plain[s[core]]]
    ce[core] = inner[plain[e[core]] - 1] + 1
    odd = np.bincount(row, (solid < ce - cs) | (e - ce > 1) | ~core, minlength=n)
    marked = e > ce
    marks = mix(segment_hashes(prefix, ce[marked], e[marked]), 4)
    marks = np.unique((row[marked].astype(np.uint64) << np.uint64(40)) | (marks >> np.uint64(24)))
    rows = [row, row, (marks >> np.uint64(40)).astype(np.int64)]
    feats = [mix(segment_hashes(prefix, cs, ce), 1), mix(segment_hashes(prefix, cs, np.minimum(cs + 6, ce)), 2),
             mix(marks & np.uint64((1 << 40) - 1), 3)]
    for k, (share, of) in enumerate(((distinct, words), (capitals, words), (odd, distinct))):
        level = (8 * share / np.maximum(of, 1)).astype(np.uint64)
        rows.append(np.arange(n))
        feats.append(mix(level + np.uint64(100 * (k + 1)), 6))
    return np.concatenate(rows), (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to GRADES - 1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, *, epochs: int = 12, rate: float = 0.15,
                shrink: float = 2e-3, min_rows: int = 3, batch: int = 64, seed: int = 5) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by AdaGrad over mini-batches, with soft thresholding.

    Features of fewer than ``min_rows`` rows get no weight: they would only tell the rows apart.
    Thresholds stay ordered: the gaps between them are kept positive. Without rows, all scores are 0.
    """
    rows_of = np.zeros(1 << BITS, np.int64)
    for f in features:
        rows_of[np.unique(f)] += 1
    features = [f[rows_of[f] >= min_rows] for f in features]
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    cut, c2 = np.arange(GRADES - 1) * 2.0 - 3.0, np.full(GRADES - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(features) else 0):
        order = rng.permutation(len(features))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            size = np.array([len(features[r]) for r in rows])
            flat = np.concatenate([features[r] for r in rows])
            score, y = np.bincount(np.repeat(np.arange(len(rows)), size), w[flat], minlength=len(rows)), grades[rows]
            # Derivative of -log P(y) = -log(F(cut_y - s) - F(cut_{y-1} - s)) by s and by the cuts.
            bound = np.concatenate([[-1e3], cut, [1e3]])
            z1, z0 = bound[y + 1] - score, bound[y] - score
            f1, f0 = (1 / (1 + np.exp(-np.clip(z, -500, 500))) for z in (z1, z0))
            p = np.maximum(f1 - f0, 1e-9)
            d1, d0 = f1 * (1 - f1) / p, f0 * (1 - f0) / p
            ds = d1 - d0
            grad = np.bincount(flat, np.repeat(ds, size), minlength=1 << BITS)
            hit = np.flatnonzero(grad)
            g2[hit] += grad[hit] ** 2
            step = rate / np.sqrt(g2[hit])
            w[hit] -= step * grad[hit]
            w[hit] = np.sign(w[hit]) * np.maximum(np.abs(w[hit]) - step * shrink * len(rows), 0)
            dc = np.array([d0[y == k + 1].sum() - d1[y == k].sum() for k in range(GRADES - 1)])
            c2 += dc ** 2
            cut = np.maximum.accumulate(cut - rate * dc / np.sqrt(c2) + 1e-3 * np.arange(GRADES - 1))
    return OrdinalModel(w.astype(np.float32), cut)


def _feature_rows(docs: DataFrame) -> DataFrame:
    """Features of (grade, text) rows, as packed 32-bit numbers."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in runs(offsets):
                row, feature = _features(data, offsets[first:last + 1])
                feature = feature[np.argsort(row, kind="stable")]
                at = np.append(0, np.cumsum(np.bincount(row, minlength=last - first))) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], binary_array(feature.astype(np.int32), at)], ["grade", "features"])

    return docs.mapInArrow(trimmed(task), "grade int, features binary")


def fit(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` rated documents; ``ratings`` has (doc_id, grade 0 to GRADES - 1).

    Unrated rows, null grades and ids do not take part; of several ratings the lowest counts. The
    sampled ids are the smallest by hash, so the sample does not depend on file order.
    """
    graded = (ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id")
              .agg(F.min("grade").cast("int").alias("grade")))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rated = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    # Of rows that share a rated id one takes part: that with the smallest text.
    rows = rated.groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")
    found = _feature_rows(rows).toArrow()
    # Views of the gathered table, no copies.
    features = [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("features")]
    model = fit_ordinal(features, found.column("grade").to_numpy().astype(np.int64))
    # The driver lives on: what the fit took goes back to the system.
    del found, features
    trim()
    return model


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2 of each row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in runs(offsets):
                row, feature = _features(data, offsets[first:last + 1])
                tails = model.tails(np.bincount(row, model.weights[feature], minlength=last - first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(tails.sum(1)), *(pa.array(tails[:, k]) for k in range(GRADES - 1))],
                    ["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        trimmed(task), "doc_id long, expected_grade double, p_at_least_1 double, p_at_least_2 double")


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: toxic, 1: poor, 2: good; null if not rated."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def rate_documents(docs: DataFrame, ratings: DataFrame, *, min_tail: float = 0.5, sample_rows: int = SAMPLE_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected grade and tail probabilities of every document, and whether it is selected.

    ``keep``: P(grade >= 2) is at least ``min_tail``. Null text: empty, scored by the levels of a text
    without words. Repeated rows and null ids are scored like others. Without ratings all documents
    score 0 and pass or fail alike by the starting thresholds. An empty table gives no rows.
    """
    model = fit(docs, ratings, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    return score(docs, model, id_col=id_col, text_col=text_col).withColumn("keep", F.col("p_at_least_2") >= min_tail)


def keep_good(docs: DataFrame, ratings: DataFrame, *, min_tail: float = 0.5, sample_rows: int = SAMPLE_ROWS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``rate_documents`` selects, with all their columns, in one pass over the texts."""
    model = fit(docs, ratings, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            keep = np.zeros(batch.num_rows, bool)
            for first, last in runs(offsets):
                row, feature = _features(data, offsets[first:last + 1])
                tails = model.tails(np.bincount(row, model.weights[feature], minlength=last - first))
                keep[first:last] = tails[:, -1] >= min_tail
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(task), docs.schema)
