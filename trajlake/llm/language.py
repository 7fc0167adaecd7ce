"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; one binary classifier predicts each bit. A text is given the language
whose codeword costs least, each bit's loss weighted by how well its classifier separates the languages,
and is flagged when the second codeword costs almost as little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import binary_array, id_and_text, mix, runs, text_buffers

BITS = 11
# Texts per language that the classifiers are fitted on, at most: those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 700
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32  # digits, marks and white space part words and tell nothing
_FOLD[91:97] = 32
_FOLD[123:128] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed bigrams and trigrams of bytes, scaled to length 1; a row per text.

    Runs of other than letters count as one blank's worth of n-grams: n-grams of blanks alone are left out.
    """
    n = len(offsets) - 1
    at = offsets - offsets[0]
    text = _FOLD[data[offsets[0]:offsets[-1]]].astype(np.uint64)
    lengths = np.diff(at)
    out = np.zeros(n << BITS)
    row = np.repeat(np.arange(n, dtype=np.int64), lengths)
    for size, seed in ((2, 1), (3, 2)):
        if len(text) < size:
            continue
        gram = text[:len(text) - size + 1].copy()
        for k in range(1, size):
            gram = (gram << np.uint64(8)) | text[k:len(text) - size + 1 + k]
        own = row[:len(gram)]
        inside = (own == row[size - 1:]) & ~((text[:len(gram)] == 32) & (text[1:len(gram) + 1] == 32))
        slot = (mix(gram, seed) >> np.uint64(64 - BITS)).astype(np.int64)
        out += np.bincount(((own << BITS) | slot)[inside], minlength=n << BITS)
    out = np.sqrt(out.reshape(n, 1 << BITS))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter; only rows without an ASCII letter are decoded."""
    at = offsets - offsets[0]
    upto = np.zeros(at[-1] + 1, np.int64)
    text = data[offsets[0]:offsets[-1]]
    np.cumsum(_LETTER[text], out=upto[1:])
    out = upto[at[1:]] > upto[at[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in text[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """An n-row code of +-1 bits: all two-way splits of up to six languages, else the random code of
    10 log2 n bits whose closest rows are farthest apart among 200 drawn."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, -1.0, 1.0)
    width, rng, best, best_gap = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        gap = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if gap > best_gap and (np.abs(code.sum(0)) < n).all():
            best, best_gap = code, gap
    return best if best is not None else np.where(np.eye(n) > 0, 1.0, -1.0)


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text to each codeword."""
        margin = x @ self.weights + self.bias
        loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -30, 30)))
        return (loss * self.trust[None]).sum(2)


def fit_code(x: np.ndarray, y: np.ndarray, languages: list[str], *, steps: int = 250, rate: float = 0.3,
             penalty: float = 1e-5, sharpness: float = 8.0) -> CodeModel:
    """Logistic classifiers of all code bits at once (Adam on the whole sample), languages weighted alike."""
    code = codewords(len(languages))
    bits = code.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) > 1:
        target = code[y].astype(np.float32)
        share = (1 / (len(languages) * np.bincount(y, minlength=len(languages))[y])).astype(np.float32)[:, None]
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
        for t in range(1, steps + 1):
            g = -share * target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
            for p, grad, m, v in ((w, x.T @ g + penalty * w, state[0], state[1]), (b, g.sum(0), state[2], state[3])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad ** 2 - v)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        right = ((x @ w + b) * target) > 0
        trust = np.stack([right[y == k].mean(0) for k in range(len(languages))]) ** sharpness + 1e-6
    else:
        trust = np.ones_like(code)
    return CodeModel(languages, code, w, b, trust / trust.sum(1, keepdims=True))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_per_language: int = SAMPLE_PER_LANGUAGE) -> CodeModel:
    """Fit on the texts of ``docs`` with a label: at most ``sample_per_language`` of each language.

    Sampled are those with the smallest hash of their id, so the sample does not depend on file order.
    Spark cuts each task's rows to the limit before the shuffle, so a frequent language stays small.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull())
    # Which rows are taken is settled on ids alone; texts join afterwards. Of rows that share id and
    # language one takes part: that with the smallest text.
    picked = (rows.select("doc_id", "lang").distinct().withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
        .filter(F.col("rank") <= sample_per_language).select("doc_id", "lang"))
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select(
        "lang", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in runs(offsets):
                x = _profiles(data, offsets[first:last + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], binary_array(x.astype(np.float16).ravel(), np.arange(last - first + 1) * (2 << BITS))],
                    ["lang", "profile"])

    found = sample.mapInArrow(task, "lang string, profile binary").toArrow()
    labels = found.column("lang").to_pylist()
    languages = sorted(set(labels))
    x = np.frombuffer(b"".join(found.column("profile").to_pylist()), np.float16).reshape(-1, 1 << BITS).astype(np.float32)
    return fit_code(x, np.array([languages.index(v) for v in labels], np.int64), languages)


def predict(docs: DataFrame, model: CodeModel, *, id_col: str = "doc_id", text_col: str = "text",
            ambiguous_below: float = 0.6) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1, of all languages' scores the largest), ambiguous, for every row.

    Null text, and text without a letter: ``und`` with score 0. Without a learned language the same.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for first, last in runs(offsets):
                rows = offsets[first:last + 1]
                known = _has_letter(data, rows) & bool(model.languages)
                names, score = np.full(last - first, UNKNOWN, object), np.zeros(last - first)
                if model.languages:
                    odds = np.exp(-8 * model.costs(_profiles(data, rows)).astype(np.float64))
                    odds /= odds.sum(1, keepdims=True)
                    names[known] = np.array(model.languages, object)[odds.argmax(1)[known]]
                    score[known] = odds.max(1)[known]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(names, pa.string()), pa.array(score), pa.array(score < ambiguous_below)],
                    ["doc_id", "lang_pred", "score", "ambiguous"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        task, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Learn from all folds but one and predict every document.

    The fold of a document is crc32 of its doc_id as text modulo ``folds``; ``held_out`` marks the fold
    that is not learned from. A null doc_id belongs to no fold: it is not learned from and not held out.
    Repeated rows are predicted alike. An empty table gives no rows; other columns are ignored.
    """
    fold = F.crc32(F.encode(F.col(id_col).cast("long").cast("string"), "utf-8")) % folds
    model = fit(docs.filter(fold != held_fold), id_col=id_col, text_col=text_col, lang_col=lang_col)
    of_id = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % folds
    return predict(docs, model, id_col=id_col, text_col=text_col).withColumn(
        "held_out", F.coalesce(of_id == held_fold, F.lit(False)))
