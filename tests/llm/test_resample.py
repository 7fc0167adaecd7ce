"""Importance resampling against a plain reading of its rules."""

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pytest

from trajlake.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, longest, buckets, percent, least):
    count = {0: [0] * buckets, 1: [0] * buckets}
    for side, texts in ((0, [t for _, t in docs]), (1, target)):
        for text in texts:
            for g in grams(text, longest)[1]:
                count[side][crc32(g.encode()) % buckets] += 1
    s, t = count[0], count[1]
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, own = grams(text, longest)
        weight = sum(gain[crc32(g.encode()) % buckets] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = percent * len(able) // 100
    ranked = [(*r[:4], n if n <= drawn else None) for n, r in enumerate(able, 1)]
    return sorted(ranked + [(*r[:4], None) for r in out if r[4] < least], key=repr)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_equals_plain_reading(docs, make, odd_rows, longest):
    target = ["abc fgh abc", "H-g a é ab", "", None]
    goal = make([(t, 1) for t in target], "text string, doc_id long")
    out = resample.resample(docs(odd_rows), goal, longest=longest, buckets=97, percent=40, least_words=5)
    assert sorted(map(tuple, out.collect()), key=repr) == plain(odd_rows, target, longest, 97, 40, 5)


def test_parts_of_a_long_text_lose_no_gram(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, rng.integers(97, 100, 2))) for _ in range(n)) for n in (0, 1, 2, 50, 3, 0, 7)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = sorted((i, crc32(g.encode()) % 1009) for i, t in enumerate(texts) for g in grams(t, 3)[1])
    for size in (1, 2, 3, 4, 5, 63, 1000):
        monkeypatch.setattr(resample, "WORDS_AT_ONCE", size)
        parts = list(resample.features(data, offsets, 3, 1009))
        got = sorted((int(d), int(b)) for p in parts for d, b in zip(p.doc, p.bucket))
        assert got == want
        assert sum(p.words for p in parts).tolist() == [len(t.split()) for t in texts]


def test_empty_tables(docs, make):
    none = make([], "text string")
    assert resample.resample(docs([]), none).collect() == []
    rows = resample.resample(docs([(1, "a b c"), (2, None)]), none, least_words=1, percent=100).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in rows) == [(1, 3, 1), (2, 0, None)]
