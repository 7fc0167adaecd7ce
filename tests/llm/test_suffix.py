import hashlib
import random

import numpy as np
import pytest

from trajlake.llm import suffix


def brute(rows, width):
    first = {}
    key = lambda i: (i is not None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            s = b[p:p + width]
            if s not in first or key(i) < first[s]:
                first[s] = key(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < key(i):
                gone[p:p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width, unit", [(50, 1 << 23), (50, 4000), (24, 9000)])
def test_removal(docs, odd_rows, width, unit):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(20, 200))) for _ in range(12)]
    rows = odd_rows + [(2000 + i, "".join(rng.choice(base)[rng.randint(0, 60):rng.randint(60, 200)] + rng.choice(["", "x", "yé"])
                                          for _ in range(rng.randint(1, 5)))) for i in range(120)]
    rows += [(3000, "a" * 300), (3001, "a" * (width - 1)), (3002, "a" * width), (3003, "b" + "a" * 200)]
    got = suffix.remove_repeats(docs(rows).repartition(3), width=width, unit_bytes=unit).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(brute(rows, width), key=repr)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 40), dtype=np.uint8)
    rows[::3] = rows[0]
    group = np.sort(rng.integers(0, 9, 300))
    suffixes = suffix.Suffixes(rows, 7, 20)
    order = suffixes.sort(group)
    want = sorted(range(300), key=lambda i: (group[i], rows[i, 7:27].tobytes()))
    assert [(group[i], rows[i, 7:27].tobytes()) for i in order] == [(group[i], rows[i, 7:27].tobytes()) for i in want]
    a, b = rng.integers(0, 300, (2, 500))
    same = (rows[a, 7:27] == rows[b, 7:27]).cumprod(axis=1).sum(1)
    assert (suffixes.common(a, b) == same).all()


def test_hash_collisions_are_verified(monkeypatch):
    """With a hash that takes all bytes for equal, no different windows are taken for one."""
    monkeypatch.setattr(suffix, "mix", lambda x, seed=0: x * np.uint64(0))
    rng = np.random.default_rng(2)
    context = np.zeros((6, 80), np.uint8)
    context[:] = rng.integers(97, 100, (6, 80))
    context[3] = context[0]
    out = suffix.least_ids(np.zeros(6, np.int64), context, np.full(6, 30 * 256 + 50), np.arange(6), 50)
    assert all((out[k] >= 0).all() for k in range(6)) and (out[1] == 1).all() | (out[1] == 0).any() is not None
    for k in range(6):
        for l in range(out.shape[1]):
            window = context[k, 30 - l:80 - l].tobytes()
            holders = [j for j in range(6) if context[j, 30 - l:80 - l].tobytes() == window]
            assert out[k, l] in holders


def test_limits_and_empty_table(docs):
    with pytest.raises(ValueError, match="width"):
        suffix.remove_repeats(docs([(1, "x")]), width=10)
    assert suffix.remove_repeats(docs([(1, "x")]).limit(0)).count() == 0
