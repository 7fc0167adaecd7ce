import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajlake.llm import sharding


def feistel(x, left, right, keys):
    """The permutation on Python integers, from its definition."""
    a, b = divmod(x, 1 << right)
    for mul, add in keys:
        t = (b * mul + add) % sharding.PRIME
        a, b = b, a ^ ((t * t + mul) % sharding.PRIME) % (1 << left)
        left, right = right, left
    return (a << right) + b


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000])
def test_permutation(spark, n):
    rows = sharding.permuted(spark.range(n), "id", n, seed=3)
    got = {r.id: r.permuted for r in rows.collect()}
    assert sorted(got.values()) == list(range(n))
    bits, keys = sharding.half_bits(n), sharding.round_keys(3)
    for i in range(n):
        x = feistel(i, *bits, keys)
        while x >= n:
            x = feistel(x, *bits, keys)
        assert got[i] == x
    other = sharding.permuted(spark.range(n), "id", n, seed=4)
    assert n < 100 or {r.id: r.permuted for r in other.collect()} != got


def test_shards(docs, odd_rows):
    rows = list(odd_rows)
    first = sharding.shard_documents(docs(rows)).collect()
    random.Random(1).shuffle(rows)
    assert Counter(tuple(r) for r in first) == Counter(tuple(r) for r in sharding.shard_documents(docs(rows).repartition(5)).collect())
    counts = Counter(r.shard for r in first)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in first if r.shard == shard) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in first) == want
    assert {r.law for r in first} == {"rows"} and all(r.grown_shard is None for r in first)
    numbers = sorted(first, key=lambda r: r.row_number)
    assert [r.row_number for r in numbers] == list(range(len(rows)))
    ids = [r.doc_id for r in numbers]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_native_and_empty(docs):
    out = sharding.shard_documents(docs([(1, "x")]).limit(0))
    assert out.count() == 0
    plan = sharding.shard_documents(docs([(1, "x"), (2, "y")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sharding.shard_documents(docs([(1, "x")]), shards=3).select(F.max("shard")).first()[0] in (0, 1, 2)
