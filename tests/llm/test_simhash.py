"""SimHash links and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trajlake.llm import common, graph, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, distance=3):
    """Smallest id that each (id, fingerprint) reaches."""
    label = list(range(len(items)))
    fps = np.array([fp for _, fp in items], np.uint64)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(items)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(items):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(items))]


def test_near_duplicates_equal_all_pairs(docs, odd_rows):
    rng = random.Random(2)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(400)]
    near = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(400)] = "changed"
        near.append((1000 - i, " ".join(words)))
    rows = odd_rows + near
    out = simhash.near_duplicates(docs(rows)).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id")
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{fp:016x}", c) for (i, _), fp, c in zip(rows, fps, plain_components([(i, fp) for (i, _), fp in zip(rows, fps)]))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def made_fingerprints(seed, n=60):
    """Chains and clouds of near fingerprints, also with the sign bit, among random ones."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(n):
            x = center
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
            if rng.random() < 0.3:
                center = x
    return sorted(out | {rng.getrandbits(64) for _ in range(200)})


@pytest.mark.parametrize("parts,block", [(4, 1024), (5, 3), (6, 7), (8, 1), (12, 2), (None, 5)])
def test_no_link_is_lost_whatever_the_grid_and_blocks(make, parts, block):
    fps = made_fingerprints(parts or 1)
    table = make([(simhash._signed(x),) for x in fps], "fp long")
    links = simhash.fingerprint_links(table, parts=parts, block=block).collect()
    want = plain_components(list(enumerate(fps)))
    at = {simhash._signed(x): i for i, x in enumerate(fps)}
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        a, b = find(at[r.a]), find(at[r.b])
        label[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want


def test_manhattan_distance_bounds_hamming_distance(spark, make):
    fps = made_fingerprints(9, 10)[:80]
    table = make([(simhash._signed(x),) for x in fps], "fp long")
    got = {r.fp: r.e & (1 << 64) - 1 for r in table.select("fp", simhash.embedding(F.col("fp")).alias("e")).collect()}
    coordinates = lambda x: [x >> 2 * c & 3 for c in range(32)]
    for x in fps:
        assert coordinates(got[simhash._signed(x)]) == [(x >> 2 * c & 3).bit_count() for c in range(32)]
    for x in fps[:30]:
        for y in fps:
            e, f = (coordinates(got[simhash._signed(v)]) for v in (x, y))
            assert sum(abs(a - b) for a, b in zip(e, f)) <= (x ^ y).bit_count()


def test_parts_grow_with_the_number_of_fingerprints():
    assert [simhash.parts_for(n) for n in (10, 10**5, 10**7, 10**9)] == sorted(simhash.parts_for(n) for n in (10, 10**5, 10**7, 10**9))
    assert simhash.parts_for(10**15) == simhash.MOST_PARTS


def test_shingles_in_parts(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(300))
    raw = text.encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    want = plain_fingerprint(text)
    for size in (1, 7, 1 << 17):
        monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", size)
        assert int(simhash.fingerprints(data, offsets)[0]) == want


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []


def test_cells_are_not_broadcast(make):
    """A fingerprint has ten cells or more, which Spark takes for one: the table read is far smaller than the side of the join."""
    fps = made_fingerprints(3)
    table = common.stored(make([(simhash._signed(x),) for x in fps], "fp long"), "test-fingerprints")
    links = simhash.fingerprint_links(table, parts=5)
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"Broadcast(HashJoin|Exchange)[^\n]*(cell|grid)", plan), plan


def test_many_links_are_not_broadcast(make, monkeypatch):
    """The smallest neighbours are repeated for each salt, which Spark does not count."""
    plans, stored = [], graph.stored

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", kept)
    links = [(i, i + 1) for i in range(8000)]
    random.Random(4).shuffle(links)
    got = graph.components(make(links, "a long, b long").repartition(7)).collect()
    assert {(r.node, r.label) for r in got} == {(i, 0) for i in range(8001)}
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
