import random
import re

import numpy as np
import pytest

from trajlake.llm import common, graph, jaccard
from trajlake.llm.graph import components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, percent):
    """All pairs; smallest id per component."""
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least.setdefault(x, []).append(i)
    pick = {x: min((i for i in v if i is not None), default=None) for x, v in least.items()}
    return [(i, len(s), pick[x]) for (i, _), s, x in zip(rows, sets, label)], len(least)


def near_copies(n, words, rng, edits):
    base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = "w" + str(rng.randrange(1000))
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words, percent", [(5, 80), (3, 90), (1, 50)])
@pytest.mark.parametrize("block", [jaccard.BLOCK_TOKENS, 300])
def test_components(docs, odd_rows, words, percent, block):
    rng = random.Random(words)
    texts = near_copies(60, 80, rng, 4) + near_copies(40, 30, rng, 2) + near_copies(20, 6, rng, 1)
    passage = " ".join("p" + str(i) for i in range(60))
    texts += [" ".join("u" + str(rng.randrange(10 ** 6)) for _ in range(60)) + " " + passage for _ in range(30)]
    rows = odd_rows + [(1000 + i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    got = jaccard.near_duplicates(docs(rows).repartition(3), words=words, percent=percent, block_tokens=block).collect()
    want, groups = brute(rows, words, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    # Of each component one row stays; equal rows (three here: two pairs and their text) stay together.
    repeated = sum(rows.count(r) - 1 for r in set(rows) if rows.count(r) > 1)
    assert groups <= sum(r.keep for r in got) <= groups + repeated


def test_unlike_sets_that_share_passages_make_no_large_bundle(docs, monkeypatch):
    """Chains of common passages tie most of a large table; the rows of a bundle's blocks grow with its square."""
    rng = random.Random(8)
    passages = [" ".join(f"p{i}x{j}" for j in range(14)) for i in range(200)]
    texts = [" ".join(rng.sample(passages, 8)) for _ in range(300)] + near_copies(30, 80, rng, 2)
    rows = list(enumerate(texts))
    sizes, blocked = [], jaccard._blocked

    def seen(labelled, percent, block_tokens):
        sizes.extend(r["count"] for r in labelled.groupBy("bundle").count().collect())
        return blocked(labelled, percent, block_tokens)

    monkeypatch.setattr(jaccard, "_blocked", seen)
    got = jaccard.near_duplicates(docs(rows), block_tokens=1500).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 5, 80)[0])
    assert 20 <= max(sizes) <= 40, sorted(sizes)[-5:]


def test_link_sets_compares_what_is_open():
    rng = np.random.default_rng(2)
    sets = [rng.choice(60, rng.integers(1, 30), replace=False).astype(np.uint64) for _ in range(80)]
    side = rng.integers(0, 2, 80)
    for sides in (np.zeros(80, int), side):
        label = np.arange(80)
        for i in range(80):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if (sides.max() == 0 or sides[i] != sides[j]) and 100 * len(a & b) >= 40 * len(a | b):
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
        assert (jaccard.link_sets(sets, sides, 40) == label).all()


def test_components_of_chains_stars_and_nothing(make):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.label for r in components(make(chain, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(make([], "a long, b long")).count() == 0


def test_empty_table(docs):
    out = jaccard.near_duplicates(docs([(1, "x")]).limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "text_hash", "keep"]


def test_a_task_names_one_set_for_all_tokens_of_a_group():
    joined = jaccard._Joined()
    # Tokens 1, 2 and 3 tie the sets 10, 20, 30 and 40 in a chain; token 9 is of set 50 alone.
    joined.add(np.array([1, 1, 2, 2]), np.array([40, 30, 30, 20]))
    joined.add(np.array([3, 3, 9]), np.array([20, 10, 50]))
    rows = joined.rows(1).to_pylist()
    assert {(r["token"], r["a"]) for r in rows if r["token"] is not None} == {(1, 10), (2, 10), (3, 10), (9, 50)}
    assert {(r["a"], r["b"]) for r in rows if r["b"] is not None} == {(20, 10), (30, 10), (40, 10)}


def test_no_task_runs_two_python_steps(docs, monkeypatch):
    """Each Python step of a task is a worker of its own beside the others, in every core of an executor."""
    plans, stored = [], graph.stored

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")))
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", kept)
    rng = random.Random(3)
    rows = list(enumerate(near_copies(60, 80, rng, 4)))
    got = jaccard.near_duplicates(docs(rows), block_tokens=300).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 5, 80)[0])
    assert {name for name, _ in plans} == {"op5-bundles", "op5-links"}
    assert max(steps for _, steps in plans) == 1, plans


def test_a_task_gives_its_memory_back_at_its_end(monkeypatch):
    ends = []
    monkeypatch.setattr(common, "trim", lambda: ends.append(1))
    run = common.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))
    assert next(run) == 2 and not ends
    assert list(run) == [4, 6] and ends == [1]
