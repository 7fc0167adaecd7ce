import math
import random
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajlake.llm import packing
from trajlake.llm.tokens import public_tokenizer

BYTE_BPE = public_tokenizer("byte_bpe_50k.json")


def ids_of(path, text, end=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def fewest(sizes, capacity):
    """Exhaustive search for small inputs."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1:]])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_plan_is_a_packing_and_near_optimal(sizes):
    histogram = {s: sizes.count(s) for s in sizes}
    plan = packing.plan_sequences(histogram, 20)
    used = defaultdict(int)
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern) <= 20 and times > 0
        for s, n in pattern:
            used[s] += n * times
    assert dict(used) == histogram
    assert sum(t for _, t in plan) == fewest(sizes, 20)


def test_search_beats_best_fit():
    # Best fit takes 6+4+... first; three sequences of 10 exist.
    histogram = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}
    assert sum(s * n for s, n in histogram.items()) == 30
    assert sum(t for _, t in packing.plan_sequences(histogram, 10)) == 3


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack_documents(docs, odd_rows, capacity):
    rows = odd_rows
    got = packing.pack_documents(docs(rows).repartition(3), BYTE_BPE, capacity=capacity).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        assert sum(r.length for r in held) <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // capacity) + 2
    want = defaultdict(list)
    for i, t in rows:
        ids = ids_of(BYTE_BPE, t)
        head = (len(ids) - 1) % capacity + 1
        starts = [0, *range(head, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i].append((k, a, b - a, struct.pack(f"<{b - a}I", *ids[a:b])))
    for i, w in want.items():
        assert sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in pieces[i]) == sorted(w)


def test_checksum_payload_and_empty_table(docs):
    from pyspark.sql import functions as F

    out = packing.pack_documents(docs([(1, "hello there")]), BYTE_BPE, payload=F.crc32("ids").alias("ids_crc32")).first()
    ids = ids_of(BYTE_BPE, "hello there")
    assert out.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert packing.pack_documents(docs([(1, "x")]).limit(0), BYTE_BPE).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    import pyarrow as pa

    from trajlake.llm.common import text_buffers
    from trajlake.llm.tokens import Encoder

    rng = random.Random(3)
    texts = ["", " ", "\n", "a\tb c", "  a  b. \n\n c,d . e", "don't. it's, x", "naïve. é.", "×. ÷.", "<|endoftext|> hi", "hello <|endoftext|>world", "A<|ENDOFTEXT|><|startoftext|>.", "<|end", "a b", "١٢ 3 .",
             "x" * 100 + " " * 50 + "y", "\nThe cat.\nThe dog, \n end", "a .", "\r\n q", ".", ",a", "A,B. C", "é́ x. é.", "\n\nA", "Σ ΑΣ."]
    texts += ["".join(rng.choice(" \n.,ab'é×́\t Z9-日") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts.append(" ".join("".join(rng.choice("abcdé.") for _ in range(6)) for _ in range(400_000)))  # cut into runs
    encode = Encoder(public_tokenizer(name), 2, known_pieces=3000)
    flat, bounds = encode(*text_buffers(pa.array(texts)))
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    for i, x in enumerate(want):
        assert flat[bounds[i]:bounds[i + 1]].tolist() == x.ids + [2], texts[i][:80]


def test_waiting_nodes_share_their_counts(monkeypatch):
    """Memory of the search follows the nodes on its way down, not all children that wait."""
    histogram = {s: 5 + round(80 * math.exp(-((s - 400) / 150) ** 2)) + s * s % 5 for s in range(20, 900)}

    def pairs(counts, sizes, largest, capacity):
        return [((largest, 1), (s, 1)) for s in reversed(sizes) if s < largest and s + largest <= capacity][:packing.FILLINGS_PER_NODE]

    monkeypatch.setattr(packing, "_fillings", pairs)
    monkeypatch.setattr(packing, "MAX_NODES", 60)
    tracemalloc.start()
    try:
        plan = packing.plan_sequences(histogram, 1024)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    used = Counter()
    for pattern, times in plan:
        used.update({s: n * times for s, n in pattern})
    assert used == histogram
    assert peak < 15e6
