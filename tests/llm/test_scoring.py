"""Language identification, quality classifier and decontamination."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import decontaminate, language, quality
from trajlake.llm.common import runs

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_held_out_accuracy(spark, table):
    out = language.identify(table).join(table.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert held[0] > 0.985 and held[1] > 2000  # some labels of the table are wrong on purpose
    fold = out.select((F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2).alias("f"), "held_out")
    assert fold.filter("f <> held_out").count() == 0


def test_language_edges(make, odd_rows, spark, table):
    known = table.limit(400).select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang, 1.0) for r in known] + [(100_000 + k, t, None, 1.0) for k, (_, t) in enumerate(odd_rows)]
    rows += [(None, "the end of this", "en", 1.0), (200_000, "123 .;", "en", 1.0), (200_001, "日本", None, 1.0)]
    out = {r.doc_id: r for r in language.identify(make(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert len(out) == len(rows)
    for k, (_, t) in enumerate(odd_rows):
        r = out[100_000 + k]
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert out[200_000].lang_pred == "und" and out[200_000].score == 0 and out[200_001].lang_pred != "und"
    assert not out[None].held_out and set(r.lang_pred for r in out.values()) <= {"de", "en", "es", "fr", "und"}
    nothing = make([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(nothing).collect()] == ["und"]
    assert language.identify(nothing.limit(0)).count() == 0
    one = make([(k, "abc def", "xx") for k in range(8)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(one).collect()} == {"xx"}


@pytest.mark.parametrize("n", [2, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(gaps) >= max(1, code.shape[1] // 4) and (np.abs(code) == 1).all()


def labels(spark):
    rated = spark.read.parquet(f"{SF}/labels.parquet")
    return rated.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def test_quality_on_unseen_ratings(spark, table):
    rated = labels(spark)
    seen = rated.filter(F.xxhash64("doc_id") % 3 != 0)
    model_out = quality.rate_documents(table, seen).join(rated.filter(F.xxhash64("doc_id") % 3 == 0), "doc_id")
    kept = {r.grade: r.kept for r in model_out.groupBy("grade").agg(F.avg(F.col("keep").cast("double")).alias("kept")).collect()}
    assert kept[0] < 0.05 and kept[1] < 0.2 and kept[2] > 0.98
    row = model_out.first()
    assert 0 <= row.p_at_least_2 <= row.p_at_least_1 <= 1
    assert row.expected_grade == pytest.approx(row.p_at_least_1 + row.p_at_least_2)


def test_quality_edges(docs, make, odd_rows):
    ratings = make([(1, 2), (1, 0), (2, None), (None, 1), (6, 1), (11, 2)], "doc_id long, grade int")
    out = quality.rate_documents(docs(odd_rows), ratings)
    assert out.count() == len(odd_rows)
    assert sum(r.doc_id == 6 for r in out.collect()) == 3  # two texts under one id, one of them twice
    kept = quality.keep_good(docs(odd_rows), ratings)
    assert kept.columns == docs(odd_rows).columns and kept.count() == out.filter("keep").count()
    none = quality.rate_documents(docs(odd_rows), ratings.limit(0))
    assert none.select("expected_grade").distinct().count() == 1
    assert quality.rate_documents(docs(odd_rows).limit(0), ratings).count() == 0


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    features = [rng.choice(200, 20, replace=False) for _ in range(1500)]
    truth = rng.normal(size=200)
    score = np.array([truth[f].sum() for f in features])
    grades = np.digitize(score, [-2.0, 2.0])
    model = quality.fit_ordinal(features[:1000], grades[:1000])
    tails = model.tails(np.array([model.weights[f].sum() for f in features[1000:]]))
    assert model.thresholds[0] < model.thresholds[1]
    assert np.mean((tails > 0.5).sum(1) == grades[1000:]) > 0.8


def plain_distance(item, text):
    """Least edit distance of item to any part of text, cell by cell."""
    above = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        row = [i + 1]
        for j, d in enumerate(text):
            row.append(min(above[j] + (c != d), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above)


def test_best_match_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        item = bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 20)))
        text = bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 30)))
        found = decontaminate.best_match(item, text, 100)
        assert (found[0] if found else len(item)) == plain_distance(item, text)


def words(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_leaks(docs, make):
    rng = random.Random(7)
    texts = [words(rng, rng.randint(14, 50)) for _ in range(60)] + ["short one two", "tiny", "", "É ü " + words(rng, 20)]
    items = list(enumerate(texts)) + [(99, None)]
    benchmark = make([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows, want = [], set()
    for k, (i, t) in enumerate(items[:60]):
        edited = list(t)
        for _ in range(int(0.05 * len(t)) if k % 2 else 0):
            edited[rng.randrange(len(edited))] = rng.choice("aeiou")
        rows.append((k, words(rng, 30) + ".\n" + "".join(edited).upper().replace(" ", rng.choice([" ", "  ", "\n"])) + "! " + words(rng, 30)))
        want.add((k, i))
    rows += [(200, "it says: Short, ONE two."), (201, None), (202, ""), (203, words(rng, 4000)), (204, texts[3][:len(texts[3]) // 2]), (None, texts[5])]
    want |= {(200, 60), (None, 5)}
    got = decontaminate.find_leaks(docs(rows), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {w for w in want if w not in found} == set() and found <= want
    for r in got:
        assert r.edit_distance <= 0.1 * r.item_length
    clean = decontaminate.drop_leaks(docs(rows), benchmark)
    assert clean.columns == docs(rows).columns
    assert {r.doc_id for r in clean.collect()} == {201, 202, 203, 204}
    assert decontaminate.find_leaks(docs(rows), benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs(rows).limit(0), benchmark).count() == 0


def test_leaks_in_blocks(docs, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    rng = random.Random(8)
    texts = [words(rng, 25) for _ in range(20)]
    benchmark = make(list(enumerate(texts)), "item_id long, text string")
    got = decontaminate.find_leaks(docs([(i, "so " + t) for i, t in enumerate(texts)]), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(20)}


def test_recall_under_edits(docs, make):
    rng = random.Random(9)
    texts = [words(rng, 40) for _ in range(80)]
    rows = []
    for i, t in enumerate(texts):
        chars = list(t)
        for _ in range(int(0.08 * len(t))):
            p, kind = rng.randrange(len(chars)), rng.random()
            chars[p:p + 1] = [] if kind < 0.3 else [chars[p], "e"] if kind < 0.6 else ["z"]
        rows.append((i, words(rng, 20) + " " + "".join(chars) + " " + words(rng, 20)))
    got = decontaminate.find_leaks(docs(rows), make(list(enumerate(texts)), "item_id long, text string"))
    assert len({(r.doc_id, r.item_id) for r in got.collect()} & {(i, i) for i in range(80)}) >= 0.95 * 80


@pytest.mark.parametrize("size", [9, 13, 19, 34, 40, 66, 72, 80, 90, 120, 159])
def test_short_items_are_all_found_up_to_the_limit(size):
    rng = random.Random(size)
    texts = [words(rng, 60)[:size - 1] + "z" for _ in range(60)]
    rows = []
    for t in texts:
        chars = list(t)
        for _ in range(int(0.1 * size)):
            p, kind = rng.randrange(len(chars)), rng.random()
            chars[p:p + 1] = [] if kind < 0.3 else [chars[p], "e"] if kind < 0.6 else ["z"]
        rows.append(words(rng, 20) + " " + "".join(chars) + " " + words(rng, 20))
    items = decontaminate.index_items(list(range(60)), texts)
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    found = decontaminate.find_items(data, np.append(0, np.cumsum([len(r) for r in rows])), items)
    best = {(row, item): distance for row, item, distance, _ in found}
    lengths = [len(t) for t in items.texts]
    for i in range(60):
        want = plain_distance(items.texts[i].decode(), " ".join(rows[i].split()))
        if want <= int(0.1 * lengths[i]):
            assert best[i, i] == want
    assert sum((i, i) in best for i in range(60)) >= 55


def test_stretches_that_share_a_window_only_are_not_measured(monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, 60) for _ in range(40)]
    # Two fifths of an item stand in a text, too little to be it; the last text holds one whole.
    rows = [words(rng, 40) + " " + t[:2 * len(t) // 5] + " " + words(rng, 40) for t in texts] + [words(rng, 9) + " " + texts[7] + " end"]
    data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.append(0, np.cumsum([len(r) for r in rows]))
    measured, best_match = [], decontaminate.best_match
    monkeypatch.setattr(decontaminate, "best_match", lambda item, *more: measured.append(item) or best_match(item, *more))
    items = decontaminate.index_items(list(range(40)), texts)
    found = decontaminate.find_items(data, offsets, items)
    assert [f[:3] for f in found] == [(40, 7, 0)]
    assert set(measured) == {items.texts[7]}, len(set(measured))


@pytest.mark.parametrize("repetition", range(3))
def test_a_walk_ends_early_but_loses_no_window(repetition):
    rng = random.Random(repetition)
    item, other = words(rng, 300).encode(), words(rng, 3000).encode()
    pad = bytes(decontaminate.STEPS + 1)
    walk = decontaminate.Walk(decontaminate.STEPS, repetition)
    keys, sieves = walk.index(np.frombuffer(item + pad, np.uint8), np.arange(0, len(item) - decontaminate.STEPS, 5))
    text = np.frombuffer(other + item + other + pad, np.uint8)
    every = np.arange(len(text) - len(pad))
    full, _ = walk.index(text, every)
    want = every[np.isin(full, keys)]
    left, key = walk.near(text, every, sieves)
    assert len(want) >= len(keys) and set(want.tolist()) <= set(left.tolist()) and (full[left] == key).all()
    assert len(left) < len(every) / 10


def test_nothing_to_compare():
    some = np.frombuffer(b"one two three, four five", np.uint8)
    for texts in ([], ["", "...", "a"], ["x" * 300]):
        items = decontaminate.index_items(list(range(len(texts))), texts)
        assert decontaminate.find_items(some, np.array([0, 0, 24]), items) == []
        assert decontaminate.find_items(some[:0], np.array([0, 0]), items) == []
        assert decontaminate.find_items(np.frombuffer(b"?! .", np.uint8), np.array([0, 2, 4]), items) == []


def test_a_step_over_texts_stays_small():
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}".encode() for i in range(5000)])
    text = np.frombuffer(b" ".join(words[rng.integers(0, 5000, 800_000)]), np.uint8)
    offsets = np.append(np.arange(0, len(text), 3000), len(text))
    tracemalloc.start()
    for first, last in runs(offsets):
        quality._features(text, offsets[first:last + 1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6, peak
