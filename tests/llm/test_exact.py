from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trajlake.llm import exact
from trajlake.llm.common import work_path

DIGESTS = {"sha256": exact.sha256, "weak": lambda t: (F.crc32(F.encode(t, "utf-8")) % 3).cast("string")}


def classes(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[t or ""].append(i)
    return out


def landed(spark, docs, rows, files=4):
    path = work_path(spark, "test-docs")
    docs(rows).repartition(files).write.parquet(path)
    return path


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("limit", [1, 10 ** 9])
def test_classes(spark, docs, odd_rows, digest, limit, monkeypatch):
    """Also when different texts share a digest, in several triggers, and beyond the broadcast limit."""
    monkeypatch.setattr(exact, "BROADCAST_ROWS", limit)
    path = landed(spark, docs, odd_rows)
    got = exact.deduplicate(spark, path, digest=DIGESTS[digest], files_per_trigger=1).collect()
    want = classes(odd_rows)
    size = {t: len(v) for t, v in want.items()}
    best = {t: max((i for i in v if i is not None), default=None) for t, v in want.items()}
    assert len(got) == len(odd_rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == sorted(
        ((i, best[t or ""], size[t or ""]) for i, t in odd_rows), key=repr)
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_state_goes_on(spark, docs):
    """A second run of the same checkpoint takes only the new files, and knows the old ones."""
    rows = [(i, f"text {i % 5}") for i in range(20)]
    path = landed(spark, docs, rows, 2)
    schema, log, checkpoint = spark.read.parquet(path).schema, work_path(spark, "test-log"), work_path(spark, "test-state")
    exact.stream_digests(spark, path, schema, checkpoint=checkpoint, log=log)
    docs([(100, "text 1"), (101, "new")]).write.mode("append").parquet(path)
    exact.stream_digests(spark, path, schema, checkpoint=checkpoint, log=log)
    last = spark.read.parquet(log).filter("trigger = (select 1)").select("digest", "place.doc_id", "group_size").collect()
    digest = lambda t: spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0]
    assert {tuple(r) for r in last} == {(digest("text 1"), 100, 5), (digest("new"), 101, 1)}
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", None) in (None, "false")


def test_keep_one_and_empty(spark, docs, odd_rows):
    path = landed(spark, docs, odd_rows)
    kept = exact.keep_one(spark, path)
    assert kept.columns == spark.read.parquet(path).columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(classes(odd_rows))
    empty = landed(spark, docs, [(1, "x")], 1)
    spark.read.parquet(empty).limit(0).write.mode("append").parquet(work_path(spark, "unused"))
    nothing = work_path(spark, "test-none")
    docs([(1, "x")]).limit(0).write.parquet(nothing)
    assert exact.deduplicate(spark, nothing).count() == 0


def test_columns_named_like_the_locator(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, "a", "f", 5, "m"), (2, "a", "g", 6, "n"), (3, None, "h", 7, "o")]
    spark.createDataFrame(rows, "doc_id long, text string, _file string, _row long, _metadata string").write.parquet(path)
    assert sorted((r.doc_id, r.keep_id) for r in exact.deduplicate(spark, path).collect()) == [(1, 2), (2, 2), (3, 3)]
    kept = exact.keep_one(spark, path)
    assert kept.columns == ["doc_id", "text", "_file", "_row", "_metadata"] and sorted(map(tuple, kept.collect())) == rows[1:]
