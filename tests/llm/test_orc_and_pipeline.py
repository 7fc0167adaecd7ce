import re
import struct
import zlib

import pyarrow.orc as po
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard import shingles
from tests.llm.test_packing import ids_of
from trajlake.llm import orc
from trajlake.llm.common import work_path
from trajlake.llm.tokens import public_tokenizer

WORD_BPE = public_tokenizer("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def test_round_trip(spark, docs, odd_rows):
    path = work_path(spark, "test-orc")
    got = orc.encode_to_orc(docs(odd_rows).repartition(3), path, WORD_BPE).orderBy("start").collect()
    assert len(got) == len(odd_rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    want = sorted(((i, ids_of(WORD_BPE, t)) for i, t in odd_rows), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == want
    crc = {(r.start, r.ids_crc32) for r in orc.with_crc32(orc.read_tokens(spark, path)).collect()}
    assert crc == {(r.start, zlib.crc32(struct.pack(f"<{r.n_tokens}I", *r.ids))) for r in got}
    some = orc.read_tokens(spark, path, [6, 12])
    assert sorted((r.doc_id, r.start) for r in some.collect()) == sorted((r.doc_id, r.start) for r in got if r.doc_id in (6, 12))
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the scan of a plan without exchanges gave out, before any filter."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_files_have_indexes_and_stripes(spark, docs, tmp_path):
    rows = docs([(i, f"text number {i} " * 50) for i in range(400)])
    path = str(tmp_path / "orc")
    orc.write_tokens(orc.encode_documents(rows, WORD_BPE, end_id=2), path, stripe_bytes=1 << 14, index_rows=1000)
    files = [po.ORCFile(p) for p in sorted((tmp_path / "orc").glob("*.orc"))]
    assert sum(f.nrows for f in files) == 400
    assert all(f.row_index_stride == 1000 for f in files if f.nrows)
    first = [f.read(["doc_id"]).column(0).to_pylist() for f in files if f.nrows]
    assert sorted(first) == first or [x[0] for x in first] == sorted(x[0] for x in first)
    # An id that lies between others passes the statistics; the Bloom filters rule it out, and no row is read.
    gaps = str(tmp_path / "even")
    orc.write_tokens(orc.encode_documents(docs([(2 * i, f"text {i} " * 50) for i in range(4000)]), WORD_BPE, end_id=2), gaps, index_rows=1000)
    lookup = lambda i: spark.read.schema(orc.SCHEMA).orc(gaps).filter(F.col("doc_id") == i)
    assert rows_read(lookup(4001)) == 0 and 1 <= rows_read(lookup(4002)) <= 1000


def test_empty_table(spark, docs):
    assert orc.encode_to_orc(docs([(1, "x")]).limit(0), work_path(spark, "test-orc"), WORD_BPE).count() == 0


def test_stages_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    items = [re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", r.text.lower()).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns, name
        path = work_path(spark, "test-stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and after, name
        kept.append((name, before, after))
    (_, all_, good), (_, b1, a1), (_, b2, a2), (_, b3, a3) = kept
    assert len(good) > 0.7 * len(all_)
    assert a1 == {max(i for i in b1 if b1[i] == t): t for t in set(b1.values())}
    gone = set(b2) - set(a2)
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y) > 0
    sets = {i: shingles(t, 5) for i, t in b2.items()}
    assert not any(near(sets[i], sets[j]) for i in a2 for j in a2 if i < j)
    assert all(any(near(sets[i], sets[j]) for j in b2 if j != i) for i in gone)
    norm = {i: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", t.lower()) for i, t in b3.items()}
    leaks = {i for i, t in norm.items() if any(x in t for x in items if len(x) > 20)}
    assert set(b3) - set(a3) == leaks
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(a3)
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in sizes) <= 1024
    total = sum(r.n for r in sizes)
    assert len(sizes) <= -(-total // 1024) + 2


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
