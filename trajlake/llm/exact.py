"""Exact deduplication on a stream: keyed state on disk that never expires, full bytes compared on hits.

The stream keeps one state row per digest in RocksDB: the digest, the identifier of the row that stays,
its content locator (file and row in it) and the number of rows seen. Spark combines the rows of a
digest within each task before the shuffle, so a digest that holds a third of all rows costs one state
update per task. A digest seen more than once is a hit: the texts of its rows are then compared byte by
byte, and a digest that two different texts share is settled by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.common import work_path

# Rows of one group are spread over this many keys where they are joined.
SALTS = 16
# Digests or row locators up to this number are broadcast (under 32 MB); beyond it, they are joined by shuffle.
BROADCAST_ROWS = 200_000

STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # No space is set aside before it is used: each partition of the state has files of its own.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(table: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest, text and the row's order of preference: doc_id (null last), then its locator."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lies = table.metadataColumn("_metadata")  # also where a column of the table has that name
    return table.select(
        digest(text).alias("digest"), text.alias("text"),
        F.struct(F.col(id_col).cast("long").alias("doc_id"), lies["file_path"].alias("file"), lies["row_index"].alias("row")).alias("place"))


def stream_digests(spark: SparkSession, path: str, schema, *, checkpoint: str, log: str, id_col: str = "doc_id",
                   text_col: str = "text", digest: Callable[[Column], Column] = sha256,
                   files_per_trigger: int = 2000) -> None:
    """Run the stream over all Parquet files at ``path`` that it has not seen yet.

    Each trigger writes the state rows that it changed to its own folder of ``log``; a trigger that is
    repeated after a failure replaces them. The same ``checkpoint`` goes on where an earlier run ended.
    """
    # A pattern, as a file source takes a single file only under one.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path[:-1] + f"[{path[-1]}]")
    state = _rows(source, id_col, text_col, digest).groupBy("digest").agg(
        F.max("place").alias("place"), F.count("*").alias("group_size"))

    def write(changed: DataFrame, trigger: int) -> None:
        changed.write.mode("overwrite").parquet(f"{log}/trigger={trigger}")

    with _settings(spark, STATE):
        (state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], n: int, spread: Column, how: str) -> DataFrame:
    """Join groups to their rows: broadcast if few, else by shuffle with the rows of a group spread over SALTS keys."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys, how)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(
        salted, [*keys, "_salt"], how).drop("_salt")


def deduplicate(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, files_per_trigger: int = 2000) -> DataFrame:
    """Classes of equal texts over the Parquet files at ``path``, one row per row read.

    Columns: doc_id, keep_id, group_size, kept, digest, and the row's locator (file, row). Of equal texts
    the row with the largest doc_id stays; a null doc_id comes after all others, and of rows with one
    doc_id the last by file and row stays, so exactly one row of a class is kept. Null counts as the
    empty text. keep_id is null if all ids of a class are. An empty table gives no rows.
    """
    schema = spark.read.parquet(path).schema
    log, checkpoint = work_path(spark, "op4-log"), work_path(spark, "op4-state")
    stream_digests(spark, path, schema, checkpoint=checkpoint, log=log, id_col=id_col, text_col=text_col, digest=digest,
                   files_per_trigger=files_per_trigger)
    rows = _rows(spark.read.schema(schema).parquet(path), id_col, text_col, digest)
    changes = "digest string, place struct<doc_id: long, file: string, row: long>, group_size long"
    try:
        state = spark.read.schema(changes).parquet(log)
    except AnalysisException as error:  # a stream without files never wrote
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        state = spark.createDataFrame([], changes)
    hits = (state.groupBy("digest").agg(F.max("group_size").alias("group_size"))
            .filter(F.col("group_size") > 1).select("digest"))
    n = hits.count()
    # Full bytes: one row per digest and text, combined within tasks first.
    classes = (_joined(rows, hits, ["digest"], n, F.col("place"), "inner").groupBy("digest", "text")
               .agg(F.max("place").alias("keep"), F.count("*").alias("group_size")))
    per_digest = classes.groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))
    path_out = work_path(spark, "op4-classes")
    per_digest.write.parquet(path_out)
    per_digest = spark.read.schema(per_digest.schema).parquet(path_out)
    narrow = rows.select("digest", "place")
    single = per_digest.filter(F.col("texts") == 1).select("digest", "keep", "group_size")
    found = _joined(narrow, single, ["digest"], n, F.col("place"), "left")
    shared = per_digest.filter(F.col("texts") > 1).select("digest")
    if shared.limit(1).count():  # different texts under one digest
        open_rows = rows.join(shared, "digest", "left_semi")
        settled = open_rows.join(classes.join(shared, "digest", "left_semi"), ["digest", "text"]).select(
            "digest", "place", "keep", "group_size")
        found = found.join(shared, "digest", "left_anti").unionByName(settled)
    keep = F.coalesce("keep", "place")
    return found.select(
        F.col("place.doc_id").alias("doc_id"), keep["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("place")).alias("kept"), "digest",
        F.col("place.file").alias("file"), F.col("place.row").alias("row"))


def keep_one(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of the Parquet files at ``path`` that stay, with all their columns."""
    table = spark.read.parquet(path)
    gone = deduplicate(spark, path, **options).filter(~F.col("kept")).select("file", "row")
    out = work_path(spark, "op4-gone")
    gone.write.parquet(out)
    gone = spark.read.schema("file string, row long").parquet(out)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    # The table's own columns, whatever their names, stay in a struct of theirs.
    lies = table.metadataColumn("_metadata")
    rows = table.select(F.struct(*[table[f"`{c}`"] for c in table.columns]).alias("own"), lies["file_path"].alias("file"), lies["row_index"].alias("row"))
    return rows.join(gone, ["file", "row"], "left_anti").select("own.*")
