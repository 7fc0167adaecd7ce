"""Parquet tables: split shards, prepared rows, step metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.operators.runlog import CSV_FIELD_END, csv_text, matrix_lines


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Shards named ``<split>-*.parquet``, else every Parquet file of the folder."""
    def scan(pattern: str) -> DataFrame | None:
        reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        try:
            return reader.parquet(folder)
        except AnalysisException as exc:
            if exc.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    for pattern in (f"{split}-*.parquet", "*.parquet"):
        found = scan(pattern)
        if found is not None:
            return found
    raise FileNotFoundError(f"no parquet files for split {split!r} in {folder}")


def name_shards(spark: SparkSession, source: str, folder: str, split: str) -> None:
    """Move the Parquet files of a written folder into ``folder`` as ``<split>-00000.parquet`` and so on."""
    files = spark._jvm.org.apache.hadoop.fs
    system = files.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(f.getPath()) for f in system.listStatus(files.Path(source)) if f.getPath().getName().endswith(".parquet"))
    for i, part in enumerate(parts):
        system.rename(files.Path(part), files.Path(f"{folder}/{split}-{i:05d}.parquet"))


def read_instances(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The nested task row of prepared Parquet; only the struct fields used are read."""
    prepared = spark.read.parquet(path)
    if columns is None:
        return prepared.select("extra_info.*")
    return prepared.select(*[F.col(f"extra_info.{c}").alias(c) for c in columns])


SPLITS = ("train", "val")


def write_prepared(df: DataFrame, out: str, split: str = "split") -> None:
    """Write ``<out>/train.parquet`` and ``<out>/val.parquet`` from tagged prepared rows."""
    # One run of the plan writes all splits side by side; their folders then get their names.
    df.filter(F.col(split).isin(*SPLITS)).write.mode("overwrite").partitionBy(split).parquet(f"{out}/_splits")
    files = df.sparkSession._jvm.org.apache.hadoop.fs
    root = files.Path(out)
    system = root.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    for name in SPLITS:
        made, named = files.Path(f"{out}/_splits/{split}={name}"), files.Path(f"{out}/{name}.parquet")
        system.delete(named, True)
        if system.exists(made):
            system.rename(made, named)
        else:  # a split without rows is a table all the same
            df.limit(0).drop(split).write.parquet(f"{out}/{name}.parquet")
    system.delete(files.Path(f"{out}/_splits"), True)


def write_one(df: DataFrame, out: str) -> None:
    """Write a single looked-up row as one file."""
    df.coalesce(1).write.mode("overwrite").parquet(out)


def count_rows(spark: SparkSession, path: str) -> int:
    """Row count; reads no column data."""
    return spark.read.parquet(path).count()


def append_step_metrics(df: DataFrame, path: str) -> None:
    """Append long ``(run, step, metric, value)`` rows, partitioned by run."""
    df.select("run", "step", "metric", "value").write.mode("append").partitionBy("run").parquet(path)


def write_metric_matrix(long: DataFrame, path: str, steps: Sequence[int] | None = None) -> None:
    """CSV ``metric,step_0,...``, metrics in order; a blank cell means not emitted.

    The columns are the steps given, or those that occur, however many and far apart. The part files make up
    the table in the order of their names; the first begins with the header.
    """
    lines = matrix_lines(long, steps).repartitionByRange("rank", "metric").sortWithinPartitions("rank", "metric")
    lines.select("line").write.mode("overwrite").text(path)


def read_metric_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The long ``(step, metric, value)`` rows of a written matrix."""
    lines = spark.read.text(path).select(F.split("value", CSV_FIELD_END, -1).alias("cells"))
    header = lines.filter(F.col("cells")[0] == "metric").select("cells").scalar()
    body = lines.filter(F.col("cells")[0] != "metric").withColumn("names", header)
    cells = body.select(csv_text(F.col("cells")[0]).alias("metric"), F.posexplode(F.arrays_zip(
        F.slice("names", 2, F.size("names")).alias("name"), F.slice("cells", 2, F.size("cells")).alias("cell"))).alias("i", "x"))
    return cells.filter(F.col("x.cell") != "").select(
        F.substring_index("x.name", "_", -1).cast("long").alias("step"), "metric", F.col("x.cell").cast("double").alias("value"))
