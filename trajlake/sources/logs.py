"""Plain text: scrapes, run logs and line lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.functions.text import strip_space
from trajlake.operators.grouping import with_positions
from trajlake.operators.runlog import parse_step_lines

# Scrape files are named after their wall-clock second, e.g. 1717171717.25.txt, or lie in a folder that is:
# t=1717171717.25. A folder replica=<name> above names the server.
SCRAPE_TIME = r"([0-9]+(?:\.[0-9]+)?)[^/]*$"
SCRAPE_FOLDER = r"/t=([0-9]+(?:\.[0-9]+)?)/"
SCRAPE_REPLICA = r"/replica=([^/]+)/"


def _scrape_columns(files: DataFrame, by_replica: bool) -> DataFrame:
    path = F.col("_metadata.file_path")
    folder = F.nullif(F.regexp_extract(path, SCRAPE_FOLDER, 1), F.lit(""))
    time = F.coalesce(folder, F.regexp_extract(path, SCRAPE_TIME, 1)).try_cast("double")
    replica = [F.nullif(F.regexp_extract(path, SCRAPE_REPLICA, 1), F.lit("")).alias("replica")] if by_replica else []
    return files.select(*replica, time.alias("t"), F.col("value").alias("text"))


def read_scrapes(spark: SparkSession, path: str, by_replica: bool = False) -> DataFrame:
    """Raw scrapes ``(t, text)``, one file each, with the server's name ``by_replica``."""
    return _scrape_columns(spark.read.text(path, wholetext=True), by_replica)


def stream_scrapes(spark: SparkSession, path: str, max_files: int = 10_000, by_replica: bool = False) -> DataFrame:
    """The same folder as a stream; each new file is one scrape."""
    # As an argument: text() would reset an option of that name.
    files = spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(path, wholetext=True)
    return _scrape_columns(files, by_replica)


def distinct_scrapes(scrapes: DataFrame, keys: Sequence[str] = ("replica", "t"), late: str = "10 minutes") -> DataFrame:
    """One scrape per replica and time, also if a file is delivered again up to ``late`` afterwards.

    On streams the times of the last ``late`` are the state. Scrapes without a readable time are dropped.
    """
    timed = scrapes.filter(F.col("t").isNotNull()).withColumn("_at", F.timestamp_seconds("t"))
    if not scrapes.isStreaming:
        return timed.dropDuplicates(list(keys)).drop("_at")
    return timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(list(keys)).drop("_at")


def missed_ticks(scrapes: DataFrame, interval: float = 1.0, keys: Sequence[str] = ("replica",)) -> DataFrame:
    """``(keys, after, until, missed)``: where a server went without a scrape for more than a tick, and for how many.

    Each scrape meets the next of its server by position, so one server with most of the scrapes stays
    spread over all tasks.
    """
    keys = list(keys)
    times = scrapes.select(*keys, "t").filter(F.col("t").isNotNull()).distinct()
    placed = with_positions(times, "t", keys=keys, name="_at")
    following = placed.select(*[F.col(k).alias(f"_n_{k}") for k in keys], (F.col("_at") - 1).alias("_n_at"), F.col("t").alias("until"))
    on = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys] + [F.col("_at") == F.col("_n_at")]
    missed = F.round((F.col("until") - F.col("t")) / F.lit(interval)).cast("long") - 1
    return placed.join(following, on).select(*keys, F.col("t").alias("after"), "until", missed.alias("missed")).filter("missed > 0")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines in file order: ``file``, ``block`` (split offset), ``seq`` and ``value``.

    ``(file, block, seq)`` orders the lines without a shuffle, as a split's rows are
    numbered in the order they are read.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")


def number_lines(lines: DataFrame) -> DataFrame:
    """1-based line numbers per file from the line counts of the splits before.

    One summary row per split is summed up; the lines themselves are only joined to the
    summary of their split.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
    earlier = (Window.partitionBy("file").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    offsets = blocks.select("file", "block", (F.col("_before") - F.col("_first") + 1).alias("_shift"))
    return lines.join(offsets, ["file", "block"], "inner").select(
        "file", (F.col("seq") + F.col("_shift")).alias("line_no"), "value")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """``(step, metric, value)`` of all step lines."""
    return parse_step_lines(spark.read.text(path))


def read_list(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """Non-blank, stripped lines."""
    lines = spark.read.text(path).select(strip_space(F.col("value")).alias(name))
    return lines.filter(F.col(name) != "")
