"""Episode metrics, log verdicts and step metrics over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trajlake.operators.metrics import batch_metrics, trajectory_partials
from trajlake.operators.runlog import FINAL_STEP, verdict_flags, verdict_of


# Triggers after which the log of updates is folded into one table.
COMPACT_EVERY = 32


def stream_trajectory_partials(
    episodes: DataFrame, by: Sequence[str] = ("step",), *, time: str | None = None, length: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """The reducer's mergeable sums on a stream of finished episodes.

    State is one row per batch and exit status, however many episodes pass. With an event ``time`` the
    sums are kept per window of ``length``, and given up once the watermark, ``late`` behind, has passed it.
    """
    if time is None:
        return trajectory_partials(episodes, by)
    timed = episodes.withWatermark(time, late).withColumn("window", F.window(time, length))
    return trajectory_partials(timed, [*by, "window"])


def _folders(spark: SparkSession, path: str) -> list[str]:
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _latest_partials(spark: SparkSession, out: str) -> tuple[DataFrame | None, list[str]]:
    """The newest row of each key in the last folded table and the updates since, and the folders that hold them."""
    # A folded table counts once it is written whole.
    bases = [name for name in _folders(spark, f"{out}/folded") if "_SUCCESS" in _folders(spark, f"{out}/folded/{name}")]
    upto = bases[-1].removeprefix("upto=") if bases else ""
    log = [name for name in _folders(spark, f"{out}/log") if name.removeprefix("batch=") > upto]
    used = [f"{out}/folded/{name}" for name in bases[-1:]] + [f"{out}/log/{name}" for name in log]
    if not used:
        return None, []
    rows = spark.read.parquet(used[0]).withColumn("_version", F.lit(used[0].rsplit("=", 1)[-1]))
    for folder in used[1:]:
        rows = rows.unionByName(spark.read.schema(rows.drop("_version").schema).parquet(folder).withColumn(
            "_version", F.lit(folder.rsplit("=", 1)[-1])))
    sums = [c for c in rows.columns if c == "n" or ":" in c]
    keys = [c for c in rows.columns if c not in (*sums, "_version")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in sums]), "_version").alias("_newest"))
    return newest.select(*keys, *[F.col(f"_newest.`{c}`").alias(c) for c in sums]), used


def stream_trajectory_metrics(
    episodes: DataFrame,
    out: str,
    checkpoint: str,
    by: Sequence[str] = ("step",),
    *,
    compact_every: int = COMPACT_EVERY,
    **window: str,
) -> DataStreamWriter:
    """Keep the sums of all episodes seen in ``out``; ``read_stream_metrics`` gives the batch metrics of them.

    A trigger writes the sums that it changed, in a folder of its own, so a repeated trigger replaces
    itself and the cost of a trigger follows its episodes. Every ``compact_every`` triggers the newest sums
    are folded into one table and the older folders removed. ``window`` options go to
    ``stream_trajectory_partials``.
    """
    def publish(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed.write.mode("overwrite").parquet(f"{out}/log/batch={batch_id:012d}")
        if (batch_id + 1) % compact_every == 0:
            newest, used = _latest_partials(spark, out)
            newest.write.mode("overwrite").parquet(f"{out}/folded/upto={batch_id:012d}")
            for folder in used:
                _remove(spark, folder)

    return (stream_trajectory_partials(episodes, by, **window).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(publish))


def read_stream_metrics(spark: SparkSession, out: str, by: Sequence[str] = ("step",)) -> DataFrame:
    """Exit shares and fixed metrics, as long rows, of all episodes that the stream has taken in."""
    newest, _ = _latest_partials(spark, out)
    if newest is None:
        raise FileNotFoundError(f"no sums of a stream in {out}")
    merged = {c: (F.max if c.startswith("max:") else F.sum)(f"`{c}`") for c in newest.columns if c == "n" or ":" in c}
    return batch_metrics(newest.groupBy(*by, "exit_status").agg(*[expr.alias(c) for c, expr in merged.items()]), by)


def windowed_trajectory_metrics(
    episodes: DataFrame, time: str = "ts", length: str = "60 seconds", late: str = "10 minutes"
) -> DataFrame:
    """Append-mode form: sums per tumbling window, emitted once the watermark passes it."""
    timed = episodes.withWatermark(time, late).withColumn("window", F.window(time, length))
    return trajectory_partials(timed, ("window",))


def append_stream_metrics(long: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append long step metrics, partitioned by run as the batch writer does.

    Below its run a trigger has a folder of its own, so a repeated one replaces itself.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("run", "step", "metric", "value").withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(path)

    return long.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def stream_run_verdict(
    lines: DataFrame, by: Sequence[str] = (), *, line: str = "value", final_step: int = FINAL_STEP
) -> DataFrame:
    """Verdict of a log that is still being written; complete or update mode."""
    seen = lines.groupBy(*by).agg(*verdict_flags(line, final_step))
    return seen.select(*by, "reached", "saved", verdict_of(finished=False).alias("verdict"))
