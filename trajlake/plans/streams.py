"""The streaming jobs, each run over a whole table until its input is used up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.operators import servermon as sm
from trajlake.plans.catalog import query, rounded, table
from trajlake.plans.episodes import states_sql
from trajlake.plans.metrics import ALL_METRICS_SQL, episodes
from trajlake.plans.server import DRAIN_COLUMNS, DRAIN_SQL, LATENCY_COLUMNS, LATENCY_SQL, samples
from trajlake.plans.sources import SCRAPES_SQL, scrape_files, work_folder
from trajlake.session import DEFAULTS
from trajlake.sources import logs
from trajlake.streaming.episodes import stream_episodes
from trajlake.streaming.metrics import read_stream_metrics, stream_run_verdict, stream_trajectory_metrics
from trajlake.streaming.server import stream_server_summary
from trajlake.streaming.state import PROVIDER


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files."""
    # A pattern, as a file source takes a single file only under one.
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for sessions that are not of ``build_session``."""
    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, DEFAULTS[PROVIDER])
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if held is None else spark.conf.set(PROVIDER, held)


def _run(writer) -> None:
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()


@query("stream_trajectory_metrics", ALL_METRICS_SQL)
def streamed_metrics(spark, sf):
    """All metrics and exit shares, from episodes that arrive in several files, with a fold of the sums in between."""
    folder = work_folder(spark)
    episodes(spark, sf).repartition(6).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", "2").parquet(f"{folder}/in")
    _run(stream_trajectory_metrics(arriving, f"{folder}/out", f"{folder}/checkpoint", compact_every=2))
    return rounded(read_stream_metrics(spark, f"{folder}/out"))


@query("stream_windowed_metrics", """
WITH o AS (SELECT strftime(o_orderdate, '%Y') AS step, o_orderpriority, o_totalprice FROM orders),
c AS (SELECT step, o_orderpriority, count(*) AS n FROM o GROUP BY 1, 2)
SELECT step, 'traj/exit/' || o_orderpriority AS metric, round(n / sum(n) OVER (PARTITION BY step), 6) AS value FROM c
UNION ALL SELECT step, 'latency/mean_trajectory_s', round(avg(o_totalprice), 6) FROM o GROUP BY 1
UNION ALL SELECT step, 'latency/max_trajectory_s', max(o_totalprice) FROM o GROUP BY 1""")
def streamed_windows(spark, sf):
    """Sums per thirty days of event time, whose state is given up behind the watermark."""
    orders = _stream(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy").alias("step"), F.col("o_orderpriority").alias("exit_status"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("total_trajectory_time"))
    folder = work_folder(spark)
    _run(stream_trajectory_metrics(orders, f"{folder}/out", f"{folder}/checkpoint", time="ts", length="30 days", late="1 day"))
    long = read_stream_metrics(spark, f"{folder}/out")
    shown = F.col("metric").startswith("traj/exit/") | F.col("metric").isin("latency/mean_trajectory_s", "latency/max_trajectory_s")
    return rounded(long.filter(shown))


@query("stream_scrapes", f"""
WITH {SCRAPES_SQL}
SELECT replica, day * 86400.0::DOUBLE AS t, n + 1.0::DOUBLE AS running, top * 1.0::DOUBLE AS requests FROM scrapes""")
def streamed_scrapes(spark, sf):
    """Scrape files of three servers, some delivered twice."""
    arriving = logs.stream_scrapes(spark, scrape_files(spark, sf), by_replica=True)
    samples = sm.gauges(sm.to_samples(logs.distinct_scrapes(arriving, late="40 days"), ["replica", "t"]))
    folder = work_folder(spark)
    _run(samples.select("replica", "t", "running", F.col("num_requests_total").alias("requests")).writeStream.format("parquet")
         .outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out")


@query("stream_server_summary", f"""
WITH {DRAIN_SQL}, {LATENCY_SQL}
SELECT d.step, {DRAIN_COLUMNS}, {LATENCY_COLUMNS} FROM drain d LEFT JOIN lat l ON d.step = l.step""".replace(
    "strftime(ts, '%Y-%m-%d') AS step", "epoch_us(ts) // 86400000000 AS step"))
def streamed_summary(spark, sf):
    """Samples in files that overlap in time; one long after the last step lets the watermark pass it."""
    day = F.floor(F.col("t") / 86400)
    whole = samples(spark, sf).drop("step")
    steps = whole.select(day.alias("step")).distinct().select(
        "step", (F.col("step") * 86400.0).alias("t_start"), ((F.col("step") + 1) * 86400.0).alias("t_end"))
    folder = work_folder(spark)
    after = whole.agg(F.max("t").alias("t")).select((F.col("t") + 10 * 86400).alias("t"))
    closing = after.select("t", *[F.lit(0.0).alias(c) for c in whole.columns if c != "t"]).select(*whole.columns)
    whole.repartition(4).write.parquet(f"{folder}/in")
    closing.write.mode("append").parquet(f"{folder}/in")
    later = steps.unionByName(closing.select(F.lit(-1).cast("long").alias("step"), F.col("t").alias("t_start"), (F.col("t") + 1).alias("t_end")))
    arriving = spark.readStream.schema(whole.schema).parquet(f"{folder}/in")
    with rocksdb(spark):
        _run(stream_server_summary(arriving, later, parsed=True).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out"))
    return rounded(spark.read.parquet(f"{folder}/out"), 3)


@query("stream_run_verdict", """
SELECT lang AS run, bool_or(doc_id % 40 = 0) AS reached, bool_or(doc_id % 3 = 0) AS saved,
       CASE WHEN bool_or(doc_id % 40 = 0) AND bool_or(doc_id % 3 = 0) THEN 'SUCCESS' ELSE 'RUNNING' END AS verdict
FROM documents GROUP BY 1""")
def streamed_verdict(spark, sf):
    line = F.concat(
        F.when(F.col("doc_id") % 40 == 0, F.lit("global_step_6")).otherwise(F.lit("global_step_5")),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" saved")).otherwise(F.lit("")))
    lines = _stream(spark, sf, "documents").select(F.col("lang").alias("run"), line.alias("value"))
    folder = work_folder(spark)

    def publish(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    _run(stream_run_verdict(lines, ["run"]).writeStream.outputMode("complete")
         .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(publish))
    return spark.read.parquet(f"{folder}/out")


CONV_LIMITS = {"response_length": 150, "max_errors": 2, "max_turns": 4}
CONV_TURNS_SQL = """
turns AS (
  SELECT conv_id AS trajectory_id, turn + 1 AS turn, len(regexp_extract_all(text, '\\S+')) AS gen_tokens,
         length(text) % 20 AS tool_tokens, CASE WHEN role = 'assistant' THEN 2 ELSE 0 END AS n_calls,
         CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 2 ELSE 0 END AS n_salvaged, role = 'user' AS attempted,
         CASE WHEN length(text) % 5 = 0 THEN 0 END AS submitted_call_idx,
         CASE WHEN length(text) % 31 = 0 THEN 'Timeout' END AS crashed_type
  FROM conversations)"""


@query("stream_episodes", f"""
WITH {states_sql(CONV_TURNS_SQL, *CONV_LIMITS.values())},
live AS (SELECT *, coalesce(phase, 5) AS ph FROM s4 WHERE turn <= end_turn)
SELECT trajectory_id, max(CASE WHEN turn = end_turn THEN status END) AS exit_status,
       count(*) FILTER (ph <> 0 OR gen_tokens > 0) AS num_turns,
       CAST(coalesce(sum(CASE WHEN ph = 3 THEN submitted_call_idx + 1 ELSE n_calls END)
         FILTER (ph NOT IN (0, 1) AND usable), 0) AS BIGINT) AS tool_call_count,
       count(*) FILTER (ph NOT IN (0, 1) AND NOT usable) AS format_errors,
       CAST(coalesce(sum(n_salvaged) FILTER (ph NOT IN (0, 1)), 0) AS BIGINT) AS salvaged_tool_calls
FROM live GROUP BY 1""")
def streamed_episodes(spark, sf):
    """Messages as turns. Episodes that reached their end; the rest wait for their timeout."""
    size, is_call = F.length("text"), F.col("role") == "assistant"
    turns = _stream(spark, sf, "conversations").select(
        F.col("conv_id").alias("trajectory_id"), (F.col("turn") + 1).alias("turn"),
        F.timestamp_seconds(86400 + F.col("conv_id") * 3600 + F.col("turn")).alias("ts"),
        F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("gen_tokens"), (size % 20).cast("long").alias("tool_tokens"),
        F.when(is_call, F.lit(2)).otherwise(F.lit(0)).cast("long").alias("n_calls"),
        F.when(is_call & (F.col("conv_id") % 2 == 0), F.lit(2)).otherwise(F.lit(0)).cast("long").alias("n_salvaged"),
        (F.col("role") == "user").alias("attempted"), F.when(size % 5 == 0, F.lit(0)).alias("submitted_call_idx"),
        F.when(size % 31 == 0, F.lit("Timeout")).alias("crashed_type"))
    folder = work_folder(spark)
    with rocksdb(spark):
        _run(stream_episodes(turns, **CONV_LIMITS).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").filter(F.col("exit_status") != "IncompleteRollout").select(
        "trajectory_id", "exit_status", "num_turns", "tool_call_count", "format_errors", "salvaged_tool_calls")
