"""Tables written in each stored form and read back through their source."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trajlake.functions import toolcalls as tc
from trajlake.functions.numbers import epoch_seconds
from trajlake.functions.register import register_all
from trajlake.operators import grading as g
from trajlake.operators import servermon as sm
from trajlake.operators import tokens as tk
from trajlake.operators.prep import to_prepared
from trajlake.plans.catalog import WORK_DIRS, query, table
from trajlake.plans.messages import COUNTS_SQL, messages
from trajlake.plans.prep import SPEC_SQL, split_instances
from trajlake.plans.runlog import LONG_SQL, log_lines
from trajlake.plans.server import scrapes
from trajlake.schemas import with_defaults
from trajlake.session import ensure_checkpoint_dir
from trajlake.sources import logs, records, tables


def work_folder(spark: SparkSession) -> str:
    """A fresh folder on the cluster's shared storage."""
    folder = f"{ensure_checkpoint_dir(spark)}/trajlake-{uuid.uuid4().hex}"
    WORK_DIRS.append(folder)
    return folder


@query("source_prepared", f"""
WITH {SPEC_SQL}
SELECT p_partkey AS instance_id, repo, version, CASE WHEN row_idx < 20 THEN 'val' ELSE 'train' END AS split FROM good""")
def source_prepared(spark, sf):
    tagged = split_instances(spark, sf)
    prepared = to_prepared(tagged).withColumn("split", F.col("extra_info.split"))
    folder = work_folder(spark)
    tables.write_prepared(prepared, folder)
    parts = [tables.read_instances(spark, f"{folder}/{name}.parquet", ["instance_id", "repo", "version"]).withColumn(
        "split", F.lit(name)) for name in ("val", "train")]
    return parts[0].unionByName(parts[1])


@query("source_shards", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def source_shards(spark, sf):
    """A split in shards of its own name, next to one that must be left out."""
    folder = work_folder(spark)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.mode("overwrite").parquet(f"{folder}/a")
    orders.limit(5).write.mode("overwrite").parquet(f"{folder}/b")
    tables.name_shards(spark, f"{folder}/a", folder, "train")
    tables.name_shards(spark, f"{folder}/b", folder, "val")
    return tables.read_split(spark, folder, "train").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("source_row_count", "SELECT count(*) AS n FROM lineitem")
def source_row_count(spark, sf):
    return spark.range(1).select(F.lit(tables.count_rows(spark, f"{sf}/lineitem.parquet")).cast("long").alias("n"))


@query("source_split", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def source_split(spark, sf):
    return tables.read_split(spark, f"{sf}/orders.parquet", "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("source_episodes", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS exit_status, md5(text) AS output, 2 AS n_actions,
       CAST(NULL AS VARCHAR) AS first_command
FROM documents""")
def source_episodes(spark, sf):
    none = F.lit(None).cast("string")
    fields = ("turn", "tool", "command", "raw_response", "returncode", "output", "submitted")

    def action(*values):
        return F.struct(*[v.alias(f) for f, v in zip(fields, values)])

    actions = F.array(
        action(F.lit(1), F.lit("<format_error>"), none, F.lit("x"), F.lit(None).cast("int"), none, F.lit(None).cast("boolean")),
        action(F.lit(2), F.lit("bash"), F.lit("ls"), none, F.lit(0), F.col("text"), F.lit(False)))
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("instance_id"),
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("exit_status"), F.lit(0.0).alias("reward"),
        F.lit(2).alias("num_actions"), actions.alias("actions"))
    folder = work_folder(spark)
    records.write_episodes(docs, folder)
    back = records.read_episodes(spark, folder).filter(F.col(records.CORRUPT).isNull())
    return back.select(
        F.col("instance_id").cast("long").alias("doc_id"), "exit_status",
        F.md5(F.col("actions")[1]["output"].cast("binary")).alias("output"), F.size("actions").alias("n_actions"),
        F.col("actions")[0]["command"].alias("first_command"))


@query("source_rollouts", """
SELECT conv_id AS step, turn AS msg_idx, role, md5(text) AS content, turn + 3 AS num_turns, 0.0::DOUBLE AS reward_default
FROM conversations""")
def source_rollouts(spark, sf):
    message = F.struct("role", F.col("text").alias("content"))
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("step"), F.col("turn").alias("group_idx"), F.lit("i").alias("instance_id"),
        F.struct((F.col("turn") + 3).alias("num_turns")).alias("metrics"), F.array(message).alias("messages"))
    folder = work_folder(spark)
    records.write_rollouts(rows, folder)
    back = records.read_rollouts(spark, folder)
    metrics = with_defaults(back.select("step", "group_idx", "metrics.*"))
    said = records.rollout_messages(back).select("step", "group_idx", "role", F.md5(F.col("content").cast("binary")).alias("content"))
    return said.join(metrics, ["step", "group_idx"]).select(
        "step", F.col("group_idx").alias("msg_idx"), "role", "content", "num_turns", F.col("reward").alias("reward_default"))


@query("source_run_log", f"WITH {LONG_SQL} SELECT step, metric, value FROM long")
def source_run_log(spark, sf):
    folder = work_folder(spark)
    log_lines(spark, sf).write.text(folder)
    return logs.read_run_log(spark, folder)


@query("source_metric_matrix", f"""
WITH {LONG_SQL}
SELECT metric, max(value) FILTER (step = 0) AS step_0, max(value) FILTER (step = 7) AS step_7 FROM long GROUP BY 1""")
def source_metric_matrix(spark, sf):
    from trajlake.operators.runlog import parse_step_lines

    folder = work_folder(spark)
    tables.write_metric_matrix(parse_step_lines(log_lines(spark, sf)), folder, range(31))
    back = spark.read.option("header", "true").csv(folder)
    return back.select("metric", F.col("step_0").cast("double").alias("step_0"), F.col("step_7").cast("double").alias("step_7"))


@query("source_wide_matrix", f"""
WITH {LONG_SQL}
SELECT step * step * step * 100000 AS step, metric, value FROM long
UNION ALL SELECT step * step * step * 100000, '"' || metric || '", x', -value FROM long""")
def source_wide_matrix(spark, sf):
    """Steps up to three thousand million apart, and names that need quotes, written and read back."""
    from trajlake.operators.runlog import parse_step_lines

    s = F.col("step")
    long = parse_step_lines(log_lines(spark, sf)).withColumn("step", s * s * s * 100_000)
    odd = long.select("step", F.concat(F.lit('"'), "metric", F.lit('", x')).alias("metric"), (-F.col("value")).alias("value"))
    folder = work_folder(spark)
    tables.write_metric_matrix(long.unionByName(odd), folder)
    return tables.read_metric_matrix(spark, folder)


REPORTS_SQL = """
s AS (
  SELECT d.source AS instance_id, count(*) AS n, count(*) FILTER (quality = 1) AS good, min(d.doc_id) AS low
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1),
r AS (
  SELECT *, CASE low % 5 WHEN 0 THEN 'unreadable report' WHEN 1 THEN 'wrong type: tests_status' WHEN 2 THEN 'missing instance'
            ELSE 'ok' END AS report_status FROM s)"""


def _report_files(spark, sf) -> str:
    """A report and a test log per source of labelled documents; the tests are its documents. Some reports are broken."""
    joined = table(spark, sf, "labels").select("doc_id", "quality").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    name, good = F.col("doc_id").cast("string"), F.col("quality") == 1
    per = joined.groupBy(F.col("source").alias("instance_id")).agg(
        F.collect_list(F.when(good, name)).alias("success"), F.collect_list(F.when(~good, name)).alias("failure"),
        F.min("doc_id").alias("low"))
    status = F.create_map(F.lit("FAIL_TO_PASS"), F.struct("success", "failure"))
    entry = F.struct((F.size("success") > F.size("failure")).alias("resolved"), F.lit(1).alias("patch_successfully_applied"),
                     status.alias("tests_status"))
    whole = F.to_json(F.create_map(F.when(F.col("low") % 5 == 2, "another").otherwise(F.col("instance_id")), entry))
    wrong = F.to_json(F.create_map("instance_id", F.struct(F.lit(True).alias("resolved"), F.lit("all").alias("tests_status"))))
    text = (F.when(F.col("low") % 5 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3))
            .when(F.col("low") % 5 == 1, wrong).otherwise(whole))
    folder = work_folder(spark)
    keys = [F.lit("grpo").alias("run_id"), F.lit("org__model").alias("model"), "instance_id"]
    per.select(*keys, text.alias("value")).write.partitionBy("run_id", "model", "instance_id").text(f"{folder}/reports")
    log = F.array_join(F.concat("success", "failure"), "")
    per.select(*keys, log.alias("value")).write.partitionBy("run_id", "model", "instance_id").text(f"{folder}/logs")
    return folder


@query("source_reports", f"""
WITH {REPORTS_SQL}
SELECT instance_id, 'grpo' AS run_id, 'org__model' AS model, report_status,
       report_status = 'ok' AND good > n - good AS resolved, report_status = 'ok' AS patch_applied,
       CAST(CASE WHEN report_status = 'ok' THEN good ELSE 0 END AS BIGINT) AS f2p_passed,
       CAST(CASE WHEN report_status = 'ok' THEN n ELSE 0 END AS BIGINT) AS f2p_total
FROM r""")
def source_reports(spark, sf):
    counts = g.grade_counts(records.read_reports(spark, f"{_report_files(spark, sf)}/reports", "*.txt"))
    return counts.drop("p2p_passed", "p2p_total")


@query("source_artifacts", """
SELECT d.source AS instance_id, CAST(sum(length(CAST(d.doc_id AS VARCHAR))) + 1 AS BIGINT) AS pytest_output_length
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1""")
def source_artifacts(spark, sf):
    sizes = records.read_artifact_sizes(spark, f"{_report_files(spark, sf)}/logs", "*.txt")
    return sizes.select("instance_id", "pytest_output_length")


@query("graded_reports", f"""
WITH {REPORTS_SQL}, e AS (SELECT *, report_status IN ('unreadable report', 'wrong type: tests_status') AS broken FROM r)
SELECT instance_id, CAST(g AS BIGINT) AS group_idx,
       CASE WHEN report_status = 'ok' AND good > n - good THEN 1.0 ELSE 0.0 END::DOUBLE AS reward,
       CASE WHEN broken THEN report_status ELSE '' END AS eval_error,
       CAST(CASE WHEN report_status = 'ok' THEN n ELSE 0 END AS BIGINT) AS f2p_total
FROM e, range(4) t(g)""")
def graded_reports(spark, sf):
    """From report files to the grades of all attempts: a broken report costs its reward, not its rows."""
    reports = g.grade_counts(records.read_reports(spark, f"{_report_files(spark, sf)}/reports", "*.txt")).drop("run_id", "model")
    sources = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select(F.col("source").alias("instance_id")).distinct()
    errors = sources.limit(0).select("instance_id", F.lit("").alias("eval_error"))
    grades = g.grade_outcome(sources.withColumn("submission", F.lit("diff")), reports, errors, keys=["instance_id"])
    attempts = sources.withColumn("group_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return g.attach_grading(attempts, grades, ["instance_id"]).select("instance_id", "group_idx", "reward", "eval_error", "f2p_total")


# Scrapes of three servers, one a day; the second server misses every fifth day, and one file in four comes twice.
SCRAPES_SQL = """
scrapes AS (
  SELECT 'sglang_server_' || user_id % 3 AS replica, epoch_us(ts) // 86400000000 AS day, count(*) AS n, max(event_id) AS top
  FROM events WHERE NOT (user_id % 3 = 1 AND epoch_us(ts) // 86400000000 % 5 = 0) GROUP BY 1, 2)"""


def scrape_files(spark, sf) -> str:
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("server"), F.floor(epoch_seconds(F.col("ts")) / 86_400).alias("day"), "event_id")
    per = events.filter(~((F.col("server") == 1) & (F.col("day") % 5 == 0))).groupBy("server", "day").agg(
        F.count("*").alias("n"), F.max("event_id").alias("top"))
    text = F.concat(F.lit('sglang:num_running_reqs{dp="0"} '), F.col("n").cast("string"), F.lit('\nsglang:num_running_reqs{dp="1"} 1'),
                    F.lit("\nsglang:num_requests_total "), F.col("top").cast("string"))
    files = per.select(F.concat(F.lit("sglang_server_"), F.col("server").cast("string")).alias("replica"),
                       (F.col("day") * 86_400).cast("long").alias("t"), text.alias("value"))
    folder = work_folder(spark)
    files.write.partitionBy("replica", "t").text(folder)
    files.filter(F.col("t") % 4 == 0).write.mode("append").partitionBy("replica", "t").text(folder)
    return folder


@query("source_scrapes", f"""
WITH {SCRAPES_SQL}
SELECT replica, day * 86400.0::DOUBLE AS t, n + 1.0::DOUBLE AS running, top * 1.0::DOUBLE AS requests FROM scrapes""")
def source_scrapes(spark, sf):
    scrapes = logs.distinct_scrapes(logs.read_scrapes(spark, scrape_files(spark, sf), by_replica=True))
    samples = sm.gauges(sm.to_samples(scrapes, ["replica", "t"]))
    return samples.select("replica", "t", "running", F.col("num_requests_total").alias("requests"))


@query("missed_scrapes", f"""
WITH {SCRAPES_SQL},
n AS (SELECT replica, day AS a, lead(day) OVER (PARTITION BY replica ORDER BY day) AS b FROM scrapes)
SELECT replica, a * 86400.0::DOUBLE AS after, b * 86400.0::DOUBLE AS until, b - a - 1 AS missed FROM n WHERE b - a > 1""")
def missed_scrapes(spark, sf):
    return logs.missed_ticks(logs.read_scrapes(spark, scrape_files(spark, sf), by_replica=True), 86_400.0)


@query("source_step_metrics", f"WITH {LONG_SQL} SELECT 'r1' AS run, step, metric, value FROM long")
def source_step_metrics(spark, sf):
    from trajlake.operators.runlog import parse_step_lines

    folder = work_folder(spark)
    long = parse_step_lines(log_lines(spark, sf)).withColumn("run", F.lit("r1"))
    tables.append_step_metrics(long, folder)
    return spark.read.parquet(folder).select("run", "step", "metric", "value")


@query("source_lines", """
SELECT lang AS name, count(*) AS n FROM documents GROUP BY 1""")
def source_lines(spark, sf):
    folder = work_folder(spark)
    padded = F.concat(F.lit("  "), F.col("lang"), F.lit("\n\n \t"))
    table(spark, sf, "documents").select(padded.alias("value")).write.text(folder)
    return logs.read_list(spark, folder).groupBy("name").agg(F.count("*").alias("n"))


@query("numbered_lines", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT CAST(sum(len(lines)) AS BIGINT) AS n, CAST(sum(len(lines)) AS BIGINT) AS distinct_positions FROM l""")
def numbered_lines(spark, sf):
    folder = work_folder(spark)
    table(spark, sf, "documents").select(F.col("text").alias("value")).write.text(folder)
    lines = logs.number_lines(logs.read_lines(spark, folder))
    per_file = lines.groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("top"), F.min("line_no").alias("low"))
    return per_file.agg(F.sum("n").alias("n"), F.sum(F.col("top") - F.col("low") + 1).alias("distinct_positions"))


@query("python_tokenizer", f"""
WITH {COUNTS_SQL}
SELECT trajectory_id, msg_idx, n AS n_ids, CAST(length(role) + 1 AS BIGINT) AS first_id FROM m""")
def python_tokenizer(spark, sf):
    def load():
        return lambda text: [len(word) for word in text.split()]

    out = tk.tokenize(messages(spark, sf), tk.tokenizer_column(load))
    return out.select(
        "trajectory_id", "msg_idx", F.size("ids").cast("long").alias("n_ids"), F.col("ids")[0].cast("long").alias("first_id"))


@query("strict_arguments", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE md5(text) END AS command FROM documents""")
def strict_arguments(spark, sf):
    arguments = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("{"), F.col("text"))).otherwise(
        F.to_json(F.struct(F.col("text").alias("command"))))
    command = tc.arguments_command(arguments)
    return table(spark, sf, "documents").select("doc_id", command.alias("c")).select(
        "doc_id", F.when(F.col("c") == "", F.lit("")).otherwise(F.md5(F.col("c").cast("binary"))).alias("command"))


@query("exposition_table_function", """
SELECT name, count(*) AS n, round(sum(v), 2) AS total FROM (
  SELECT 'num_running_reqs' AS name, user_id % 20 AS v FROM events UNION ALL SELECT 'num_running_reqs', 1 FROM events
  UNION ALL SELECT 'num_queue_reqs', event_id % 7 FROM events UNION ALL SELECT 'gen_throughput', value FROM events
  UNION ALL SELECT 'plain', value FROM events UNION ALL SELECT 'late', 17 FROM events) GROUP BY 1""")
def exposition_table_function(spark, sf):
    register_all(spark)
    scrapes(spark, sf).createOrReplaceTempView("trajlake_scrapes")
    return spark.sql("""
        SELECT name, count(*) AS n, round(sum(value), 2) AS total
        FROM trajlake_scrapes, LATERAL exposition(text) GROUP BY name""")
