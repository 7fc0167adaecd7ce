"""Episode records and training samples put together from recorded parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import arrays
from trajlake.operators import assembly as a
from trajlake.operators import grading as g
from trajlake.plans.catalog import query, rounded, table, turn_rows
from trajlake.plans.episodes import LIMITS, STATES_SQL
from trajlake.sources import records

# An order is an episode: line items are its turns, its messages (usage, edits) and its spans; its status grades it.
PARTS_SQL = f"""
{STATES_SQL},
live AS (SELECT *, coalesce(phase, 5) AS ph FROM s4 WHERE end_turn IS NULL OR turn <= end_turn),
told AS (
  SELECT trajectory_id, coalesce(max(CASE WHEN turn = end_turn THEN status END), 'IncompleteRollout') AS exit_status,
    count(*) FILTER (ph <> 0 OR gen_tokens > 0) AS num_turns,
    coalesce(sum(CASE WHEN ph = 3 THEN submitted_call_idx + 1 ELSE n_calls END) FILTER (ph NOT IN (0, 1) AND usable), 0) AS calls,
    count(*) FILTER (ph NOT IN (0, 1) AND NOT usable) AS format_errors,
    sum(least(len_gen, {LIMITS["response_length"]}) - least(len_gen - gen_tokens, {LIMITS["response_length"]}))
      + coalesce(sum(least(len_tools, {LIMITS["response_length"]}) - least(len_tools - tool_tokens, {LIMITS["response_length"]}))
                 FILTER (ph NOT IN (0, 1, 2, 3)), 0) AS response
  FROM live GROUP BY 1),
parts AS (
  SELECT l_orderkey AS trajectory_id, max(l_partkey) AS prompt, sum(l_suppkey) AS completion,
         count(*) FILTER (l_returnflag = 'A') AS edits, sum(l_quantity) FILTER (l_linestatus = 'F') AS tool_s, sum(l_quantity) AS all_s
  FROM lineitem GROUP BY 1)"""


def _parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").withColumn("trajectory_id", F.col("l_orderkey"))
    usage = F.struct(
        F.col("l_partkey").cast("long").alias("prompt_tokens"), F.col("l_suppkey").cast("long").alias("completion_tokens"),
        F.lit(None).cast("long").alias("cached_tokens"), F.lit(None).cast("struct<cached_tokens:long>").alias("prompt_tokens_details"))
    command = F.when(F.col("l_returnflag") == "A", "apply_patch x").otherwise("ls")
    messages = li.select("trajectory_id", usage.alias("usage"), F.array(F.struct(command.alias("command"))).alias("actions"))
    kinds = F.array(F.struct(F.lit("trajectory").alias("kind"), F.col("l_quantity").alias("seconds")),
                    F.struct(F.when(F.col("l_linestatus") == "F", "tool").otherwise("generate").alias("kind"), F.col("l_quantity").alias("seconds")))
    spans = li.select("trajectory_id", F.inline(kinds))
    orders = table(spark, sf, "orders").withColumn("trajectory_id", F.col("o_orderkey"))
    zero = F.lit(0).cast("long")
    grades = orders.select(
        "trajectory_id", F.date_format("o_orderdate", "yyyy-MM").alias("step"), (F.col("o_orderstatus") == "F").alias("resolved"),
        (F.col("o_orderstatus") == "F").cast("double").alias("reward"), F.lit(False).alias("empty_patch"),
        F.when(F.col("o_orderkey") % 10 == 0, "timeout").otherwise("").alias("eval_error"), F.lit(True).alias("patch_applied"),
        *[zero.alias(c) for c in g.GRADE_FIELDS[5:]])
    return turn_rows(spark, sf), messages, spans, grades


@query("episode_records", f"""
WITH {PARTS_SQL}
SELECT t.trajectory_id, t.exit_status, t.exit_status = 'ContextLimit' AS truncated, CAST(num_turns AS BIGINT) AS num_turns,
       CAST(calls AS BIGINT) AS tool_call_count, CAST(format_errors AS BIGINT) AS format_errors,
       CAST(prompt AS BIGINT) AS prompt_tokens, CAST(completion AS BIGINT) AS completion_tokens, CAST(edits AS BIGINT) AS edit_count,
       CAST(prompt + CASE WHEN response = 0 THEN 1 ELSE response END AS BIGINT) AS total_trajectory_tokens,
       round(coalesce(tool_s, 0), 4) AS total_tool_call_time, round(all_s, 4) AS total_trajectory_time,
       coalesce(o_orderstatus = 'F', false) AS resolved, CASE WHEN o_orderkey % 10 = 0 THEN 'timeout' ELSE '' END AS eval_error
FROM told t JOIN parts p ON t.trajectory_id = p.trajectory_id LEFT JOIN orders o ON t.trajectory_id = o.o_orderkey""")
def episode_records(spark, sf):
    outcomes, messages, spans, grades = _parts(spark, sf)
    out = a.assemble_episodes(outcomes, messages=messages, spans=spans, grades=grades, **LIMITS)
    return rounded(out.select(
        "trajectory_id", "exit_status", "truncated", "num_turns", "tool_call_count", "format_errors", "prompt_tokens", "completion_tokens",
        "edit_count", "total_trajectory_tokens", "total_tool_call_time", "total_trajectory_time", "resolved", "eval_error"), 4)


@query("turns_to_metrics", f"""
WITH {PARTS_SQL},
e AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS step, t.*, p.*, o_orderstatus AS os, o_orderkey
  FROM told t JOIN parts p ON t.trajectory_id = p.trajectory_id JOIN orders o ON t.trajectory_id = o.o_orderkey),
c AS (SELECT step, exit_status, count(*) AS n FROM e GROUP BY 1, 2),
w AS (
  SELECT step, avg(num_turns) AS "traj/mean_turns", avg(calls) AS "traj/mean_tool_calls", avg(edits) AS "traj/mean_edits",
         avg(prompt) AS "tokens/mean_prompt", avg(all_s) AS "latency/mean_trajectory_s",
         avg(CASE WHEN o_orderkey % 10 = 0 THEN 1.0 ELSE 0.0 END) AS "reward/eval_error_rate",
         avg(CASE WHEN exit_status = 'ContextLimit' THEN 1.0 ELSE 0.0 END) AS "traj/truncation_rate",
         avg(CASE WHEN os = 'F' THEN 1.0 ELSE 0.0 END) AS "traj/mean_reward"
  FROM e GROUP BY 1)
SELECT step, 'traj/exit/' || exit_status AS metric, round(n / sum(n) OVER (PARTITION BY step), 6) AS value FROM c
UNION ALL SELECT step, metric, round(value, 6) FROM (UNPIVOT w ON COLUMNS(* EXCLUDE step) INTO NAME metric VALUE value)""")
def turns_to_metrics(spark, sf):
    """From turns, messages, spans and grades to the step's metrics in one plan."""
    from trajlake.operators.metrics import batch_metrics, trajectory_partials

    outcomes, messages, spans, grades = _parts(spark, sf)
    known = grades.select("trajectory_id")
    records_ = a.assemble_episodes(outcomes.join(known, "trajectory_id", "left_semi"), messages=messages, spans=spans, grades=grades,
                                   keep=["step"], **LIMITS)
    long = batch_metrics(trajectory_partials(records_))
    shown = F.col("metric").startswith("traj/exit/") | F.col("metric").isin(
        "traj/mean_turns", "traj/mean_tool_calls", "traj/mean_edits", "tokens/mean_prompt", "latency/mean_trajectory_s",
        "reward/eval_error_rate", "traj/truncation_rate", "traj/mean_reward")
    return rounded(long.filter(shown))


@query("rollouts_to_samples", """
WITH m AS (
  SELECT conv_id, turn, role, CAST(len(regexp_extract_all(role || ': ' || text, '\\S+')) AS BIGINT) AS n FROM conversations),
back AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM m),
k AS (SELECT *, least(n, greatest(60 - (upto - n), 0)) AS k FROM back),
r AS (
  SELECT conv_id, CAST(sum(k) AS BIGINT) AS n_ids, CAST(coalesce(sum(k) FILTER (role = 'assistant'), 0) AS BIGINT) AS n_trained,
         sum(n) > 60 AS truncated, conv_id % 5 = 4 AS broken, CASE WHEN conv_id % 5 <> 4 AND conv_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward
  FROM k GROUP BY conv_id)
SELECT conv_id % 20 AS instance_id, conv_id AS group_idx, n_ids, n_trained, truncated, reward,
       CASE WHEN broken THEN 'unreadable report' ELSE '' END AS eval_error,
       round(n_trained * CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0.0
             ELSE (reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6) END, 6) + 0.0::DOUBLE AS advantage_sum
FROM r WINDOW g AS (PARTITION BY conv_id % 20)""")
def rollouts_to_samples(spark, sf):
    """Conversations as attempts at twenty instances, graded by reports of which a fifth is cut off."""
    said = F.struct("turn", "role", F.col("text").alias("content"))
    rollouts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("m")).select(
        F.lit(1).cast("long").alias("step"), (F.col("conv_id") % 20).alias("instance_id"), F.col("conv_id").alias("group_idx"),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    keys = ["step", "instance_id", "group_idx"]
    name = F.col("instance_id").cast("string")
    report = F.to_json(F.create_map(name, F.struct((F.col("group_idx") % 3 == 0).alias("resolved"))))
    files = rollouts.select(*keys, name.alias("name"), F.when(F.col("group_idx") % 5 == 4, F.left(report, F.length(report) - 1)).otherwise(report).alias("value"))
    counts = g.grade_counts(records.parse_reports(files, instance="name")).drop("name")
    errors = counts.limit(0).select(*keys, F.lit("").alias("eval_error"))
    grades = g.grade_outcome(rollouts.select(*keys, F.lit("diff").alias("submission")), counts, errors, keys=keys)
    samples = a.rollout_samples(rollouts, grades, budget=60)
    total = F.aggregate("token_advantages", F.lit(0.0), lambda acc, x: acc + x)
    return rounded(samples.select(
        "instance_id", "group_idx", F.size("input_ids").cast("long").alias("n_ids"), arrays.total(F.col("response_mask")).alias("n_trained"),
        "truncated", "reward", "eval_error", total.alias("advantage_sum")))
