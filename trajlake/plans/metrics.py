from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.operators import metrics as m
from trajlake.operators import usage as u
from trajlake.operators.tokens import pooled_observations
from trajlake.plans.catalog import month, query, rounded, table

# One row per order; an order without line items keeps the defaults of every field.
EPISODES_SQL = """
per_turn AS (
  SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS obs FROM lineitem GROUP BY 1, 2),
obs AS (
  SELECT l_orderkey, count(*) AS n_obs, sum(obs) AS obs_sum, max(obs) AS obs_max FROM per_turn GROUP BY 1),
folded AS (
  SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS completion, CAST(max(l_partkey) AS BIGINT) AS prompt,
         CAST(sum(l_suppkey) AS BIGINT) AS cached, count(*) AS turns,
         count(*) FILTER (l_returnflag = 'R') AS format_errors, count(*) FILTER (l_linestatus = 'F') AS edits,
         sum(l_tax) * 100 AS traj_s, sum(l_discount) * 100 AS tool_s,
         count(*) FILTER (l_returnflag = 'A') AS f2p_passed, count(*) FILTER (l_returnflag <> 'N') AS f2p_total,
         count(*) FILTER (l_linestatus = 'O') AS p2p_passed, count(*) AS p2p_total
  FROM lineitem GROUP BY 1),
episodes AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS step, o_orderpriority AS status, o_orderstatus AS os,
         o_totalprice > 200000 AS truncated, o_orderkey,
         coalesce(completion, 0) AS completion, coalesce(prompt, 0) AS prompt, coalesce(cached, 0) AS cached,
         coalesce(turns, 0) AS turns, coalesce(format_errors, 0) AS format_errors, coalesce(edits, 0) AS edits,
         coalesce(traj_s, 0) AS traj_s, coalesce(tool_s, 0) AS tool_s,
         coalesce(f2p_passed, 0) AS f2p_passed, coalesce(f2p_total, 0) AS f2p_total,
         coalesce(p2p_passed, 0) AS p2p_passed, coalesce(p2p_total, 0) AS p2p_total,
         coalesce(n_obs, 0) AS n_obs, coalesce(obs_sum, 0) AS obs_sum, obs_max
  FROM orders LEFT JOIN folded f ON o_orderkey = f.l_orderkey LEFT JOIN obs b ON o_orderkey = b.l_orderkey)"""


def episodes(spark, sf) -> DataFrame:
    """Orders as episodes, their line items as turns."""
    li = table(spark, sf, "lineitem")

    def count_if(cond):
        return F.sum(cond.cast("long"))

    # Line numbers are folded first: an order then has few rows to gather, however many it had.
    per_turn = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_partkey").alias("part"), F.sum("l_suppkey").alias("supp"),
        F.count("*").alias("n"), F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("discount"),
        count_if(F.col("l_returnflag") == "R").alias("r"), count_if(F.col("l_returnflag") == "A").alias("a"),
        count_if(F.col("l_linestatus") == "F").alias("f"), count_if(F.col("l_linestatus") == "O").alias("o"))
    obs = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("qty").cast("long").alias("obs"))))
    folded = per_turn.groupBy("l_orderkey").agg(
        F.sum("qty").cast("long").alias("completion_tokens"), F.max("part").alias("prompt_tokens"),
        F.sum("supp").alias("cached_prompt_tokens"), F.sum("n").alias("num_turns"), F.sum("r").alias("format_errors"),
        F.sum("f").alias("edit_count"), (F.sum("tax") * 100).alias("total_trajectory_time"),
        (F.sum("discount") * 100).alias("total_tool_call_time"), F.sum("a").alias("f2p_passed"),
        F.sum(F.col("a") + F.col("r")).alias("f2p_total"), F.sum("o").alias("p2p_passed"), F.sum("n").alias("p2p_total"),
        F.transform(obs, lambda x: x["obs"]).alias("tool_obs_tokens"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), month(F.col("o_orderdate")).alias("step"),
        F.col("o_orderpriority").alias("exit_status"),
        (F.col("o_totalprice") > 200000).alias("truncated"),
        (F.col("o_orderstatus") == "F").alias("resolved"),
        (F.col("o_orderstatus") == "F").cast("double").alias("reward"),
        (F.col("o_orderstatus") == "P").alias("empty_patch"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("timeout")).alias("eval_error"),
        (F.col("o_orderstatus") != "P").alias("patch_applied"))
    joined = orders.join(folded, "l_orderkey", "left")
    return joined.withColumns({
        "tool_call_count": F.col("num_turns") * 2, "salvaged_tool_calls": F.col("num_turns") - F.col("format_errors"),
        "response_tokens": F.col("completion_tokens"),
        "total_trajectory_tokens": F.col("prompt_tokens") + F.col("completion_tokens")})


TRAJECTORY_METRICS_SQL = f"""
WITH {EPISODES_SQL}
SELECT step,
  round(avg(CASE WHEN o_orderkey % 50 = 0 THEN 1.0 ELSE 0.0 END), 6) AS "reward/eval_error_rate",
  round(avg(CASE WHEN os = 'P' THEN 1.0 ELSE 0.0 END), 6) AS "reward/empty_patch_rate",
  round(avg(CASE WHEN os = 'F' THEN 1.0 ELSE 0.0 END), 6) AS "traj/resolve_rate",
  round(avg(CASE WHEN os = 'F' THEN 1.0 ELSE 0.0 END), 6) AS "traj/mean_reward",
  round(avg(CASE WHEN os <> 'P' THEN 1.0 ELSE 0.0 END), 6) AS "reward/patch_applied_rate",
  round(CASE WHEN sum(f2p_total) > 0 THEN sum(f2p_passed)::DOUBLE / sum(f2p_total)::DOUBLE ELSE 0 END, 6) AS "reward/f2p_pass_rate",
  round(CASE WHEN sum(p2p_total) > 0 THEN sum(p2p_passed)::DOUBLE / sum(p2p_total)::DOUBLE ELSE 0 END, 6) AS "reward/p2p_pass_rate",
  round(avg(turns), 6) AS "traj/mean_turns", round(avg(turns * 2), 6) AS "traj/mean_tool_calls",
  round(avg(edits), 6) AS "traj/mean_edits",
  round(avg(CASE WHEN truncated THEN 1.0 ELSE 0.0 END), 6) AS "traj/truncation_rate",
  round(avg(format_errors), 6) AS "traj/mean_format_errors",
  round(avg(CASE WHEN format_errors > 0 THEN 1.0 ELSE 0.0 END), 6) AS "traj/format_error_rate",
  round(avg(turns - format_errors), 6) AS "traj/mean_salvaged_calls",
  round(avg(prompt), 6) AS "tokens/mean_prompt", round(avg(completion), 6) AS "tokens/mean_completion",
  round(avg(cached), 6) AS "tokens/mean_cached_prompt", round(avg(prompt + completion), 6) AS "tokens/mean_total",
  round(avg(completion), 6) AS "tokens/mean_response",
  round(CASE WHEN sum(n_obs) > 0 THEN sum(obs_sum)::DOUBLE / sum(n_obs)::DOUBLE ELSE 0 END, 6) AS "tokens/mean_obs",
  CAST(coalesce(max(obs_max), 0) AS DOUBLE) AS "tokens/max_obs",
  round(avg(traj_s), 6) AS "latency/mean_trajectory_s", round(max(traj_s), 6) AS "latency/max_trajectory_s",
  round(avg(tool_s), 6) AS "latency/mean_tool_s",
  round(avg(greatest(traj_s - tool_s, 0.0)), 6) AS "latency/mean_generation_s"
FROM episodes GROUP BY step"""


@query("trajectory_metrics", TRAJECTORY_METRICS_SQL)
def trajectory_metrics(spark, sf):
    return rounded(m.summarize_trajectories(episodes(spark, sf)))


@query("exit_shares", """
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS step, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT step, 'traj/exit/' || o_orderpriority AS metric, round(n / sum(n) OVER (PARTITION BY step), 6) AS value
FROM c""")
def exit_shares(spark, sf):
    orders = table(spark, sf, "orders").select(
        month(F.col("o_orderdate")).alias("step"), F.col("o_orderpriority").alias("exit_status"))
    return rounded(m.exit_shares(m.trajectory_partials(orders)))


# Every metric and exit share as long rows.
ALL_METRICS_SQL = f"""
WITH wide AS ({TRAJECTORY_METRICS_SQL}),
{EPISODES_SQL},
c AS (SELECT step, status, count(*) AS n FROM episodes GROUP BY 1, 2)
SELECT step, 'traj/exit/' || status AS metric, round(n / sum(n) OVER (PARTITION BY step), 6) AS value FROM c
UNION ALL SELECT step, metric, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE step) INTO NAME metric VALUE value)"""


@query("batch_metrics_long", ALL_METRICS_SQL)
def batch_metrics_long(spark, sf):
    return rounded(m.batch_metrics(m.trajectory_partials(episodes(spark, sf))))


@query("merged_metrics", """
WITH a AS (SELECT event_type AS metric, round(avg(value), 4) AS v, round(max(value), 4) AS top FROM events GROUP BY 1)
SELECT 0 AS step, metric, top AS value FROM a
UNION ALL SELECT 0, metric || '/mean', v FROM a""")
def merged_metrics(spark, sf):
    by_type = table(spark, sf, "events").groupBy("event_type").agg(
        F.avg("value").alias("_avg"), F.max("value").alias("_max"))
    first = by_type.select(F.lit(0).alias("step"), F.col("event_type").alias("metric"), F.col("_avg").alias("value"))
    renamed = first.withColumn("metric", F.concat("metric", F.lit("/mean")))
    later = by_type.select(F.lit(0).alias("step"), F.col("event_type").alias("metric"), F.col("_max").alias("value"))
    return rounded(m.merge_metrics([first, renamed, later]), 4)


@query("micro_pass_rate", """
SELECT l_suppkey,
  round(CASE WHEN count(*) FILTER (l_returnflag <> 'N') > 0 THEN
    count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*) FILTER (l_returnflag <> 'N')::DOUBLE ELSE 0 END, 6) AS f2p,
  round(count(*) FILTER (l_linestatus = 'O')::DOUBLE / count(*)::DOUBLE, 6) AS p2p
FROM lineitem GROUP BY 1""")
def micro_pass_rate(spark, sf):
    flags = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("step"), (F.col("l_returnflag") == "A").cast("long").alias("f2p_passed"),
        (F.col("l_returnflag") != "N").cast("long").alias("f2p_total"),
        (F.col("l_linestatus") == "O").cast("long").alias("p2p_passed"), F.lit(1).alias("p2p_total"))
    out = m.summarize_trajectories(flags)
    return rounded(out.select(
        F.col("step").alias("l_suppkey"), F.col("`reward/f2p_pass_rate`").alias("f2p"),
        F.col("`reward/p2p_pass_rate`").alias("p2p")))


@query("pooled_obs", """
WITH o AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS obs FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey % 100 AS bucket, round(sum(obs)::DOUBLE / count(*), 6) AS "tokens/mean_obs",
       CAST(max(obs) AS DOUBLE) AS "tokens/max_obs"
FROM o GROUP BY 1""")
def pooled_obs(spark, sf):
    per_episode = episodes(spark, sf).filter(F.col("tool_obs_tokens").isNotNull())
    return rounded(pooled_observations(
        per_episode.withColumn("bucket", F.col("l_orderkey") % 100), ["bucket"]))


@query("step_timing", """
SELECT strftime(l_shipdate, '%Y-%m') AS step, round(sum(l_quantity), 4) AS "time/rollout_s",
       round(sum(l_tax), 4) AS "time/update_s",
       round(sum(l_quantity) / greatest(sum(l_quantity) + sum(l_tax), 1e-9), 4) AS "time/rollout_fraction"
FROM lineitem GROUP BY 1""")
def step_timing(spark, sf):
    li = table(spark, sf, "lineitem").select(
        month(F.col("l_shipdate")).alias("step"), F.col("l_quantity").alias("rollout_s"), F.col("l_tax").alias("update_s"))
    return rounded(m.step_timing(li), 4)


@query("span_totals", """
SELECT l_orderkey AS trajectory_id,
       round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 4) AS generate_s,
       round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 4) AS tool_s,
       round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 4) AS score_s,
       0.0::DOUBLE AS trajectory_s
FROM lineitem GROUP BY 1""")
def span_totals(spark, sf):
    kind = (F.when(F.col("l_returnflag") == "A", "generate").when(F.col("l_returnflag") == "N", "tool")
            .otherwise("score"))
    spans = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trajectory_id"), kind.alias("kind"), F.col("l_quantity").alias("seconds"))
    return rounded(m.span_totals(spans), 4)


@query("usage_fold", """
SELECT l_orderkey AS trajectory_id, CAST(max(l_partkey) AS BIGINT) AS prompt_tokens,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE l_quantity END) AS BIGINT) AS completion_tokens,
       CAST(sum(CASE l_linestatus WHEN 'F' THEN l_suppkey ELSE l_suppkey * 2 END) AS BIGINT) AS cached_prompt_tokens
FROM lineitem GROUP BY 1""")
def usage_fold(spark, sf):
    li = table(spark, sf, "lineitem")
    in_details = F.col("l_linestatus") != "F"
    usage = F.struct(
        F.col("l_partkey").alias("prompt_tokens"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("long")).alias("completion_tokens"),
        F.when(~in_details, F.col("l_suppkey")).alias("cached_tokens"),
        F.struct(F.when(in_details, F.col("l_suppkey") * 2).alias("cached_tokens")).alias("prompt_tokens_details"))
    messages = li.select(
        F.col("l_orderkey").alias("trajectory_id"), usage.alias("usage"),
        F.col("l_linenumber").cast("long").alias("completion_tokens"))
    return u.fold_usage(messages)


@query("action_counts", """
WITH c AS (SELECT source, unnest(string_split(text, chr(10))) AS command FROM documents)
SELECT source AS trajectory_id, count(*) AS tool_call_count,
       count(*) FILTER (contains(command, 'apply_patch') OR contains(command, 'edit ') OR contains(command, 'str_replace')
             OR contains(command, '>>>>>>> REPLACE') OR contains(command, '<<<<<<< SEARCH')) AS edit_count
FROM (SELECT source, replace(command, 'er ', 'edit ') AS command FROM c) GROUP BY 1""")
def action_counts(spark, sf):
    commands = F.transform(F.split("text", "\n"), lambda x: F.struct(
        F.replace(x, F.lit("er "), F.lit("edit ")).alias("command")))
    docs = table(spark, sf, "documents").select(F.col("source").alias("trajectory_id"), commands.alias("actions"))
    return u.count_actions(docs)


@query("loop_profile", """
SELECT user_id AS trajectory_id, count(*) AS num_actions, count(DISTINCT event_type) AS distinct_commands
FROM events GROUP BY 1""")
def loop_profile(spark, sf):
    actions = table(spark, sf, "events").select(
        F.col("user_id").alias("trajectory_id"), F.col("event_type").alias("command"))
    return u.loop_profile(actions)
