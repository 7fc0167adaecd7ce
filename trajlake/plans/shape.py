from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import advantage as adv
from trajlake.operators import batch_shape as bs
from trajlake.operators.prep import with_row_index
from trajlake.plans.advantage import REWARDS_SQL, rewards
from trajlake.plans.catalog import month, query, rounded, table


def _stats_sql(prefix: str, expr: str, where: str = "true") -> str:
    return (f'round(avg({expr}) FILTER ({where}), 4) AS "{prefix}/mean", '
            f'CAST(max({expr}) FILTER ({where}) AS DOUBLE) AS "{prefix}/max", '
            f'CAST(min({expr}) FILTER ({where}) AS DOUBLE) AS "{prefix}/min"')


@query("critic_metrics", f"""
WITH {REWARDS_SQL},
a AS (SELECT doc_id, reward, n_chars % 50 AS n,
             (reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6) AS adv
      FROM rewards WINDOW g AS (PARTITION BY source)),
k AS (SELECT doc_id % 4 AS step, reward, n, adv FROM a)
SELECT step, {_stats_sql("critic/score", "reward", "n > 0")}, {_stats_sql("critic/rewards", "reward", "n > 0")},
  round(sum(adv * n) / sum(n), 4) AS "critic/advantages/mean", round(max(adv) FILTER (n > 0), 4) AS "critic/advantages/max",
  round(min(adv) FILTER (n > 0), 4) AS "critic/advantages/min",
  round(sum(adv * n) / sum(n), 4) AS "critic/returns/mean", round(max(adv) FILTER (n > 0), 4) AS "critic/returns/max",
  round(min(adv) FILTER (n > 0), 4) AS "critic/returns/min"
FROM k GROUP BY 1""")
def critic_metrics(spark, sf):
    df = adv.group_advantage(rewards(spark, sf), ["source"], spread_by=["doc_id"])
    n = F.col("n_chars") % 50
    return rounded(bs.critic_metrics(df.select(
        (F.col("doc_id") % 4).alias("step"), "reward", "advantage", n.alias("n_tokens"), n.alias("response_length"))), 4)


SHAPE_SQL = "SELECT lang AS step, n_chars % 4097 AS p, n_chars % 700 * 41 AS r, doc_id % 9 AS turns FROM documents"


@query("batch_shape", f"""
WITH d AS ({SHAPE_SQL})
SELECT step, {_stats_sql("prompt_length", "p")},
  round(avg(CASE WHEN p = 4096 THEN 1.0 ELSE 0.0 END), 4) AS "prompt_length/clip_ratio",
  {_stats_sql("response_length", "r")},
  round(avg(CASE WHEN r = 28659 THEN 1.0 ELSE 0.0 END), 4) AS "response_length/clip_ratio",
  {_stats_sql("response_length_non_aborted", "r", "r > 0")},
  round(avg(CASE WHEN r = 28659 THEN 1.0 ELSE 0.0 END) FILTER (r > 0), 4) AS "response_length_non_aborted/clip_ratio",
  round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END), 4) AS "response/aborted_ratio",
  {_stats_sql("num_turns", "turns * 2 + 1")}
FROM d GROUP BY 1""")
def batch_shape(spark, sf):
    df = table(spark, sf, "documents").select(
        F.col("lang").alias("step"), (F.col("n_chars") % 4097).alias("prompt_length"),
        (F.col("n_chars") % 700 * 41).alias("response_length"), (F.col("doc_id") % 9).alias("assistant_turns"))
    return rounded(bs.batch_shape(df, max_response=28659), 4)


@query("global_seqlen", """
WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT n_chars, (row_number() OVER (ORDER BY doc_id) - 1) * 8 // n.n AS rank FROM documents, n),
c AS (SELECT rank, sum(n_chars) AS t FROM r GROUP BY 1)
SELECT CAST(min(t) AS DOUBLE) AS "global_seqlen/min", CAST(max(t) AS DOUBLE) AS "global_seqlen/max",
       round(avg(t), 4) AS "global_seqlen/mean", CAST(max(t) - min(t) AS DOUBLE) AS "global_seqlen/minmax_diff"
FROM c""")
def global_seqlen(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return rounded(bs.global_seqlen(with_row_index(docs, "doc_id"), 8, tokens="n_chars", table=docs), 4)


@query("timing_per_token", """
SELECT strftime(l_shipdate, '%Y-%m') AS step,
  round(sum(l_quantity) * 1000 / sum(l_suppkey), 4) AS "timing_per_token_ms/gen",
  round(sum(l_tax) * 1000 / sum(l_partkey + l_suppkey), 4) AS "timing_per_token_ms/ref"
FROM lineitem GROUP BY 1""")
def timing_per_token(spark, sf):
    li = table(spark, sf, "lineitem").select(
        month(F.col("l_shipdate")).alias("step"), F.col("l_partkey").alias("prompt_tokens"),
        F.col("l_suppkey").alias("response_tokens"), F.col("l_quantity").alias("gen_s"), F.col("l_tax").alias("ref_s"))
    return rounded(bs.timing_per_token(li, stages=["gen", "ref"]), 4)


TIMING_SQL = """
t AS (
  SELECT l_suppkey % 50 AS step, l_orderkey, sum(l_quantity) AS g, sum(l_discount) AS c, sum(l_tax) AS s,
         count(*) AS n, sum(l_partkey) AS p, sum(l_suppkey) AS r
  FROM lineitem GROUP BY 1, 2)"""


@query("agent_loop_timing", f"""
WITH {TIMING_SQL},
x AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(g + c + s, 4) DESC, l_orderkey) AS rk FROM t)
SELECT step,
  {_stats_sql("timing_s/agent_loop/generate_sequences", "g")},
  round(avg(c), 4) AS "timing_s/agent_loop/tool_calls/mean", round(max(c), 4) AS "timing_s/agent_loop/tool_calls/max",
  round(min(c), 4) AS "timing_s/agent_loop/tool_calls/min",
  round(avg(s), 4) AS "timing_s/agent_loop/compute_score/mean", round(max(s), 4) AS "timing_s/agent_loop/compute_score/max",
  round(min(s), 4) AS "timing_s/agent_loop/compute_score/min",
  {_stats_sql("timing_s/agent_loop/num_preempted", "n")},
  CAST(max(g) FILTER (rk = 1) AS DOUBLE) AS "timing_s/agent_loop/slowest/generate_sequences",
  round(max(c) FILTER (rk = 1), 4) AS "timing_s/agent_loop/slowest/tool_calls",
  round(max(s) FILTER (rk = 1), 4) AS "timing_s/agent_loop/slowest/compute_score",
  CAST(max(n) FILTER (rk = 1) AS DOUBLE) AS "timing_s/agent_loop/slowest/num_preempted",
  CAST(max(p) FILTER (rk = 1) AS DOUBLE) AS "timing_s/agent_loop/slowest/prompt_length",
  CAST(max(r) FILTER (rk = 1) AS DOUBLE) AS "timing_s/agent_loop/slowest/response_length"
FROM x GROUP BY 1""")
def agent_loop_timing(spark, sf):
    # Times are rounded before the arg-max: sums in another order must not pick another row.
    per_episode = table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 50).alias("step"), F.col("l_orderkey").alias("trajectory_id")).agg(
        F.sum("l_quantity").alias("generate_sequences"), F.round(F.sum("l_discount"), 4).alias("tool_calls"),
        F.round(F.sum("l_tax"), 4).alias("compute_score"), F.count("*").alias("num_preempted"),
        F.sum("l_partkey").alias("prompt_length"), F.sum("l_suppkey").alias("response_length"))
    return rounded(bs.agent_loop_timing(per_episode), 4)


@query("throughput", """
SELECT strftime(l_shipdate, '%Y') AS step, CAST(sum(l_partkey + l_suppkey) AS DOUBLE) AS "perf/total_num_tokens",
       max(l_quantity) AS "perf/time_per_step",
       round(sum(l_partkey + l_suppkey) / (max(l_quantity) * 8), 4) AS "perf/throughput"
FROM lineitem GROUP BY 1""")
def throughput(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("step"), F.col("l_partkey").alias("prompt_tokens"),
        F.col("l_suppkey").alias("response_tokens"), F.col("l_quantity").alias("step_s"))
    return rounded(bs.throughput(li), 4)


@query("validation_metrics", """
WITH v AS (SELECT d.lang AS step, d.source, l.quality, d.n_chars % 9 AS turns FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT step, 'val-core/' || source || '/reward/mean@1' AS metric, round(avg(quality), 6) AS value FROM v GROUP BY 1, 2
UNION ALL SELECT step, 'val-aux/num_turns/mean', round(avg(turns * 2 + 1), 6) FROM v GROUP BY 1
UNION ALL SELECT step, 'val-aux/num_turns/max', max(turns * 2 + 1) FROM v GROUP BY 1
UNION ALL SELECT step, 'val-aux/num_turns/min', min(turns * 2 + 1) FROM v GROUP BY 1""")
def validation_metrics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    df = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("step"), F.col("source").alias("data_source"),
        F.col("quality").cast("double").alias("reward"), (F.col("n_chars") % 9).alias("assistant_turns"))
    return rounded(bs.validation_metrics(df))


@query("total_steps", """
SELECT count(*) AS n, CAST(ceil(count(*) / 256.0) * 3 AS BIGINT) AS total_steps FROM orders""")
def total_steps(spark, sf):
    from trajlake.functions.numbers import total_steps as steps

    n = F.count("*")
    return table(spark, sf, "orders").agg(n.alias("n"), steps(n, 256).cast("long").alias("total_steps"))
