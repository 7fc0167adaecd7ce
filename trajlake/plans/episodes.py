from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import episodes as ep
from trajlake.operators.tokens import running_response_length
from trajlake.plans.catalog import TURNS_SQL, query, table, turn_rows

LIMITS = {"response_length": 120, "max_errors": 2, "max_turns": 6}


def states_sql(turns: str, response: int, errors: int, cap: int) -> str:
    """The turn states as window queries over the CTE ``turns``."""
    return f"""{turns},
s1 AS (
  SELECT *, sum(gen_tokens + tool_tokens) OVER w AS len_tools, n_calls > 0 AS usable,
         row_number() OVER w AS rk
  FROM turns WHERE turn <= {cap} WINDOW w AS (PARTITION BY trajectory_id ORDER BY turn)),
s2 AS (
  SELECT *, len_tools - tool_tokens AS len_gen,
         rk - coalesce(max(CASE WHEN usable THEN rk END) OVER (PARTITION BY trajectory_id ORDER BY turn), 0) AS streak
  FROM s1),
s3 AS (
  SELECT *, CASE WHEN crashed_type IS NOT NULL THEN 0 WHEN len_gen >= {response} THEN 1
                 WHEN NOT usable AND streak >= {errors} THEN 2 WHEN usable AND submitted_call_idx IS NOT NULL THEN 3
                 WHEN len_tools >= {response} THEN 4 WHEN turn = {cap} THEN 5 END AS phase
  FROM s2),
s4 AS (
  SELECT *, CASE phase WHEN 0 THEN 'Crashed:' || crashed_type WHEN 1 THEN 'ContextLimit'
                 WHEN 2 THEN CASE WHEN attempted THEN 'FormatErrorLimit' ELSE 'NoToolCall' END
                 WHEN 3 THEN 'Submitted' WHEN 4 THEN 'ContextLimit' WHEN 5 THEN 'TurnLimit' END AS status,
         min(CASE WHEN phase IS NOT NULL THEN turn END) OVER (PARTITION BY trajectory_id) AS end_turn
  FROM s3)"""


STATES_SQL = states_sql(TURNS_SQL, *LIMITS.values())


@query("turn_kinds", f"""
WITH {TURNS_SQL}
SELECT CASE WHEN n_calls > 0 THEN 'ok' WHEN attempted THEN '<format_error>' ELSE '<no_tool_call>' END AS kind,
       turn, count(*) AS n
FROM turns GROUP BY 1, 2""")
def turn_kinds(spark, sf):
    from trajlake.functions.toolcalls import turn_kind

    kind = turn_kind(F.col("n_calls"), F.col("attempted"))
    return turn_rows(spark, sf).groupBy(kind.alias("kind"), "turn").agg(F.count("*").alias("n"))


@query("exit_status", f"""
WITH {STATES_SQL}
SELECT trajectory_id, coalesce(max(CASE WHEN turn = end_turn THEN status END), 'IncompleteRollout') AS exit_status,
       max(end_turn) AS end_turn, max(CASE WHEN turn = end_turn THEN phase END) AS end_phase
FROM s4 GROUP BY 1""")
def exit_status(spark, sf):
    return ep.derive_exit_status(turn_rows(spark, sf), **LIMITS)


@query("turn_states", f"""
WITH {STATES_SQL}
SELECT trajectory_id, turn, CAST(len_gen AS BIGINT) AS len_after_generate, CAST(len_tools AS BIGINT) AS len_after_tools,
       CAST(streak AS BIGINT) AS error_streak
FROM s4""")
def turn_states(spark, sf):
    return ep.turn_states(turn_rows(spark, sf), **LIMITS).select(
        "trajectory_id", "turn", "len_after_generate", "len_after_tools",
        F.col("error_streak").cast("long").alias("error_streak"))


@query("episode_counters", f"""
WITH {STATES_SQL},
live AS (SELECT *, coalesce(phase, 5) AS ph FROM s4 WHERE end_turn IS NULL OR turn <= end_turn),
flags AS (
  SELECT *, ph NOT IN (0, 1) AS parsed, ph NOT IN (0, 1, 2, 3) AS observed,
         least(len_gen, 120) - least(len_gen - gen_tokens, 120) AS gen_in,
         least(len_tools, 120) - least(len_tools - tool_tokens, 120) AS tool_in
  FROM live),
agg AS (
  SELECT trajectory_id,
    coalesce(max(CASE WHEN turn = end_turn THEN status END), 'IncompleteRollout') AS exit_status,
    count(*) FILTER (ph <> 0 OR gen_tokens > 0) AS num_turns,
    coalesce(sum(CASE WHEN ph = 3 THEN submitted_call_idx + 1 ELSE n_calls END) FILTER (parsed AND usable), 0) AS calls,
    count(*) FILTER (parsed AND NOT usable) AS format_errors,
    coalesce(sum(n_salvaged) FILTER (parsed), 0) AS salvaged,
    coalesce(sum(tool_tokens) FILTER (observed), 0) AS obs_sum, count(*) FILTER (observed) AS obs_count,
    sum(gen_in) AS completion, sum(gen_in) + coalesce(sum(tool_in) FILTER (observed), 0) AS response
  FROM flags GROUP BY 1)
SELECT trajectory_id, exit_status, exit_status = 'ContextLimit' AS truncated, num_turns,
       CAST(calls AS BIGINT) AS tool_call_count, format_errors, CAST(salvaged AS BIGINT) AS salvaged_tool_calls,
       CAST(obs_sum AS BIGINT) AS obs_sum, obs_count,
       CAST(CASE WHEN response = 0 THEN 1 ELSE completion END AS BIGINT) AS response_tokens,
       CAST(CASE WHEN response = 0 THEN 1 ELSE response END AS BIGINT) AS response_length
FROM agg""")
def episode_counters(spark, sf):
    out = ep.episode_counters(turn_rows(spark, sf), **LIMITS)
    obs = F.col("tool_obs_tokens")
    return out.select(
        "trajectory_id", "exit_status", "truncated", "num_turns", "tool_call_count", "format_errors",
        "salvaged_tool_calls", F.aggregate(obs, F.lit(0).cast("long"), lambda a, x: a + x).alias("obs_sum"),
        F.size(obs).cast("long").alias("obs_count"), "response_tokens", "response_length")


@query("actions_log", """
WITH t AS (
  SELECT o_orderkey AS trajectory_id, CAST(l_linenumber AS BIGINT) AS turn,
         max(l_returnflag) AS flag, min(l_linestatus) AS st, sum(l_partkey) AS part
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT trajectory_id, count(*) AS num_actions, count(*) FILTER (flag = 'R') AS n_errors,
       count(*) FILTER (flag = 'R' AND st = 'F') AS n_attempted,
       md5(string_agg(CASE WHEN flag <> 'R' THEN 'ls ' || part ELSE '-' END, '|' ORDER BY turn)) AS commands
FROM t GROUP BY 1""")
def actions_log(spark, sf):
    li = table(spark, sf, "lineitem")
    turns = li.groupBy(F.col("l_orderkey").alias("trajectory_id"), F.col("l_linenumber").alias("turn")).agg(
        F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("st"), F.sum("l_partkey").alias("part"))
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trajectory_id"))
    turns = turns.join(known, "trajectory_id", "left_semi")
    failed = F.col("flag") == "R"
    executed = turns.filter(~failed).select(
        "trajectory_id", "turn", F.lit(0).alias("call_idx"), F.lit("bash").alias("name"),
        F.concat(F.lit("ls "), F.col("part").cast("string")).alias("command"), F.lit(0).alias("returncode"),
        F.lit("out").alias("output"), F.lit(False).alias("submitted"))
    errors = turns.filter(failed).select(
        "trajectory_id", "turn", F.when(F.col("st") == "F", F.lit("<tool_call>{")).otherwise(F.lit("done")
                                                                                            ).alias("raw_text"))
    log = ep.actions_log(executed, errors)

    def matching(cond):
        return F.size(F.filter("actions", cond)).cast("long")

    return log.select(
        "trajectory_id", "num_actions", matching(lambda a: a["command"].isNull()).alias("n_errors"),
        matching(lambda a: a["tool"] == "<format_error>").alias("n_attempted"),
        F.md5(F.array_join(F.transform("actions", lambda a: F.coalesce(a["command"], F.lit("-"))), "|")
              ).alias("commands"))


@query("running_response_length", """
SELECT conv_id AS trajectory_id, turn AS seg_idx,
       CAST(sum(len(regexp_extract_all(text, '\\S+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS response_len
FROM conversations""")
def running_length(spark, sf):
    segments = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("seg_idx"),
        F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_tokens"))
    return running_response_length(segments).select("trajectory_id", "seg_idx", "response_len")
