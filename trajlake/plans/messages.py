from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import arrays
from trajlake.operators import chat
from trajlake.operators import tokens as tk
from trajlake.plans.catalog import query, rounded, table

COUNTS_SQL = """
m AS (
  SELECT conv_id AS trajectory_id, turn AS msg_idx, role,
         CAST(len(regexp_extract_all(role || ': ' || text, '\\S+')) AS BIGINT) AS n,
         CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS bit
  FROM conversations)"""


def messages(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("msg_idx"), "role", F.col("text").alias("content"))


@query("message_tokens", f"""
WITH {COUNTS_SQL} SELECT trajectory_id, msg_idx, role, n AS n_tokens, n * bit AS mask_sum FROM m""")
def message_tokens(spark, sf):
    return tk.message_tokens(messages(spark, sf))


@query("role_mask", f"""
WITH {COUNTS_SQL} SELECT trajectory_id, msg_idx, n AS n_ids, n AS mask_len, n * bit AS mask_sum FROM m""")
def role_mask(spark, sf):
    tokens = tk.tokenize(messages(spark, sf))
    mask = arrays.role_mask(F.col("role"), F.size("ids"))
    return tokens.select(
        "trajectory_id", "msg_idx", F.size("ids").cast("long").alias("n_ids"),
        F.size(mask).cast("long").alias("mask_len"), arrays.total(mask).alias("mask_sum"))


@query("obs_tokens", f"""
WITH {COUNTS_SQL}
SELECT trajectory_id, CAST(sum(n) AS BIGINT) AS obs_sum, count(*) AS obs_count, max(n) AS obs_max
FROM m WHERE bit = 0 AND msg_idx >= 2 GROUP BY 1""")
def obs_tokens(spark, sf):
    return tk.observation_totals(tk.message_tokens(messages(spark, sf)))


@query("left_truncate", f"""
WITH {COUNTS_SQL},
back AS (
  SELECT *, sum(n) OVER (PARTITION BY trajectory_id ORDER BY msg_idx DESC) AS upto FROM m),
kept AS (SELECT *, least(n, greatest(60 - (upto - n), 0)) AS k FROM back)
SELECT trajectory_id, CAST(sum(k) AS BIGINT) AS total_trajectory_tokens,
       CAST(sum(k * bit) AS BIGINT) AS response_tokens, sum(n) > 60 AS truncated,
       CAST(sum(k) AS BIGINT) AS n_ids, CAST(sum(k) * (sum(k) - 1) // 2 AS BIGINT) AS position_sum
FROM kept GROUP BY 1""")
def left_truncate(spark, sf):
    out = tk.adapt_trajectories(tk.tokenize(messages(spark, sf)), budget=60)
    return out.select(
        "trajectory_id", "total_trajectory_tokens", "response_tokens", "truncated",
        F.size("input_ids").cast("long").alias("n_ids"),
        arrays.total(F.col("position_ids")).alias("position_sum"))


@query("right_clip", """
WITH s AS (
  SELECT conv_id AS trajectory_id, turn AS seg_idx, turn = 0 AS is_prompt,
         len(regexp_extract_all(text, '\\S+')) AS n, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS bit
  FROM conversations),
r AS (SELECT *, sum(CASE WHEN is_prompt THEN 0 ELSE n END) OVER (PARTITION BY trajectory_id ORDER BY seg_idx) AS upto
      FROM s),
k AS (SELECT *, CASE WHEN is_prompt THEN 0 ELSE least(n, greatest(40 - (upto - n), 0)) END AS kept FROM r),
a AS (SELECT trajectory_id, sum(CASE WHEN is_prompt THEN n ELSE 0 END) AS prompt, sum(kept) AS resp,
             sum(kept * bit) AS trained FROM k GROUP BY 1)
SELECT trajectory_id, CAST(greatest(prompt, 1) AS BIGINT) AS prompt_tokens,
       CAST(CASE WHEN resp = 0 THEN 1 ELSE trained END AS BIGINT) AS response_tokens,
       CAST(greatest(prompt, 1) + greatest(resp, 1) AS BIGINT) AS total_trajectory_tokens
FROM a""")
def right_clip(spark, sf):
    kind = (F.when(F.col("turn") == 0, F.lit("prompt")).when(F.col("role") == "assistant", F.lit("generated"))
            .otherwise(F.lit("tool")))
    segments = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("seg_idx"), kind.alias("kind"),
        tk.word_ids(F.col("text")).alias("ids"))
    out = tk.accumulate_segments(segments, response_length=40)
    return out.select("trajectory_id", "prompt_tokens", "response_tokens", "total_trajectory_tokens")


@query("prefix_deltas", """
WITH p AS (
  SELECT conv_id, turn, len(regexp_extract_all(string_split(text, chr(10))[1], '\\S+')) AS n0,
         len(regexp_extract_all(text, '\\S+')) AS n1 FROM conversations)
SELECT conv_id, turn, 0 AS msg_idx, CAST(n0 AS BIGINT) AS n_delta FROM p
UNION ALL SELECT conv_id, turn, 1, CAST(n1 - n0 AS BIGINT) FROM p""")
def prefix_deltas(spark, sf):
    # Two prefixes of every message: its first line, and all of it.
    both = F.array(F.split("text", "\n")[0], F.col("text"))
    prefixes = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(both).alias("msg_idx", "_text")).select(
        "conv_id", "turn", "msg_idx", tk.word_ids(F.col("_text")).alias("prefix_ids"))
    out = tk.prefix_deltas(prefixes, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "msg_idx", F.size("ids").cast("long").alias("n_delta"))


# Assistant messages open with reasoning, which the template drops once the user has spoken again.
PREFIX_SQL = """
said AS (
  SELECT conv_id AS trajectory_id, turn AS msg_idx, role,
         CASE WHEN role = 'assistant' THEN '<think>' || left(text, 40) || '</think>' || chr(10) || text ELSE text END AS content, text,
         max(CASE WHEN role = 'user' THEN turn END) OVER w AS asked,
         lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AND role <> 'assistant' AS prompt
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
prefixes AS (
  SELECT a.trajectory_id, a.msg_idx, any_value(a.role) AS role, regexp_extract_all(
         string_agg('<|im_start|>' || b.role || chr(10) || CASE WHEN b.role = 'assistant' AND b.msg_idx < a.asked
                    THEN ltrim(b.text, chr(10)) ELSE b.content END || '<|im_end|>' || chr(10), '' ORDER BY b.msg_idx)
         || CASE WHEN any_value(a.prompt) THEN '<|im_start|>assistant' || chr(10) ELSE '' END, '\\S+') AS words
  FROM said a JOIN said b ON a.trajectory_id = b.trajectory_id AND b.msg_idx <= a.msg_idx GROUP BY 1, 2),
deltas AS (
  SELECT trajectory_id, msg_idx, role, len(words) AS n, list_slice(words, coalesce(lag(len(words)) OVER w, 0) + 1, len(words)) AS added
  FROM prefixes WINDOW w AS (PARTITION BY trajectory_id ORDER BY msg_idx))"""


def word_model():
    """Words as tokens, each under its length. Words end at the template's marks only with the line after them."""
    template = chat.TEMPLATES["chatml-thinking"]
    return chat.ChatModel(lambda text: [len(w) for w in text.split()], template.render, lambda text: text.rfind("<|im_end|>\n") + 11
                          if "<|im_end|>\n" in text else 0)


def _thinking(spark, sf) -> DataFrame:
    content = F.when(F.col("role") == "assistant", F.concat(
        F.lit("<think>"), F.left("content", F.lit(40)), F.lit("</think>\n"), F.col("content"))).otherwise(F.col("content"))
    return messages(spark, sf).withColumn("content", content)


@query("chat_prefixes", f"""
WITH {PREFIX_SQL}
SELECT trajectory_id, msg_idx, CAST(n AS BIGINT) AS n_prefix, CAST(len(added) AS BIGINT) AS n_delta,
       CAST(coalesce(list_sum(list_transform(added, lambda x: length(x))), 0) AS BIGINT) AS id_sum, false AS fallback
FROM deltas""")
def chat_prefixes(spark, sf):
    out = chat.tokenize_chat(_thinking(spark, sf), word_model)
    return out.select("trajectory_id", "msg_idx", "n_prefix", F.size("ids").cast("long").alias("n_delta"),
                      arrays.total(F.col("ids")).alias("id_sum"), "fallback")


@query("chat_trajectories", f"""
WITH {PREFIX_SQL},
back AS (SELECT *, len(added) AS k, sum(len(added)) OVER (PARTITION BY trajectory_id ORDER BY msg_idx DESC) AS upto FROM deltas),
kept AS (SELECT *, least(k, greatest(90 - (upto - k), 0)) AS r FROM back)
SELECT trajectory_id, CAST(sum(r) AS BIGINT) AS total_trajectory_tokens,
       CAST(sum(r) FILTER (role = 'assistant') AS BIGINT) AS response_tokens, sum(k) > 90 AS truncated,
       CAST(sum(coalesce(list_sum(list_transform(list_slice(added, k - r + 1, k), lambda x: length(x))), 0)) AS BIGINT) AS id_sum
FROM kept GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') > 0""")
def chat_trajectories(spark, sf):
    """Training rows of the most recent 90 tokens, from a template that rewrites earlier messages."""
    out = tk.adapt_trajectories(chat.tokenize_chat(_thinking(spark, sf), word_model), budget=90)
    spoken = messages(spark, sf).filter(F.col("role") == "assistant").select("trajectory_id")
    return out.join(spoken, "trajectory_id", "left_semi").select(
        "trajectory_id", "total_trajectory_tokens", "response_tokens", "truncated", arrays.total(F.col("input_ids")).alias("id_sum"))


@query("chat_text", """
SELECT conv_id, turn,
       md5('system: You are a helpful assistant that can interact with a computer shell.' || chr(10)
           || 'user: <task>' || text || '</task>') AS digest,
       CAST(length(text) + 96 AS BIGINT) AS n_chars
FROM conversations""")
def chat_text(spark, sf):
    from trajlake.functions.text import chat_text as linear
    from trajlake.functions.text import render_prompt

    prompt = linear(render_prompt(F.col("text"), instance="<task>{{task}}</task>"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(prompt.cast("binary")).alias("digest"), F.length(prompt).cast("long").alias("n_chars"))


@query("trained_share", f"""
WITH {COUNTS_SQL}
SELECT trajectory_id, round(sum(n * bit)::DOUBLE / sum(n)::DOUBLE, 6) AS trained_share FROM m GROUP BY 1""")
def trained_share(spark, sf):
    counted = tk.message_tokens(messages(spark, sf)).groupBy("trajectory_id")
    return rounded(counted.agg((F.sum("mask_sum") / F.sum("n_tokens")).alias("trained_share")))
