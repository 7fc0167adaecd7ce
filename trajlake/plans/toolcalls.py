from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import toolcalls as tc
from trajlake.operators import episodes as ep
from trajlake.plans.catalog import query, table


def call_turns(spark, sf) -> DataFrame:
    """Documents as assistant turns, wrapped in one of six call shapes.

    0 canonical, 1 without arguments, 2 arguments as plain text, 3 unescaped text inside
    JSON, 4 cut off, 5 no call.
    """
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\\"), F.lit("/")).alias("text"))
    command = F.to_json(F.struct(F.col("text").alias("command")))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)

    def wrapped(*parts):
        return F.concat(F.lit("I will run <tool_call>"), *parts, F.lit("</tool_call>"))

    raw = (
        F.when(F.col("doc_id") % 6 == 0, wrapped(F.lit('{"name": "bash", "arguments": '), command, F.lit("}")))
        .when(F.col("doc_id") % 6 == 1, wrapped(F.lit("\n"), command, F.lit("\n")))
        .when(F.col("doc_id") % 6 == 2, wrapped(F.lit('{"name": "sh", "arguments": '), quoted, F.lit("}")))
        .when(F.col("doc_id") % 6 == 3, wrapped(
            F.lit('{"name": "bash", "arguments": {"command": "'), F.col("text"), F.lit('"}}')))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("<tool_call>"), command))
        .otherwise(F.col("text")))
    return docs.select(F.col("doc_id").alias("trajectory_id"), F.lit(1).cast("long").alias("turn"), raw.alias("raw_text"))


CALLS_SQL = """
d AS (SELECT doc_id, doc_id % 6 AS v, replace(text, chr(92), '/') AS text FROM documents),
c AS (
  SELECT doc_id, v, text, v <= 4 AS attempted,
         CASE WHEN v IN (0, 1, 2, 3) AND NOT (v IN (1, 3) AND text = '') THEN 1 ELSE 0 END AS n_calls,
         v = 1 OR (v = 3 AND regexp_matches(text, '[\\x00-\\x1f"]')) AS salvaged
  FROM d)"""


@query("toolcall_salvage", f"""
WITH {CALLS_SQL}
SELECT doc_id AS trajectory_id, attempted, CAST(n_calls AS BIGINT) AS n_calls, salvaged,
       CASE v WHEN 2 THEN 'sh' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'bash' END AS name,
       md5(CASE v WHEN 2 THEN '' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE text END) AS command_digest,
       CASE WHEN v <= 3 THEN 'ok' WHEN v = 4 THEN '<format_error>' ELSE '<no_tool_call>' END AS kind
FROM c""")
def toolcall_salvage(spark, sf):
    calls = ep.extract_calls(call_turns(spark, sf))
    first = F.try_element_at("calls", F.lit(1))
    n_calls = F.size("calls").cast("long")
    return calls.select(
        "trajectory_id", "attempted", n_calls.alias("n_calls"), "salvaged", first["name"].alias("name"),
        F.md5(first["command"].cast("binary")).alias("command_digest"),
        tc.turn_kind(n_calls, F.col("attempted")).alias("kind"))


@query("tool_call_rows", f"""
WITH {CALLS_SQL}
SELECT doc_id AS trajectory_id, 0 AS call_idx, salvaged, CASE v WHEN 2 THEN -1 END AS returncode,
       CASE v WHEN 2 THEN 'Unknown tool ''sh''. Only ''bash'' is available.' END AS error
FROM c WHERE n_calls = 1""")
def tool_call_rows(spark, sf):
    return ep.extract_tool_calls(call_turns(spark, sf)).select(
        "trajectory_id", "call_idx", "salvaged", "returncode", "error")


@query("turn_outcomes", f"""
WITH {CALLS_SQL}
SELECT attempted, salvaged, count(*) AS n, CAST(sum(n_calls) AS BIGINT) AS n_calls,
       CAST(sum(CASE WHEN salvaged THEN n_calls ELSE 0 END) AS BIGINT) AS n_salvaged
FROM c GROUP BY 1, 2""")
def turn_outcomes(spark, sf):
    turns = call_turns(spark, sf).withColumns({
        "gen_tokens": F.lit(1), "tool_tokens": F.lit(1), "submitted_call_idx": F.lit(None).cast("int"),
        "crashed_type": F.lit(None).cast("string")})
    out = ep.turn_outcomes(turns)
    return out.groupBy("attempted", (F.col("n_salvaged") > 0).alias("salvaged")).agg(
        F.count("*").alias("n"), F.sum("n_calls").alias("n_calls"), F.sum("n_salvaged").alias("n_salvaged"))


@query("unescape", """
WITH d AS (SELECT doc_id, replace(text, chr(92), '') AS text FROM documents)
SELECT doc_id, md5(replace(replace(text, 'e', chr(10)), 'a', chr(92) || 'd')) AS digest FROM d""")
def unescape(spark, sf):
    clean = F.replace("text", F.lit("\\"), F.lit(""))
    escaped = F.replace(F.replace(clean, F.lit("e"), F.lit("\\n")), F.lit("a"), F.lit("\\d"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tc.unescape_once(escaped).cast("binary")).alias("digest"))


@query("lenient_command", """
WITH d AS (SELECT doc_id, replace(text, chr(92), '') AS text FROM documents)
SELECT doc_id, 'tool' || doc_id AS name, md5(text) AS digest FROM d""")
def lenient_command(spark, sf):
    clean = F.replace("text", F.lit("\\"), F.lit(""))
    block = F.concat(F.lit('{"name": "tool'), F.col("doc_id").cast("string"), F.lit('", "command" : "'), clean,
                     F.lit('" , "timeout": 1}'))
    return table(spark, sf, "documents").select(
        "doc_id", tc.lenient_name(block).alias("name"), F.md5(tc.lenient_command(block).cast("binary")).alias("digest"))
