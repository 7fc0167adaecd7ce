from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.functions import text as tx
from trajlake.operators.runlog import classify_failures
from trajlake.plans.catalog import query, table


def _digest(col):
    return F.md5(col.cast("binary"))


@query("truncate_text", """
SELECT doc_id,
  md5(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || '...(truncated)...' || right(text, 200) END) AS middle,
  md5(CASE WHEN length(text) <= 400 THEN text ELSE '(truncated)...' || right(text, 400) END) AS left_cut,
  md5(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 400) || '...(truncated)' END) AS right_cut
FROM documents""")
def truncate_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", _digest(tx.truncate_text(text, 400)).alias("middle"),
        _digest(tx.truncate_text(text, 400, "left")).alias("left_cut"),
        _digest(tx.truncate_text(text, 400, "right")).alias("right_cut"))


_SQL_WARNING = tx.LONG_OUTPUT_WARNING.replace("'", "''")


@query("render_observation", f"""
SELECT doc_id, md5(
  CASE WHEN source = 'src1' THEN '<exception>boom</exception>' || chr(10) ELSE '' END
  || '<returncode>' || (doc_id % 3) || '</returncode>' || chr(10)
  || CASE WHEN length(text) < 10000 THEN '<output>' || chr(10) || text || '</output>'
     ELSE '<warning>' || chr(10) || '{_SQL_WARNING}' || chr(10) || '</warning><output_head>' || chr(10)
       || left(text, 5000) || chr(10) || '</output_head>' || chr(10) || '<elided_chars>' || chr(10)
       || (length(text) - 10000) || ' characters elided' || chr(10) || '</elided_chars>' || chr(10)
       || '<output_tail>' || chr(10) || right(text, 5000) || chr(10) || '</output_tail>' END) AS digest
FROM documents""")
def render_observation(spark, sf):
    exc = F.when(F.col("source") == "src1", F.lit("boom"))
    return table(spark, sf, "documents").select(
        "doc_id", _digest(tx.render_observation(F.col("doc_id") % 3, F.col("text"), exc)).alias("digest"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("render_format_error", f"""
SELECT doc_id, md5(CASE doc_id % 3
  WHEN 0 THEN {_sql_text(tx.CUT_OFF_TEXT)}
  WHEN 1 THEN {_sql_text(tx.CALL_ERROR_HEAD + tx.BROKEN_CALL_TEXT + tx.CALL_ERROR_TAIL)}
  ELSE {_sql_text(tx.CALL_ERROR_HEAD + tx.NO_CALL_TEXT + tx.CALL_ERROR_TAIL)} END) AS digest
FROM documents""")
def render_format_error(spark, sf):
    kind = F.col("doc_id") % 3
    raw = (F.when(kind == 0, F.concat(F.lit("<tool_call>"), F.col("text")))
           .when(kind == 1, F.concat(F.lit("<tool_call>"), F.col("text"), F.lit("</tool_call>")))
           .otherwise(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", _digest(tx.render_format_error(raw)).alias("digest"))


@query("failure_class", """
WITH m AS (
  SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' HTTP 429' WHEN 1 THEN ' Manifest Unknown '
                         WHEN 2 THEN ' read: Connection reset' ELSE ' ' END AS msg FROM documents)
SELECT doc_id,
  CASE WHEN contains(msg, '429') OR contains(lower(msg), 'timeout') OR contains(lower(msg), 'i/o')
         OR contains(lower(msg), 'eof') OR contains(lower(msg), 'unknown blob') OR contains(lower(msg), 'connection')
       THEN 'transient'
       WHEN contains(lower(msg), 'manifest unknown') OR contains(lower(msg), 'not found') THEN 'missing'
       ELSE 'permanent' END AS failure_class,
  md5(right(regexp_replace(msg, '^\\s+|\\s+$', '', 'g'), 160)) AS failure_tail
FROM m""")
def failure_class(spark, sf):
    kind = F.col("doc_id") % 5
    mark = (F.when(kind == 0, F.lit(" HTTP 429")).when(kind == 1, F.lit(" Manifest Unknown "))
            .when(kind == 2, F.lit(" read: Connection reset")).otherwise(F.lit(" ")))
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", mark).alias("text"))
    out = classify_failures(docs)
    return out.select("doc_id", "failure_class", _digest(F.col("failure_tail")).alias("failure_tail"))


@query("strip_ansi", """
SELECT doc_id, md5(text) AS digest FROM documents""")
def strip_ansi(spark, sf):
    painted = F.replace("text", F.lit(" "), F.lit("\x1b[1;31m \x1b[0m"))
    return table(spark, sf, "documents").select("doc_id", _digest(tx.strip_ansi(painted)).alias("digest"))
