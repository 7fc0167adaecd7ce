from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.predicates import ERROR_PATTERN, NOISE_PATTERN
from trajlake.operators import runlog as rl
from trajlake.plans.catalog import query, rounded, table

# Daily event statistics written out as step lines; step = day of month - 1.
LONG_SQL = """
daily AS (
  SELECT CAST(day(ts) - 1 AS BIGINT) AS step, event_type AS e, count(*) AS n, round(max(value), 3) AS top,
         round(min(value), 3) AS low FROM events GROUP BY 1, 2),
long AS (
  SELECT step, e || '/n' AS metric, CAST(n AS DOUBLE) AS value FROM daily
  UNION ALL SELECT step, e || '/count', CAST(n AS DOUBLE) FROM daily
  UNION ALL SELECT step, e || '/top', top FROM daily
  UNION ALL SELECT step, 'val-' || e || '/low', low FROM daily
  UNION ALL SELECT step, e || '/zero', 0.0 FROM daily)"""


def log_lines(spark, sf) -> DataFrame:
    daily = table(spark, sf, "events").groupBy(
        (F.dayofmonth("ts") - 1).alias("step"), F.col("event_type").alias("e")).agg(
        F.count("*").alias("n"), F.round(F.max("value"), 3).alias("top"), F.round(F.min("value"), 3).alias("low"))

    def pair(name, value, prefix=""):
        return F.concat(F.lit(prefix), F.col("e"), F.lit(f"/{name}:"), value.cast("string"))

    n = F.col("n")
    line = F.concat(
        F.lit("\x1b[36m(worker)\x1b[0m step:"), F.col("step").cast("string"), F.lit(" - "),
        F.concat_ws(" - ", pair("n", n), pair("count", n), pair("top", F.col("top")),
                    pair("low", F.col("low"), "val-"), pair("zero", F.lit(0.0)), pair("skip", F.lit("nan"))))
    return daily.select(line.alias("value")).unionByName(
        daily.select(F.concat(F.lit("epoch done "), F.col("e")).alias("value")))


@query("run_log", f"WITH {LONG_SQL} SELECT step, metric, value FROM long")
def run_log(spark, sf):
    return rl.parse_step_lines(log_lines(spark, sf))


_CELLS = ", ".join(f"max(value) FILTER (step = {s}) AS step_{s}" for s in range(31))


@query("metric_matrix", f"WITH {LONG_SQL} SELECT metric, {_CELLS} FROM long GROUP BY 1")
def metric_matrix(spark, sf):
    return rl.metric_matrix(rl.parse_step_lines(log_lines(spark, sf)), range(31))


@query("metric_audit", f"""
WITH {LONG_SQL},
s AS (SELECT metric, count(*) AS n_steps, max(abs(value)) = 0 AS always_zero, list((step, value) ORDER BY step) AS v
      FROM long GROUP BY 1)
SELECT metric, n_steps, always_zero,
       nullif(min(metric) OVER (PARTITION BY v), metric) AS twin_of, count(*) OVER (PARTITION BY v) > 1 AS has_twin
FROM s""")
def metric_audit(spark, sf):
    return rl.metric_audit(rl.parse_step_lines(log_lines(spark, sf)))


@query("emission_coverage", f"""
WITH {LONG_SQL}
SELECT step, string_split(metric, '/')[1] AS prefix, count(DISTINCT metric) AS n_metrics, count(*) AS n_values,
       step = 0 AND NOT starts_with(metric, 'val-') AS unexpected
FROM long GROUP BY 1, 2, 5""")
def emission_coverage(spark, sf):
    return rl.emission_coverage(rl.parse_step_lines(log_lines(spark, sf)))


LINES_SQL = """
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (
  SELECT doc_id, source, line_no,
         CASE (doc_id + line_no) % 9 WHEN 0 THEN 'RuntimeError: ' || line WHEN 1 THEN 'w.py: UserWarning ' || line
              WHEN 2 THEN ' ' WHEN 3 THEN 'process killed ' || line ELSE line END AS value FROM l)"""


def doc_lines(spark, sf) -> DataFrame:
    """Document lines as a log, some of them failures or noise."""
    split = table(spark, sf, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kind, line = (F.col("doc_id") + F.col("line_no")) % 9, F.col("line")
    value = (F.when(kind == 0, F.concat(F.lit("RuntimeError: "), line))
             .when(kind == 1, F.concat(F.lit("w.py: UserWarning "), line)).when(kind == 2, F.lit(" "))
             .when(kind == 3, F.concat(F.lit("process killed "), line)).otherwise(line))
    return split.select("doc_id", "source", F.col("line_no").cast("long").alias("line_no"), value.alias("value"))


_ERROR = ERROR_PATTERN.replace("'", "''")
_NOISE = NOISE_PATTERN


@query("error_lines", f"""
WITH {LINES_SQL} SELECT source, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS line_sum
FROM lines WHERE regexp_matches(value, '{_ERROR}') GROUP BY 1""")
def error_lines(spark, sf):
    return rl.error_lines(doc_lines(spark, sf)).groupBy("source").agg(
        F.count("*").alias("n"), F.sum("line_no").alias("line_sum"))


@query("clean_lines", f"""
WITH {LINES_SQL} SELECT source, count(*) AS n FROM lines WHERE NOT regexp_matches(value, '{_NOISE}') GROUP BY 1""")
def clean_lines(spark, sf):
    return rl.clean_lines(doc_lines(spark, sf)).groupBy("source").agg(F.count("*").alias("n"))


@query("error_tail", f"""
WITH {LINES_SQL} SELECT doc_id, line_no, value FROM lines WHERE regexp_matches(value, '{_ERROR}')
ORDER BY doc_id DESC, line_no DESC LIMIT 8""")
def error_tail(spark, sf):
    return rl.tail_lines(rl.error_lines(doc_lines(spark, sf)), ["doc_id", "line_no"]).select("doc_id", "line_no", "value")


@query("run_verdict", """
SELECT lang || n_chars % 5 AS run, bool_or(doc_id % 40 = 0) AS reached, bool_or(doc_id % 3 = 0) AS saved,
       CASE WHEN bool_or(doc_id % 40 = 0) THEN 'SUCCESS' ELSE 'DIED' END AS verdict
FROM documents GROUP BY 1""")
def run_verdict(spark, sf):
    line = (F.when(F.col("doc_id") % 40 == 0, F.lit("at global_\x1b[1mstep_6 now")).otherwise(F.lit("global_step_5")))
    lines = table(spark, sf, "documents").select(
        F.concat("lang", (F.col("n_chars") % 5).cast("string")).alias("run"),
        F.concat(line, F.when(F.col("doc_id") % 3 == 0, F.lit(" Saved")).otherwise(F.lit(""))).alias("value"))
    return rl.run_verdict(lines, ["run"])


@query("status_counts", """
SELECT o_orderstatus AS status, count(*) AS n, CAST((SELECT count(*) FROM orders) AS BIGINT) AS processed
FROM orders GROUP BY 1""")
def status_counts(spark, sf):
    return rl.status_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))
