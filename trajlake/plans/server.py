from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import epoch_seconds
from trajlake.operators import servermon as sm
from trajlake.plans.catalog import query, rounded, table

# Events as samples of a server: one step per day, counters from the running event number.
SAMPLES_SQL = """
samples AS (
  SELECT strftime(ts, '%Y-%m-%d') AS step, epoch_us(ts) / 1e6 AS t, event_id, user_id, value,
         CAST(user_id % 20 AS DOUBLE) AS running, CAST(greatest(event_id % 7 - 5, 0) AS DOUBLE) AS queue,
         CAST(event_id % 100 AS DOUBLE) / 100 AS usage
  FROM events)"""


def samples(spark, sf, events: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf, "events") if events is None else events

    def d(col):
        return col.cast("double")

    n = F.col("event_id")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("step"), epoch_seconds(F.col("ts")).alias("t"),
        d(F.col("user_id") % 20).alias("num_running_reqs"),
        d(F.greatest(n % 7 - 5, F.lit(0))).alias("num_queue_reqs"), F.col("value").alias("gen_throughput"),
        (d(n % 100) / 100).alias("token_usage"), (d(n % 10) / 10).alias("cache_hit_rate"),
        (d(n) * 0.5).alias("time_to_first_token_seconds_sum"), d(n).alias("time_to_first_token_seconds_count"),
        d(n % 1000).alias("e2e_request_latency_seconds_sum"), d(n % 100).alias("e2e_request_latency_seconds_count"),
        d(n * 3).alias("prompt_tokens_total"), d(n * 2).alias("cached_tokens_total"),
        d(n % 1000).alias("generation_tokens_total"))


DRAIN_SQL = f"""{SAMPLES_SQL},
spans AS (
  SELECT step, min(t) FILTER (running > 0) AS s, max(t) FILTER (running > 0) AS e, max(running) AS peak,
         max(usage) AS usage_peak, count(*) AS n FROM samples GROUP BY 1),
last_full AS (
  SELECT p.step, max(t) FILTER (t BETWEEN s AND e AND (queue > 0 OR running >= peak)) AS f
  FROM samples x JOIN spans p ON x.step = p.step GROUP BY 1),
drain AS (
  SELECT p.step, coalesce(f, s) - s AS off, e - coalesce(f, s) AS win, e - s AS busy, peak, usage_peak, n
  FROM spans p JOIN last_full l ON p.step = l.step WHERE s IS NOT NULL)"""

DRAIN_COLUMNS = """round(off, 3) AS "srv/drain_start_offset_s", round(win, 3) AS "srv/drain_window_s",
  round(CASE WHEN busy > 0 THEN win / busy ELSE 0 END, 3) AS "srv/drain_ratio", round(busy, 3) AS "srv/gpu_busy_s",
  peak AS "srv/running_peak", peak AS "srv/capacity", usage_peak AS "srv/token_usage_peak",
  CAST(n AS DOUBLE) AS "srv/samples" """

LATENCY_SQL = """
ends AS (
  SELECT step, count(*) AS cnt, arg_min(event_id, t) AS a, arg_max(event_id, t) AS b,
         avg(value) FILTER (running > 0 AND value > 0) AS tput,
         avg(event_id % 10 / 10.0) FILTER (running > 0) AS hit
  FROM samples GROUP BY 1),
lat AS (
  SELECT step, CASE WHEN b - a > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS ttft,
         CASE WHEN b % 100 - a % 100 > 0 THEN (b % 1000 - a % 1000)::DOUBLE / (b % 100 - a % 100) ELSE 0 END AS e2e,
         (b - a) * 3.0::DOUBLE AS prompt, (b - a) * 2.0::DOUBLE AS cached,
         greatest(b % 1000 - a % 1000, 0)::DOUBLE AS gen, coalesce(tput, 0) AS tput, coalesce(hit, 0) AS hit
  FROM ends WHERE cnt >= 2)"""

LATENCY_COLUMNS = """ttft AS "srv/ttft_mean_s", 0.0::DOUBLE AS "srv/inter_token_latency_mean_s",
  round(e2e, 3) AS "srv/e2e_latency_mean_s", 0.0::DOUBLE AS "srv/queue_time_mean_s",
  CAST(prompt AS DOUBLE) AS "srv/prompt_tokens", gen AS "srv/generation_tokens", CAST(cached AS DOUBLE) AS "srv/cached_tokens",
  0.0::DOUBLE AS "srv/num_requests",
  round(CASE WHEN prompt > 0 THEN cached / prompt ELSE 0 END, 3) AS "srv/prefix_cache_hit_frac",
  round(tput, 3) AS "srv/gen_throughput_mean", round(hit, 3) AS "srv/cache_hit_rate_mean" """


@query("drain_summary", f"WITH {DRAIN_SQL} SELECT step, {DRAIN_COLUMNS} FROM drain")
def drain_summary(spark, sf):
    return rounded(sm.drain_summary(samples(spark, sf)), 3)


@query("latency_breakdown", f"WITH {SAMPLES_SQL}, {LATENCY_SQL} SELECT step, {LATENCY_COLUMNS} FROM lat")
def latency_breakdown(spark, sf):
    return rounded(sm.latency_breakdown(samples(spark, sf)), 3)


@query("server_summary", f"""
WITH {DRAIN_SQL}, {LATENCY_SQL}
SELECT d.step, {DRAIN_COLUMNS}, {LATENCY_COLUMNS} FROM drain d LEFT JOIN lat l ON d.step = l.step""")
def server_summary(spark, sf):
    return rounded(sm.server_summary(samples(spark, sf)), 3)


def scrapes(spark, sf) -> DataFrame:
    """Every event as one scraped text: labels, an extra time stamp, comments, bad values."""
    number = F.col("value").cast("string")
    text = F.concat(
        F.lit("# HELP sglang:num_running_reqs running\n"),
        F.lit('sglang:num_running_reqs{dp="0"} '), (F.col("user_id") % 20).cast("string"),
        F.lit('\n  sglang:num_running_reqs{dp="1"}   1\n\nsglang:num_queue_reqs '), (F.col("event_id") % 7).cast("string"),
        F.lit("\nsglang:gen_throughput "), number, F.lit("\nplain "), number, F.lit("e0"),
        F.lit("\nbad NaN\nworse +Inf\ntwo 1 2\nlonely\nsglang:late{x=\"y\"} 3 17\nd 1d\n"))
    return table(spark, sf, "events").select("event_id", text.alias("text"))


@query("exposition_roundtrip", """
SELECT event_id, name, CAST(v AS DOUBLE) AS value FROM (
  SELECT event_id, 'num_running_reqs' AS name, user_id % 20 + 1 AS v FROM events
  UNION ALL SELECT event_id, 'num_queue_reqs', event_id % 7 FROM events
  UNION ALL SELECT event_id, 'gen_throughput', value FROM events
  UNION ALL SELECT event_id, 'plain', value FROM events
  UNION ALL SELECT event_id, 'late', 17 FROM events)""")
def exposition_roundtrip(spark, sf):
    return sm.parse_exposition(scrapes(spark, sf), ["event_id"])


@query("exposition_gauges", """
SELECT event_id, CAST(user_id % 20 + 1 AS DOUBLE) AS running, CAST(event_id % 7 AS DOUBLE) AS queue,
       value AS throughput, 0.0::DOUBLE AS usage
FROM events""")
def exposition_gauges(spark, sf):
    wide = sm.gauges(sm.to_samples(scrapes(spark, sf), ["event_id"]))
    return wide.select("event_id", "running", "queue", "throughput", "usage")


@query("exposition_snapshots", """
SELECT event_id, 5 AS n_metrics, CAST(user_id % 20 + 1 AS DOUBLE) AS running FROM events""")
def exposition_snapshots(spark, sf):
    snaps = sm.to_snapshots(scrapes(spark, sf), ["event_id"])
    return snaps.select("event_id", F.size("raw").alias("n_metrics"), F.col("raw")["num_running_reqs"].alias("running"))


STEPS_SQL = """
steps AS (SELECT epoch_us(ts) // 86400000000 AS step, min(epoch_us(ts) / 1e6) AS t_start, max(epoch_us(ts) / 1e6) AS t_end
          FROM events WHERE event_type <> 'click' GROUP BY 1)"""


@query("assign_steps", f"""
WITH {STEPS_SQL}
SELECT e.event_id, CAST(s.step AS BIGINT) AS step FROM events e
JOIN steps s ON epoch_us(e.ts) / 1e6 >= s.t_start AND epoch_us(e.ts) / 1e6 <= s.t_end""")
def assign_steps(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", epoch_seconds(F.col("ts")).alias("t"))
    steps = e.filter(F.col("event_type") != "click").groupBy(F.floor(F.col("t") / 86400).alias("step")).agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    return sm.assign_steps(e.drop("event_type"), steps, width=3600.0).select("event_id", "step")


@query("assign_open_steps", """
WITH b AS (SELECT epoch_us(min(ts)) / 1e6 AS lo, epoch_us(max(ts)) / 1e6 AS hi FROM events),
steps AS (
  SELECT 'from the start' AS step, NULL AS t_start, lo + 86400 AS t_end FROM b
  UNION ALL SELECT 'to the end', hi - 5 * 86400, NULL FROM b
  UNION ALL SELECT 'always', NULL, NULL FROM b
  UNION ALL SELECT 'within', lo + 1000.5, lo + 3 * 86400 FROM b
  UNION ALL SELECT 'backwards', hi, lo FROM b
  UNION ALL SELECT 'day ' || epoch_us(ts) // 86400000000, min(epoch_us(ts)) / 1e6, max(epoch_us(ts)) / 1e6 FROM events GROUP BY 1)
SELECT s.step, count(*) AS n, CAST(sum(e.event_id) AS BIGINT) AS ids FROM events e
JOIN steps s ON (t_start IS NULL OR epoch_us(e.ts) / 1e6 >= t_start) AND (t_end IS NULL OR epoch_us(e.ts) / 1e6 <= t_end)
GROUP BY 1""")
def assign_open_steps(spark, sf):
    """Nested, overlapping and open windows; the join is dealt over several tasks."""
    e = table(spark, sf, "events").select("event_id", epoch_seconds(F.col("ts")).alias("t"))
    none = F.lit(None).cast("double")

    def window(name, start, end):
        return F.struct(F.lit(name).alias("step"), start.alias("t_start"), end.alias("t_end"))

    b = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    lo, hi, day = F.col("lo"), F.col("hi"), 86400
    made = b.select(F.inline(F.array(
        window("from the start", none, lo + day), window("to the end", hi - 5 * day, none), window("always", none, none),
        window("within", lo + 1000.5, lo + 3 * day), window("backwards", hi, lo))))
    daily = e.groupBy(F.concat(F.lit("day "), F.floor(F.col("t") / day)).alias("step")).agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    out = sm.assign_steps(e, made.unionByName(daily), broadcast=False)
    return out.groupBy("step").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("window_samples", f"""
WITH {SAMPLES_SQL}, b AS (SELECT min(t) + 86400 AS lo, min(t) + 3 * 86400 AS hi FROM samples)
SELECT step, count(*) AS n FROM samples, b WHERE t >= lo AND t <= hi GROUP BY 1""")
def window_samples(spark, sf):
    s = samples(spark, sf).select("step", "t")
    first = s.agg(F.min("t")).scalar()
    return sm.window_samples(s, first + 86400, first + 3 * 86400).groupBy("step").agg(F.count("*").alias("n"))


def _replicas(spark, sf):
    kind = F.col("user_id") % 5
    name = (F.when(kind == 0, F.lit("sglang_server_reward_0")).when(kind == 1, F.lit("sglang_server_teacher_0"))
            .when(kind == 2, F.lit("other")).otherwise(F.concat(F.lit("sglang_server_"), kind.cast("string"), F.lit("_0"))))
    return table(spark, sf, "events").select(name.alias("replica"), "value")


@query("select_replica", """
SELECT 'sglang_server_3_0' AS replica, count(*) AS n, round(sum(value), 2) AS total
FROM events WHERE user_id % 5 = 3""")
def select_replica(spark, sf):
    out = sm.select_replica(_replicas(spark, sf)).groupBy("replica")
    return rounded(out.agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("all_replicas", """
SELECT 'sglang_server_' || user_id % 5 || '_0' AS replica, count(*) AS n FROM events WHERE user_id % 5 >= 3 GROUP BY 1""")
def all_replicas(spark, sf):
    return sm.select_replica(_replicas(spark, sf), per_replica=True).groupBy("replica").agg(F.count("*").alias("n"))
