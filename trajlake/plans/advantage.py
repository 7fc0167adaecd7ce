from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import arrays
from trajlake.operators import advantage as adv
from trajlake.plans.catalog import query, rounded, table

REWARDS_SQL = """
rewards AS (
  SELECT l.doc_id, d.source, CAST(l.quality AS DOUBLE) AS reward, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def rewards(spark, sf) -> DataFrame:
    """Labelled documents as graded attempts: group = source, reward = quality."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("reward"))
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return labels.join(docs, "doc_id")


def _advantage(spark, sf, std_normalize: bool) -> DataFrame:
    out = adv.group_advantage(rewards(spark, sf), ["source"], std_normalize=std_normalize, spread_by=["doc_id"])
    return rounded(out.select("doc_id", "source", "reward", "group_mean", "group_std", "advantage"))


@query("grpo_advantage", f"""
WITH {REWARDS_SQL}
SELECT doc_id, source, reward,
       round(avg(reward) OVER g, 6) AS group_mean, round(stddev_pop(reward) OVER g, 6) AS group_std,
       round((reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6), 6) AS advantage
FROM rewards WINDOW g AS (PARTITION BY source)""")
def grpo_advantage(spark, sf):
    return _advantage(spark, sf, True)


@query("grpo_advantage_centered", f"""
WITH {REWARDS_SQL}
SELECT doc_id, source, reward,
       round(avg(reward) OVER g, 6) AS group_mean, round(stddev_pop(reward) OVER g, 6) AS group_std,
       round(reward - avg(reward) OVER g, 6) AS advantage
FROM rewards WINDOW g AS (PARTITION BY source)""")
def grpo_advantage_centered(spark, sf):
    return _advantage(spark, sf, False)


@query("grpo_reward_signal", f"""
WITH {REWARDS_SQL},
groups AS (SELECT source, min(reward) <> max(reward) AS mixed FROM rewards GROUP BY source)
SELECT 'all' AS run,
       round((SELECT avg(reward) FROM rewards), 6) AS "grpo/mean_reward",
       round((SELECT avg(CASE WHEN reward >= 1.0 THEN 1.0 ELSE 0.0 END) FROM rewards), 6) AS "grpo/resolve_rate",
       round(avg(CASE WHEN mixed THEN 1.0 ELSE 0.0 END), 6) AS "grpo/informative_group_frac",
       CAST(count(*) AS DOUBLE) AS "grpo/num_groups"
FROM groups""")
def grpo_reward_signal(spark, sf):
    df = rewards(spark, sf).withColumn("run", F.lit("all"))
    return rounded(adv.reward_signal(df, ["run", "source"], by=["run"]))


@query("group_stats", """
SELECT o_custkey AS instance_id, count(*) AS group_size,
       round(avg(o_totalprice), 6) AS group_mean, round(stddev_pop(o_totalprice), 6) AS group_std,
       min(o_totalprice) = max(o_totalprice) AS uniform
FROM orders GROUP BY 1""")
def group_stats(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("instance_id"), "o_totalprice")
    return rounded(adv.group_stats(orders, ["instance_id"], "o_totalprice"))


@query("large_group_advantage", """
WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS reward
           FROM orders)
SELECT o_orderkey, o_custkey, reward,
       round(CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0.0
             ELSE (reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6) END, 6) AS advantage
FROM r WINDOW g AS (PARTITION BY o_custkey)""")
def large_group_advantage(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("double").alias("reward"))
    out = adv.group_advantage(orders, ["o_custkey"], spread_by=["o_orderkey"])
    return rounded(out.select("o_orderkey", "o_custkey", "reward", "advantage"))


@query("heavy_group_advantage", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS grp,
                  CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM orders)
SELECT o_orderkey, grp, reward,
       round(CASE WHEN min(reward) OVER g = max(reward) OVER g THEN 0.0
             ELSE (reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6) END, 6) AS advantage
FROM r WINDOW g AS (PARTITION BY grp)""")
def heavy_group_advantage(spark, sf):
    """One group holds a third of the rows, and the statistics are too large to broadcast."""
    out = adv.group_advantage(_heavy_orders(spark, sf), ["grp"], spread_by=["o_orderkey"], broadcast=False)
    return rounded(out.select("o_orderkey", "grp", "reward", "advantage"))


def _heavy_orders(spark, sf) -> DataFrame:
    grp = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey"))
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", grp.alias("grp"), (F.col("o_orderstatus") == "F").cast("double").alias("reward"))


@query("heavy_group_ordinal", """
SELECT o_orderkey, grp, row_number() OVER (PARTITION BY grp ORDER BY o_orderdate, o_orderkey) - 1 AS group_idx
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS grp FROM orders)""")
def heavy_group_ordinal(spark, sf):
    """Arrival positions by date, of a group with a third of the rows among others."""
    orders = _heavy_orders(spark, sf)
    return adv.group_ordinal(orders, ["o_orderdate", "o_orderkey"], ["grp"]).select("o_orderkey", "grp", "group_idx")


@query("group_ordinal", """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS group_idx
FROM orders""")
def group_ordinal(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return adv.group_ordinal(orders, "o_orderkey", ["o_custkey"]).select("o_orderkey", "o_custkey", "group_idx")


@query("token_advantages", f"""
WITH {REWARDS_SQL},
a AS (SELECT doc_id, n_chars % 5 + 1 AS n, reward - avg(reward) OVER (PARTITION BY source) AS advantage
      FROM rewards)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST((n + 1) // 2 AS BIGINT) AS n_trained,
       round(advantage * ((n + 1) // 2), 6) AS advantage_sum
FROM a""")
def token_advantages(spark, sf):
    df = adv.group_advantage(rewards(spark, sf), ["source"], std_normalize=False, spread_by=["doc_id"])
    mask = F.transform(F.sequence(F.lit(1), F.col("n_chars") % 5 + 1), lambda i: (i % 2).cast("int"))
    spread = df.withColumn("response_mask", mask).withColumn(
        "token_advantages", arrays.token_advantages(F.col("advantage"), F.col("response_mask")))
    return rounded(spread.select(
        "doc_id", F.size("token_advantages").cast("long").alias("n_tokens"),
        arrays.total(F.col("response_mask")).alias("n_trained"),
        F.aggregate("token_advantages", F.lit(0.0), lambda a, x: a + x).alias("advantage_sum")))


@query("training_samples", f"""
WITH {REWARDS_SQL},
a AS (SELECT r.doc_id, reward - avg(reward) OVER (PARTITION BY r.source) AS advantage,
             len(regexp_extract_all(text, '\\S+')) AS n
      FROM rewards r JOIN documents d ON r.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_ids, CAST(n AS BIGINT) AS n_attended, CAST(n * (n - 1) // 2 AS BIGINT) AS position_sum,
       round(advantage * n, 4) AS advantage_sum
FROM a""")
def training_samples(spark, sf):
    from trajlake.operators.tokens import word_ids

    df = adv.group_advantage(rewards(spark, sf), ["source"], std_normalize=False, spread_by=["doc_id"])
    # Advantages are computed on narrow rows; the token arrays join last.
    docs = table(spark, sf, "documents").select("doc_id", word_ids(F.col("text")).alias("input_ids"))
    wide = df.select("doc_id", "advantage").join(docs, "doc_id").withColumn(
        "response_mask", arrays.repeat_int(1, F.size("input_ids")))
    s = adv.to_training_samples(wide, ["doc_id"])
    return rounded(s.select(
        "doc_id", F.size("input_ids").cast("long").alias("n_ids"),
        arrays.total(F.col("attention_mask")).alias("n_attended"),
        arrays.total(F.col("position_ids")).alias("position_sum"),
        F.aggregate("token_advantages", F.lit(0.0), lambda a, x: a + x).alias("advantage_sum")), 4)
