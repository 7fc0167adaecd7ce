"""Group-relative advantages and reward-signal statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import arrays
from trajlake.functions.numbers import rate
from trajlake.operators.grouping import join_group_values, with_positions

GROUP = ("step", "instance_id")
EPS = 1e-6


def group_ordinal(df: DataFrame, arrival: str | Sequence[str], keys: Sequence[str] = GROUP) -> DataFrame:
    """``group_idx``: 0-based arrival position of a trajectory inside its group."""
    return with_positions(df, arrival, keys=keys, name="group_idx")


def group_stats(df: DataFrame, keys: Sequence[str] = GROUP, reward: str = "reward") -> DataFrame:
    """Size, mean and population deviation per group; partial sums meet, rows do not."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("group_size"),
        F.avg(reward).alias("group_mean"),
        F.stddev_pop(reward).alias("group_std"),
        (F.min(reward) == F.max(reward)).alias("uniform"),
    )


def attach_advantage(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = GROUP,
    reward: str = "reward",
    *,
    eps: float = EPS,
    std_normalize: bool = True,
    spread_by: Sequence[str] | None = None,
    broadcast: bool | None = None,
) -> DataFrame:
    """Give every row its group's statistics and its ``advantage``."""
    joined = join_group_values(df, stats, keys, spread_by=spread_by, broadcast=broadcast)
    centered = F.col(reward) - F.col("group_mean")
    scaled = centered / (F.col("group_std") + F.lit(eps)) if std_normalize else centered
    return joined.withColumn(
        "advantage", F.when(F.col("uniform"), F.lit(0.0)).otherwise(scaled)).drop("uniform")


def group_advantage(
    df: DataFrame,
    keys: Sequence[str] = GROUP,
    reward: str = "reward",
    *,
    eps: float = EPS,
    std_normalize: bool = True,
    spread_by: Sequence[str] | None = None,
    broadcast: bool | None = None,
) -> DataFrame:
    """Reward minus group mean, over group deviation when ``std_normalize``."""
    return attach_advantage(df, group_stats(df, keys, reward), keys, reward, eps=eps,
                            std_normalize=std_normalize, spread_by=spread_by, broadcast=broadcast)


def reward_signal(
    df: DataFrame, keys: Sequence[str] = GROUP, reward: str = "reward", by: Sequence[str] = ("step",)
) -> DataFrame:
    """Mean reward, resolve rate, share of groups with mixed rewards, number of groups.

    One aggregation per group, folded into one per ``by``; no distinct count is needed
    because a group is mixed exactly if its smallest and largest rewards differ.
    """
    groups = df.groupBy(*keys).agg(
        F.count(reward).alias("_n"), F.sum(reward).alias("_sum"),
        F.sum((F.col(reward) >= 1.0).cast("long")).alias("_solved"),
        (F.min(reward) != F.max(reward)).alias("_mixed"))
    total = F.sum("_n")
    out = groups.groupBy(*by).agg(
        (F.sum("_sum") / total).alias("grpo/mean_reward"),
        (F.sum("_solved") / total).alias("grpo/resolve_rate"),
        rate(F.col("_mixed")).alias("grpo/informative_group_frac"),
        F.count("*").cast("double").alias("grpo/num_groups"), total.alias("_total"))
    return out.filter(F.col("_total") > 0).drop("_total")


def to_training_samples(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Token arrays and per-token advantages of rows that carry ``advantage``."""
    return df.select(
        *keep, "input_ids",
        arrays.attention_mask(F.col("input_ids")).alias("attention_mask"),
        arrays.position_ids(F.col("input_ids")).alias("position_ids"),
        "response_mask",
        arrays.token_advantages(F.col("advantage"), F.col("response_mask")).alias("token_advantages"))
