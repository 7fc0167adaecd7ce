"""Episodes reduced to batch metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import generation_time, safe_ratio
from trajlake.schemas import with_defaults

# Metric name -> episode field whose mean it is.
MEANS = {
    "traj/mean_reward": "reward",
    "traj/mean_turns": "num_turns",
    "traj/mean_tool_calls": "tool_call_count",
    "traj/mean_edits": "edit_count",
    "traj/mean_format_errors": "format_errors",
    "traj/mean_salvaged_calls": "salvaged_tool_calls",
    "tokens/mean_prompt": "prompt_tokens",
    "tokens/mean_completion": "completion_tokens",
    "tokens/mean_cached_prompt": "cached_prompt_tokens",
    "tokens/mean_total": "total_trajectory_tokens",
    "tokens/mean_response": "response_tokens",
    "latency/mean_trajectory_s": "total_trajectory_time",
    "latency/mean_tool_s": "total_tool_call_time",
}


def _shares() -> dict[str, Column]:
    """Metric name -> condition whose share it is."""
    return {
        "reward/eval_error_rate": F.col("eval_error") != "",
        "reward/empty_patch_rate": F.col("empty_patch"),
        "reward/patch_applied_rate": F.col("patch_applied"),
        "traj/resolve_rate": F.col("resolved"),
        "traj/truncation_rate": F.col("truncated"),
        "traj/format_error_rate": F.col("format_errors") != 0,
    }


def trajectory_partials(df: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Mergeable sums per batch and exit status, in one shuffle.

    Exit shares and means come from the same rows, and the same sums serve as the state
    of the streaming reducer. Observation arrays are folded inside their row.
    """
    df = with_defaults(df)
    obs = F.col("tool_obs_tokens")
    status = F.when(F.col("exit_status") == "", F.lit("Unknown")).otherwise(F.col("exit_status"))
    sums = {f"sum:{name}": F.sum(field) for name, field in MEANS.items()}
    sums |= {f"sum:{name}": F.sum(flag.cast("long")) for name, flag in _shares().items()}
    sums |= {f"sum:{c}": F.sum(c) for c in ("f2p_passed", "f2p_total", "p2p_passed", "p2p_total")}
    sums |= {
        "n": F.count("*"),
        "sum:obs": F.sum(F.aggregate(obs, F.lit(0).cast("long"), lambda a, x: a + x)),
        "sum:n_obs": F.sum(F.size(obs).cast("long")),
        "max:obs": F.max(F.array_max(obs)),
        "max:trajectory_s": F.max("total_trajectory_time"),
        "sum:latency/mean_generation_s": F.sum(
            generation_time(F.col("total_trajectory_time"), F.col("total_tool_call_time"))),
    }
    return df.groupBy(*by, status.alias("exit_status")).agg(
        *[expr.alias(name) for name, expr in sums.items()])


def _finished() -> dict[str, Column]:
    """The fixed metrics as aggregates over the partials of a batch."""
    def s(name: str) -> Column:
        return F.sum(f"`sum:{name}`")

    n = F.sum("n")
    out = {name: s(name) / n for name in [*MEANS, *_shares(), "latency/mean_generation_s"]}
    out |= {
        "reward/f2p_pass_rate": safe_ratio(s("f2p_passed"), s("f2p_total")),
        "reward/p2p_pass_rate": safe_ratio(s("p2p_passed"), s("p2p_total")),
        "tokens/mean_obs": safe_ratio(s("obs"), s("n_obs")),
        "tokens/max_obs": F.coalesce(F.max("`max:obs`"), F.lit(0)),
        "latency/max_trajectory_s": F.max("`max:trajectory_s`"),
    }
    return {name: expr.cast("double") for name, expr in sorted(out.items())}


def finish_partials(partials: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """The fixed metrics, one wide row per batch."""
    return partials.groupBy(*by).agg(*[expr.alias(name) for name, expr in _finished().items()])


def _exits() -> list[Column]:
    """Aggregates of a batch over its partials: the rows of each status, and all rows."""
    return [F.collect_list(F.struct("exit_status", "n")).alias("_exits"), F.sum("n").alias("_total")]


def _exit_pairs() -> Column:
    return F.transform("_exits", lambda e: F.struct(
        F.concat(F.lit("traj/exit/"), e["exit_status"]).alias("metric"), (e["n"] / F.col("_total")).alias("value")))


def exit_shares(partials: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Long rows ``traj/exit/<Status>`` -> share; a status appears only where it was seen."""
    return partials.groupBy(*by).agg(*_exits()).select(*by, F.inline(_exit_pairs()))


def to_long(wide: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """One row per metric instead of one column per metric."""
    names = [c for c in wide.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
                      for c in names])
    return wide.select(*by, F.inline(pairs))


def summarize_trajectories(df: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Fixed metrics, wide. A batch without rows yields no row."""
    return finish_partials(trajectory_partials(df, by), by)


def batch_metrics(partials: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Exit shares and fixed metrics as long rows, from one aggregation of the partials.

    ``partials`` has one row per batch and exit status, as ``trajectory_partials`` gives them.
    """
    finished = _finished()
    wide = partials.groupBy(*by).agg(*_exits(), *[expr.alias(name) for name, expr in finished.items()])
    fixed = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in finished])
    return wide.select(*by, F.inline(F.concat(_exit_pairs(), fixed)))


def merge_metrics(sources: Sequence[DataFrame], by: Sequence[str] = ("step",)) -> DataFrame:
    """Union of long metric tables; on the same name the later source wins."""
    ranked = [df.select(*by, "metric", "value", F.lit(i).alias("_rank")) for i, df in enumerate(sources)]
    merged = ranked[0]
    for other in ranked[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(*by, "metric").agg(F.max_by("value", "_rank").alias("value"))


def step_timing(df: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Rollout and update seconds per step and the rollout's share of their sum."""
    rollout, update = F.sum("rollout_s"), F.sum("update_s")
    return df.groupBy(*by).agg(
        rollout.alias("time/rollout_s"), update.alias("time/update_s"),
        (rollout / F.greatest(rollout + update, F.lit(1e-9))).alias("time/rollout_fraction"))


def span_totals(spans: DataFrame, keys: Sequence[str] = ("trajectory_id",)) -> DataFrame:
    """Seconds per episode spent generating, in tools, scoring and overall.

    ``spans`` has one row per timed span: ``kind`` in generate, tool, score, trajectory
    and ``seconds``. Absent kinds are 0.
    """
    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("seconds"))), F.lit(0.0))

    return spans.groupBy(*keys).agg(
        of("generate").alias("generate_s"), of("tool").alias("tool_s"),
        of("score").alias("score_s"), of("trajectory").alias("trajectory_s"))
