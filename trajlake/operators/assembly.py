"""Whole episode records and training samples from their recorded parts.

The parts of an episode (turns, messages, spans, grades) are folded by the episode's key and joined on it.
All folds and joins ask for the same partitioning, so each part passes one exchange and the joins none;
parts stored in buckets of the key (``store_bucketed``) pass none at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.operators.advantage import group_advantage, to_training_samples
from trajlake.operators.episodes import episode_counters
from trajlake.operators.grading import GRADE_FIELDS, attach_grading
from trajlake.operators.metrics import span_totals
from trajlake.operators.tokens import CONTEXT, adapt_trajectories, tokenize
from trajlake.operators.usage import fold_messages
from trajlake.schemas import TRAJECTORY_METRICS, with_defaults

TRAJECTORY = ("trajectory_id",)
GROUP = ("step", "instance_id")


def store_bucketed(
    df: DataFrame, table: str, keys: Sequence[str] = TRAJECTORY, buckets: int = 200, path: str | None = None
) -> DataFrame:
    """Keep a part as a table in buckets of the episode key, sorted by it; returns the table.

    Parts with the same keys and number of buckets are folded and joined where they lie. ``path`` is where the
    files go; without it, into the warehouse.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return df.sparkSession.table(table)


def assemble_episodes(
    outcomes: DataFrame,
    *,
    messages: DataFrame | None = None,
    spans: DataFrame | None = None,
    grades: DataFrame | None = None,
    keys: Sequence[str] = TRAJECTORY,
    keep: Sequence[str] = (),
    **limits: int,
) -> DataFrame:
    """One metrics record per episode from its turn outcomes and what else was recorded of it.

    ``messages`` bring usage and edit actions, ``spans`` the times, ``grades(keys, GRADE_FIELDS)`` the
    outcome of grading. What a part does not say of an episode keeps its default; an episode is one that
    has turns. ``keep`` are columns of ``grades`` to pass on. Keys must not be null.
    """
    record = episode_counters(outcomes, keys, **limits)
    if messages is not None:
        used = fold_messages(messages, keys).select(*keys, "prompt_tokens", F.col("completion_tokens").alias("_completion"), "cached_prompt_tokens", "edit_count")
        record = record.join(used, list(keys), "left")
    else:
        none = F.lit(None).cast("long")
        record = record.withColumns({"prompt_tokens": none, "_completion": none})
    if spans is not None:
        times = span_totals(spans, keys).select(
            *keys, F.col("trajectory_s").alias("total_trajectory_time"), F.col("tool_s").alias("total_tool_call_time"))
        record = record.join(times, list(keys), "left")
    if grades is not None:
        record = record.join(grades.select(*keys, *keep, *GRADE_FIELDS), list(keys), "left")
    whole = record.withColumns({
        "total_trajectory_tokens": F.coalesce("prompt_tokens", F.lit(0)) + F.col("response_length"),
        "completion_tokens": F.coalesce("_completion", "response_tokens")})
    fields = [f.name for f in TRAJECTORY_METRICS.fields if f.name not in keys]
    return with_defaults(whole).select(*keys, *keep, *fields)


def rollout_samples(
    rollouts: DataFrame,
    grades: DataFrame,
    tokens: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
    *,
    group: Sequence[str] = GROUP,
    attempt: str = "group_idx",
    budget: int = CONTEXT,
    std_normalize: bool = True,
) -> DataFrame:
    """Training samples of graded rollouts: token rows with the advantage of their attempt on every trained token.

    ``rollouts(group, attempt, messages)``, ``grades(group, attempt, GRADE_FIELDS)``; an ungraded attempt has
    reward 0. ``tokens`` adds ``ids`` to ``(group, attempt, msg_idx, role, content)`` rows, by default those of
    the built-in tokenizer. Rewards and advantages are worked out on narrow rows; tokens join last, on the
    attempt's whole key, so that a group of any size is spread.
    """
    keys = [*group, attempt]
    graded = attach_grading(rollouts.select(*keys), grades, keys).select(*keys, "reward", "eval_error")
    scored = group_advantage(graded, group, std_normalize=std_normalize, spread_by=[attempt])
    said = rollouts.select(*keys, F.posexplode("messages").alias("msg_idx", "_m")).select(
        *keys, F.col("msg_idx").cast("long").alias("msg_idx"), "_m.role", "_m.content")
    told = tokenize(said) if tokens is None else tokens(said, keys)
    rows = adapt_trajectories(told, keys, budget)
    joined = rows.join(scored.select(*keys, "reward", "eval_error", "advantage"), keys)
    return to_training_samples(joined, [*keys, "reward", "eval_error", "truncated"])
