"""Token usage and action counts folded from messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.predicates import is_edit

TRAJECTORY = ("trajectory_id",)


def usage_fields(df: DataFrame) -> dict[str, Column]:
    """Prompt, completion and cached tokens of a message.

    The server's usage comes first, then a column of the message itself; cached tokens
    may also sit under the prompt-token details. In columnar data an absent key is null,
    so a present but null key falls through as well.
    """
    details = F.col("usage.prompt_tokens_details.cached_tokens")

    def own(name: str) -> list[Column]:
        return [F.col(name)] if name in df.columns else []

    return {
        "prompt_tokens": F.coalesce(F.col("usage.prompt_tokens"), *own("prompt_tokens")),
        "completion_tokens": F.coalesce(F.col("usage.completion_tokens"), *own("completion_tokens")),
        "cached_tokens": F.coalesce(F.col("usage.cached_tokens"), details),
    }


def fold_usage(messages: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Peak prompt, summed completion and summed cached tokens per trajectory."""
    return messages.groupBy(*keys).agg(*_usage(messages))


def _usage(messages: DataFrame) -> list[Column]:
    f = usage_fields(messages)
    zero = F.lit(0).cast("long")
    return [
        F.greatest(F.coalesce(F.max(f["prompt_tokens"]), zero), zero).alias("prompt_tokens"),
        F.coalesce(F.sum(f["completion_tokens"]), zero).alias("completion_tokens"),
        F.coalesce(F.sum(f["cached_tokens"]), zero).alias("cached_prompt_tokens")]


def count_actions(messages: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Actions and edit actions per trajectory; an action counts once whatever its markers."""
    return messages.groupBy(*keys).agg(*_actions())


def _actions() -> list[Column]:
    actions = F.coalesce(F.col("actions"), F.array())
    edits = F.filter(actions, lambda a: is_edit(a["command"]))
    return [F.sum(F.size(actions).cast("long")).alias("tool_call_count"), F.sum(F.size(edits).cast("long")).alias("edit_count")]


def fold_messages(messages: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Usage and action counts per trajectory in one aggregation; without a column of actions there are none."""
    known = messages if "actions" in messages.columns else messages.withColumn(
        "actions", F.lit(None).cast("array<struct<command:string>>"))
    return known.groupBy(*keys).agg(*_usage(known), *_actions())


def loop_profile(actions: DataFrame, keys: Sequence[str] = TRAJECTORY, command: str = "command") -> DataFrame:
    """Actions against distinct commands per episode.

    Counted per (episode, command) first, so a long repetitive episode shrinks before
    the per-episode sum.
    """
    per_command = actions.groupBy(*keys, command).agg(F.count("*").alias("_n"))
    return per_command.groupBy(*keys).agg(
        F.sum("_n").alias("num_actions"), F.count(command).alias("distinct_commands"))
