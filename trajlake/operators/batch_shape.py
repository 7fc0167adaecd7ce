"""Batch metrics documented for training steps: scores, lengths, timings, throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import turn_count

MAX_PROMPT = 4096
MAX_RESPONSE = 28672
STATS = {"mean": F.avg, "max": F.max, "min": F.min}
SLOWEST = (
    "generate_sequences", "tool_calls", "compute_score", "num_preempted",
    "prompt_length", "response_length",
)


def stats(prefix: str, value: Column, where: Column | None = None) -> list[Column]:
    """``prefix/{mean,max,min}`` of ``value`` over the rows that satisfy ``where``."""
    value = value if where is None else F.when(where, value)
    return [f(value).cast("double").alias(f"{prefix}/{name}") for name, f in STATS.items()]


def _share(cond: Column, where: Column | None = None) -> Column:
    value = cond.cast("double")
    return F.avg(value if where is None else F.when(where, value))


def critic_metrics(df: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Scores, rewards, advantages and returns.

    Scores leave out empty responses. Advantages are taken over response tokens: a
    trajectory weighs in with its ``n_tokens``, without expanding token arrays.
    """
    alive = F.col("response_length") > 0
    weighted = F.col("n_tokens") > 0
    adv, n = F.when(weighted, F.col("advantage")), F.when(weighted, F.col("n_tokens"))
    over_tokens = {"mean": F.try_divide(F.sum(adv * n), F.sum(n)), "max": F.max(adv), "min": F.min(adv)}
    return df.groupBy(*by).agg(
        *stats("critic/score", F.col("reward"), alive), *stats("critic/rewards", F.col("reward"), alive),
        *[expr.alias(f"critic/{kind}/{name}") for kind in ("advantages", "returns")
          for name, expr in over_tokens.items()])


def batch_shape(
    df: DataFrame,
    by: Sequence[str] = ("step",),
    *,
    max_prompt: int = MAX_PROMPT,
    max_response: int = MAX_RESPONSE,
) -> DataFrame:
    """Prompt and response lengths, clip and abort ratios, turns."""
    prompt, response = F.col("prompt_length"), F.col("response_length")
    alive = response > 0
    return df.groupBy(*by).agg(
        *stats("prompt_length", prompt), _share(prompt == max_prompt).alias("prompt_length/clip_ratio"),
        *stats("response_length", response),
        _share(response == max_response).alias("response_length/clip_ratio"),
        *stats("response_length_non_aborted", response, alive),
        _share(response == max_response, alive).alias("response_length_non_aborted/clip_ratio"),
        _share(response == 0).alias("response/aborted_ratio"),
        *stats("num_turns", turn_count(F.col("assistant_turns"))))


def global_seqlen(
    df: DataFrame, ranks: int, tokens: str = "n_tokens", index: str = "row_idx", table: DataFrame | None = None
) -> DataFrame:
    """Token sums of the ``ranks`` contiguous row chunks: min, max, mean and spread.

    ``table`` has the same rows without their index; given it, the rows are counted there.
    """
    n = (df if table is None else table).agg(F.count("*")).scalar()
    rank = F.call_function("div", F.col(index).cast("long") * F.lit(ranks), n)
    chunks = df.groupBy(rank.alias("rank")).agg(F.sum(tokens).alias("_tokens"))
    low, high = F.min("_tokens"), F.max("_tokens")
    return chunks.agg(
        low.cast("double").alias("global_seqlen/min"), high.cast("double").alias("global_seqlen/max"),
        F.avg("_tokens").alias("global_seqlen/mean"),
        (high - low).cast("double").alias("global_seqlen/minmax_diff"))


def timing_per_token(df: DataFrame, by: Sequence[str] = ("step",), stages: Sequence[str] = ("gen",)) -> DataFrame:
    """Stage seconds in ms per token; generation counts response tokens, the rest all tokens.

    ``df`` has one row per step with ``prompt_tokens``, ``response_tokens`` and ``<stage>_s``.
    """
    response = F.sum("response_tokens")
    everything = F.sum(F.col("prompt_tokens") + F.col("response_tokens"))

    def per_token(stage: str) -> Column:
        tokens = response if stage == "gen" else everything
        return F.try_divide(F.sum(f"{stage}_s") * 1000, tokens).alias(f"timing_per_token_ms/{stage}")

    return df.groupBy(*by).agg(*[per_token(s) for s in stages])


def agent_loop_timing(
    df: DataFrame, by: Sequence[str] = ("step",), order: str = "trajectory_id"
) -> DataFrame:
    """Per-episode timings reduced, and the fields of the slowest episode.

    Slowest is the largest generation + tool + score time; equal ones resolve to the
    smallest ``order``.
    """
    fields = SLOWEST[:4]
    total = F.col("generate_sequences") + F.col("tool_calls") + F.col("compute_score")
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in SLOWEST])
    grouped = df.groupBy(*by).agg(
        *[c for f in fields for c in stats(f"timing_s/agent_loop/{f}", F.col(f))],
        F.max_by(row, F.struct(total.alias("total"), (-F.col(order)).alias("tie"))).alias("_slowest"))
    kept = [F.col(f"`{c}`") for c in grouped.columns if c != "_slowest"]
    return grouped.select(*kept, *[
        F.col(f"_slowest.{c}").alias(f"timing_s/agent_loop/slowest/{c}") for c in SLOWEST])


def throughput(df: DataFrame, by: Sequence[str] = ("step",), n_gpus: int = 8) -> DataFrame:
    """Tokens of a step and tokens per second and GPU; ``step_s`` is the step's wall time."""
    tokens = F.sum(F.col("prompt_tokens") + F.col("response_tokens"))
    return df.groupBy(*by).agg(
        tokens.cast("double").alias("perf/total_num_tokens"), F.max("step_s").alias("perf/time_per_step"),
        F.try_divide(tokens, F.max("step_s") * n_gpus).alias("perf/throughput"))


def validation_metrics(df: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Mean reward per data source and turn statistics of a validation pass, long form."""
    def name(head: str, tail: str) -> Column:
        return F.concat(F.lit(head), F.col("data_source"), F.lit(tail))

    turns = turn_count(F.col("assistant_turns"))
    per_source = df.groupBy(*by, "data_source").agg(F.avg("reward").alias("value"))
    core = per_source.select(*by, name("val-core/", "/reward/mean@1").alias("metric"), "value")
    aux = df.groupBy(*by).agg(*stats("val-aux/num_turns", turns))
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value"))
                      for c in aux.columns if c not in by])
    return core.unionByName(aux.select(*by, F.inline(pairs)))
