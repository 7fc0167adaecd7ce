"""Messages and segments turned into masked token rows.

Long trajectories are cut to their budget before anything is gathered: the tokens
after (or before) a message are counted with chunked running sums, messages wholly
outside the budget are dropped, and only then do the arrays of a trajectory meet.
No task gathers more tokens of one trajectory than the budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions import arrays
from trajlake.functions.text import chat_line
from trajlake.operators.grouping import running_sums

TRAJECTORY = ("trajectory_id",)
CONTEXT = 16384
RESPONSE = 28672
WORD = r"\S+"


def word_ids(text: Column) -> Column:
    """Built-in tokenizer: one id per run of non-space characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def word_count(text: Column) -> Column:
    """``size(word_ids(text))`` without building the ids."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def tokenizer_column(load: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """Wrap a third-party tokenizer. ``load`` runs once per Python worker and returns the
    function that encodes one text."""
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield texts.map(lambda t: list(tokenizer(t or "")))

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda text: F.pandas_udf(encode, "array<int>")(text)


def tokenize(
    messages: DataFrame,
    tokenizer: Callable[[Column], Column] = word_ids,
    *,
    text: Column | None = None,
) -> DataFrame:
    """Add ``ids``: the tokens a message contributes to its trajectory.

    The default text is the ``role: content`` line. A template that only appends lets
    each message be encoded by itself; for any other use ``prefix_deltas``.
    """
    text = chat_line(F.col("role"), F.col("content")) if text is None else text
    return messages.withColumn("ids", tokenizer(text))


def message_tokens(messages: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Token count and mask sum of every message, narrow and without a shuffle."""
    n = word_count(chat_line(F.col("role"), F.col("content")))
    return messages.select(
        *keys, "msg_idx", "role", n.alias("n_tokens"),
        (n * arrays.role_bit(F.col("role"))).alias("mask_sum"))


def prefix_deltas(prefixes: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Tokens of message i = tokens of prefix i beyond the length of prefix i-1.

    The previous length arrives by an equi join on (trajectory, msg_idx), which spreads
    even a single huge trajectory over all tasks. ``msg_idx`` must be gapless.
    """
    before = prefixes.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys],
        (F.col("msg_idx") + 1).alias("_b_idx"), F.size("prefix_ids").alias("_start"))
    on = [F.col(k) == F.col(f"_b_{k}") for k in keys] + [F.col("msg_idx") == F.col("_b_idx")]
    start = F.coalesce(F.col("_start"), F.lit(0))
    rest = F.greatest(F.size("prefix_ids") - start, F.lit(0))
    return prefixes.join(before, on, "left").select(
        *prefixes.columns,
        F.slice(F.col("prefix_ids"), start + 1, rest).alias("ids"))


def observation_tokens(counted: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """One row per observation: a non-assistant message after the two opening ones."""
    return counted.filter((F.col("role") != "assistant") & (F.col("msg_idx") >= 2)).select(
        *keys, "msg_idx", F.col("n_tokens").alias("obs_tokens"))


def observation_totals(counted: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Sum, count and maximum of the observation tokens, pooled per key."""
    return observation_tokens(counted, keys).groupBy(*keys).agg(
        F.sum("obs_tokens").alias("obs_sum"), F.count("*").alias("obs_count"),
        F.max("obs_tokens").alias("obs_max"))


def pooled_observations(df: DataFrame, by: Sequence[str], obs: str = "tool_obs_tokens") -> DataFrame:
    """Mean and maximum over all observations of a batch from per-episode arrays."""
    zero = F.lit(0).cast("long")
    total = F.sum(F.aggregate(F.col(obs), zero, lambda a, x: a + x))
    count = F.sum(F.size(obs).cast("long"))
    return df.groupBy(*by).agg(
        F.coalesce(F.try_divide(total, count), F.lit(0.0)).alias("tokens/mean_obs"),
        F.coalesce(F.max(F.array_max(obs)), zero).cast("double").alias("tokens/max_obs"))


def _gather(order: str) -> Column:
    """Ordered parts of one trajectory; rows without a part add nothing."""
    return F.array_sort(F.collect_list(F.when(F.col("_ids").isNotNull(), F.struct(order, "_ids", "_mask"))))


def _joined(field: str) -> Column:
    return F.flatten(F.transform("_parts", lambda p: p[field])).cast("array<int>")


def _with_part(counted: DataFrame, ids: Column, room: Column) -> DataFrame:
    """``_ids`` and ``_mask`` of the rows inside the budget, null for the others."""
    inside = (room > 0) & (F.col("_n") > 0)
    cut = counted.withColumn("_ids", F.when(inside, ids))
    return cut.withColumn("_mask", F.when(inside, arrays.repeat_int(F.col("_bit"), F.size("_ids"))))


def adapt_trajectories(
    tokens: DataFrame, keys: Sequence[str] = TRAJECTORY, budget: int = CONTEXT
) -> DataFrame:
    """Messages with ``ids`` to one masked sequence per trajectory, most recent ``budget`` tokens.

    Adds attention mask, positions (from 0 after the cut), ``truncated``, and the totals
    after the cut.
    """
    back = tokens.select(
        *keys, "msg_idx", (-F.col("msg_idx")).alias("_back"), arrays.role_bit(F.col("role")).alias("_bit"),
        F.size("ids").cast("long").alias("_n"),
        # Tokens of one message beyond the budget can never survive.
        arrays.keep_last(F.col("ids"), budget).alias("_tail"))
    counted = running_sums(back, "_back", {"_upto": F.col("_n")}, keys=keys)
    room = F.lit(budget) - (F.col("_upto") - F.col("_n"))
    parts = _with_part(counted, arrays.keep_last(F.col("_tail"), room), room)
    gathered = parts.groupBy(*keys).agg(F.max("_upto").alias("_total"), _gather("msg_idx").alias("_parts"))
    flat = gathered.select(*keys, "_total", _joined("_ids").alias("input_ids"), _joined("_mask").alias("response_mask"))
    return flat.select(
        *keys, "input_ids",
        arrays.attention_mask(F.col("input_ids")).alias("attention_mask"),
        arrays.position_ids(F.col("input_ids")).alias("position_ids"), "response_mask",
        (F.col("_total") > budget).alias("truncated"),
        F.least(F.col("_total"), F.lit(budget)).cast("long").alias("total_trajectory_tokens"),
        arrays.total(F.col("response_mask")).alias("response_tokens"))


def accumulate_segments(
    segments: DataFrame,
    keys: Sequence[str] = TRAJECTORY,
    *,
    response_length: int = RESPONSE,
    pad: int = 0,
) -> DataFrame:
    """Prompt and response of one episode from its ordered segments.

    ``segments(keys, seg_idx, kind, ids)`` with ``kind`` in prompt (the first one counts),
    generated and tool. The response keeps its first ``response_length`` tokens; generated
    tokens carry mask 1. An empty prompt becomes one pad token, an empty response one pad
    token with mask 1.
    """
    is_prompt = F.col("kind") == "prompt"
    rows = segments.select(
        *keys, "seg_idx", is_prompt.alias("_is_prompt"),
        F.when(F.col("kind") == "generated", F.lit(1)).otherwise(F.lit(0)).alias("_bit"),
        F.when(is_prompt, F.lit(0)).otherwise(F.size("ids")).cast("long").alias("_n"),
        F.when(is_prompt, F.col("ids")).otherwise(arrays.keep_first(F.col("ids"), response_length)).alias("_head"))
    counted = running_sums(rows, "seg_idx", {"_upto": F.col("_n")}, keys=keys)
    room = F.lit(response_length) - (F.col("_upto") - F.col("_n"))
    parts = _with_part(counted, arrays.keep_first(F.col("_head"), room), room)
    gathered = parts.groupBy(*keys).agg(
        F.min_by("_head", F.when(F.col("_is_prompt"), F.col("seg_idx"))).alias("_prompt"),
        _gather("seg_idx").alias("_parts"))
    padded = gathered.select(
        *keys, arrays.or_pad(F.coalesce(F.col("_prompt"), arrays.empty_ints()), pad).alias("prompt_ids"),
        arrays.or_pad(_joined("_ids"), pad).alias("response_ids"),
        arrays.or_pad(_joined("_mask"), 1).alias("response_mask"))
    return padded.select(
        "*", F.size("prompt_ids").cast("long").alias("prompt_tokens"),
        arrays.total(F.col("response_mask")).alias("response_tokens"),
        (F.size("prompt_ids") + F.size("response_ids")).cast("long").alias("total_trajectory_tokens"))


def running_response_length(
    segments: DataFrame, keys: Sequence[str] = TRAJECTORY, order: str = "seg_idx", n: str = "n_tokens"
) -> DataFrame:
    """``response_len`` after each generated or tool segment."""
    return running_sums(segments, order, {"response_len": F.col(n)}, keys=keys)
