"""How an episode ended, and what it counted until then.

A turn beyond ``max_turns`` cannot matter, so it is filtered first; the windows below
then hold at most ``max_turns`` rows per trajectory whatever the input looks like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions import toolcalls
from trajlake.functions.text import attempted, truncate_text

TRAJECTORY = ("trajectory_id",)
RESPONSE = 28672
MAX_TURNS = 80
MAX_ERRORS = 3
INCOMPLETE = "IncompleteRollout"

# Order in which the checks of one turn are made. A crash overrides the turn it hits.
CRASH, AFTER_GENERATE, ERROR_STREAK, SUBMIT, AFTER_TOOLS, TURN_CAP = range(6)


def extract_calls(turns: DataFrame) -> DataFrame:
    """Add ``calls``, ``salvaged`` and ``attempted`` to every turn, without a shuffle.

    ``strict_calls`` of the input is used where present; otherwise the strict parse is
    made from ``raw_text``. Salvage applies only to a turn whose strict parse is empty.
    """
    blocks = turns.withColumn("_blocks", toolcalls.closed_blocks(F.coalesce(F.col("raw_text"), F.lit(""))))
    decoded = toolcalls.decoded_blocks(blocks, "_blocks", "_decoded")
    parsed = toolcalls.strict_calls(F.col("_decoded"))
    if "strict_calls" in turns.columns:
        given = F.col("strict_calls").cast(f"array<{toolcalls.CALL}>")
        parsed = F.when(F.col("strict_calls").isNotNull(), given).otherwise(parsed)
    with_strict = decoded.withColumn("_strict", parsed)
    use_salvage = F.size("_strict") == 0
    repaired = toolcalls.salvage_calls(F.col("_blocks"), F.col("_decoded"))
    return with_strict.withColumn(
        "calls", F.when(use_salvage, repaired).otherwise(F.col("_strict"))).withColumn(
        "salvaged", use_salvage & (F.size("calls") > 0)).withColumn(
        "attempted", attempted(F.col("raw_text"))).drop("_blocks", "_decoded", "_strict")


def extract_tool_calls(turns: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """One row per call: ``call_idx, name, command, salvaged`` and the error it meets, if any."""
    # From the plain form Spark infers a filter on the array's size, moves it below the parse and so parses every text again.
    exploded = extract_calls(turns).select(
        *keys, "turn", "salvaged", F.posexplode_outer("calls").alias("call_idx", "call")).filter(F.col("call_idx").isNotNull())
    name, command = F.col("call.name"), F.col("call.command")
    return exploded.select(
        *keys, "turn", "call_idx", name.alias("name"), command.alias("command"), "salvaged",
        toolcalls.call_returncode(name, command).alias("returncode"),
        toolcalls.call_error(name, command).alias("error"))


def turn_outcomes(turns: DataFrame, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Turns reduced to the counts the episode fold needs."""
    return extract_calls(turns).select(
        *keys, "turn", "gen_tokens", "tool_tokens",
        F.size("calls").cast("long").alias("n_calls"),
        F.when(F.col("salvaged"), F.size("calls")).otherwise(F.lit(0)).cast("long").alias("n_salvaged"),
        "attempted", "submitted_call_idx", "crashed_type")


def turn_states(
    outcomes: DataFrame,
    keys: Sequence[str] = TRAJECTORY,
    *,
    response_length: int = RESPONSE,
    max_errors: int = MAX_ERRORS,
    max_turns: int = MAX_TURNS,
) -> DataFrame:
    """Running response length, error streak and the first event of every turn.

    One row per (trajectory, turn), as recorded; the windows hold ``max_turns`` + 1 rows at most.
    """
    rows = outcomes.filter(F.col("turn") <= max_turns)
    ordered = Window.partitionBy(*keys).orderBy("turn")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gen = F.coalesce(F.col("gen_tokens"), F.lit(0))
    tool = F.coalesce(F.col("tool_tokens"), F.lit(0))
    usable = F.coalesce(F.col("n_calls"), F.lit(0)) > 0
    tried = F.coalesce(F.col("attempted"), F.lit(False))

    rows = rows.withColumn("_rank", F.row_number().over(ordered)).withColumn("usable", usable)
    rows = rows.withColumn("len_after_tools", F.sum(gen + tool).over(upto))
    rows = rows.withColumn("len_after_generate", F.col("len_after_tools") - tool)
    last_usable = F.max(F.when(F.col("usable"), F.col("_rank"))).over(upto)
    rows = rows.withColumn("error_streak", F.col("_rank") - F.coalesce(last_usable, F.lit(0)))

    def event(phase: int, status: Column) -> Column:
        return F.struct(F.col("turn").alias("turn"), F.lit(phase).alias("phase"), status.alias("status"))

    first = (
        F.when(F.coalesce(F.col("crashed_type"), F.lit("")) != "",
               event(CRASH, F.concat(F.lit("Crashed:"), F.col("crashed_type"))))
        .when(F.col("len_after_generate") >= response_length, event(AFTER_GENERATE, F.lit("ContextLimit")))
        .when(~F.col("usable") & (F.col("error_streak") >= max_errors),
              event(ERROR_STREAK, F.when(tried, F.lit("FormatErrorLimit")).otherwise(F.lit("NoToolCall"))))
        .when(F.col("usable") & F.col("submitted_call_idx").isNotNull(), event(SUBMIT, F.lit("Submitted")))
        .when(F.col("len_after_tools") >= response_length, event(AFTER_TOOLS, F.lit("ContextLimit")))
        .when(F.col("turn") == max_turns, event(TURN_CAP, F.lit("TurnLimit"))))
    return rows.withColumn("event", first).drop("_rank")


def derive_exit_status(
    outcomes: DataFrame,
    keys: Sequence[str] = TRAJECTORY,
    *,
    response_length: int = RESPONSE,
    max_errors: int = MAX_ERRORS,
    max_turns: int = MAX_TURNS,
) -> DataFrame:
    """First terminal event per trajectory; later rows have no effect."""
    states = turn_states(outcomes, keys, response_length=response_length, max_errors=max_errors,
                         max_turns=max_turns)
    return states.groupBy(*keys).agg(F.min("event").alias("_end")).select(
        *keys, F.coalesce(F.col("_end.status"), F.lit(INCOMPLETE)).alias("exit_status"),
        F.col("_end.turn").alias("end_turn"), F.col("_end.phase").alias("end_phase"))


def episode_counters(
    outcomes: DataFrame,
    keys: Sequence[str] = TRAJECTORY,
    *,
    response_length: int = RESPONSE,
    max_errors: int = MAX_ERRORS,
    max_turns: int = MAX_TURNS,
) -> DataFrame:
    """Exit status and the counters up to the terminal event, in the same shuffle."""
    states = turn_states(outcomes, keys, response_length=response_length, max_errors=max_errors,
                         max_turns=max_turns)
    whole = Window.partitionBy(*keys)
    states = states.withColumn("_end", F.min("event").over(whole))
    live = states.filter(F.col("_end").isNull() | (F.col("turn") <= F.col("_end.turn")))
    phase = F.coalesce(F.col("event.phase"), F.lit(TURN_CAP))
    gen = F.coalesce(F.col("gen_tokens"), F.lit(0))
    tool = F.coalesce(F.col("tool_tokens"), F.lit(0))
    generated = (phase != CRASH) | (gen > 0)
    parsed = ~phase.isin(CRASH, AFTER_GENERATE)
    observed = parsed & ~phase.isin(ERROR_STREAK, SUBMIT)

    def clipped(upto: Column, own: Column) -> Column:
        """Tokens of a segment that fall inside the response limit."""
        return F.least(upto, F.lit(response_length)) - F.least(upto - own, F.lit(response_length))

    def total(cond: Column, value: Column | int = 1) -> Column:
        value = F.lit(value) if isinstance(value, int) else value
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")

    calls = F.when(phase == SUBMIT, F.col("submitted_call_idx") + 1).otherwise(F.col("n_calls"))
    completion = total(F.lit(True), clipped(F.col("len_after_generate"), gen))
    response = total(F.lit(True), clipped(F.col("len_after_generate"), gen)) + total(
        observed, clipped(F.col("len_after_tools"), tool))
    obs = F.array_sort(F.collect_list(F.when(observed, F.struct("turn", tool.cast("long").alias("n")))))
    agg = live.groupBy(*keys).agg(
        F.coalesce(F.first("_end.status"), F.lit(INCOMPLETE)).alias("exit_status"),
        total(generated & (F.col("turn") >= 1)).alias("num_turns"),
        total(parsed & F.col("usable"), calls).alias("tool_call_count"),
        total(parsed & ~F.col("usable")).alias("format_errors"),
        total(parsed & F.col("usable"), F.col("n_salvaged")).alias("salvaged_tool_calls"),
        obs.alias("_obs"),
        completion.alias("_completion"), response.alias("_response"))
    empty = F.col("_response") == 0
    return agg.select(
        *keys, "exit_status", (F.col("exit_status") == "ContextLimit").alias("truncated"),
        "num_turns", "tool_call_count", "format_errors", "salvaged_tool_calls",
        F.transform("_obs", lambda o: o["n"]).alias("tool_obs_tokens"),
        # A response without tokens carries one pad token with mask 1.
        F.when(empty, F.lit(1)).otherwise(F.col("_completion")).cast("long").alias("response_tokens"),
        F.when(empty, F.lit(1)).otherwise(F.col("_response")).cast("long").alias("response_length"))


def actions_log(
    executed: DataFrame,
    errors: DataFrame,
    keys: Sequence[str] = TRAJECTORY,
) -> DataFrame:
    """Per episode the ordered array of clipped action records, all that were made.

    ``executed(keys, turn, call_idx, name, command, returncode, output, submitted)`` and
    ``errors(keys, turn, raw_text)``. Texts are clipped before the records of an episode meet.
    """
    none = F.lit(None).cast("string")
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    kind = F.when(attempted(raw), F.lit("<format_error>")).otherwise(F.lit("<no_tool_call>"))
    done = executed.select(
        *keys, F.col("turn").cast("long").alias("turn"), F.col("call_idx").cast("long").alias("call_idx"),
        F.col("name").alias("tool"), truncate_text(F.col("command"), 600).alias("command"),
        none.alias("raw_response"), F.col("returncode").cast("long").alias("returncode"),
        truncate_text(F.coalesce(F.col("output"), F.lit("")), 400).alias("output"),
        F.col("submitted").cast("boolean").alias("submitted"))
    failed = errors.select(
        *keys, F.col("turn").cast("long").alias("turn"), F.lit(0).cast("long").alias("call_idx"),
        kind.alias("tool"), none.alias("command"), truncate_text(raw, 600).alias("raw_response"),
        F.lit(None).cast("long").alias("returncode"), none.alias("output"),
        F.lit(None).cast("boolean").alias("submitted"))
    rows = done.unionByName(failed)
    fields = ["turn", "call_idx", "tool", "command", "raw_response", "returncode", "output", "submitted"]
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_a"))
    return gathered.select(*keys, F.size("_a").cast("long").alias("num_actions"), F.transform(
        "_a", lambda a: F.struct(*[a[f].alias(f) for f in fields if f != "call_idx"])).alias("actions"))
