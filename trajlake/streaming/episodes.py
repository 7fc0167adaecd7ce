"""The episode fold on a live stream of turns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trajlake.operators.episodes import INCOMPLETE, MAX_ERRORS, MAX_TURNS, RESPONSE, turn_states
from trajlake.streaming.state import require_rocksdb

TURN_FIELDS = ("gen_tokens", "tool_tokens", "n_calls", "n_salvaged", "attempted", "submitted_call_idx", "crashed_type")
PENDING = "at_ms long, gen long, tool long, calls long, salvaged long, tried boolean, submit long, crash string"
# The fold of the turns applied so far; ``turn`` is the last of them.
FOLD = {
    "turn": "long", "length": "long", "streak": "long", "turns": "long", "calls": "long", "errors": "long", "salvaged": "long",
    "completion": "long", "response": "long", "obs": "array<long>", "late": "long", "done": "boolean"}
FOLD_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FOLD.items())
COUNTERS = ("exit_status string, truncated boolean, num_turns long, tool_call_count long, format_errors long,"
            " salvaged_tool_calls long, tool_obs_tokens array<long>, response_tokens long, response_length long, late_turns long")
UNTIMED = "untimed_turns"


def _int(value: Any, default: int | None = 0) -> int | None:
    return default if value is None or pd.isna(value) else int(value)


class Fold:
    """One episode, turn by turn, by the rules of the batch operator.

    Turns apply in ascending order. A missing turn is passed over, as in batch: what follows it counts as
    it is. ``add`` returns the exit status if the turn ends the episode.
    """

    def __init__(self, state: dict[str, Any], response_length: int, max_errors: int, max_turns: int):
        self.s = state
        self.response_length, self.max_errors, self.max_turns = response_length, max_errors, max_turns

    @staticmethod
    def empty() -> dict[str, Any]:
        return {**dict.fromkeys(FOLD, 0), "turn": -1, "obs": [], "done": False}

    def _inside(self, own: int) -> int:
        """Take in tokens; returns how many of them lie within the response limit."""
        before, self.s["length"] = self.s["length"], self.s["length"] + own
        return min(self.s["length"], self.response_length) - min(before, self.response_length)

    def add(self, turn: int, gen: int, tool: int, calls: int, salvaged: int, tried: bool, submit: int | None, crash: str) -> str | None:
        s = self.s
        s["turn"] = turn
        kept = self._inside(gen)
        s["completion"] += kept
        s["response"] += kept
        if turn >= 1 and (not crash or gen > 0):
            s["turns"] += 1
        if crash:
            return f"Crashed:{crash}"
        if s["length"] >= self.response_length:
            return "ContextLimit"
        if calls > 0:
            s["streak"] = 0
            s["salvaged"] += salvaged
            s["calls"] += calls if submit is None else submit + 1
            if submit is not None:
                return "Submitted"
        else:
            s["streak"] += 1
            s["errors"] += 1
            if s["streak"] >= self.max_errors:
                return "FormatErrorLimit" if tried else "NoToolCall"
        s["response"] += self._inside(tool)
        s["obs"].append(tool)
        if s["length"] >= self.response_length:
            return "ContextLimit"
        return "TurnLimit" if turn == self.max_turns else None

    def row(self, status: str) -> dict[str, Any]:
        s, empty = self.s, self.s["response"] == 0
        return {
            "exit_status": status, "truncated": status == "ContextLimit", "num_turns": s["turns"], "tool_call_count": s["calls"],
            "format_errors": s["errors"], "salvaged_tool_calls": s["salvaged"], "tool_obs_tokens": list(s["obs"]),
            # A response without tokens carries one pad token with mask 1.
            "response_tokens": 1 if empty else s["completion"], "response_length": 1 if empty else s["response"], "late_turns": s["late"]}


class EpisodeFold(StatefulProcessor):
    """Per trajectory: the fold of the turns applied, and turns that wait.

    A turn that follows the last one applies at once. One ahead of its predecessors waits until these
    come, or until the watermark has passed its own time: then nothing earlier can come any more, and it
    applies over the gap. At most ``max_turns`` turns wait. An episode without news for ``timeout_ms`` of
    event time ends as incomplete; a finished one is remembered that long, so that late turns are told
    from new episodes, and then forgotten.
    """

    def __init__(self, response_length: int, max_errors: int, max_turns: int, timeout_ms: int):
        self.limits = (response_length, max_errors, max_turns)
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD_SCHEMA)
        self.pending = handle.getMapState("pending", "turn long", PENDING)

    def close(self) -> None:
        pass

    def _start(self) -> Fold:
        state = dict(zip(FOLD, self.fold.get())) if self.fold.exists() else Fold.empty()
        state["obs"] = [int(x) for x in state["obs"]]
        return Fold(state, *self.limits)

    def _save(self, fold: Fold) -> None:
        self.fold.update(tuple(fold.s[name] for name in FOLD))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        held = initialState.iloc[0]
        fold = Fold({name: held[name] for name in FOLD}, *self.limits)
        fold.s = {name: list(v) if name == "obs" else bool(v) if name == "done" else int(v) for name, v in fold.s.items()}
        self._save(fold)
        self._set_timers(timerValues.getCurrentWatermarkInMs() + self.timeout_ms, timerValues)

    def _store(self, fold: Fold, frames: Iterator[pd.DataFrame]) -> int:
        """Keep the turns that are still to come; returns the latest event time in ms."""
        latest = 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                at = int(row.event_time.timestamp() * 1000)
                latest = max(latest, at)
                if fold.s["done"] or row.turn <= fold.s["turn"]:
                    fold.s["late"] += 1
                    continue
                crash = row.crashed_type if isinstance(row.crashed_type, str) else ""
                self.pending.updateValue((int(row.turn),), (
                    at, _int(row.gen_tokens), _int(row.tool_tokens), _int(row.n_calls), _int(row.n_salvaged),
                    bool(_int(row.attempted)), _int(row.submitted_call_idx, None), crash))
        return latest

    def _apply(self, key: Any, fold: Fold, watermark: int) -> pd.DataFrame | None:
        """Apply what is due; the episode's row if that ends it."""
        waiting = {turn[0]: row for turn, row in self.pending.iterator()}
        for turn in sorted(waiting):
            # Turn 0 stands alone, for a crash before the first turn; other episodes begin with turn 1.
            follows = turn == fold.s["turn"] + 1 or (turn == 1 and fold.s["turn"] < 0)
            if not follows and waiting[turn][0] >= watermark:
                break
            self.pending.removeKey((turn,))
            status = fold.add(turn, *waiting[turn][1:])
            if status is not None:
                fold.s["done"] = True
                self.pending.clear()
                return pd.DataFrame([{"trajectory_id": key[0], **fold.row(status)}])
        return None

    def _set_timers(self, silence_ms: int, timerValues: Any) -> None:
        """Wake up when the first waiting turn is due, and when the episode has been silent too long."""
        now = timerValues.getCurrentWatermarkInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [row[0] + 1 for _, row in self.pending.iterator()]
        for at in {max(silence_ms, now + 1), *([max(min(due), now + 1)] if due else [])}:
            self.handle.registerTimer(at)

    def _silence(self, latest: int) -> int:
        known = [t - self.timeout_ms for t in self.handle.listTimers()]
        return max([latest, *known]) + self.timeout_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fold = self._start()
        latest = self._store(fold, rows)
        silence = self._silence(latest)
        if not fold.s["done"]:
            ended = self._apply(key, fold, timerValues.getCurrentWatermarkInMs())
            if ended is not None:
                yield ended
        self._save(fold)
        self._set_timers(silence, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.fold.exists():  # two timers at once, and the first has ended the episode
            return
        fold = self._start()
        now = timerValues.getCurrentWatermarkInMs()
        left = [t for t in self.handle.listTimers() if t > now]
        if not fold.s["done"]:
            ended = self._apply(key, fold, now)
            if ended is not None:
                yield ended
            elif not left:
                yield pd.DataFrame([{"trajectory_id": key[0], **fold.row(INCOMPLETE)}])
        if left:
            self._save(fold)
            self._set_timers(max(left), timerValues)
        else:
            self.fold.clear()
            self.pending.clear()


def episode_folds(
    outcomes: DataFrame, *, response_length: int = RESPONSE, max_errors: int = MAX_ERRORS, max_turns: int = MAX_TURNS
) -> DataFrame:
    """``(trajectory_id, FOLD)`` of recorded turns: the state a stream may start from.

    Episodes that have ended are marked done, so that the stream ignores their further turns.
    """
    limits = dict(response_length=response_length, max_errors=max_errors, max_turns=max_turns)
    states = turn_states(outcomes, **limits)
    gen, tool = F.coalesce("gen_tokens", F.lit(0)), F.coalesce("tool_tokens", F.lit(0))
    inside = lambda upto, own: F.least(upto, F.lit(response_length)) - F.least(upto - own, F.lit(response_length))
    usable = F.col("usable")
    after = F.struct("turn", F.col("len_after_tools").alias("length"), F.when(usable, 0).otherwise(F.col("error_streak")).alias("streak"))
    folded = states.groupBy("trajectory_id").agg(
        F.max(after).alias("last"), F.sum((F.col("turn") >= 1).cast("long")).alias("turns"),
        F.coalesce(F.sum(F.when(usable, F.col("n_calls"))), F.lit(0)).alias("calls"),
        F.sum((~usable).cast("long")).alias("errors"), F.coalesce(F.sum(F.when(usable, F.col("n_salvaged"))), F.lit(0)).alias("salvaged"),
        F.sum(inside(F.col("len_after_generate"), gen)).alias("completion"),
        F.sum(inside(F.col("len_after_generate"), gen) + inside(F.col("len_after_tools"), tool)).alias("response"),
        F.array_sort(F.collect_list(F.struct("turn", tool.cast("long").alias("n")))).alias("obs"),
        F.max(F.col("event").isNotNull().cast("int")).alias("done"))
    values = {
        "turn": F.col("last.turn"), "length": F.col("last.length"), "streak": F.col("last.streak"),
        **{c: F.col(c) for c in ("turns", "calls", "errors", "salvaged", "completion", "response")},
        "obs": F.transform("obs", lambda o: o["n"]), "late": F.lit(0), "done": F.col("done") == 1}
    return folded.select("trajectory_id", *[values[name].cast(kind).alias(name) for name, kind in FOLD.items()])


def stream_episodes(
    outcomes: DataFrame,
    *,
    time: str = "ts",
    response_length: int = RESPONSE,
    max_errors: int = MAX_ERRORS,
    max_turns: int = MAX_TURNS,
    delay: str = "10 minutes",
    timeout_ms: int = 7_200_000,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Exit status and all counters of the batch operator, emitted the moment an episode ends.

    ``outcomes`` is a stream of ``turn_outcomes`` rows with an event time. ``delay`` is
    the watermark delay, ``timeout_ms`` the silence after which an episode is given up.
    Turns beyond ``max_turns`` are dropped before the shuffle. Turns without an event time can be put
    nowhere; they are left out and counted in the query's observed metrics under ``untimed_turns``.
    ``initial`` are folds to go on from (``episode_folds``). ``late_turns`` counts turns that came
    after a later one was applied over their gap.
    """
    require_rocksdb(outcomes.sparkSession)
    seen = outcomes.observe(UNTIMED, F.count_if(F.col(time).isNull()).alias("n"))
    turns = seen.filter((F.col("turn") <= max_turns) & F.col(time).isNotNull()).select(
        "trajectory_id", "turn", F.col(time).alias("event_time"), *TURN_FIELDS).withWatermark("event_time", delay)
    output = f"trajectory_id {outcomes.schema['trajectory_id'].dataType.simpleString()}, {COUNTERS}"
    return turns.groupBy("trajectory_id").transformWithStateInPandas(
        EpisodeFold(response_length, max_errors, max_turns, timeout_ms), outputStructType=output, outputMode="append",
        timeMode="EventTime", initialState=None if initial is None else initial.groupBy("trajectory_id"))
