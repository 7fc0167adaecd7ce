"""Server summaries of steps on a stream of samples: one small state per step, no stored samples."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trajlake.operators.servermon import SNAPSHOT, assign_steps, drain_figures, gauges, latency_figures, snapshot_values, to_samples
from trajlake.streaming.state import require_rocksdb

# What a step comes to so far. Times are null until a sample of their kind was seen.
FIELDS = {
    "n": "long", "phase_start": "double", "phase_end": "double", "peak": "double", "peak_t": "double", "usage": "double",
    "full_t": "double", "idle_t": "double", "pending": "array<double>", "throughput": "double", "n_throughput": "long",
    "hit_rate": "double", "n_busy": "long", "first": "array<double>", "last": "array<double>", "t_end": "double"}
STATE = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
_GAUGES = ("running", "queue", "throughput", "usage", "hit_rate")


def stream_samples(scrapes: DataFrame) -> DataFrame:
    """Samples of a stream of scraped texts, with all their other columns."""
    return to_samples(scrapes, [c for c in scrapes.columns if c != "text"])


def _latest(old: float | None, times: np.ndarray) -> float | None:
    new = float(times.max()) if len(times) else None
    return new if old is None else old if new is None else max(old, new)


class StepFold:
    """The mergeable part of a step's summary.

    Samples may come in any order. What saturates a sample beside its queue is the capacity or, without
    one, the step's peak; so the time of the last sample at the peak is kept. A sample with a queue on an
    idle server counts if it lies in the busy span: of those before the span's present end the latest is
    enough, those after it wait. Once the watermark has passed a waiting time, a later one covers it.
    """

    def __init__(self, state: dict[str, Any], capacity: float | None):
        self.s = state
        self.capacity = capacity

    @classmethod
    def empty(cls, capacity: float | None) -> StepFold:
        state = dict.fromkeys(FIELDS)
        state |= {"n": 0, "n_throughput": 0, "n_busy": 0, "throughput": 0.0, "hit_rate": 0.0, "pending": []}
        return cls(state, capacity)

    def add(self, t: np.ndarray, gauge: dict[str, np.ndarray], snapshots: np.ndarray) -> None:
        s = self.s
        s["n"] += len(t)
        running, queue = gauge["running"], gauge["queue"]
        busy = running > 0
        top = float(running.max())
        at_top = _latest(None, t[running == top])
        if s["peak"] is None or top > s["peak"]:
            s["peak"], s["peak_t"] = top, at_top
        elif top == s["peak"]:
            s["peak_t"] = max(s["peak_t"], at_top)
        s["usage"] = float(gauge["usage"].max()) if s["usage"] is None else max(s["usage"], float(gauge["usage"].max()))
        full = busy & (queue > 0)
        if self.capacity:
            full |= running >= self.capacity
        s["full_t"] = _latest(s["full_t"], t[full])
        if busy.any():
            s["phase_start"] = min(float(t[busy].min()), s["phase_start"] if s["phase_start"] is not None else np.inf)
            s["phase_end"] = _latest(s["phase_end"], t[busy])
        waiting = np.concatenate([np.asarray(s["pending"], float), t[~busy & (queue > 0)]])
        inside = waiting <= (s["phase_end"] if s["phase_end"] is not None else -np.inf)
        s["idle_t"] = _latest(s["idle_t"], waiting[inside])
        s["pending"] = waiting[~inside].tolist()
        flowing = busy & (gauge["throughput"] > 0)
        s["throughput"] += float(gauge["throughput"][flowing].sum())
        s["n_throughput"] += int(flowing.sum())
        s["hit_rate"] += float(gauge["hit_rate"][busy].sum())
        s["n_busy"] += int(busy.sum())
        rows = np.column_stack([t, snapshots])
        order = np.lexsort(rows.T[::-1])
        first, last = rows[order[0]].tolist(), rows[order[-1]].tolist()
        s["first"] = first if s["first"] is None else min(s["first"], first)
        s["last"] = last if s["last"] is None else max(s["last"], last)

    def passed(self, watermark: float) -> None:
        """Of the waiting times that no earlier busy sample can still precede, only the latest matters."""
        waiting = np.asarray(self.s["pending"], float)
        old = waiting[waiting < watermark]
        self.s["pending"] = [*([float(old.max())] if len(old) else []), *waiting[waiting >= watermark].tolist()]


class StepSummary(StatefulProcessor):
    """Per step: the fold of its samples, given out when the watermark passes its end."""

    def __init__(self, capacity: float | None, grace: float):
        self.capacity = capacity
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", STATE)

    def close(self) -> None:
        pass

    def _fold(self) -> StepFold:
        if not self.state.exists():
            return StepFold.empty(self.capacity)
        held = dict(zip(FIELDS, self.state.get()))
        return StepFold({k: list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for k, v in held.items()}, self.capacity)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fold = self._fold()
        for frame in rows:
            t = frame["t"].to_numpy(float)
            fold.add(t, {g: frame[g].to_numpy(float) for g in _GAUGES}, np.array(frame["snapshot"].tolist(), float).reshape(len(t), -1))
            end = frame["t_end"].iloc[0]
            if fold.s["t_end"] is None and not pd.isna(end):
                fold.s["t_end"] = float(end)
                now = timerValues.getCurrentWatermarkInMs()
                self.handle.registerTimer(max(int((float(end) + self.grace) * 1000), now + 1))
        fold.passed(timerValues.getCurrentWatermarkInMs() / 1000)
        self.state.update(tuple(fold.s[name] for name in FIELDS))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            fold = self._fold()
            yield pd.DataFrame({"step": [key[0]], **{name: [fold.s[name]] for name in FIELDS}})
        self.state.clear()


def summary_of_folds(folds: DataFrame, capacity: float | None = None) -> DataFrame:
    """The batch figures from the folded samples of each step; steps that were never busy are left out."""
    cap = F.lit(float(capacity)) if capacity else F.col("peak")
    # A sample at the peak saturates a server whose capacity is that peak.
    at_peak = F.lit(None).cast("double") if capacity else F.when(F.col("peak") > 0, F.col("peak_t"))
    queued = F.when(F.col("idle_t") >= F.col("phase_start"), F.col("idle_t"))

    def snapshot(column: str):
        return F.when(F.col("n") >= 2, F.struct(*[F.get(column, F.lit(i + 1)).alias(name) for i, name in enumerate(SNAPSHOT)]))

    ready = folds.filter(F.col("phase_start").isNotNull()).select(
        "step", "phase_start", "phase_end", F.col("peak").alias("running_peak"), cap.alias("cap"), F.col("usage").alias("usage_peak"),
        F.col("n").alias("n_samples"), F.greatest("full_t", at_peak, queued).alias("last_full"),
        snapshot("first").alias("_first"), snapshot("last").alias("_last"),
        F.try_divide("throughput", "n_throughput").alias("_throughput"), F.try_divide("hit_rate", "n_busy").alias("_hit_rate"))
    # Latencies need two samples.
    latency = [F.when(F.col("_first").isNotNull(), F.col(f"`{c}`")).alias(c) for c in ready.select(*latency_figures()).columns]
    figures = ready.select("step", "_first", *drain_figures(), *latency_figures())
    return figures.select("step", *[F.col(f"`{c}`") for c in ready.select(*drain_figures()).columns], *latency)


def stream_server_summary(
    scrapes: DataFrame,
    steps: DataFrame | None = None,
    *,
    parsed: bool = False,
    capacity: float | None = None,
    inclusive_end: bool = False,
    delay: str = "1 minute",
    grace: float = 0.0,
) -> DataFrame:
    """Summary of every step, once the watermark has passed its end: the rows of the batch summary.

    ``scrapes`` is a stream of ``(t, text)``, or of samples with tracked metric columns when ``parsed``.
    ``steps(step, t_start, t_end)`` are small enough to broadcast; without them the samples bring ``step``
    and ``t_end`` themselves. Windows are half open unless ``inclusive_end``. The state is one row per open
    step, whatever its number of samples. ``delay`` is how late samples may come, ``grace`` seconds are
    waited on top of a step's end; samples later than that are left out and counted by ``late_samples``.
    A step without an end stays open. Append mode.
    """
    require_rocksdb(scrapes.sparkSession)
    samples = gauges(scrapes if parsed else stream_samples(scrapes))
    # At an inclusive end itself a sample may still belong to the step.
    grace = grace + (0.001 if inclusive_end else 0.0)
    if steps is not None:
        ends = steps.withColumn("_end_of_step", F.col("t_end"))
        samples = assign_steps(samples, ends, inclusive_end=inclusive_end, broadcast=True).withColumnRenamed("_end_of_step", "t_end")
    timed = samples.filter(F.col("t").isNotNull()).select(
        "step", F.col("t").cast("double").alias("t"), F.col("t_end").cast("double").alias("t_end"),
        *_GAUGES, F.array(*snapshot_values(samples)).alias("snapshot"),
        F.timestamp_seconds("t").alias("event_time")).withWatermark("event_time", delay)
    folds = timed.groupBy("step").transformWithStateInPandas(
        StepSummary(capacity, grace), outputStructType=f"step {samples.schema['step'].dataType.simpleString()}, {STATE}",
        outputMode="append", timeMode="EventTime")
    return summary_of_folds(folds, capacity)


def late_samples(query: StreamingQuery) -> int:
    """Samples of a running or ended query that came after the watermark and were left out, as its progress reports tell."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
