"""Small arithmetic rules shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character no decimal number holds. A cast alone would also take "1d", "0x1p3" or "Infinity".
NOT_DECIMAL = r"[^0-9eE.+-]"


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 when the denominator is not positive or missing."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def decimal_double(text: Column) -> Column:
    """Text to double, null for anything but a decimal number. Too large a number is infinite;
    ``finite`` tells."""
    text = F.trim(text)
    return F.when(~text.rlike(NOT_DECIMAL), text).try_cast("double")


def finite(value: Column) -> Column:
    """Neither null nor infinite."""
    return F.abs(value) < F.lit(float("inf"))


def generation_time(trajectory_s: Column, tool_s: Column) -> Column:
    return F.greatest(trajectory_s - tool_s, F.lit(0.0))


def binary_reward(resolved: Column) -> Column:
    return F.when(resolved, F.lit(1.0)).otherwise(F.lit(0.0))


def turn_count(assistant_turns: Column) -> Column:
    """Prompt plus one assistant and one tool message per turn."""
    return assistant_turns * 2 + 1


def total_steps(rows: Column, batch_size: int, epochs: int = 3) -> Column:
    return F.ceil(rows / F.lit(batch_size)) * F.lit(epochs)


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two epoch doubles, never negative."""
    return F.greatest(end - start, F.lit(0.0))


def rate(flag: Column) -> Column:
    """Share of rows for which ``flag`` holds."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def epoch_seconds(ts: Column) -> Column:
    """A zone-less timestamp, read as UTC whatever the session's zone, in seconds since the epoch."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / F.lit(1e6)


def run_name(ts: Column) -> Column:
    """Run names are start times written ``yyyyMMdd-HHmmss``."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")
