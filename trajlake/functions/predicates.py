"""Boolean columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.numbers import any_of

# Substrings that mark a shell command as a code edit.
EDIT_MARKERS = ("apply_patch", "edit ", "str_replace", ">>>>>>> REPLACE", "<<<<<<< SEARCH")

# Log lines counted as failures, and lines dropped as noise.
ERROR_PATTERN = (
    r"(?i)Traceback|RuntimeError|CUDA error|has no attribute 'dim'|OutOfMemory"
    r"|Permission denied|Killed|Error:"
)
NOISE_PATTERN = (
    r"^\s*$|RouterReplay|NPU not support|UserWarning|warnings.warn"
    r"|file_system_monitor|Loading checkpoint shards"
)


def is_empty_patch(patch: Column) -> Column:
    """Null, empty or whitespace only."""
    return ~F.coalesce(patch, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def busy(running: Column) -> Column:
    return running > 0


def saturated(running: Column, queue: Column, capacity: Column) -> Column:
    return (queue > 0) | (running >= capacity)


def in_window(t: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Both ends inclusive; a missing or null end leaves that side open."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (start.isNull() | (t >= start))
    if end is not None:
        inside = inside & (end.isNull() | (t <= end))
    return inside


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return any_of([text.contains(part) for part in parts if part])


def is_edit(command: Column) -> Column:
    return contains_any(F.coalesce(command, F.lit("")), EDIT_MARKERS)


def is_error_line(line: Column) -> Column:
    return line.rlike(ERROR_PATTERN)


def is_noise_line(line: Column) -> Column:
    return line.rlike(NOISE_PATTERN)
