"""Token-array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_INTS = "array<int>"


def empty_ints() -> Column:
    return F.array().cast(NO_INTS)


def repeat_int(value: Column | int, n: Column) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.array_repeat(value.cast("int"), n.cast("int"))


def role_bit(role: Column) -> Column:
    """1 for tokens the policy wrote, 0 for everything else."""
    return F.when(role == "assistant", F.lit(1)).otherwise(F.lit(0))


def role_mask(role: Column, n: Column) -> Column:
    return repeat_int(role_bit(role), n)


def keep_last(values: Column, limit: Column | int) -> Column:
    """The last ``limit`` elements."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.slice(values, F.greatest(F.size(values) - limit, F.lit(0)).cast("int") + 1, limit.cast("int"))


def keep_first(values: Column, limit: Column | int) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.slice(values, F.lit(1), limit.cast("int"))


def or_pad(values: Column, pad: int) -> Column:
    """A single pad value in place of an empty array."""
    return F.when(F.size(values) == 0, F.array(F.lit(pad).cast("int"))).otherwise(values)


def attention_mask(ids: Column) -> Column:
    return repeat_int(1, F.size(ids))


def position_ids(ids: Column) -> Column:
    """0..n-1, empty for an empty sequence; restarts at 0 after truncation."""
    return F.when(F.size(ids) == 0, empty_ints()).otherwise(
        F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0))).cast(NO_INTS))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def token_advantages(advantage: Column, mask: Column) -> Column:
    """The trajectory's advantage on its own tokens, 0 elsewhere."""
    return F.transform(mask, lambda bit: F.when(bit == 1, advantage).otherwise(F.lit(0.0)))
