"""Grading outcomes attached to episodes. A missing or failed grading keeps its row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import binary_reward
from trajlake.functions.predicates import is_empty_patch
from trajlake.operators.grouping import join_group_values

EPISODE = ("step", "instance_id", "group_idx")
GRADE_FIELDS = (
    "resolved", "reward", "empty_patch", "eval_error", "patch_applied",
    "f2p_passed", "f2p_total", "p2p_passed", "p2p_total", "pytest_output_length",
)


def _size(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)).cast("long")


def grade_counts(reports: DataFrame) -> DataFrame:
    """Flags and pass counts of parsed reports; an absent bucket counts 0."""
    out = {
        "resolved": F.coalesce(F.col("report.resolved"), F.lit(False)),
        "patch_applied": F.coalesce(F.col("report.patch_successfully_applied"), F.lit(False)),
    }
    for bucket, prefix in (("FAIL_TO_PASS", "f2p"), ("PASS_TO_PASS", "p2p")):
        tests = F.try_element_at(F.col("report.tests_status"), F.lit(bucket))
        # size(null) is null only outside legacy mode, so guard the bucket itself.
        passed = F.when(tests["success"].isNotNull(), _size(tests["success"])).otherwise(F.lit(0))
        failed = F.when(tests["failure"].isNotNull(), _size(tests["failure"])).otherwise(F.lit(0))
        out[f"{prefix}_passed"] = passed.cast("long")
        out[f"{prefix}_total"] = (passed + failed).cast("long")
    kept = [c for c in reports.columns if c != "report"]
    return reports.select(*kept, *[expr.alias(name) for name, expr in out.items()])


def grade_outcome(
    patches: DataFrame,
    reports: DataFrame,
    errors: DataFrame,
    sizes: DataFrame | None = None,
    keys: Sequence[str] = EPISODE,
) -> DataFrame:
    """Grade every submitted patch: empty patch first, then a grading error, then its report.

    ``reports`` holds the columns of ``grade_counts``, ``errors(keys, eval_error)`` the
    failed gradings, ``sizes(keys, pytest_output_length)`` the test-log sizes. A patch with
    none of them scores 0 with all counts 0. Where reports carry a ``report_status``, one that could
    not be read is a failed grading with that status as its error.
    """
    if "report_status" in reports.columns:
        broken = ~F.col("report_status").isin("ok", "missing instance")
        reports = reports.withColumn("_report_error", F.when(broken, F.col("report_status"))).drop("report_status")
    else:
        reports = reports.withColumn("_report_error", F.lit(None).cast("string"))
    df = patches.join(reports, list(keys), "left").join(errors, list(keys), "left")
    if sizes is not None:
        df = df.join(sizes, list(keys), "left")
    else:
        df = df.withColumn("pytest_output_length", F.lit(0).cast("long"))
    empty = is_empty_patch(F.col("submission"))
    error = F.when(~empty, F.coalesce(F.col("eval_error"), F.col("_report_error"), F.lit(""))).otherwise(F.lit(""))
    graded = ~empty & (error == "")

    def if_graded(name: str, default: Column) -> Column:
        return F.when(graded, F.coalesce(F.col(name), default)).otherwise(default)

    resolved = if_graded("resolved", F.lit(False))
    zero = F.lit(0).cast("long")
    return df.select(
        *keys,
        resolved.alias("resolved"), binary_reward(resolved).alias("reward"), empty.alias("empty_patch"),
        error.alias("eval_error"), if_graded("patch_applied", F.lit(False)).alias("patch_applied"),
        *[if_graded(c, zero).alias(c) for c in GRADE_FIELDS[5:]])


def attach_grading(
    trajectories: DataFrame, grades: DataFrame, keys: Sequence[str] = EPISODE, broadcast: bool | None = None
) -> DataFrame:
    """Copy the grading fields onto every episode; an ungraded one gets their defaults.

    The keys may be coarser than an episode (one grade for all attempts at an instance),
    so a heavy instance, graded or not, is kept from filling one task. ``broadcast``: as in
    ``join_group_values``.
    """
    zero = F.lit(0).cast("long")
    defaults = {
        "resolved": F.lit(False), "reward": F.lit(0.0), "empty_patch": F.lit(False),
        "eval_error": F.lit(""), "patch_applied": F.lit(False),
        **{c: zero for c in GRADE_FIELDS[5:]},
    }
    joined = join_group_values(trajectories, grades.select(*keys, *GRADE_FIELDS), keys, broadcast=broadcast)
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def degrade_to_zero(df: DataFrame, failed: Column, reason: Column) -> DataFrame:
    """Keep a failed row with reward 0, unresolved, and the reason as its grading error."""
    return df.withColumns({
        "reward": F.when(failed, F.lit(0.0)).otherwise(F.col("reward")),
        "resolved": F.when(failed, F.lit(False)).otherwise(F.col("resolved")),
        "eval_error": F.when(failed, reason).otherwise(F.col("eval_error")),
    })
