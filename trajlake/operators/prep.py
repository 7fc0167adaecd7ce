"""Task preparation: gradable filter, split, batches, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.numbers import total_steps
from trajlake.functions.predicates import contains_any
from trajlake.operators.grouping import join_group_values, row_at, running_sums, with_positions

SPEC_KEYS = ("repo", "version")
GROUP_SIZE = 8
# Files whose row counts are broadcast: a path and a number each.
MAX_FILES = 20_000


def _with_spec(df: DataFrame, specs: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Attach whether the row's (repo, version) has a spec, and its build error."""
    error = F.max("build_error") if "build_error" in specs.columns else F.lit(None).cast("string")
    known = specs.groupBy(*SPEC_KEYS).agg(error.alias("_error"), F.lit(True).alias("_known"))
    return join_group_values(df, known, SPEC_KEYS, broadcast=broadcast)


def keep_gradable(df: DataFrame, specs: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Rows whose (repo, version) is in the spec table and builds. ``broadcast``: as in ``join_group_values``."""
    placed = _with_spec(df, specs, broadcast)
    return placed.filter(F.col("_known") & F.col("_error").isNull()).drop("_known", "_error")


def drop_reason(repo: Column, version: Column) -> Column:
    quoted = F.when(version.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), version, F.lit("'")))
    return F.concat(F.lit("(repo,version)=("), F.coalesce(repo, F.lit("None")), F.lit(","), quoted,
                    F.lit(") not in spec map"))


def dropped(df: DataFrame, specs: DataFrame, id_col: str = "instance_id", broadcast: bool | None = None) -> DataFrame:
    """Rows left out by ``keep_gradable`` with the reason."""
    placed = _with_spec(df, specs, broadcast).filter(F.col("_known").isNull() | F.col("_error").isNotNull())
    reason = F.when(F.col("_known"), F.col("_error")).otherwise(drop_reason(F.col("repo"), F.col("version")))
    return placed.select(
        *df.columns, F.concat(F.col(id_col).cast("string"), F.lit(": "), reason).alias("reason"))


def with_row_index(df: DataFrame, order: str | Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """0-based position over the whole table along columns of any sortable type, nulls first."""
    return with_positions(df, order, ties=ties, name="row_idx")


def in_file_order(df: DataFrame, name: str = "row_idx", *, broadcast: bool | None = None) -> DataFrame:
    """Rows of a table read from files, with their 0-based position in it: files by name, rows as they lie.

    The reader tells file and place of each row (``_metadata``), so no row is sorted or moved: the rows
    are counted per file, and the files before give each file's first position. The counts are broadcast
    if the table has at most ``MAX_FILES`` files; with more, rows and counts meet in a skew-proof join.
    Call it on the table as read: later steps hide the file columns. Formats without ``row_index`` in
    their metadata (all but Parquet) raise an error.
    """
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    counts = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
    # Ranges only pay for very many files.
    files = len(df.inputFiles())
    upto = running_sums(counts, "_file", {"_upto": F.col("_rows")}, ranges=-(-files // MAX_FILES))
    before = upto.select("_file", (F.col("_upto") - F.col("_rows")).alias("_before"))
    few = files <= MAX_FILES if broadcast is None else broadcast
    joined = placed.join(F.broadcast(before), "_file") if few else join_group_values(
        placed, before, ["_file"], how="inner", spread_by=["_at"], broadcast=False)
    return joined.select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))


def split_first_k(df: DataFrame, k: int = 20, index: str = "row_idx") -> DataFrame:
    """Tag the first ``k`` rows ``val`` and the rest ``train``; no shuffle, no seed."""
    return df.withColumn("split", F.when(F.col(index) < k, F.lit("val")).otherwise(F.lit("train")))


def to_prepared(
    df: DataFrame, data_source: str = "swebench", agent_name: str = "swebench_agent"
) -> DataFrame:
    """Training-row layout: constant tags, one user message, ground truth, the whole row nested."""
    statement = F.coalesce(F.col("problem_statement"), F.lit(""))
    return df.select(
        F.lit(data_source).alias("data_source"), F.lit(agent_name).alias("agent_name"),
        F.array(F.struct(F.lit("user").alias("role"), statement.alias("content"))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), F.col("instance_id").alias("ground_truth")).alias("reward_model"),
        F.struct(*[F.col(c) for c in df.columns]).alias("extra_info"))


def prep_report(df: DataFrame, specs: DataFrame, val_size: int = 20) -> DataFrame:
    """Counts of raw, gradable, dropped, train and val rows, in one pass."""
    gradable = F.coalesce(F.col("_known"), F.lit(False)) & F.col("_error").isNull()
    counts = _with_spec(df, specs).agg(
        F.count("*").alias("raw"), F.coalesce(F.sum(gradable.cast("long")), F.lit(0)).alias("gradable"))
    val = F.least(F.col("gradable"), F.lit(val_size).cast("long"))
    return counts.select("raw", "gradable", (F.col("raw") - F.col("gradable")).alias("dropped"),
                         (F.col("gradable") - val).alias("train"), val.alias("val"))


def assign_batches(
    instances: DataFrame, batch_size: int, steps: int | None = None, *, epochs: int = 3, index: str = "row_idx",
    table: DataFrame | None = None,
) -> DataFrame:
    """Cyclic batches: slot k (0-based, over all steps) holds instance k mod N.

    Every instance lists its own slots, so nothing is joined. ``steps`` defaults to the
    steps of ``epochs`` passes. ``table`` has the same rows without their index; given it, the rows are
    counted there, and the index is worked out once.
    """
    n = (instances if table is None else table).agg(F.count("*")).scalar()
    wanted = F.lit(steps) if steps is not None else total_steps(n, batch_size, epochs)
    slots = wanted.cast("long") * F.lit(batch_size)
    mine = F.when(F.col(index) < slots, F.sequence(F.col(index).cast("long"), slots - 1, n.cast("long")))
    out = instances.withColumn("slot", F.explode(mine))
    return out.withColumns({
        "step": F.floor(F.col("slot") / F.lit(batch_size)).cast("long"),
        "position": F.pmod(F.col("slot"), F.lit(batch_size)).cast("long")})


def expand_groups(df: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """``group_size`` samples of every row."""
    return df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))))


def missing(
    required: DataFrame, present: DataFrame, keys: Sequence[str] = ("name",), broadcast: bool | None = None
) -> DataFrame:
    """Required names that are not present."""
    return join_group_values(required, present, keys, how="left_anti", broadcast=broadcast)


def skip_any(df: DataFrame, column: str, parts: Sequence[str]) -> DataFrame:
    """Drop rows whose ``column`` contains any of ``parts``."""
    return df.filter(~contains_any(F.col(column), parts))


def union_splits(parts: Sequence[tuple[str, DataFrame | None]]) -> DataFrame:
    """Concatenate tagged tables in the given order; a missing one is skipped."""
    tagged = [df.withColumns({"source": F.lit(name), "source_rank": F.lit(i)})
              for i, (name, df) in enumerate(parts) if df is not None]
    if not tagged:
        raise ValueError("no table to union")
    out = tagged[0]
    for other in tagged[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def lookup_id(df: DataFrame, instance_id, column: str = "instance_id", order: Sequence[str] = ()) -> DataFrame:
    """First row with the given id. Empty if absent; ``require_row`` turns that into an error."""
    return df.filter(F.col(column) == F.lit(instance_id)).orderBy(*(order or [column])).limit(1)


def lookup_index(df: DataFrame, index: int, order: str | Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The row at a 0-based position along ``order``, empty if there are fewer rows; only its range is sorted."""
    return row_at(df, index, order, ties=ties)


def require_row(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise LookupError(f"{what} not found")
    return df


def head_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows along ``order``, for a report."""
    return df.orderBy(*order).limit(n)


def attach_instances(
    rollouts: DataFrame, instances: DataFrame, keys: Sequence[str] = ("instance_id",), broadcast: bool | None = None
) -> DataFrame:
    """Rollout rows with the columns of their instance; a heavy instance is spread out."""
    return join_group_values(rollouts, instances, keys, how="inner", broadcast=broadcast)
