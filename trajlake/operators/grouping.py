"""Joins and ordered sums that stay balanced when one key, or a few thousand, hold most of the rows.

* ``join_group_values`` joins rows to values. One pass counts the rows per bucket of the key hash
  (a counting sketch of fixed width); rows in heavy buckets are tagged, with or without a value, and
  dealt over several tasks, and only the values of those buckets are repeated.
* ``running_sums`` / ``with_positions`` / ``row_at`` are a segmented scan: rows are cut into ranges of
  (key, order), summed per range, and the totals of a key that spans ranges are carried on.

Every broadcast here has a bound that follows from the method: at most ``GRAIN`` buckets per task of
the join, and two totals per range of the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A bucket with more than 1/GRAIN of a task's share of the rows is dealt over several tasks.
GRAIN = 4
# Buckets of the key hash per task of the join.
BUCKETS_PER_TASK = 16
# Rows sampled per range for the bounds of the scan, and the most ranges one scan is cut into.
SAMPLE_PER_RANGE = 64
MAX_RANGES = 4096


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _flat(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's own estimate of ``df`` is within the session's broadcast threshold; no job runs."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def heavy_buckets(rows: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """(bucket, splits) of the key-hash buckets that hold too many rows for one task.

    The counts are sums of partial counts: the same whenever and wherever they are taken, so that both
    sides of a join may ask for them. At most ``GRAIN * tasks`` buckets come out, as each holds more
    than that share of the rows; a heavy key is never missed, because its bucket is as heavy.
    """
    counts = rows.select(_bucket(keys, tasks).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    table = counts.agg(F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("all"))
    part = F.col("total") / F.lit(GRAIN * tasks)
    heavy = F.filter("all", lambda x: x["n"] > part)
    return table.select(F.inline(F.transform(heavy, lambda x: F.struct(
        x["bucket"].alias("bucket"), F.ceil(x["n"] / part).cast("int").alias("splits")))))


def _bucket(keys: Sequence[str], tasks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS_PER_TASK * tasks)).cast("int")


def join_group_values(
    rows: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    tasks: int | None = None,
    broadcast: bool | None = None,
) -> DataFrame:
    """Join ``values`` to ``rows`` on ``keys`` without sending a heavy key to one task.

    Keys compare null-safely and may repeat on either side. ``how`` is ``left``, ``inner``, ``left_semi``
    or ``left_anti``. Columns of ``values`` replace those of the same name in ``rows``. ``spread_by`` are
    the columns telling the rows of one key apart (default: all flat columns); rows equal in them are
    spread over no more tasks than the input has partitions.

    Values that Catalyst itself would broadcast are joined plainly (``broadcast`` overrides the guess).
    Otherwise ``rows`` is read twice: once for the bucket counts, which need the keys only. Neither side of that
    join is broadcast, however small Spark takes it to be: it estimates exploded rows as if there was one each.
    """
    keys = list(keys)
    extra = [c for c in values.columns if c not in keys]
    kept = [c for c in rows.columns if c not in extra]
    if how in ("left_semi", "left_anti"):
        values, extra = values.select(*keys).distinct(), []
        kept = rows.columns
    side = values.select(*[F.col(k).alias(f"_v_{k}") for k in keys], *[F.col(c).alias(f"_x_{c}") for c in extra])
    match = [F.col(k).eqNullSafe(F.col(f"_v_{k}")) for k in keys]
    out = [*[F.col(c) for c in kept], *[F.col(f"_x_{c}").alias(c) for c in extra]]
    if fits_broadcast(values) if broadcast is None else broadcast:
        return rows.join(side, match, how).select(*out)

    tasks = tasks or _tasks(rows)
    heavy = heavy_buckets(rows, keys, tasks).toDF("_h_bucket", "_h_splits")
    spread_by = _flat(rows) if spread_by is None else list(spread_by)

    def tagged(df: DataFrame, names: Sequence[str]) -> DataFrame:
        own = df.withColumn("_bucket_of", _bucket(names, tasks))
        return own.join(F.broadcast(heavy), F.col("_bucket_of") == F.col("_h_bucket"), "left").drop("_bucket_of", "_h_bucket")

    # The number of the input partition keeps its value when a task is run again.
    share = F.pmod(F.xxhash64(*spread_by, F.spark_partition_id(), F.lit("share")), F.col("_h_splits")).cast("int")
    dealt = tagged(rows, keys).withColumn("_share", F.when(F.col("_h_splits").isNull(), 0).otherwise(share)).drop("_h_splits")
    copies = F.sequence(F.lit(0), F.coalesce("_h_splits", F.lit(1)) - 1)
    side = tagged(side, [f"_v_{k}" for k in keys]).withColumn("_copy", F.explode(copies)).drop("_h_splits")
    return dealt.hint("merge").join(side, [*match, F.col("_share") == F.col("_copy")], how).select(*out)


class _Ranges(NamedTuple):
    """Rows with their range number, and what tells whether the row's key reaches beyond its range."""

    rows: DataFrame
    number: int
    spans: Column


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None) -> _Ranges:
    """Cut rows into ranges of (keys, order) that hold about as many rows each.

    The bounds are quantiles of a sample of ``SAMPLE_PER_RANGE`` rows a range, drawn by a hash of the
    values and so the same at every evaluation; any bounds give right sums. Nulls sort first. Rows equal
    in keys and order share a range.
    """
    number = max(1, min(ranges or _tasks(df), MAX_RANGES))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    place = F.struct(key.alias("key"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("order"))
    if number == 1:
        return _Ranges(df.withColumn("_range", F.lit(0)), 1, F.lit(False))
    places = df.select(place.alias("place"))
    n = df.agg(F.count("*").cast("double")).scalar()
    drawn = F.pmod(F.xxhash64("place", F.lit("drawn")), F.lit(1 << 31)).cast("double")
    sample = places.filter(drawn * n < F.lit(float(number * SAMPLE_PER_RANGE) * (1 << 31))).distinct()
    ordered = sample.agg(F.array_sort(F.collect_list("place")).alias("all"))
    at = lambda i: F.floor(i * F.size("all") / number).cast("int")
    bounds = ordered.select(F.transform(F.sequence(F.lit(1), F.lit(number - 1)), lambda i: F.get("all", at(i)))).scalar()

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(number.bit_length()))])
    marked = df.withColumns({"_bounds": bounds, "_place": place})
    # The number of bounds below the row, by binary search.
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("_bounds", at + step - 1) < F.col("_place"), at + step).otherwise(at))
    marked = marked.withColumn("_range", found)
    same = lambda i: F.col("_place.key").eqNullSafe(F.get("_bounds", i)["key"])
    spans = same(F.col("_range") - 1) | same(F.col("_range"))
    return _Ranges(marked, number, spans)


def running_sums(
    df: DataFrame,
    order: str | Sequence[str],
    sums: Mapping[str, Column],
    *,
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``order`` within ``keys``, whatever the share of a key.

    ``order`` and ``ties`` are columns of any sortable type, nulls first, unique together within a key
    (rows equal in them are summed in any order). A segmented scan: the rows pass one shuffle, into
    ``ranges`` ranges of (key, order) of about equal size (default: the session's shuffle partitions). A
    range is summed per key in one task. Only a key found at a bound of its range can span ranges: the
    totals of those keys, at most two a range, are summed over the ranges and broadcast back.

    The plan reads ``df`` for the count, the sample and the totals besides; store it first if it is dear.
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    along = [*order, *ties]
    cut = _ranged(df, keys, along, ranges)
    kept = [c for c in df.columns if c not in sums]
    added = {f"_s_{name}": expr for name, expr in sums.items()}
    frame = Window.partitionBy("_range", *keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.rows.select(*df.columns, "_range")
    local = own.repartitionById(cut.number, "_range").withColumns({name: F.sum(expr).over(frame) for name, expr in added.items()})
    if cut.number == 1:
        return local.select(*kept, *[F.col(f"_s_{name}").alias(name) for name in sums])

    totals = cut.rows.filter(cut.spans).groupBy("_range", *keys).agg(*[F.sum(expr).alias(name) for name, expr in added.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_range").alias("_c_range"), *[F.col(k).alias(f"_c_{i}") for i, k in enumerate(keys)],
        *[F.sum(name).over(before).alias(f"_c{name}") for name in added])
    on = [F.col("_range") == F.col("_c_range"), *[F.col(k).eqNullSafe(F.col(f"_c_{i}")) for i, k in enumerate(keys)]]
    whole = lambda name: F.when(F.col(name).isNull(), F.col(f"_c{name}")).otherwise(
        F.col(name) + F.coalesce(F.col(f"_c{name}"), F.lit(0)))
    return local.join(F.broadcast(carried), on, "left").select(*kept, *[whole(f"_s_{name}").alias(name) for name in sums])


def with_positions(
    df: DataFrame,
    order: str | Sequence[str],
    *,
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "row_idx",
    ranges: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row along ``order`` within ``keys``."""
    numbered = running_sums(df, order, {name: F.lit(1).cast("long")}, keys=keys, ties=ties, ranges=ranges)
    return numbered.withColumn(name, F.col(name) - 1)


def row_at(df: DataFrame, index: int, order: str | Sequence[str], *, ties: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """The row at a 0-based position along ``order``; empty if there are fewer rows.

    Rows are counted per range, and only those of the one range that holds the position are sorted.
    """
    along = [*([order] if isinstance(order, str) else order), *ties]
    cut = _ranged(df, [], along, ranges)
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = cut.rows.groupBy("_range").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    held = counts.filter((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index))
    there = held.select(F.struct("_range", (F.lit(index) - F.col("upto") + F.col("n")).alias("at"))).scalar()
    found = cut.rows.withColumn("_there", there).filter(F.col("_range") == F.col("_there._range"))
    at = Window.partitionBy("_range").orderBy(*along)
    return found.withColumn("_at", F.row_number().over(at) - 1).filter(F.col("_at") == F.col("_there.at")).select(*df.columns)
