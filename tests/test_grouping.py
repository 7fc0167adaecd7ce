import random

import pytest
from pyspark.sql import functions as F

from trajlake.operators.grouping import heavy_buckets, join_group_values, row_at, running_sums, with_positions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(make):
    # Key "h" holds well over a third of the rows.
    data = [(i, "h" if i % 5 < 2 else f"k{i % 7}" if i % 11 else None) for i in range(600)]
    return data, make(data, "id long, k string")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("tasks,broadcast", [(1, False), (4, False), (64, False), (None, True), (None, None)])
def test_join_group_values_equals_plain_join(make, rows, how, tasks, broadcast):
    data, df = rows
    known = {"h": 1, "k1": 2, "k3": 3, None: 9, "unused": 4}
    values = make(list(known.items()), "k string, v long")
    out = join_group_values(df, values, ["k"], how=how, tasks=tasks, broadcast=broadcast)
    got = sorted(map(tuple, out.collect()), key=repr)
    if how == "left":
        want = [(i, k, known.get(k)) for i, k in data]
    elif how == "inner":
        want = [(i, k, known[k]) for i, k in data if k in known]
    else:
        want = [(i, k) for i, k in data if (k in known) == (how == "left_semi")]
    assert got == sorted(want, key=repr)


def test_join_group_values_with_repeated_keys_and_replaced_columns(make, rows):
    data, df = rows
    twice = make([("h", 1), ("h", 2), ("k1", 3)], "k string, v long")
    out = join_group_values(df, twice, ["k"], how="inner", tasks=8, broadcast=False)
    want = [(i, k, v) for i, k in data for kk, v in [("h", 1), ("h", 2), ("k1", 3)] if k == kk]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    clash = df.withColumns({"v": F.lit(0), "bucket": F.lit(5), "splits": F.lit(6)})
    out = join_group_values(clash, make([("h", 1)], "k string, v long"), ["k"], how="inner", tasks=8, broadcast=False)
    assert out.columns == ["id", "k", "bucket", "splits", "v"]
    assert {tuple(r)[1:] for r in out.collect()} == {("h", 5, 6, 1)}


def test_heavy_key_without_a_value_is_spread_too(spark, make):
    """Of 400 rows 320 have a key that no value has; they must not meet in one task."""
    df = spark.range(400).select("id", F.when(F.col("id") < 320, "lost").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    values = make([("k350", 1)], "k string, v long")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = join_group_values(df, values, ["k"], tasks=4, broadcast=False)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert sum(sizes) == 400 and max(sizes) <= 200


def test_heavy_buckets_are_bounded_and_miss_no_heavy_key(spark):
    df = spark.range(30_000).select((F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))).alias("k"))
    heavy = heavy_buckets(df, ["k"], 8).collect()
    assert 1 <= len(heavy) <= 4 * 8
    # A third of the rows over 8 tasks of four grains each: eleven pieces.
    assert 10 <= max(r["splits"] for r in heavy) <= 14


@pytest.mark.parametrize("ranges", [1, 2, 7, 300])
def test_running_sums_equal_a_window(make, ranges):
    rng = random.Random(ranges)
    data = []
    for key in ("a", "b", None):
        for order in rng.sample(range(-(1 << 20), 1 << 34), 300 if key == "a" else 80):
            data.append((key, order, rng.choice([None, rng.randrange(100)])))
    out = running_sums(make(data, "k string, o long, v long"), "o", {"upto": F.col("v"), "n": F.lit(1)}, keys=["k"], ranges=ranges)
    want = []
    for key in ("a", "b", None):
        total = None
        for n, (_, order, v) in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: r[1]), 1):
            total = total if v is None else (total or 0) + v
            want.append((key, order, v, total, n))
    got = out.select("k", "o", "v", "upto", "n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_positions_along_strings_dates_and_nulls(make):
    data = [(None, 1, "x"), ("b", None, "x"), ("a", 2, "x"), ("a", None, None), ("a", 2, None), (None, None, "x")]
    out = with_positions(make(data, "s string, n long, t string"), ["s", "n"], ties=["t"], ranges=3)
    order = sorted(data, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])
    assert {tuple(r)[:3]: r["row_idx"] for r in out.collect()} == {row: i for i, row in enumerate(order)}
    out = with_positions(make([(None,), (0,), (1,)], "o long"), "o", ranges=2)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == [(None, 0), (0, 1), (1, 2)]


def test_positions_of_repeated_rows_and_of_nothing(make):
    out = with_positions(make([("same",)] * 50, "o string"), "o", ranges=4)
    assert sorted(r["row_idx"] for r in out.collect()) == list(range(50))
    assert with_positions(make([], "o string"), "o", ranges=4).collect() == []


def test_two_thousand_equally_heavy_keys_stay_balanced(spark):
    """No range holds twice the mean, be there one key, a few or two thousand, and rows are shuffled once."""
    for keys in (1, 3, 2000):
        df = spark.range(0, 200_000, 1, 8).select((F.col("id") % keys).alias("k"), (F.col("id") * 7919 % 200_003).alias("o"))
        out = with_positions(df, "o", keys=["k"], ranges=16)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) <= 2 * 200_000 / 16
        last = out.groupBy("k").agg(F.max("row_idx").alias("m"), F.count("*").alias("n"))
        assert last.filter("m + 1 <> n").count() == 0
    plan = plan_of(out)
    wide = [line for line in plan.splitlines() if "Exchange shufflepartitionidpassthrough" in line]
    assert len(wide) == 1 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("index", [0, 1, 57, 99, 100, 5000])
def test_row_at(make, index):
    data = [(f"id-{i:03d}", i) for i in random.Random(1).sample(range(100), 100)]
    found = row_at(make(data, "s string, v long"), index, "s", ranges=6).collect()
    assert [tuple(r) for r in found] == ([(f"id-{index:03d}", index)] if index < 100 else [])
