"""Physical plans of the catalogue: no nested loops, no whole table in one partition."""

import re

import pytest

from trajlake import plans
from trajlake.plans.catalog import greatest_is, least_is, turn_rows

plans.load()
SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in plans.QUERIES if not n.startswith(("stream", "source", "numbered")))


@pytest.mark.parametrize("name", BATCH)
def test_plan_scales(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    lines = [re.sub(r"#\d+L?", "", line.strip(" +-:")) for line in plan.splitlines()]
    for above, below in zip(lines, lines[1:]):
        if "SinglePartition" in above:
            # Only partial aggregates and totals of ranges and counts of files, both of bounded number, come together.
            assert re.match(r"\w+Aggregate\(key(s)?=\[\], functions=\[partial_|HashAggregate\(keys=\[_(range|file)\b", below), below


def test_only_used_columns_are_read(spark):
    for name, columns in (("large_group_advantage", {"o_orderkey", "o_custkey", "o_orderstatus"}),
                          ("loop_profile", {"user_id", "event_type"}), ("head_rows", {"l_orderkey", "l_partkey", "l_extendedprice"})):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
            assert {c.split(":")[0] for c in schema.split(",")} <= columns


def test_first_filters_reach_the_scan(spark):
    plan = plans.QUERIES["missing_names"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,P\)", plan)


def test_calls_are_parsed_once(spark):
    plan = plans.QUERIES["tool_call_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and not re.search(r"Filter .*_rewritten|Filter .*parseJson", plan)


def test_turns_are_summed_without_sorting_the_rows(spark):
    assert "SortAggregate" not in turn_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, "A"), (1, "R"), (2, "R"), (2, "S"), (3, None), (4, None), (4, "R"), (5, "A")], "k int, x string")
    found = rows.groupBy("k").agg(greatest_is("x", "R").alias("top"), least_is("x", "R").alias("low")).orderBy("k").collect()
    assert [tuple(r) for r in found] == [(1, True, False), (2, False, True), (3, None, None), (4, True, True), (5, False, False)]
