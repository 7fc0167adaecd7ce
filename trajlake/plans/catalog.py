"""Registration of queries and what their inputs share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Folders written by queries, all below the session's checkpoint folder.
WORK_DIRS: list[str] = []


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that sums in another order compare equal."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[
        F.round(F.col(f"`{c}`"), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def greatest_is(column: str, value: str) -> Column:
    """Whether the greatest text of a group is ``value``. Spark sorts all rows for the greatest of texts, not for that of booleans."""
    return F.max(F.col(column) == value) & ~F.max(F.col(column) > value)


def least_is(column: str, value: str) -> Column:
    return F.max(F.col(column) == value) & ~F.max(F.col(column) < value)


def turn_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as turns: an order is an episode, a line number a turn.

    Line numbers repeat within an order, so they are summed up first; an order then has
    at most as many turns as there are line numbers.
    """
    li = table(spark, sf, "lineitem")
    turns = li.groupBy(F.col("l_orderkey").alias("trajectory_id"),
                       F.col("l_linenumber").cast("long").alias("turn")).agg(
        F.sum("l_quantity").cast("long").alias("gen_tokens"),
        F.sum(F.col("l_partkey") % 20).alias("tool_tokens"),
        F.count("*").alias("_n"), greatest_is("l_returnflag", "R").alias("_returned"), least_is("l_linestatus", "F").alias("_tried"),
        F.sum("l_suppkey").alias("_supp"), F.sum("l_partkey").alias("_part"))
    return turns.select(
        "trajectory_id", "turn", "gen_tokens", "tool_tokens",
        F.when(F.col("_returned"), F.lit(0)).otherwise(F.col("_n")).cast("long").alias("n_calls"),
        F.when(~F.col("_returned") & (F.col("_supp") % 3 == 0), F.col("_n")).otherwise(F.lit(0)
               ).cast("long").alias("n_salvaged"),
        F.col("_tried").alias("attempted"),
        F.when(F.col("_supp") % 7 == 0, F.lit(0)).alias("submitted_call_idx"),
        F.when(F.col("_part") % 97 == 0, F.lit("Timeout")).alias("crashed_type"))


TURNS_SQL = """
turns AS (
  SELECT l_orderkey AS trajectory_id, CAST(l_linenumber AS BIGINT) AS turn,
         CAST(sum(l_quantity) AS BIGINT) AS gen_tokens, CAST(sum(l_partkey % 20) AS BIGINT) AS tool_tokens,
         CASE WHEN max(l_returnflag) = 'R' THEN 0 ELSE count(*) END AS n_calls,
         CASE WHEN max(l_returnflag) <> 'R' AND sum(l_suppkey) % 3 = 0 THEN count(*) ELSE 0 END AS n_salvaged,
         min(l_linestatus) = 'F' AS attempted,
         CASE WHEN sum(l_suppkey) % 7 = 0 THEN 0 END AS submitted_call_idx,
         CASE WHEN sum(l_partkey) % 97 = 0 THEN 'Timeout' END AS crashed_type
  FROM lineitem GROUP BY 1, 2)"""
