from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import prep as p
from trajlake.plans.catalog import query, table

SPEC_SQL = """
inst AS (SELECT p_partkey, p_brand AS repo, CAST(p_size AS VARCHAR) AS version, p_name FROM part),
specs AS (SELECT DISTINCT p_brand AS repo, CAST(p_size AS VARCHAR) AS version,
                 CASE WHEN p_size = 13 THEN 'build failed' END AS build_error FROM part WHERE p_size <= 25),
placed AS (SELECT i.*, s.repo IS NOT NULL AS known, s.build_error FROM inst i
           LEFT JOIN specs s ON i.repo = s.repo AND i.version = s.version),
good AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx FROM placed WHERE known AND build_error IS NULL)"""


def instances(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("instance_id"), F.col("p_brand").alias("repo"),
        F.col("p_size").cast("string").alias("version"), F.col("p_name").alias("problem_statement"))


def specs(spark, sf):
    part = table(spark, sf, "part").filter(F.col("p_size") <= 25)
    return part.select(
        F.col("p_brand").alias("repo"), F.col("p_size").cast("string").alias("version"),
        F.when(F.col("p_size") == 13, F.lit("build failed")).alias("build_error")).distinct()


def split_instances(spark, sf):
    good = p.keep_gradable(instances(spark, sf), specs(spark, sf))
    return p.split_first_k(p.with_row_index(good, "instance_id"), 20)


@query("gradable_split", f"""
WITH {SPEC_SQL}
SELECT p_partkey AS instance_id, row_idx, CASE WHEN row_idx < 20 THEN 'val' ELSE 'train' END AS split FROM good""")
def gradable_split(spark, sf):
    return split_instances(spark, sf).select("instance_id", "row_idx", "split")


@query("gradable_spread", f"""
WITH {SPEC_SQL}
SELECT p_partkey AS instance_id, repo, version FROM good""")
def gradable_spread(spark, sf):
    """The same filter through the skew-proof join, as for spec tables too large to broadcast."""
    return p.keep_gradable(instances(spark, sf), specs(spark, sf), broadcast=False).select("instance_id", "repo", "version")


@query("prepared_rows", f"""
WITH {SPEC_SQL}
SELECT 'swebench' AS data_source, 'swebench_agent' AS agent_name, 1 AS n_messages, 'user' AS role, p_name AS content,
       'rule' AS style, p_partkey AS ground_truth, repo, version
FROM good""")
def prepared_rows(spark, sf):
    good = p.keep_gradable(instances(spark, sf), specs(spark, sf))
    first = F.col("prompt")[0]
    return p.to_prepared(good).select(
        "data_source", "agent_name", F.size("prompt").alias("n_messages"), first["role"].alias("role"),
        first["content"].alias("content"), "reward_model.style", "reward_model.ground_truth",
        "extra_info.repo", "extra_info.version")


@query("ungradable", f"""
WITH {SPEC_SQL}
SELECT p_partkey AS instance_id, p_partkey || ': ' || CASE WHEN known THEN build_error
       ELSE '(repo,version)=(' || repo || ',''' || version || ''') not in spec map' END AS reason
FROM placed WHERE NOT known OR build_error IS NOT NULL""")
def ungradable(spark, sf):
    return p.dropped(instances(spark, sf), specs(spark, sf)).select("instance_id", "reason")


@query("prep_report", f"""
WITH {SPEC_SQL}
SELECT count(*) AS raw, count(*) FILTER (known AND build_error IS NULL) AS gradable,
       count(*) FILTER (NOT known OR build_error IS NOT NULL) AS dropped,
       greatest(count(*) FILTER (known AND build_error IS NULL) - 20, 0) AS train,
       least(count(*) FILTER (known AND build_error IS NULL), 20) AS val
FROM placed""")
def prep_report(spark, sf):
    return p.prep_report(instances(spark, sf), specs(spark, sf))


@query("row_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders""")
def row_index(spark, sf):
    return p.with_row_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("row_index_strings", """
SELECT c_name, c_mktsegment, row_number() OVER (ORDER BY seg NULLS FIRST, c_name) - 1 AS row_idx
FROM (SELECT *, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS seg FROM customer)""")
def row_index_strings(spark, sf):
    """Positions along string columns, of which one is null for a fifth of the rows."""
    named = table(spark, sf, "customer").select(
        "c_name", "c_mktsegment", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("seg"))
    return p.with_row_index(named, ["seg", "c_name"]).drop("seg")


@query("row_index_files", """
SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents""")
def row_index_files(spark, sf):
    """Positions in file order; the table's files are in ascending order of doc_id."""
    return p.in_file_order(table(spark, sf, "documents")).select("doc_id", "source", "row_idx")


@query("file_order_split", """
SELECT p_partkey AS instance_id, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= 20 THEN 'val' ELSE 'train' END AS split
FROM part""")
def file_order_split(spark, sf):
    """First-k split of a task table in file order, by its string id."""
    rows = p.in_file_order(table(spark, sf, "part"), broadcast=False)
    return p.split_first_k(rows, 20).select(F.col("p_partkey").alias("instance_id"), "split")


CYCLE_SQL = """
WITH n AS (SELECT count(*) AS n FROM supplier),
slots AS (SELECT unnest(range(CAST(ceil(n / 7.0) AS BIGINT) * 3 * 7)) AS slot FROM n),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx FROM supplier)"""


@query("cyclic_batches", f"""
{CYCLE_SQL}
SELECT s_suppkey, slot, slot // 7 AS step, slot % 7 AS position
FROM slots CROSS JOIN n JOIN s ON row_idx = slot % n.n""")
def cyclic_batches(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey")
    return p.assign_batches(p.with_row_index(suppliers, "s_suppkey"), 7, epochs=3, table=suppliers).select("s_suppkey", "slot", "step", "position")


@query("expand_groups", """
SELECT s_suppkey, CAST(g AS INTEGER) AS sample FROM supplier, range(8) r(g)""")
def expand_groups(spark, sf):
    return p.expand_groups(table(spark, sf, "supplier").select("s_suppkey"))


@query("point_lookup", """
SELECT 'id' AS how, c_custkey, c_name FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)
UNION ALL SELECT 'index', c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 40)""")
def point_lookup(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    wanted = customers.agg(F.max("c_name")).first()[0]
    by_id = p.lookup_id(customers, wanted, "c_name", ["c_custkey"])
    by_index = p.lookup_index(customers, 40, "c_custkey")
    return by_id.select(F.lit("id").alias("how"), "*").unionByName(by_index.select(F.lit("index").alias("how"), "*"))


@query("split_union", """
SELECT 'val' AS source, 0 AS source_rank, s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier
UNION ALL SELECT 'train', 1, c_custkey, c_name, NULL FROM customer""")
def split_union(spark, sf):
    val = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    train = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return p.union_splits([("val", val), ("missing", None), ("train", train)]).withColumn(
        "source_rank", F.when(F.col("source") == "val", 0).otherwise(1))


@query("missing_names", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def missing_names(spark, sf):
    seen = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return p.missing(table(spark, sf, "customer").select("c_custkey"), seen, ["c_custkey"])


@query("missing_spread", """
SELECT o_orderkey, grp FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS grp FROM orders)
WHERE grp NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def missing_spread(spark, sf):
    """A third of the rows hold one key that is nowhere present."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("grp"))
    present = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("grp"))
    return p.missing(orders, present, ["grp"], broadcast=False)


@query("skip_any", """
SELECT p_partkey FROM part WHERE NOT contains(p_type, 'BRASS') AND NOT contains(p_type, 'TIN')""")
def skip_any(spark, sf):
    return p.skip_any(table(spark, sf, "part"), "p_type", ["BRASS", "TIN", ""]).select("p_partkey")


@query("attach_instances", """
SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def attach_instances(spark, sf):
    rollouts = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return p.attach_instances(rollouts, customers, ["o_custkey"])


@query("head_rows", """SELECT l_orderkey, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 5""")
def head_rows(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("_desc", -F.col("l_extendedprice"))
    return p.head_rows(li, 5, ["_desc", "l_orderkey"]).select("l_orderkey", "l_partkey")


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))
