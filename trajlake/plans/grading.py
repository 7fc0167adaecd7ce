from __future__ import annotations

from pyspark.sql import functions as F

from trajlake.operators import grading as g
from trajlake.plans.catalog import query, table
from trajlake.schemas import TEST_STATUS

# Labelled documents as submitted patches. Texts of source 7 count as empty patches, long ones
# failed to grade, and for source 3 no report was written.
GRADES_SQL = """
p AS (SELECT l.doc_id, d.source = 'src7' AS empty_patch, d.n_chars > 3000 AS failed, d.source <> 'src3' AS reported,
             l.quality, l.toxic
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (
  SELECT doc_id, empty_patch, CASE WHEN NOT empty_patch AND failed THEN 'harness timeout' ELSE '' END AS eval_error,
         NOT empty_patch AND NOT failed AND reported AS graded, quality, toxic
  FROM p),
grades AS (
  SELECT doc_id, graded AND quality = 1 AS resolved,
         CASE WHEN graded AND quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, empty_patch, eval_error,
         graded AND toxic = 0 AS patch_applied,
         CAST(CASE WHEN graded THEN doc_id % 4 ELSE 0 END AS BIGINT) AS f2p_passed,
         CAST(CASE WHEN graded THEN doc_id % 4 + 1 ELSE 0 END AS BIGINT) AS f2p_total,
         CAST(CASE WHEN graded AND doc_id % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS p2p_passed,
         CAST(CASE WHEN graded AND doc_id % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS p2p_total,
         CAST(CASE WHEN graded OR (NOT empty_patch AND eval_error = '') THEN doc_id * 10 ELSE 0 END AS BIGINT)
           AS pytest_output_length
  FROM g)"""


def _reports(labels):
    """Parsed reports of the graded labels; odd instances lack the second bucket."""
    def names(n):
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("test_"), i.cast("string")))

    none = F.array().cast("array<string>")
    n = (F.col("doc_id") % 4).cast("int")
    passed = F.when(n > 0, names(n)).otherwise(none)
    f2p = F.struct(passed.alias("success"), names(F.lit(1)).alias("failure")).cast(TEST_STATUS)
    p2p = F.struct(names(F.lit(3)).alias("success"), F.lit(None).cast("array<string>").alias("failure")).cast(TEST_STATUS)
    both = F.create_map(F.lit("FAIL_TO_PASS"), f2p, F.lit("PASS_TO_PASS"), p2p)
    status = F.when(F.col("doc_id") % 2 == 0, both).otherwise(F.create_map(F.lit("FAIL_TO_PASS"), f2p))
    report = F.struct(
        (F.col("quality") == 1).alias("resolved"), (F.col("toxic") == 0).alias("patch_successfully_applied"),
        status.alias("tests_status"))
    return labels.select("doc_id", report.alias("report"))


def grades(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    patches = labels.select("doc_id").join(docs.select("doc_id", "source", "text"), "doc_id").select(
        "doc_id", F.when(F.col("source") == "src7", F.lit("  ")).otherwise(F.col("text")).alias("submission"))
    errors = docs.filter(F.col("n_chars") > 3000).select("doc_id", F.lit("harness timeout").alias("eval_error"))
    reported = docs.filter(F.col("source") != "src3").select("doc_id")
    reports = _reports(labels).join(reported, "doc_id", "left_semi")
    sizes = labels.select("doc_id", (F.col("doc_id") * 10).alias("pytest_output_length"))
    return g.grade_outcome(patches, g.grade_counts(reports), errors, sizes, keys=["doc_id"])


@query("grade_outcome", f"WITH {GRADES_SQL} SELECT * FROM grades")
def grade_outcome(spark, sf):
    return grades(spark, sf)


@query("grade_counts", """
SELECT doc_id, quality = 1 AS resolved, toxic = 0 AS patch_applied, CAST(doc_id % 4 AS BIGINT) AS f2p_passed,
       CAST(doc_id % 4 + 1 AS BIGINT) AS f2p_total,
       CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS p2p_passed,
       CAST(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS p2p_total
FROM labels""")
def grade_counts(spark, sf):
    return g.grade_counts(_reports(table(spark, sf, "labels")))


@query("attach_grading", f"""
WITH {GRADES_SQL}
SELECT d.doc_id, d.lang, coalesce(resolved, false) AS resolved, coalesce(reward, 0.0) AS reward,
       coalesce(empty_patch, false) AS empty_patch, coalesce(eval_error, '') AS eval_error,
       coalesce(patch_applied, false) AS patch_applied, coalesce(f2p_passed, 0) AS f2p_passed,
       coalesce(f2p_total, 0) AS f2p_total, coalesce(p2p_passed, 0) AS p2p_passed,
       coalesce(p2p_total, 0) AS p2p_total, coalesce(pytest_output_length, 0) AS pytest_output_length
FROM documents d LEFT JOIN grades g ON d.doc_id = g.doc_id""")
def attach_grading(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return g.attach_grading(docs, grades(spark, sf), ["doc_id"])


@query("attach_grading_spread", f"""
WITH {GRADES_SQL}
SELECT d.doc_id, d.source, coalesce(resolved, false) AS resolved, coalesce(reward, 0.0) AS reward, coalesce(f2p_passed, 0) AS f2p_passed
FROM documents d LEFT JOIN grades g ON CASE WHEN d.doc_id % 2 = 0 THEN -1 ELSE d.doc_id END = g.doc_id""")
def attach_grading_spread(spark, sf):
    """Half of the rows share a key that was never graded."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    keyed = docs.withColumn("doc_id", F.when(F.col("id") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("id")))
    out = g.attach_grading(keyed, grades(spark, sf), ["doc_id"], broadcast=False)
    return out.select(F.col("id").alias("doc_id"), "source", "resolved", "reward", "f2p_passed")


@query("degrade_to_zero", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS reward,
       o_orderstatus <> 'P' AS resolved, CASE WHEN o_orderstatus = 'P' THEN 'crashed: ' || o_orderpriority ELSE '' END AS eval_error
FROM orders""")
def degrade_to_zero(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("reward"), F.lit(True).alias("resolved"),
        F.lit("").alias("eval_error"), "o_orderstatus", "o_orderpriority")
    out = g.degrade_to_zero(orders, F.col("o_orderstatus") == "P",
                            F.concat(F.lit("crashed: "), F.col("o_orderpriority")))
    return out.select("o_orderkey", "reward", "resolved", "eval_error")


@query("empty_patch", """
SELECT source, count(*) FILTER (NOT regexp_matches(CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(10) ELSE text END, '\\S')) AS n_empty,
       count(*) AS n
FROM documents GROUP BY 1""")
def empty_patch(spark, sf):
    from trajlake.functions.predicates import is_empty_patch

    patch = F.when(F.col("doc_id") % 9 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return table(spark, sf, "documents").groupBy("source").agg(
        F.sum(is_empty_patch(patch).cast("long")).alias("n_empty"), F.count("*").alias("n"))
