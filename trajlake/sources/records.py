"""JSON lines of episodes and rollouts, grading reports and their artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.functions.toolcalls import parsed
from trajlake.schemas import EPISODE, ROLLOUT, TEST_STATUS

CORRUPT = "_corrupt_record"


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episode records, one per line; an unreadable line is kept in ``_corrupt_record``."""
    return _json(spark, path, EPISODE)


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """Rollout records with nested metrics and messages."""
    return _json(spark, path, ROLLOUT)


def rollout_messages(rollouts: DataFrame) -> DataFrame:
    """One row per message of each rollout, in order."""
    return rollouts.select(
        "step", "instance_id", "group_idx", F.posexplode("messages").alias("msg_idx", "m")).select(
        "step", "instance_id", "group_idx", F.col("msg_idx").cast("long").alias("msg_idx"), "m.role", "m.content")


def write_json_lines(df: DataFrame, folder: str) -> None:
    """Append one object per row, text as raw UTF-8, nulls written out."""
    df.write.mode("append").option("ignoreNullFields", "false").json(folder)


write_episodes = write_json_lines
write_rollouts = write_json_lines

# Report paths end in <run>/<model>/<instance>/report.json, "/" in a model name as "__"; folders may also be
# named as a partitioned writer does, run_id=<run> and so on.
REPORT_PATH = r"(?:run_id=)?([^/]+)/(?:model=)?([^/]+)/(?:instance_id=)?([^/]+)/[^/]+$"


def _path_ids(path) -> list:
    return [
        F.regexp_extract(path, REPORT_PATH, 1).alias("run_id"),
        F.regexp_extract(path, REPORT_PATH, 2).alias("model"),
        F.regexp_extract(path, REPORT_PATH, 3).alias("path_instance"),
    ]


# What became of a report. Those in BROKEN count as failed gradings.
OK, MISSING, UNREADABLE, WRONG_TYPE = "ok", "missing instance", "unreadable report", "wrong type"
BUCKETS = ("FAIL_TO_PASS", "PASS_TO_PASS")


def _get(value: Column, key: str) -> Column:
    """A field as a variant; null if it is missing, a null variant if it is null."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, ..., VOID for a JSON null; null for what is missing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _truthy(value: Column) -> Column:
    """False for what is missing, null, false, zero or empty."""
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(_kind(value).isin("VOID", "STRING", "ARRAY", "OBJECT"), ~F.to_json(value).isin("null", '""', "[]", "{}"))
        .otherwise(number != 0), F.lit(False))


def _names(value: Column) -> Column:
    """Entries of a list of tests; a text counts by its characters, an object by its keys. Null for other types."""
    kind = _kind(value)
    return (F.when(kind == "ARRAY", F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.to_json(v)))
            .when(kind == "STRING", F.filter(F.split(F.try_variant_get(value, "$", "string"), ""), lambda c: c != ""))
            .when(kind == "OBJECT", F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))))


def parse_reports(files: DataFrame, text: str = "value", instance: str = "instance_id") -> DataFrame:
    """Replace the JSON ``text`` of a report by ``report``, what it says on its ``instance``, and ``report_status``.

    The status is ``ok``; ``missing instance`` where the report says nothing on it, which counts as
    unresolved; ``unreadable report`` for a text that is no JSON as a whole; ``wrong type: <field>`` for a
    field that cannot be counted. No row is lost.
    """
    doc = files.withColumn("_doc", parsed(F.col(text)))
    held = doc.withColumn("_entry", F.try_element_at(F.try_variant_get("_doc", "$", "map<string,variant>"), F.col(instance)))
    entry, status = F.col("_entry"), _get(F.col("_entry"), "tests_status")

    def wrong(name: str) -> Column:
        return F.lit(f"{WRONG_TYPE}: {name}")

    def not_object(value: Column) -> Column:
        return value.isNotNull() & (_kind(value) != "OBJECT")

    said = (F.when(F.col("_doc").isNull(), UNREADABLE).when(not_object(F.col("_doc")), wrong("report"))
            .when(entry.isNull(), MISSING).when(not_object(entry), wrong(instance)).when(not_object(status), wrong("tests_status")))
    tests = {}
    for name in BUCKETS:
        bucket = _get(status, name)
        said = said.when(not_object(bucket), wrong(name))
        for part in ("success", "failure"):
            own = _get(bucket, part)
            said = said.when(own.isNotNull() & ~_kind(own).isin("ARRAY", "STRING", "OBJECT"), wrong(f"{name}.{part}"))
        tests[name] = F.when(bucket.isNotNull(), F.struct(
            _names(_get(bucket, "success")).alias("success"), _names(_get(bucket, "failure")).alias("failure")).cast(TEST_STATUS))
    status_map = F.create_map(*[x for name, value in tests.items() for x in (F.lit(name), value)])
    report = F.struct(_truthy(_get(entry, "resolved")).alias("resolved"),
                      _truthy(_get(entry, "patch_successfully_applied")).alias("patch_successfully_applied"),
                      status_map.alias("tests_status"))
    kept = [c for c in files.columns if c != text]
    outcome = held.withColumn("report_status", said.otherwise(OK))
    usable = F.col("report_status").isin(OK, MISSING)
    return outcome.select(*kept, F.when(usable, report).alias("report"), "report_status")


def read_reports(spark: SparkSession, root: str, name: str = "report.json") -> DataFrame:
    """One row per report: run, model and instance its path names, ``report`` and ``report_status``.

    A report counts only for the instance whose folder it lies in.
    """
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
             .text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path")))
    return parse_reports(files.select("value", *_path_ids(F.col("_path"))).withColumnRenamed("path_instance", "instance_id"))


def report_errors(reports: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """``(keys, eval_error)`` of the reports that could not be read, for ``grade_outcome``."""
    return reports.filter(~F.col("report_status").isin(OK, MISSING)).select(*keys, F.col("report_status").alias("eval_error"))


def episode_runs(reports: DataFrame, episodes: DataFrame, run: str = "run_id") -> DataFrame:
    """Give reports the key of the episode they grade: ``episodes(run_id, instance_id, step, group_idx)`` names the run of each."""
    named = episodes.select(F.col(run).alias("_run"), F.col("instance_id").alias("_instance"), "step", "group_idx")
    return reports.join(named, (F.col("run_id") == F.col("_run")) & (F.col("instance_id") == F.col("_instance"))).drop("_run", "_instance")


def read_artifact_sizes(spark: SparkSession, root: str, name: str = "test_output.txt") -> DataFrame:
    """Byte size of every test log; the content column is never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", name).load(root))
    return files.select(*_path_ids(F.col("path")), F.col("length").alias("pytest_output_length")).withColumnRenamed(
        "path_instance", "instance_id")
