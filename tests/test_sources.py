import json

import pytest
from pyspark.sql import functions as F

from trajlake.operators import prep
from trajlake.operators.grading import attach_grading, grade_counts, grade_outcome
from trajlake.schemas import EPISODE, with_defaults
from trajlake.sources import logs, records, tables


def test_split_scan(spark, tmp_path, make):
    folder = str(tmp_path / "data")
    for name, n in (("test-0", 1), ("test-1", 2), ("train-0", 4)):
        make([(i,) for i in range(n)], "x long").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    # Shards are files; give them their names by writing single files through pyarrow.
    import pyarrow as pa
    import pyarrow.parquet as pq

    flat = tmp_path / "flat"
    flat.mkdir()
    for name, n in (("test-00000-of-2", 1), ("test-00001-of-2", 2), ("train-00000-of-1", 4)):
        pq.write_table(pa.table({"x": list(range(n))}), flat / f"{name}.parquet")
    assert tables.read_split(spark, str(flat), "test").count() == 3
    assert tables.read_split(spark, str(flat), "dev").count() == 7
    assert tables.count_rows(spark, str(flat)) == 7
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_split(spark, str(empty), "test")


def test_prepared_roundtrip_prunes_nested_fields(spark, tmp_path, make):
    df = make([(i, f"id{i}", "r", "1", None if i == 1 else f"s{i}") for i in range(5)],
              "row_idx long, instance_id string, repo string, version string, problem_statement string")
    tagged = prep.split_first_k(df, 2)
    prepared = prep.to_prepared(tagged.drop("split")).withColumn(
        "split", F.when(F.col("extra_info.row_idx") < 2, "val").otherwise("train"))
    tables.write_prepared(prepared, str(tmp_path))
    val = tables.read_instances(spark, f"{tmp_path}/val.parquet", ["instance_id"])
    assert sorted(r.instance_id for r in val.collect()) == ["id0", "id1"]
    assert tables.read_instances(spark, f"{tmp_path}/train.parquet").count() == 3
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<extra_info:struct<instance_id:string>>" in plan
    first = spark.read.parquet(f"{tmp_path}/val.parquet").orderBy("reward_model.ground_truth").collect()[1]
    assert first.prompt[0].content == "" and first.reward_model.style == "rule"
    tables.write_one(prep.lookup_id(tagged, "id3"), f"{tmp_path}/one.parquet")
    assert spark.read.parquet(f"{tmp_path}/one.parquet").count() == 1
    with pytest.raises(LookupError):
        prep.require_row(prep.lookup_id(tagged, "nope"), "nope")
    assert prep.lookup_index(tagged, 4, "row_idx").collect()[0].instance_id == "id4"
    assert prep.lookup_index(tagged, 5, "row_idx").collect() == []


def test_episode_lines(spark, tmp_path):
    folder = tmp_path / "episodes"
    folder.mkdir()
    record = {"instance_id": "é1", "exit_status": "Submitted", "reward": 1.0, "num_actions": 2, "actions": [
        {"turn": 1, "tool": "<format_error>", "command": None, "raw_response": "x"},
        {"turn": 2, "tool": "bash", "command": "ls", "returncode": 0, "output": "o", "submitted": True}]}
    (folder / "trajectories-1.jsonl").write_text(json.dumps(record, ensure_ascii=False) + "\n{broken\n")
    df = records.read_episodes(spark, str(folder)).cache()
    good = df.filter(F.col(records.CORRUPT).isNull()).drop(records.CORRUPT)
    assert df.count() == 2 and good.collect()[0].actions[0].command is None
    records.write_episodes(good, str(tmp_path / "again"))
    text = "".join(p.read_text() for p in (tmp_path / "again").glob("*.json"))
    assert '"instance_id":"é1"' in text and '"command":null' in text
    back = records.read_episodes(spark, str(tmp_path / "again")).drop(records.CORRUPT)
    assert back.schema == EPISODE and back.collect() == good.collect()


def test_rollout_lines(spark, tmp_path):
    path = tmp_path / "rollouts.jsonl"
    path.write_text(json.dumps({
        "step": 1, "group_idx": 0, "instance_id": "a", "reward": 1.0, "resolved": True, "submission": "diff",
        "metrics": {"num_turns": 3, "tool_obs_tokens": [1, 2]}, "messages": [
            {"role": "user", "content": "hi", "extra": {"x": 1}}, {"role": "assistant", "content": "yo"}]}) + "\n")
    df = records.read_rollouts(spark, str(path))
    filled = with_defaults(df.select("metrics.*")).collect()[0]
    assert (filled.num_turns, filled.tool_obs_tokens, filled.eval_error, filled.reward) == (3, [1, 2], "", 0.0)
    messages = records.rollout_messages(df).orderBy("msg_idx").collect()
    assert [(m.msg_idx, m.role, m.content) for m in messages] == [(0, "user", "hi"), (1, "assistant", "yo")]


def test_reports_and_grading(spark, tmp_path, make):
    def put(instance, report, log=None, key=None):
        folder = tmp_path / "logs" / "run1" / "org__model" / instance
        folder.mkdir(parents=True)
        if report is not None:
            (folder / "report.json").write_text(json.dumps({key or instance: report}))
        if log is not None:
            (folder / "test_output.txt").write_text(log)

    tests = {"FAIL_TO_PASS": {"success": ["a", "b"], "failure": []}, "PASS_TO_PASS": {"success": ["c"], "failure": ["d"]}}
    put("i1", {"resolved": True, "patch_successfully_applied": True, "tests_status": tests}, "12345")
    put("i2", {"patch_successfully_applied": True, "tests_status": {"FAIL_TO_PASS": {"success": ["a"]}}}, "1")
    put("i3", None, "123")
    put("i4", {"resolved": True}, key="other")
    put("i5", {"resolved": True}, "1")
    put("i6", {"resolved": True}, "1")
    root = str(tmp_path / "logs")
    counts = grade_counts(records.read_reports(spark, root))
    got = {r.instance_id: r for r in counts.collect()}
    assert set(got) == {"i1", "i2", "i4", "i5", "i6"} and got["i1"].model == "org__model" and got["i1"].run_id == "run1"
    assert {i: r.report_status for i, r in got.items() if r.report_status != "ok"} == {"i4": "missing instance"}
    assert (got["i1"].f2p_passed, got["i1"].f2p_total, got["i1"].p2p_passed, got["i1"].p2p_total) == (2, 2, 1, 2)
    assert (got["i2"].resolved, got["i2"].f2p_total, got["i2"].p2p_total) == (False, 1, 0)

    patches = make([("i1", "diff"), ("i2", "diff"), ("i3", "diff"), ("i4", "diff"), ("i5", " \n"), ("i6", "diff")],
                   "instance_id string, submission string")
    errors = make([("i5", "boom"), ("i6", "boom")], "instance_id string, eval_error string")
    sizes = records.read_artifact_sizes(spark, root)
    assert "content" not in sizes._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    keys = ["instance_id"]
    graded = grade_outcome(patches, counts.drop("run_id", "model"), errors, sizes.select("instance_id", "pytest_output_length"), keys)
    g = {r.instance_id: r for r in graded.collect()}
    assert (g["i1"].reward, g["i1"].pytest_output_length, g["i1"].empty_patch) == (1.0, 5, False)
    assert (g["i2"].reward, g["i2"].patch_applied) == (0.0, True)
    assert (g["i3"].reward, g["i3"].pytest_output_length, g["i3"].eval_error) == (0.0, 3, "")
    assert (g["i4"].resolved, g["i4"].pytest_output_length) == (False, 0)
    assert (g["i5"].empty_patch, g["i5"].eval_error, g["i5"].reward) == (True, "", 0.0)
    assert (g["i6"].eval_error, g["i6"].reward, g["i6"].pytest_output_length) == ("boom", 0.0, 0)

    episodes = make([("i1", 0), ("i1", 1), ("none", 0)], "instance_id string, group_idx long")
    rows = {(r.instance_id, r.group_idx): r for r in attach_grading(episodes, graded, keys).collect()}
    assert len(rows) == 3 and rows["i1", 1].reward == 1.0 and rows["none", 0].eval_error == ""


def test_logs(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("start\n\x1b[31mx\x1b[0m step:1 - a/b:0.5 - c:nan - d:e:2\nplain - k:1\nstep:2 - a/b:-1e3 - bad\n")
    assert sorted(map(tuple, logs.read_run_log(spark, str(log)).collect())) == [(1, "a/b", 0.5), (1, "d:e", 2.0), (2, "a/b", -1000.0)]
    names = tmp_path / "names.txt"
    names.write_text("  a \n\n   \nb\n")
    assert [r.name for r in logs.read_list(spark, str(names)).collect()] == ["a", "b"]
    folder = tmp_path / "scrapes"
    folder.mkdir()
    (folder / "12.5.txt").write_text("a 1\nb 2")
    assert [tuple(r) for r in logs.read_scrapes(spark, str(folder)).collect()] == [(12.5, "a 1\nb 2")]


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, n in (("a", 3000), ("b", 10), ("c", 1)):
        (folder / f"{name}.log").write_text("".join(f"{name} {i} {'x' * (i % 40)}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = logs.number_lines(logs.read_lines(spark, str(folder)))
        rows = lines.collect()
        assert lines.select("file").distinct().count() == 3 and len(rows) == 3011
        assert all(r.value.split()[1] == str(r.line_no) for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_metric_sinks(spark, tmp_path, make):
    long = make([("r", 0, "val-x", 0.5), ("r", 1, "a", 1.0), ("r", 3, "a", 2.0)], "run string, step long, metric string, value double")
    tables.write_metric_matrix(long, str(tmp_path / "m"))
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert read("m") == "metric,step_0,step_1,step_3\na,,1.0,2.0\nval-x,0.5,,\n"
    tables.write_metric_matrix(long, str(tmp_path / "given"), range(4))
    assert read("given") == "metric,step_0,step_1,step_2,step_3\na,,1.0,,2.0\nval-x,0.5,,,\n"
    far = make([("m", 0, 1.0), ("m", 2_000_000, 2.0), ('q",', 2_000_000, None), ('q",', 7, -0.5), ("n", None, 3.0)],
               "metric string, step long, value double")
    tables.write_metric_matrix(far, str(tmp_path / "far"))
    assert read("far") == 'metric,step_0,step_7,step_2000000\nm,1.0,,2.0\n"q"",",,-0.5,\n'
    back = {(r.step, r.metric): r.value for r in tables.read_metric_matrix(spark, str(tmp_path / "far")).collect()}
    assert back == {(0, "m"): 1.0, (2_000_000, "m"): 2.0, (7, 'q",'): -0.5}
    tables.write_metric_matrix(make([], "metric string, step long, value double"), str(tmp_path / "none"))
    assert read("none").strip() in ("", "metric")
    for _ in range(2):
        tables.append_step_metrics(long, str(tmp_path / "steps"))
    back = spark.read.parquet(str(tmp_path / "steps"))
    assert back.count() == 6 and (tmp_path / "steps" / "run=r").exists()


def test_reports_that_cannot_be_read(make):
    """Each as the reader of one report after the other would take it: an error, or counts."""
    entry = lambda **kw: json.dumps({"i": kw})
    cases = {
        "cut off": ('{"i": {"resolved": true', "unreadable report", None),
        "empty": ("", "unreadable report", None),
        "twice": ("{} {}", "unreadable report", None),
        "list": ("[1]", "wrong type: report", None),
        "other": ('{"j": {}}', "missing instance", (False, 0, 0)),
        "null entry": ('{"i": null}', "wrong type: instance_id", None),
        "bare": ('{"i": {}}', "ok", (False, 0, 0)),
        "status": (entry(resolved=True, tests_status=5), "wrong type: tests_status", None),
        "bucket": (entry(resolved=True, tests_status={"FAIL_TO_PASS": []}), "wrong type: FAIL_TO_PASS", None),
        "number": (entry(tests_status={"FAIL_TO_PASS": {"success": 3}}), "wrong type: FAIL_TO_PASS.success", None),
        "null list": (entry(tests_status={"PASS_TO_PASS": {"failure": None}}), "wrong type: PASS_TO_PASS.failure", None),
        "text": (entry(resolved=True, tests_status={"FAIL_TO_PASS": {"success": "abc", "failure": {"x": 1}}}), "ok", (True, 3, 4)),
        "good": (entry(resolved=True, tests_status={"FAIL_TO_PASS": {"success": ["a"], "failure": ["b", "c"]}}), "ok", (True, 1, 3)),
        "words": (entry(resolved="yes"), "ok", (True, 0, 0)),
        "zero": (entry(resolved=0), "ok", (False, 0, 0)),
        "null flag": (entry(resolved=None), "ok", (False, 0, 0)),
    }
    files = make([(name, "i", text) for name, (text, _, _) in cases.items()] + [("null", "i", None)], "case string, instance_id string, value string")
    counts = grade_counts(records.parse_reports(files))
    got = {r.case: r for r in counts.collect()}
    assert set(got) == {*cases, "null"} and got["null"].report_status == "unreadable report"
    for name, (_, status, want) in cases.items():
        r = got[name]
        assert (r.report_status, (r.resolved, r.f2p_passed, r.f2p_total)) == (status, want or (False, 0, 0)), name
    patches = make([(name, "diff") for name in cases], "case string, submission string")
    graded = {r.case: r for r in grade_outcome(patches, counts.drop("instance_id"), make([], "case string, eval_error string"), keys=["case"]).collect()}
    for name, (_, status, want) in cases.items():
        r = graded[name]
        assert (r.eval_error, r.reward) == (("", float(want[0])) if want else (status, 0.0)), name
    errors = {r.case: r.eval_error for r in records.report_errors(counts, ["case"]).collect()}
    assert errors == {**{n: s for n, (_, s, w) in cases.items() if not w}, "null": "unreadable report"}


def test_reports_find_their_episode(make):
    reports = make([("run-7", "i1", "ok"), ("run-8", "i1", "ok")], "run_id string, instance_id string, report_status string")
    episodes = make([("run-7", "i1", 3, 0), ("run-8", "i1", 3, 1), ("run-9", "i2", 3, 0)], "run_id string, instance_id string, step long, group_idx long")
    got = sorted((r.run_id, r.step, r.group_idx) for r in records.episode_runs(reports, episodes).collect())
    assert got == [("run-7", 3, 0), ("run-8", 3, 1)]
