"""Episode records and samples put together from parts."""

import pytest

from trajlake.operators import assembly as a
from trajlake.operators.grading import GRADE_FIELDS

TURNS = ("trajectory_id long, turn long, gen_tokens long, tool_tokens long, n_calls long, n_salvaged long,"
         " attempted boolean, submitted_call_idx int, crashed_type string")
MESSAGES = ("trajectory_id long, usage struct<prompt_tokens:long,completion_tokens:long,cached_tokens:long,"
            "prompt_tokens_details:struct<cached_tokens:long>>, actions array<struct<command:string>>")
GRADES = "trajectory_id long, " + ", ".join(
    f"{c} {'boolean' if c in ('resolved', 'empty_patch', 'patch_applied') else 'double' if c == 'reward' else 'string' if c == 'eval_error' else 'long'}"
    for c in GRADE_FIELDS)


@pytest.fixture
def parts(make):
    turns = [(1, 1, 10, 3, 1, 0, True, None, None), (1, 2, 5, 1, 2, 0, True, 0, None), (2, 1, 4, 0, 0, 0, False, None, None),
             (3, 1, 0, 0, 0, 0, None, None, "Boom")]
    messages = [(1, (100, 10, 3, None), [("apply_patch x",), ("ls",)]), (1, (120, 5, None, (4,)), None), (2, (7, None, None, None), [])]
    spans = [(1, "trajectory", 9.0), (1, "tool", 2.0), (1, "tool", 0.5), (2, "generate", 1.0)]
    grades = [(1, True, 1.0, False, "", True, 2, 2, 1, 1, 50), (9, True, 1.0, False, "", True, 0, 0, 0, 0, 0)]
    return (make(turns, TURNS), make(messages, MESSAGES), make(spans, "trajectory_id long, kind string, seconds double"), make(grades, GRADES))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def test_records(parts):
    outcomes, messages, spans, grades = parts
    got = {r.trajectory_id: r for r in a.assemble_episodes(outcomes, messages=messages, spans=spans, grades=grades).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert (r.exit_status, r.num_turns, r.tool_call_count, r.tool_obs_tokens) == ("Submitted", 2, 2, [3])
    assert (r.prompt_tokens, r.completion_tokens, r.cached_prompt_tokens, r.edit_count) == (120, 15, 7, 1)
    assert (r.total_trajectory_tokens, r.response_tokens) == (120 + 18, 15)
    assert (r.total_trajectory_time, r.total_tool_call_time, r.reward, r.f2p_passed, r.pytest_output_length) == (9.0, 2.5, 1.0, 2, 50)
    assert (got[2].reward, got[2].eval_error, got[2].prompt_tokens, got[2].total_trajectory_time) == (0.0, "", 7, 0.0)
    assert (got[3].exit_status, got[3].num_turns, got[3].response_tokens) == ("Crashed:Boom", 0, 1)
    bare = {r.trajectory_id: r for r in a.assemble_episodes(outcomes).collect()}
    assert (bare[1].prompt_tokens, bare[1].completion_tokens, bare[1].total_trajectory_tokens) == (0, 15, 18)


def test_each_part_passes_one_exchange_and_buckets_none(spark, parts, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        outcomes, messages, spans, grades = parts
        n, joins = exchanges(a.assemble_episodes(outcomes, messages=messages, spans=spans, grades=grades))
        assert (n, joins) == (4, 3)
        names = ("part_turns", "part_messages", "part_spans", "part_grades")
        kept = [a.store_bucketed(p, name, buckets=4, path=str(tmp_path / name)) for p, name in zip(parts, names)]
        whole = a.assemble_episodes(kept[0], messages=kept[1], spans=kept[2], grades=kept[3])
        assert exchanges(whole) == (0, 3)
        assert sorted(map(str, whole.collect())) == sorted(map(str, a.assemble_episodes(
            outcomes, messages=messages, spans=spans, grades=grades).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("part_turns", "part_messages", "part_spans", "part_grades"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_samples_of_graded_rollouts(make):
    said = [("user", "fix it now"), ("assistant", "a b c"), ("tool", "x")]
    rollouts = make([(1, "i", g, said) for g in (0, 1, 2)] + [(1, "j", 0, said)],
                    "step long, instance_id string, group_idx long, messages array<struct<role:string,content:string>>")
    keys = "step long, instance_id string, group_idx long, "
    grades = make([(1, "i", 0, True, 1.0, False, "", True, 0, 0, 0, 0, 0), (1, "i", 2, False, 0.0, False, "late", True, 0, 0, 0, 0, 0)],
                  keys + GRADES.removeprefix("trajectory_id long, "))
    got = {(r.instance_id, r.group_idx): r for r in a.rollout_samples(rollouts, grades, budget=6, std_normalize=False).collect()}
    assert set(got) == {("i", 0), ("i", 1), ("i", 2), ("j", 0)}
    assert got["i", 0].response_mask == [1, 1, 1, 1, 0, 0] and got["i", 0].truncated
    assert [round(x, 6) for x in got["i", 0].token_advantages] == [round(2 / 3, 6)] * 4 + [0.0, 0.0]
    assert (got["i", 1].reward, got["i", 2].eval_error, got["j", 0].token_advantages) == (0.0, "late", [0.0] * 6)
