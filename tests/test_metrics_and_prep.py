import random
import statistics

import pytest
from pyspark.sql import functions as F

from trajlake.operators import batch_shape as bs
from trajlake.operators import metrics as m
from trajlake.operators import prep as p
from trajlake.operators import runlog as rl
from trajlake.operators import usage as u

EPISODES = ("step long, exit_status string, eval_error string, resolved boolean, reward double, truncated boolean,"
            " format_errors long, f2p_passed long, f2p_total long, tool_obs_tokens array<long>,"
            " total_trajectory_time double, total_tool_call_time double")


def random_episodes(rng, n):
    rows = []
    for _ in range(n):
        resolved = rng.random() < 0.4
        status = rng.choice(["Submitted", "ContextLimit", "", None])
        rows.append((rng.randrange(3), status, rng.choice(["", None, "x"]), resolved, 1.0 if resolved else 0.0,
                     status == "ContextLimit", rng.choice([0, 0, 2, None]), rng.randrange(3), 3,
                     [rng.randrange(50) for _ in range(rng.randrange(4))] if rng.random() < 0.8 else None,
                     rng.random() * 9, rng.random() * 9))
    return rows


def test_batch_metrics(make):
    rows = random_episodes(random.Random(1), 200)
    partials = m.trajectory_partials(make(rows, EPISODES))
    long = {}
    for r in m.batch_metrics(partials).collect():
        assert (r.step, r.metric) not in long
        long[r.step, r.metric] = r.value
    for step in range(3):
        batch = [r for r in rows if r[0] == step]
        n = len(batch)
        got = {k: v for (s, k), v in long.items() if s == step}
        obs = [o for r in batch for o in r[9] or []]
        want = {
            "reward/eval_error_rate": sum(bool(r[2]) for r in batch) / n,
            "traj/resolve_rate": sum(r[3] for r in batch) / n,
            "traj/mean_format_errors": sum(r[6] or 0 for r in batch) / n,
            "traj/format_error_rate": sum(bool(r[6]) for r in batch) / n,
            "reward/f2p_pass_rate": sum(r[7] for r in batch) / sum(r[8] for r in batch),
            "reward/p2p_pass_rate": 0.0, "traj/mean_turns": 0.0,
            "tokens/mean_obs": statistics.fmean(obs), "tokens/max_obs": float(max(obs)),
            "latency/max_trajectory_s": max(r[10] for r in batch),
            "latency/mean_generation_s": sum(max(r[10] - r[11], 0) for r in batch) / n,
            "traj/exit/Unknown": sum(not r[1] for r in batch) / n,
        }
        for k, v in want.items():
            assert got[k] == pytest.approx(v), k
        assert got["traj/mean_reward"] == got["traj/resolve_rate"]
        assert got["traj/truncation_rate"] == pytest.approx(got["traj/exit/ContextLimit"])
        assert sum(v for k, v in got.items() if k.startswith("traj/exit/")) == pytest.approx(1)
        assert len([k for k in got if not k.startswith("traj/exit/")]) == 25


def test_several_keys_and_empty_batch(make):
    df = make(random_episodes(random.Random(2), 50), EPISODES).withColumn("run", F.lit("r"))
    assert m.summarize_trajectories(df, ["run", "step"]).count() == 3
    assert m.summarize_trajectories(df.filter("false")).count() == 0


def test_merge_lets_the_later_source_win(make):
    a = make([(1, "x", 1.0), (1, "y", 1.0)], "step long, metric string, value double")
    b = make([(1, "x", 2.0)], "step long, metric string, value double")
    assert {(r.metric, r.value) for r in m.merge_metrics([a, b]).collect()} == {("x", 2.0), ("y", 1.0)}


def test_usage_and_actions(make):
    usage = "usage struct<prompt_tokens:long,completion_tokens:long,cached_tokens:long,prompt_tokens_details:struct<cached_tokens:long>>"
    df = make([(1, (5, 2, 3, None), [("apply_patch edit x",), ("ls",)], None), (1, (9, None, None, (4,)), None, 7),
               (2, None, [], None)],
              f"trajectory_id long, {usage}, actions array<struct<command:string>>, completion_tokens long")
    got = {r.trajectory_id: tuple(r)[1:] for r in u.fold_usage(df).collect()}
    assert got == {1: (9, 9, 7), 2: (0, 0, 0)}
    assert {r.trajectory_id: (r.tool_call_count, r.edit_count) for r in u.count_actions(df).collect()} == {1: (2, 1), 2: (0, 0)}
    actions = make([(1, "a"), (1, "a"), (1, "b"), (2, None)], "trajectory_id long, command string")
    assert sorted(tuple(r) for r in u.loop_profile(actions).collect()) == [(1, 3, 2), (2, 1, 0)]


def test_gradable_and_dropped(make):
    df = make([("a", "r", "1"), ("b", "r", "2"), ("c", "r", "3"), ("d", None, None), ("e", "q", "1")], "instance_id string, repo string, version string")
    specs = make([("r", "1", None), ("r", "2", "no image"), ("r", "1", None)], "repo string, version string, build_error string")
    assert [r.instance_id for r in p.keep_gradable(df, specs).collect()] == ["a"]
    assert sorted(r.reason for r in p.dropped(df, specs).collect()) == [
        "b: no image", "c: (repo,version)=(r,'3') not in spec map", "d: (repo,version)=(None,None) not in spec map",
        "e: (repo,version)=(q,'1') not in spec map"]
    assert tuple(p.prep_report(df, specs, 20).collect()[0]) == (5, 1, 4, 0, 1)


@pytest.mark.parametrize("n,batch,steps", [(5, 2, 4), (3, 7, 2), (4, 4, 1), (10, 3, 1)])
def test_cyclic_batches(make, n, batch, steps):
    df = make([(i,) for i in range(n)], "row_idx long")
    got = sorted((r.slot, r.row_idx, r.step, r.position) for r in p.assign_batches(df, batch, steps).collect())
    assert got == [(k, k % n, k // batch, k % batch) for k in range(batch * steps)]


def test_small_prep_rules(make):
    df = make([("ab",), ("cd",)], "name string")
    assert [r.name for r in p.skip_any(df, "name", ["b", ""]).collect()] == ["cd"]
    assert [r.name for r in p.missing(df, make([("ab",)], "name string")).collect()] == ["cd"]
    assert p.expand_groups(df, 3).count() == 6
    with pytest.raises(ValueError):
        p.union_splits([("val", None)])


def test_audit_and_coverage(make):
    rows = [(s, k, v) for s in range(4) for k, v in (("a", s), ("b", s), ("c", s + 1), ("z", 0), ("y", -0.0))] + [(4, "b2", 1)]
    df = make([(s, k, float(v)) for s, k, v in rows], "step long, metric string, value double")
    got = {r.metric: (r.always_zero, r.twin_of, r.has_twin) for r in rl.metric_audit(df).collect()}
    assert got == {"a": (False, None, True), "b": (False, "a", True), "c": (False, None, False),
                   "z": (True, "y", True), "y": (True, None, True), "b2": (False, None, False)}
    cover = make([(0, "val-core/x", 1.0), (0, "actor/y", 1.0), (1, "actor/y", None)], "step long, metric string, value double")
    assert sorted(tuple(r) for r in rl.emission_coverage(cover).collect()) == [
        (0, "actor", 1, 1, True), (0, "val-core", 1, 1, False), (1, "actor", 1, 0, False)]


def test_verdicts(make):
    df = make([("ok", "global_step_6"), ("ok", "x"), ("dead", "global_step_5"), ("saved", "global_step_6"), ("saved", "Saved it")],
              "run string, value string")
    done = {r.run: r.verdict for r in rl.run_verdict(df, ["run"]).collect()}
    live = {r.run: r.verdict for r in rl.run_verdict(df, ["run"], finished=False).collect()}
    assert done == {"ok": "SUCCESS", "dead": "DIED", "saved": "SUCCESS"}
    assert live == {"ok": "RUNNING", "dead": "RUNNING", "saved": "SUCCESS"}


def test_critic_excludes_empty_responses(make):
    df = make([(1, 1.0, 2.0, 3, 3), (1, 0.0, -1.0, 1, 1), (1, 9.0, 99.0, 0, 0)],
              "step long, reward double, advantage double, n_tokens long, response_length long")
    r = bs.critic_metrics(df).collect()[0]
    assert (r["critic/score/mean"], r["critic/score/max"], r["critic/advantages/mean"], r["critic/advantages/max"]) == (0.5, 1.0, 1.25, 2.0)
