import random

import pytest

from trajlake.operators.episodes import actions_log, derive_exit_status, episode_counters

SCHEMA = ("trajectory_id long, turn long, gen_tokens long, tool_tokens long, n_calls long, n_salvaged long,"
          " attempted boolean, submitted_call_idx int, crashed_type string")


def fold(turns, limit, max_errors, max_turns):
    """The rule, one turn after the other."""
    out = dict(status="IncompleteRollout", turns=0, calls=0, errors=0, salvaged=0, obs=[])
    mask, streak = [], 0
    for t in turns:
        if t["turn"] > max_turns:
            break
        if t["crash"]:
            if t["gen"] > 0:
                out["turns"] += 1
                mask += [1] * t["gen"]
            out["status"] = "Crashed:" + t["crash"]
            break
        out["turns"] += 1
        mask += [1] * t["gen"]
        if len(mask) >= limit:
            out["status"] = "ContextLimit"
            break
        if t["calls"] == 0:
            streak += 1
            out["errors"] += 1
            if streak >= max_errors:
                out["status"] = "FormatErrorLimit" if t["tried"] else "NoToolCall"
                break
        else:
            streak = 0
            out["salvaged"] += t["salvaged"]
            if t["submit"] is not None:
                out["calls"] += t["submit"] + 1
                out["status"] = "Submitted"
                break
            out["calls"] += t["calls"]
        out["obs"].append(t["tool"])
        mask += [0] * t["tool"]
        if len(mask) >= limit:
            out["status"] = "ContextLimit"
            break
        if t["turn"] >= max_turns:
            out["status"] = "TurnLimit"
            break
    mask = mask[:limit] or [1]
    return dict(out, trained=sum(mask), length=len(mask))


def random_turns(rng):
    turns = []
    for n in range(1, rng.randrange(2, 11)):
        calls = rng.choice([0, 1, 1, 3])
        turns.append(dict(
            turn=n, gen=rng.choice([0, 5, 20, 40]), tool=rng.choice([0, 4, 30]), calls=calls,
            salvaged=calls if calls and rng.random() < 0.3 else 0, tried=rng.random() < 0.5,
            submit=rng.randrange(calls) if calls and rng.random() < 0.1 else None,
            crash="Oops" if rng.random() < 0.04 else None))
    return turns


@pytest.mark.parametrize("limit,max_errors,max_turns", [(100, 2, 6), (1000, 3, 8), (60, 1, 3)])
def test_fold_matches_the_rule(make, limit, max_errors, max_turns):
    rng = random.Random(limit)
    episodes = {i: random_turns(rng) for i in range(300)}
    rows = [(i, t["turn"], t["gen"], t["tool"], t["calls"], t["salvaged"], t["tried"], t["submit"], t["crash"])
            for i, turns in episodes.items() for t in turns]
    rng.shuffle(rows)
    df = make(rows, SCHEMA)
    limits = dict(response_length=limit, max_errors=max_errors, max_turns=max_turns)
    want = {i: fold(turns, limit, max_errors, max_turns) for i, turns in episodes.items()}
    statuses = {r.trajectory_id: r.exit_status for r in derive_exit_status(df, **limits).collect()}
    assert statuses == {i: w["status"] for i, w in want.items()}
    for r in episode_counters(df, **limits).collect():
        w = want[r.trajectory_id]
        got = (r.exit_status, r.truncated, r.num_turns, r.tool_call_count, r.format_errors, r.salvaged_tool_calls,
               r.tool_obs_tokens, r.response_tokens, r.response_length)
        assert got == (w["status"], w["status"] == "ContextLimit", w["turns"], w["calls"], w["errors"],
                       w["salvaged"], w["obs"], w["trained"], w["length"]), r.trajectory_id
    seen = {w["status"] for w in want.values()}
    assert {"Submitted", "Crashed:Oops"} <= seen


def test_last_turn_of_a_mixed_streak_decides(make):
    rows = [(1, 1, 5, 5, 0, 0, True, None, None), (1, 2, 5, 5, 0, 0, False, None, None),
            (2, 1, 5, 5, 0, 0, False, None, None), (2, 2, 5, 5, 0, 0, True, None, None),
            (3, 1, 5, 5, 0, 0, True, None, None), (3, 2, 5, 5, 1, 0, True, None, None), (3, 3, 5, 5, 0, 0, True, None, None),
            (4, 0, None, None, None, None, None, None, "DockerError"),
            (5, 1, 5, 5, 3, 0, True, 1, None), (5, 2, 5, 5, 3, 0, True, None, None)]
    got = {r.trajectory_id: r for r in episode_counters(make(rows, SCHEMA), max_errors=2).collect()}
    assert [got[i].exit_status for i in range(1, 6)] == [
        "NoToolCall", "FormatErrorLimit", "IncompleteRollout", "Crashed:DockerError", "Submitted"]
    assert (got[4].num_turns, got[4].response_tokens) == (0, 1)
    assert (got[5].tool_call_count, got[5].num_turns) == (2, 1)


def test_actions_log(make):
    executed = make([(1, 2, 0, "bash", "x" * 700, 0, "y" * 500, False), (1, 2, 1, "bash", "ls", 0, None, True),
                     (1, 90, 0, "bash", "late", 0, "", False)],
                    "trajectory_id long, turn long, call_idx int, name string, command string, returncode int, output string, submitted boolean")
    errors = make([(1, 1, "<tool_call>{"), (2, 1, "hi")], "trajectory_id long, turn long, raw_text string")
    got = {r.trajectory_id: r for r in actions_log(executed, errors).collect()}
    assert got[1].num_actions == 4
    tools = [(a.turn, a.tool, a.returncode, a.submitted) for a in got[1].actions]
    assert tools == [(1, "<format_error>", None, None), (2, "bash", 0, False), (2, "bash", 0, True), (90, "bash", 0, False)]
    assert got[1].actions[1].command == "x" * 300 + "...(truncated)..." + "x" * 300
    assert got[1].actions[1].output == "y" * 200 + "...(truncated)..." + "y" * 200
    assert got[2].actions[0].tool == "<no_tool_call>"
