import random
import statistics

import pytest
from pyspark.sql import functions as F

from trajlake.functions import arrays
from trajlake.operators import advantage as adv
from trajlake.operators import tokens as tk


def conversations(rng, n=60):
    roles = ["system", "user", "assistant", "tool"]
    return {i: [(j, rng.choice(roles), " ".join("w%d" % rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 9]))))
                for j in range(rng.randrange(1, 9))] for i in range(n)}


@pytest.mark.parametrize("budget", [1, 7, 1000])
def test_adapt_keeps_the_most_recent_tokens(make, budget):
    convs = conversations(random.Random(budget))
    rows = [(i, j, role, text) for i, ms in convs.items() for j, role, text in ms]
    df = make(rows, "trajectory_id long, msg_idx long, role string, content string")
    tokens = tk.tokenize(df)
    ids = {(r.trajectory_id, r.msg_idx): r.ids for r in tokens.collect()}
    for r in tk.adapt_trajectories(tokens, budget=budget).collect():
        seq, mask = [], []
        for j, role, text in convs[r.trajectory_id]:
            own = ids[r.trajectory_id, j]
            assert len(own) == 1 + len(text.split())
            seq += own
            mask += [1 if role == "assistant" else 0] * len(own)
        assert r.truncated == (len(seq) > budget)
        seq, mask = seq[-budget:], mask[-budget:]
        assert (r.input_ids, r.response_mask) == (seq, mask)
        assert (r.attention_mask, r.position_ids) == ([1] * len(seq), list(range(len(seq))))
        assert (r.total_trajectory_tokens, r.response_tokens) == (len(seq), sum(mask))


def test_adapt_without_tokens(make):
    df = make([(1, 0, "user", [])], "trajectory_id long, msg_idx long, role string, ids array<int>")
    r = tk.adapt_trajectories(df).collect()[0]
    assert (r.input_ids, r.position_ids, r.attention_mask, r.truncated, r.response_tokens) == ([], [], [], False, 0)


@pytest.mark.parametrize("limit", [1, 6, 500])
def test_segments(make, limit):
    rng = random.Random(limit)
    episodes = {i: [("prompt", [rng.randrange(9) for _ in range(rng.choice([0, 3]))])] + [
        (rng.choice(["generated", "tool"]), [rng.randrange(9) for _ in range(rng.choice([0, 0, 2, 5]))])
        for _ in range(rng.randrange(5))] for i in range(80)}
    rows = [(i, j, kind, ids) for i, segs in episodes.items() for j, (kind, ids) in enumerate(segs)]
    df = make(rows, "trajectory_id long, seg_idx long, kind string, ids array<int>")
    out = tk.accumulate_segments(df, response_length=limit, pad=77).collect()
    assert len(out) == len(episodes)
    for r in out:
        prompt = episodes[r.trajectory_id][0][1] or [77]
        ids = [t for _, seg in episodes[r.trajectory_id][1:] for t in seg]
        mask = [1 if k == "generated" else 0 for k, seg in episodes[r.trajectory_id][1:] for _ in seg]
        ids, mask = (ids[:limit], mask[:limit]) if ids else ([77], [1])
        assert (r.prompt_ids, r.response_ids, r.response_mask) == (prompt, ids, mask)
        assert (r.response_tokens, r.total_trajectory_tokens) == (sum(mask), len(prompt) + len(ids))


def test_prefix_deltas_and_observations(make):
    df = make([(1, 0, [5, 6]), (1, 1, [5, 6, 7]), (1, 2, [5, 6, 7]), (2, 0, [])], "trajectory_id long, msg_idx long, prefix_ids array<int>")
    got = {(r.trajectory_id, r.msg_idx): r.ids for r in tk.prefix_deltas(df).collect()}
    assert got == {(1, 0): [5, 6], (1, 1): [7], (1, 2): [], (2, 0): []}
    messages = make([(1, 0, "system", "a"), (1, 1, "user", "b c"), (1, 2, "assistant", "d"), (1, 3, "tool", "e f g"), (1, 4, "tool", "")],
                    "trajectory_id long, msg_idx long, role string, content string")
    counted = tk.message_tokens(messages)
    assert sorted(tuple(r) for r in tk.observation_tokens(counted).collect()) == [(1, 3, 4), (1, 4, 1)]
    assert [tuple(r) for r in tk.observation_totals(counted).collect()] == [(1, 5, 2, 4)]


def test_third_party_tokenizer(make):
    def load():
        return lambda text: [len(w) for w in text.split()]

    df = make([(1, 0, "user", "abc de"), (1, 1, "assistant", None)], "trajectory_id long, msg_idx long, role string, content string")
    out = {r.msg_idx: r.ids for r in tk.tokenize(df, tk.tokenizer_column(load)).collect()}
    assert out == {0: [5, 3, 2], 1: [10]}


def test_array_edges(make):
    df = make([([],), ([1],), ([1, 2, 3],)], "a array<int>")
    a = F.col("a")
    rows = df.select(arrays.keep_last(a, 2).alias("l"), arrays.keep_first(a, 2).alias("f"), arrays.or_pad(a, 9).alias("p"),
                     arrays.position_ids(a).alias("pos"), arrays.attention_mask(a).alias("att"), arrays.total(a).alias("s")).collect()
    assert [tuple(r) for r in rows] == [
        ([], [], [9], [], [], 0), ([1], [1], [1], [0], [1], 1), ([2, 3], [1, 2], [1, 2, 3], [0, 1, 2], [1, 1, 1], 6)]


GROUPS = {"zero": [0.0] * 4, "one": [1.0] * 3, "mixed": [1.0, 0.0, 0.0, 0.5], "single": [0.7], "wrapped": [0.0, 1.0] * 9}


@pytest.mark.parametrize("normalize", [True, False])
def test_group_advantage(make, normalize):
    rows = [(1, g, i, r) for g, rs in GROUPS.items() for i, r in enumerate(rs)]
    out = adv.group_advantage(make(rows, "step long, instance_id string, arrival long, reward double"), std_normalize=normalize)
    for r in out.collect():
        rs = GROUPS[r.instance_id]
        mean, std = statistics.fmean(rs), statistics.pstdev(rs)
        want = (r.reward - mean) / (std + 1e-6) if normalize else r.reward - mean
        assert r.advantage == pytest.approx(want, abs=1e-9)
        if len(set(rs)) == 1:
            assert r.advantage == 0.0
    sums = out.groupBy("instance_id").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in sums)


def test_reward_signal_and_samples(make):
    rows = [(1, g, r) for g, rs in GROUPS.items() for r in rs]
    df = make(rows, "step long, instance_id string, reward double")
    r = adv.reward_signal(df).collect()[0]
    flat = [x for rs in GROUPS.values() for x in rs]
    assert r["grpo/mean_reward"] == pytest.approx(statistics.fmean(flat))
    assert r["grpo/resolve_rate"] == pytest.approx(sum(x >= 1 for x in flat) / len(flat))
    assert (r["grpo/informative_group_frac"], r["grpo/num_groups"]) == (2 / 5, 5.0)
    assert adv.reward_signal(df.filter("false")).collect() == []
    one = make([([4, 5, 6], [0, 1, 1], 0.5)], "input_ids array<int>, response_mask array<int>, advantage double")
    assert tuple(adv.to_training_samples(one).collect()[0]) == ([4, 5, 6], [1, 1, 1], [0, 1, 2], [0, 1, 1], [0.0, 0.5, 0.5])
