import random

import pytest
from pyspark.sql import functions as F

from trajlake.operators.episodes import episode_counters
from trajlake.operators.metrics import batch_metrics, trajectory_partials
from trajlake.operators.servermon import assign_steps, gauges, server_summary, to_samples
from trajlake.sources.logs import distinct_scrapes, missed_ticks, read_scrapes, stream_scrapes
from trajlake.streaming.episodes import Fold, episode_folds, stream_episodes
from trajlake.streaming.metrics import append_stream_metrics, read_stream_metrics, stream_trajectory_metrics, windowed_trajectory_metrics
from trajlake.streaming.server import late_samples, stream_server_summary
from trajlake.streaming.state import PROVIDER


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a stateful stream is a store of its own; two are enough to tell them apart."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return query


def rounded_rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("compact_every,window", [(2, {}), (100, {"time": "ts", "length": "10 seconds", "late": "1 hour"})])
def test_metrics_equal_batch_over_several_triggers(spark, tmp_path, make, compact_every, window):
    schema = "step long, exit_status string, reward double, tool_obs_tokens array<long>, ts timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    everything = []
    for part in range(4):
        rows = [(i % 2, ["A", "B", None][i % 3], float(i % 2), [i, part], None) for i in range(part, 20 + part)]
        everything += rows
        make(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("tool_obs_tokens")[0])).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run(stream_trajectory_metrics(stream, out, check, compact_every=compact_every, **window))
        want = batch_metrics(trajectory_partials(make(everything, schema)))
        assert rounded_rows(read_stream_metrics(spark, out)) == rounded_rows(want)
    folders = {p.name for p in (tmp_path / "out" / "log").iterdir()}
    assert len(folders) == (0 if compact_every == 2 else 4)


def test_a_trigger_writes_only_what_it_changes(spark, tmp_path, make):
    schema = "step long, exit_status string"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in range(3):
        make([(part, "A"), (part, "B")], schema).write.mode("append").parquet(source)
        run(stream_trajectory_metrics(spark.readStream.schema(schema).parquet(source), out, check))
    sizes = [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "out" / "log").iterdir())]
    assert sizes == [2, 2, 2]
    with pytest.raises(FileNotFoundError):
        read_stream_metrics(spark, str(tmp_path / "nothing"))


def test_windowed_metrics_wait_for_the_watermark(spark, tmp_path, make):
    rows = [("2024-01-01 00:00:10", "A"), ("2024-01-01 00:00:50", "B"), ("2024-01-01 02:00:00", "A")]
    source = str(tmp_path / "in")
    df = make(rows, "ts string, exit_status string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(source)
    out = windowed_trajectory_metrics(spark.readStream.schema(df.schema).parquet(source))
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.exit_status, r.n) for r in got.collect()) == [("A", 1), ("B", 1)]


def scrape(running, queue, tokens):
    return f'sglang:num_running_reqs{{a="0"}} {running}\nsglang:num_queue_reqs {queue}\nprompt_tokens_total {tokens}\n'


SAMPLES = "t double, num_running_reqs double, num_queue_reqs double, token_usage double, gen_throughput double, prompt_tokens_total double"


# Times well after 1970, where a watermark starts.
EPOCH = 1_000_000.0


def some_samples(seed, n=120):
    """Times on and off the bounds of steps, idle stretches with a queue, equal times."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = rng.choice([rng.randrange(0, 40), rng.randrange(0, 400) / 10])
        running = 0.0 if rng.random() < 0.5 or 20 <= t < 30 else float(rng.randrange(1, 5))
        out.append((EPOCH + t, running, float(rng.choice([0, 0, 1])), rng.random(), float(rng.randrange(3)), float(rng.randrange(100))))
    return out


@pytest.mark.parametrize("inclusive,capacity,seed", [(False, None, 1), (True, 3.0, 2)])
def test_server_summary_equals_batch_on_shuffled_samples(spark, tmp_path, make, inclusive, capacity, seed):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    steps = make([(s, EPOCH + s * 10.0, EPOCH + s * 10.0 + 10) for s in range(4)] + [(9, EPOCH + 500.0, EPOCH + 501.0)],
                 "step long, t_start double, t_end double")
    rows = some_samples(seed)
    closing = [(EPOCH + 500.5, 0.0, 0.0, 0.0, 0.0, 0.0)]
    for part in (rows[0::3], rows[1::3], rows[2::3], closing):
        make(part, SAMPLES).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SAMPLES).parquet(source)
        query = run(stream_server_summary(stream, steps, parsed=True, capacity=capacity, inclusive_end=inclusive, delay="1 hour" if part is not closing
                                          else "1 second").writeStream.format("parquet").outputMode("append")
                    .option("path", out).option("checkpointLocation", check))
        assert late_samples(query) == 0
    want = server_summary(assign_steps(gauges(make(rows, SAMPLES)), steps, inclusive_end=inclusive), capacity=capacity)
    got = spark.read.parquet(out)
    assert rounded_rows(got) == rounded_rows(want.select(*got.columns))
    assert got.count() >= 3


def test_late_samples_are_left_out_and_counted(spark, tmp_path, make):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    steps = make([(1, EPOCH, EPOCH + 10.0), (2, EPOCH + 10.0, EPOCH + 20.0)], "step int, t_start double, t_end double")
    late = 0
    for part in ([(1.0, 2.0)], [(15.0, 1.0), (700.0, 0.0)], [(5.0, 9.0), (6.0, 9.0)], [(800.0, 0.0)]):
        make([(EPOCH + t, r, 0.0, 0.0, 0.0, 0.0) for t, r in part], SAMPLES).coalesce(1).write.mode("append").parquet(source)
        # The last sample lies in no step: steps are told apart first, so it is joined in by an open one.
        every = steps.unionByName(make([(3, EPOCH + 600.0, None)], "step int, t_start double, t_end double"))
        query = run(stream_server_summary(spark.readStream.schema(SAMPLES).parquet(source), every, parsed=True, delay="10 seconds")
                    .writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check))
        late += late_samples(query)
    got = {r.step: (r["srv/samples"], r["srv/running_peak"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (1.0, 2.0), 2: (1.0, 1.0)} and late == 2


def test_summary_of_scraped_texts(spark, tmp_path, make):
    folder = tmp_path / "scrapes"
    folder.mkdir()
    texts = [(EPOCH + t, "no gauges 1\n" if t % 7 == 3 else scrape(0 if 20 <= t < 30 else t % 5, t % 3, t * 10)) for t in range(41)]
    for t, text in [*texts, (EPOCH + 500.0, scrape(0, 0, 0))]:
        (folder / f"{t}.txt").write_text(text)
    steps = make([(s, EPOCH + s * 10.0, EPOCH + s * 10.0 + 10) for s in range(4)] + [(9, EPOCH + 500.0, None)], "step long, t_start double, t_end double")
    run(stream_server_summary(stream_scrapes(spark, str(folder)), steps).writeStream.format("parquet").outputMode("append")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = server_summary(assign_steps(gauges(to_samples(make(texts, "t double, text string"))), steps, inclusive_end=False))
    assert {r.step for r in got.collect()} == {0, 1, 3}
    assert rounded_rows(got) == rounded_rows(want.select(*got.columns))


def test_stateful_streams_ask_for_their_state_store(spark, tmp_path, make):
    make([], SAMPLES).write.parquet(str(tmp_path / "in"))
    held = spark.conf.get(PROVIDER)
    spark.conf.unset(PROVIDER)
    try:
        if spark.conf.get(PROVIDER, None) != held:
            with pytest.raises(ValueError):
                stream_server_summary(spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in")), parsed=True)
    finally:
        spark.conf.set(PROVIDER, held)


TURNS = ("trajectory_id long, turn long, gen_tokens long, tool_tokens long, n_calls long, n_salvaged long,"
         " attempted boolean, submitted_call_idx int, crashed_type string, at long")
LIMITS = dict(response_length=60, max_errors=2, max_turns=5)


def some_turns(seed, n=40):
    """Episodes with gaps, missing first turns, crashes before (turn 0) and after them, and every way to end."""
    rng = random.Random(seed)
    rows = [(i, 0, None, 0, None, 0, None, None, "NoStart", 100) for i in range(8, n, 9)]
    for i in range(n):
        for turn in range(1, 1 if i % 9 == 8 else rng.randrange(2, 8)):
            if rng.random() < 0.2:
                continue
            rows.append((i, turn, rng.choice([None, 0, 5, 9, 30]), rng.randrange(12), rng.choice([None, 0, 1, 2]), rng.randrange(2),
                         rng.choice([None, True, False]), rng.choice([None, None, None, 1]), rng.choice([None, None, None, None, "", "Boom"]), 100 + turn))
    return rows


COLUMNS = ["trajectory_id", "exit_status", "truncated", "num_turns", "tool_call_count", "format_errors", "salvaged_tool_calls",
           "tool_obs_tokens", "response_tokens", "response_length"]


@pytest.mark.parametrize("seed", [1])
def test_episode_fold_equals_batch_over_gaps(spark, tmp_path, make, seed):
    rows = some_turns(seed)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    untimed = 0
    # Later turns arrive first, and in other triggers; then the watermark passes all of them, and the silence.
    far = [(999, 1, 0, 0, 1, 0, True, 0, None, 10_000_000)]
    for part in (rows[1::2], rows[0::2], far, [(*far[0][:-1], 20_000_000)]):
        made = make(part, TURNS).withColumn("ts", F.timestamp_seconds("at"))
        lost = make([(1, 1, 1, 1, 1, 0, True, None, None, 0)], TURNS).withColumn("ts", F.lit(None).cast("timestamp"))
        made.unionByName(lost).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        query = run(stream_episodes(stream, **LIMITS).writeStream.format("parquet").outputMode("append")
                    .option("path", out).option("checkpointLocation", str(tmp_path / "c")))
        untimed += sum(p["observedMetrics"]["untimed_turns"]["n"] for p in query.recentProgress if "untimed_turns" in p["observedMetrics"])
    got = spark.read.parquet(out).filter("trajectory_id <> 999")
    want = episode_counters(make(rows, TURNS), **LIMITS).select(*COLUMNS)
    assert rounded_rows(got.select(*COLUMNS)) == rounded_rows(want)
    assert untimed == 4 and got.agg(F.sum("late_turns")).first()[0] == 0
    assert {"IncompleteRollout", "Submitted"} <= {r.exit_status for r in got.collect()}


def test_recorded_folds_equal_the_fold_and_start_a_stream(spark, tmp_path, make):
    rows = some_turns(5)
    early = [r for r in rows if r[1] <= 2]
    folds = episode_folds(make(early, TURNS), **LIMITS)
    for r in folds.collect():
        fold = Fold(Fold.empty(), **LIMITS)
        ended = False
        for row in sorted(x for x in early if x[0] == r.trajectory_id and x[1] is not None):
            if not ended:
                _, turn, gen, tool, calls, salvaged, tried, submit, crash, _ = row
                ended = fold.add(turn, gen or 0, tool or 0, calls or 0, salvaged or 0, bool(tried), submit, crash or "") is not None
        assert r.done == ended
        if not ended:
            assert {**r.asDict(), "trajectory_id": None} == {"trajectory_id": None, **fold.s}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([r for r in rows if r[1] > 2], [(999, 1, 0, 0, 1, 0, True, 0, None, 10_000_000)], [(999, 1, 0, 0, 1, 0, True, 0, None, 20_000_000)]):
        make(part, TURNS).withColumn("ts", F.timestamp_seconds("at")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        run(stream_episodes(stream, **LIMITS, initial=folds).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    got = spark.read.parquet(out).filter("trajectory_id <> 999")
    want = episode_counters(make(rows, TURNS), **LIMITS).select(*COLUMNS)
    done = {r.trajectory_id for r in folds.collect() if r.done}
    assert rounded_rows(got.select(*COLUMNS)) == rounded_rows(want.filter(~F.col("trajectory_id").isin(list(done))))


def test_appended_step_metrics(spark, tmp_path, make):
    df = make([("r", 1, "a", 1.0)], "run string, step long, metric string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(append_stream_metrics(stream, str(tmp_path / "out"), str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "out")).select(*df.columns).collect() == df.collect()
    assert (tmp_path / "out" / "run=r" / "batch=0").exists()


def test_streamed_scrapes_are_whole_files(spark, tmp_path):
    folder = tmp_path / "scrapes"
    folder.mkdir()
    (folder / "7.5.txt").write_text(scrape(1, 2, 3))
    query = stream_scrapes(spark, str(folder)).writeStream.format("memory").queryName("whole_scrapes").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("whole_scrapes").collect()] == [(7.5, scrape(1, 2, 3))]


def test_scrapes_by_replica(spark, tmp_path):
    for replica, t in (("a", "5"), ("a", "5.25"), ("b", "5"), ("b", "9")):
        folder = tmp_path / "in" / f"replica={replica}" / f"t={t}"
        folder.mkdir(parents=True)
        for copy in range(2):
            (folder / f"part-0000{copy}.txt").write_text(scrape(1, 2, 3))
    scrapes = read_scrapes(spark, str(tmp_path / "in"), by_replica=True)
    assert scrapes.count() == 8 and distinct_scrapes(scrapes).count() == 4
    run(distinct_scrapes(stream_scrapes(spark, str(tmp_path / "in"), max_files=1, by_replica=True)).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    got = sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 5.0), ("a", 5.25), ("b", 5.0), ("b", 9.0)]
    missed = missed_ticks(scrapes, 1.0).collect()
    assert [(r.replica, r.after, r.until, r.missed) for r in missed] == [("b", 5.0, 9.0, 3)]


@pytest.mark.parametrize("name,tables", [
    ("stream_episodes", ["conversations"]), ("stream_run_verdict", ["documents"]), ("stream_windowed_metrics", ["orders"])])
def test_tables_of_part_files_stream_whole(spark, tmp_path, name, tables):
    for table in tables:
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    from trajlake import plans

    plans.load()
    want = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rounded_rows(plans.QUERIES[name](spark, str(tmp_path))) == rounded_rows(want)
