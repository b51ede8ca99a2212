"""Streams against their batch forms: any split, any order of arrival, replays and restarts."""

import random
import shutil
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from querywatch.operators import capture, counters, statistics, tracking
from querywatch.operators.identity import merge_observations
from querywatch.sources import store
from querywatch.streaming import feed, heartbeat, rollup, upsert
from querywatch.streaming import tracking as streamed

OBS = "instance_id string, tick_ms bigint, thread_id bigint, time_secs bigint, digest string, db_user string, db_host string"
TICKS = "instance_id string, tick_ms bigint, truncated boolean"
BASE = 1_700_000_000_000
FAR = BASE + 10**10


@pytest.fixture(scope="module")
def rocks(spark):
    name, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, was)


def sightings(seed, n_ticks=150, step=60_000):
    """Threads of two instances: one with few cut lists, one with hardly any whole one; reused threads, unknown digests, doubled rows."""
    r, obs, ticks = random.Random(seed), [], []
    for inst in "ij":
        secs = {}
        for k in range(n_ticks):
            t = BASE + k * step
            if r.random() < 0.05:
                continue
            cut = r.random() < (0.3 if inst == "i" else 0.97)
            ticks.append((inst, t, cut))
            for th in range(5):
                if r.random() < (0.6 if cut else 0.97):
                    s = r.randrange(0, 100) if r.random() < 0.02 else secs.get(th, 0) + r.choice([0, 60, 60])
                    secs[th] = s
                    obs.append((inst, t, th, s, r.choice([None, "d", "d", "e" if r.random() < 0.05 else "d"]), "u" if r.random() < 0.99 else "v", "h"))
                    if r.random() < 0.02:
                        obs.append((inst, t, th, s + r.choice([0, -1, 1]), r.choice([None, "d"]), "u", "h"))
    return obs, ticks


def plain_runs(obs, ticks, most_open=10**9):
    """The tracker's ticks one after the other."""
    out = []
    for inst in {t[0] for t in ticks}:
        open_ = {}
        tell = lambda th, e, reason: out.append((inst, th, e.started_at_ms, e.secs * 1000, e.digest, e.sightings, e.last_seen_ms, reason, "finalized" if reason else "in_flight"))  # noqa: B023, E731
        for _, t, cut in sorted(x for x in ticks if x[0] == inst):
            seen = {}
            for o in sorted((o for o in obs if o[:2] == (inst, t)), key=lambda o: (o[2], o[3], o[4] is not None, o[4] or "", o[5])):
                seen[o[2]] = (o[3], o[4], o[5:])
            for found in streamed.advance(open_, t, cut, seen, most_open):
                tell(*found)
        for th, e in open_.items():
            tell(th, e, None)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_batch_tracking_equals_tick_by_tick(spark, seed):
    obs, ticks = sightings(seed, 400)
    got = tracking.track_executions(spark.createDataFrame(obs, OBS), spark.createDataFrame(ticks, TICKS)).collect()
    want = plain_runs(obs, ticks)
    assert sorted(map(tuple, got), key=repr) == want
    assert {"too_long", "disappeared", "thread_reused", None} == {x[7] for x in want} and max(Counter(x[7] for x in want).values()) > 20


def test_a_run_ends_after_an_hour_without_a_sighting(spark):
    ticks = [("i", t, True) for t in (0, 1000, 3_600_000, 3_600_001, 4_000_000)]
    obs = [("i", 0, 1, 5, "d", "u", "h"), ("i", 1000, 2, 5, "d", "u", "h"), ("i", 0, 3, 1, "d", "u", "h"), ("i", 3_600_001, 3, 9, "d", "u", "h"), ("i", 4_000_000, 3, 9, "d", "u", "h")]
    got = sorted((r["thread_id"], r["sightings"], r["end_reason"]) for r in tracking.track_executions(spark.createDataFrame(obs, OBS), spark.createDataFrame(ticks, TICKS)).collect())
    assert got == [(1, 1, "too_long"), (2, 1, "too_long"), (3, 1, None), (3, 2, "too_long")]


PACKED = "instance_id string, thread_id bigint, tick_ms array<bigint>, time_secs array<bigint>, digest array<string>, db_user string, db_host string"


def packed(obs, r):
    """Some sightings of a thread in a row, in any order, cut anywhere; a row without a digest has no list of them."""
    rows, out = {}, []
    for inst, t, th, s, d, *who in obs:
        rows.setdefault((inst, th, *who, r.randrange(3)), []).append((t, s, d))
    for (inst, th, *who, _), x in rows.items():
        while x:
            n = r.randrange(1, 12)
            part, x = x[:n], x[n:]
            r.shuffle(part)
            t, s, d = map(list, zip(*part))
            out.append((inst, th, t, s, d if any(d) else None, *who))
    return out


@pytest.mark.parametrize(("place", "batch"), [(1 << 17, 10_000), (20, 7), (200, 1)])
def test_tracking_of_packed_rows_in_any_places_and_batches(spark, monkeypatch, place, batch):
    r = random.Random(place)
    obs, ticks = sightings(5, 300)
    want = plain_runs(obs, ticks)
    monkeypatch.setattr(tracking, "PLACE", place)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        for frame in (spark.createDataFrame(packed(obs, r), PACKED), spark.createDataFrame(obs, OBS)):
            assert sorted(map(tuple, tracking.track_executions(frame, spark.createDataFrame(ticks, TICKS)).collect()), key=repr) == want
    finally:
        spark.conf.set(name, was)


def test_tracking_of_times_far_apart_and_of_ticks_that_are_not_listed(spark):
    ticks = [(i, t, False) for i in "ab" for t in (0, 1 << 61)] + [("c", None, False), (None, 0, False)]
    obs = [(i, t, 1, 5, "d", "u", "h") for i in "ab" for t in (0, 1 << 61, 1000)] + [("c", 0, 1, 5, "d", "u", "h"), (None, 0, 1, 5, "d", "u", "h"), ("a", None, 1, 5, "d", "u", "h")]
    got = sorted((r["instance_id"], r["last_seen_ms"], r["end_reason"]) for r in tracking.track_executions(spark.createDataFrame(obs, OBS), spark.createDataFrame(ticks, TICKS)).collect())
    assert got == [("a", 1 << 61, "too_long"), ("b", 1 << 61, "too_long")]  # both sightings of each are one run up to its cut


def test_sightings_are_dealt_once(spark):
    frame = entry.queries()["e4_track_executions"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "Window" not in plan and "SortMergeJoin" not in plan


def test_what_a_tick_shows_is_not_given_up():
    open_ = {}
    assert list(streamed.advance(open_, 0, True, {n: (1, "d", "u") for n in range(6)}, 4)) == [] and len(open_) == 6
    gone = list(streamed.advance(open_, 1000, True, {5: (2, "d", "u"), 7: (0, None, "u")}, 4))
    assert [(n, reason) for n, _, reason in gone] == [(0, "evicted"), (1, "evicted"), (2, "evicted")] and set(open_) == {3, 4, 5, 7}


def files(spark, at, schema, parts):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/{n:03}")


def reading(spark, at, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")


def run(spark, at, frame):
    """All that there is, from the checkpoint on; what has come out is in at/out."""
    frame.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{at}/out").collect()), key=repr)


def dealt(rows, n, r):
    parts = [[] for _ in range(n)]
    for x in rows:
        parts[r.randrange(n)].append(x)
    return [p for p in parts if p]


@pytest.mark.parametrize(("seed", "n"), [(3, 1), (4, 3)])
def test_stream_tracking_equals_batch_for_any_split_and_a_restart(rocks, tmp_path, seed, n):
    spark, r = rocks, random.Random(seed)
    obs, ticks = sightings(seed)
    half = BASE + 75 * 60_000
    delay = "2 hours"  # rows come in any order within half of the time
    stream = lambda: streamed.track_stream(reading(spark, tmp_path / "obs", OBS), reading(spark, tmp_path / "ticks", TICKS), delay)
    for name, rows, schema in (("obs", obs, OBS), ("ticks", ticks, TICKS)):
        files(spark, tmp_path / name, schema, dealt([x for x in rows if x[1] < half], n, r))
    run(spark, tmp_path, stream())
    for name, rows, schema in (("obs", obs, OBS), ("ticks", ticks, TICKS)):
        files(spark, tmp_path / name / "more", schema, dealt([x for x in rows if x[1] >= half], n, r))
        shutil.copytree(tmp_path / name / "more", tmp_path / name, dirs_exist_ok=True, copy_function=lambda a, b: shutil.copy(a, str(b).replace("part-", "part-more-")))
        shutil.rmtree(tmp_path / name / "more")
    files(spark, tmp_path / "ticks" / "end", TICKS, [[("end", FAR, True)]])
    shutil.copytree(tmp_path / "ticks" / "end", tmp_path / "ticks", dirs_exist_ok=True, copy_function=lambda a, b: shutil.copy(a, str(b).replace("part-", "part-end-")))
    shutil.rmtree(tmp_path / "ticks" / "end")
    got = run(spark, tmp_path, stream())
    batch = tracking.track_executions(spark.createDataFrame(obs, OBS), spark.createDataFrame(ticks, TICKS)).filter("state = 'finalized'")
    assert got == sorted(map(tuple, batch.collect()), key=repr) and len(got) > 50


# --- the store ----------------------------------------------------------------------------------------------

SEEN = "date_part string, instance_id string, record_id string, started_at_ms bigint, ended_at_ms bigint, captured_at_ms bigint, duration_ms bigint, state string, app_digest string, capture_source string, db_user string, stats struct<rows_examined bigint>"
KEYS = ["date_part", "instance_id", "record_id"]


def observations(seed, n=200):
    r, rows = random.Random(seed), []
    for _ in range(n):
        day, start = r.choice(["2024-01-01", "2024-01-02", "2024-01-03"]), r.randrange(5)
        end = r.choice([None, start + r.randrange(-2, 9)])
        rows.append((day, r.choice("ij"), f"r{r.randrange(12)}", start, end, r.randrange(9), r.randrange(9), r.choice(["finalized", "in_flight", "abandoned"]), r.choice(["unknown-1", "a", "b"]), r.choice(["slowlog", "processlist"]), r.choice([None, "u", "v"]), (r.choice([None, 3, 8]),)))
    return rows


def same(df):
    return sorted((repr(sorted(r.asDict(recursive=True).items())) for r in df.collect()))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_store_does_not_depend_on_order_or_split(spark, tmp_path, seed):
    r, rows = random.Random(seed), observations(seed)
    want = same(merge_observations(spark.createDataFrame(rows, SEEN), KEYS))
    r.shuffle(rows)
    for n, part in enumerate(dealt(rows, 1 + seed * 2, r)):
        out = store.write_executions(spark.createDataFrame(part, SEEN), f"{tmp_path}/s", n)
        again = store.write_executions(spark.createDataFrame(part, SEEN), f"{tmp_path}/s", n)  # a replay changes nothing
        assert same(out) == same(again)
    assert same(out) == want


def test_a_lost_writer_loses_nothing(spark, tmp_path, monkeypatch):
    rows, path = observations(5), f"{tmp_path}/s"
    first, second = spark.createDataFrame(rows[:100], SEEN), spark.createDataFrame(rows[100:], SEEN)
    store.write_executions(first, path, 0)
    class Lost(Exception):
        pass

    real = store._files

    def failing(spark_, path_):
        fs, at = real(spark_, path_)

        class Files:
            exists, listStatus, delete = fs.exists, fs.listStatus, fs.delete

            def create(self, *_):
                raise Lost  # the store is written, the batch not marked as done

        return Files(), at

    monkeypatch.setattr(store, "_files", failing)
    with pytest.raises(Lost):
        store.write_executions(second, path, 1)
    shutil.rmtree(f"{path}/date_part=2024-01-02")  # as if it had been lost while that day was replaced
    monkeypatch.setattr(store, "_files", real)
    out = store.write_executions(second, path, 1)
    assert same(out) == same(merge_observations(spark.createDataFrame(rows, SEEN), KEYS))


def test_upsert_stream_equals_one_merge(spark, tmp_path):
    r, rows = random.Random(9), observations(9)
    start = lambda: upsert.upsert_stream(reading(spark, tmp_path / "in", SEEN), f"{tmp_path}/s").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    files(spark, tmp_path / "in", SEEN, dealt(rows, 3, r))
    start()
    want = same(merge_observations(spark.createDataFrame(rows, SEEN), KEYS))
    read = lambda: spark.read.parquet(f"{tmp_path}/s").withColumn("date_part", F.col("date_part").cast("string"))
    assert same(read()) == want
    for name in ("commits",):  # the last batch is replayed, as after a loss before its commit
        last = max((tmp_path / "c" / name).glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    start()
    assert same(read()) == want


# --- rollups, ticks and pauses ------------------------------------------------------------------------------

DELTAS = "instance_id string, snapshot_ms bigint, app_digest string, count_delta bigint, time_ms bigint, rows_delta bigint, kind string"
HOUR = 3_600_000


def deltas(seed, hours=6, n=400):
    r = random.Random(seed)
    return [(r.choice("ij"), BASE // HOUR * HOUR + r.randrange(1, hours * HOUR + 1), f"d{r.randrange(30):02}", r.randrange(1, 5), r.randrange(300), r.randrange(9), "reset" if r.random() < 0.02 else "incremental") for _ in range(n)]


def test_hours_are_rolled_up_once_and_late_rows_kept(spark, tmp_path):
    rows = sorted(deltas(2), key=lambda x: x[1])
    late = [x for x in rows[:40] if x[1] < BASE // HOUR * HOUR + HOUR // 2][:5]
    early = [x for x in rows if x not in late]
    at, parts = tmp_path / "out", [early[:150], early[150:300], early[300:] + late, [("end", BASE + 30 * HOUR, "x", 1, 1, 1, "baseline")]]
    files(spark, tmp_path / "in", DELTAS, parts)
    write = lambda: rollup.rollup_hours(reading(spark, tmp_path / "in", DELTAS), str(at), HOUR, 10, 100).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    write()
    want = same(counters.hourly_rollup(spark.createDataFrame(early, DELTAS), 10, 100))
    read = lambda: spark.read.parquet(f"{at}/rollup").drop("ends_ms")
    assert same(read()) == want
    assert sorted(tuple(r) for r in spark.read.parquet(f"{at}/late").select(DELTAS.replace(" string", "").replace(" bigint", "").split(", ")).collect()) == sorted(late) and len(late) == 5
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    write()  # the last batch once more
    assert same(read()) == want and spark.read.parquet(f"{at}/late").count() == 5


def test_ticks_are_counted_alike_in_batch_and_stream(spark, tmp_path):
    schema = "instance_id string, tick_ms bigint, probed boolean, wants_plan boolean, state string, has_history boolean, plan_source string, masking_degraded boolean, end_reason string, truncated boolean"
    r = random.Random(1)
    flag = lambda: r.choice([True, False, None])
    rows = [(r.choice("ij"), r.randrange(5), flag(), flag(), r.choice(["finalized", "in_flight"]), flag(), r.choice(["none", "rerun", "for_connection", None]), flag(), r.choice([None, "evicted"]), flag()) for _ in range(200)]
    report = capture.tick_report(spark.createDataFrame(rows, schema))
    total = report.agg(*[F.sum(n).alias(n) for n in capture.TICK]).first().asDict()
    assert total["candidates"] == 200 and total["evicted"] == sum(x[8] == "evicted" for x in rows) and report.count() == 10
    files(spark, tmp_path / "in", schema, [rows[:70], rows[70:]])
    query = capture.observe_ticks(reading(spark, tmp_path / "in", schema), "ticks").writeStream.foreachBatch(lambda df, n: df.count() and None).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["observedMetrics"]["ticks"] for p in query.recentProgress if "ticks" in p["observedMetrics"]]
    assert {n: sum(x[n] for x in seen) for n in capture.TICK} == total


def test_paused_targets_close_what_began_before(spark, tmp_path):
    rows = [(1, "i", "prod", 5, "in_flight"), (2, "i", "prod", 10, "in_flight"), (3, "j", "dev", 5, "in_flight"), (4, "i", "prod", 1, "finalized"), (5, "k", None, 2, "in_flight"), (6, "k", "qa", 3, "in_flight")]
    schema = "event_id int, instance_id string, env string, started_at_ms bigint, state string"
    pauses = spark.createDataFrame([("id:i", 4), ("id:i", 8), ("env:dev", 5), ("all", 3)], "scope string, since_ms bigint")
    read = lambda df: sorted((r["event_id"], r["state"], r["abandoned_reason"]) for r in df.collect())
    want = [(1, "abandoned", "collector_paused"), (5, "abandoned", "collector_paused")]
    assert read(statistics.close_paused(spark.createDataFrame(rows, schema), pauses)) == want
    files(spark, tmp_path / "in", schema, [rows[:3], rows[3:]])
    run(spark, tmp_path, statistics.close_paused(reading(spark, tmp_path / "in", schema), pauses))
    assert read(spark.read.parquet(f"{tmp_path}/out")) == want
    assert statistics.close_paused(spark.createDataFrame(rows, schema), pauses.limit(0)).count() == 0


def test_status_rates_of_a_stream_equal_the_batch(spark, tmp_path):
    schema = "instance_id string, at_ms bigint, uptime_s bigint, queries bigint"
    r, rows = random.Random(6), []
    for inst in "ij":
        up, q = 0, 0
        for t in range(0, 60_000, 5000):
            up, q = (0, 0) if r.random() < 0.1 else (up + 5, q + r.randrange(900))
            rows.append((inst, t, up, q))
    rows.sort(key=lambda x: x[1])
    files(spark, tmp_path / "in", schema, [rows[:7], rows[7:8], rows[8:]])
    got = run(spark, tmp_path, rollup.status_stream(reading(spark, tmp_path / "in", schema)))
    assert got == sorted(map(tuple, counters.status_rates(spark.createDataFrame(rows, schema)).collect()), key=repr) and len(got) == 24


def test_silent_runs_get_a_heartbeat(rocks, tmp_path):
    spark, schema = rocks, "instance_id string, thread_id bigint, started_at_ms bigint, state string"
    files(spark, tmp_path / "in", schema, [[("i", n, 5, "in_flight") for n in range(5)] + [("i", 9, 5, "in_flight"), ("i", 9, 5, "finalized"), ("j", 1, 7, "in_flight")]])
    query = heartbeat.heartbeat(reading(spark, tmp_path / "in", schema), 2000, 3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start(f"{tmp_path}/out")
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = spark.read.schema(heartbeat.OUT).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            by = Counter((r["instance_id"], r["thread_id"]) for r in got)
            if len(by) == 6 and min(by.values()) > 1:
                break
    finally:
        query.stop()
    assert set(by) == {("i", n) for n in range(5)} | {("j", 1)} and min(by.values()) > 1  # again and again, but not the one that ended
    assert all(r["silent_ms"] >= 2000 for r in got)
    assert max(Counter((r["instance_id"], r["touched_at_ms"]) for r in got).values()) <= 3


def test_gaps_of_a_stream_equal_the_batch(rocks, tmp_path):
    schema, r = "instance_id string, metric string, at_ms bigint", random.Random(8)
    rows = sorted({(r.choice("ij"), r.choice(("cpu", "io")), r.randrange(400) * 1000) for _ in range(120)}, key=lambda x: x[2])
    files(rocks, tmp_path / "in", schema, [rows[:50], rows[50:51], rows[51:]])
    got = run(rocks, tmp_path, feed.gap_stream(reading(rocks, tmp_path / "in", schema), 15_000))
    assert got == sorted(map(tuple, feed.gap_events(rocks.createDataFrame(rows, schema), 15_000).collect()), key=repr) and len(got) > 15


def test_feed_of_streams_has_a_topic_for_each_row(spark, tmp_path):
    files(spark, tmp_path / "slow", "event_id int, instance_id string, env string", [[(1, "i", "prod"), (2, "j", "qa")], [(3, "i", "dev")]])
    files(spark, tmp_path / "status", "instance_id string, qps double", [[("i", 1.5)]])
    read = lambda name, schema: reading(spark, tmp_path / name, schema)
    got = run(spark, tmp_path, feed.live_feed(read("slow", "event_id int, instance_id string, env string"), read("status", "instance_id string, qps double"), ["prod", "dev", "qa"], ["prod", "dev"]))
    assert got == [("slow/dev", "i", '{"event_id":3,"instance_id":"i","env":"dev"}'), ("slow/prod", "i", '{"event_id":1,"instance_id":"i","env":"prod"}'), ("status/i", "i", '{"instance_id":"i","qps":1.5}')]
