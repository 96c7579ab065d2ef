"""Streams fed in several batches give what the batch operators give on everything."""

import random

import pytest
from pyspark.sql import functions as F

from inspectlake.operators import health as h
from inspectlake.sinks import tables as sk
from inspectlake.streaming import streams as st

BASE = 1_700_000_000_000_000  # a stream starts with its watermark at zero


def feed(spark, folder, df, order, parts=3):
    """``df`` as a stream of ``parts`` files in order."""
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/p{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        kind = rng.choices(["result", "fault", "idle"], [8, 1, 1])[0]
        decision = rng.choice(["OK", "NG", "RECHECK", "ERROR"])
        rows.append((rng.randrange(5), i * 1000, i, kind, decision, rng.choice([0, 7, 8]) if decision in ("RECHECK", "ERROR") else 0))
    return spark.createDataFrame(rows, "s int, ts_us long, id long, kind string, decision string, error_code int")


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_health_over_batches(spark, tmp_path, rows, events, hot_rows):
    stream = feed(spark, str(tmp_path), events, ["ts_us"])
    st.run_health(stream, str(tmp_path / "out"), ["s"], ["ts_us", "id"], 2, 3, hot_rows).awaitTermination()
    columns = ["s", "id", "streak", "alarm_level", "station_state"]
    batch = h.station_states(events, ["s"], ["ts_us", "id"], 2, 3)
    written = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert written.select("version").distinct().count() == 3
    assert rows(written, *columns) == rows(batch, *columns)
    state = sk.newest_version(spark, str(tmp_path / "out" / "state"))
    assert state.agg(F.sum("total_jobs")).first()[0] == events.where("kind = 'result'").count()


def test_presence_over_batches(spark, tmp_path, rows):
    rng = random.Random(4)
    data = [(i % 6, i * 400_000, i, rng.choice([150, 210, 220, 230, 240])) for i in range(200)]
    df = spark.createDataFrame(data, "k int, ts_us long, id long, distance_mm int")
    stream = feed(spark, str(tmp_path), df, ["ts_us"])
    st.run_presence(stream, str(tmp_path / "out"), ["k"], ["ts_us", "id"], 200, 250, 9000).awaitTermination()
    state = sk.newest_version(spark, str(tmp_path / "out" / "state"))
    batch = h.stable_presence(df, ["k"], ["ts_us", "id"], 200, 250, 9000)
    assert batch.where("outcome = 'present'").count() > 0
    assert rows(state, "k", "present_us", "distance_mm") == rows(batch, "k", "present_us", "distance_mm")


def test_dedupe_and_counts(spark, tmp_path, rows):
    df = spark.createDataFrame([(i % 3, i // 2, BASE + (i // 2) * 60_000_000, "OK" if i % 4 < 2 else "NG") for i in range(80)], "s int, id long, ts_us long, decision string")
    stream = feed(spark, str(tmp_path), df, ["ts_us"], 2).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", "10 minutes")
    once = st.to_table(st.dedupe(stream.select("s", "id", "event_time"), ["s", "id"]), "t-dedupe")
    assert rows(once, "s", "id") == rows(df.select("s", "id").distinct())
    hours = st.newest_updates(st.to_table(st.hourly_counts(stream, ["s"]), "t-counts", "update"), ["s", "hour_start"])
    assert hours.agg(F.sum("total")).first()[0] == 80


def shuffled(spark, folder, df, parts, seed):
    """``df`` as a stream of ``parts`` files of any rows, with a fixed order of files."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def tick(spark, folder, at_us=BASE + 10**14, after=5):
    """A stream whose only row comes after ``after`` batches."""
    for i in range(after + 1):
        spark.createDataFrame([(at_us,)] if i == after else [], "at_us long").coalesce(1).write.parquet(f"{folder}/p{i}")
    return spark.readStream.schema("at_us long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("seed", [1, 2])
def test_timeouts_equal_the_batch_form(spark, tmp_path, rows, seed):
    """Rows in any order over four batches; broken, late, early, several and missing replies; open jobs end with the tick."""
    from inspectlake.operators import decide

    rng = random.Random(seed)
    jobs = spark.createDataFrame([(i % 3, i, BASE + i * 3_000_000) for i in range(60)], "s int, id long, published_us long")
    replies = [(i % 3, i, BASE + i * 3_000_000 + rng.choice([-1, 0, 1_000_000, 5_000_000, 5_000_001, 9_000_000]), rng.random() < 0.3) for i in range(60) for _ in range(rng.choice([0, 1, 2, 3]))]
    replies += [(2, 999, BASE, False)]
    df = spark.createDataFrame(replies, "s int, id long, reply_us long, corrupt boolean")
    out = st.result_timeouts(shuffled(spark, str(tmp_path / "j"), jobs, 4, seed), shuffled(spark, str(tmp_path / "r"), df, 4, seed), ["s", "id"], 5.0, "1 hour", tick(spark, str(tmp_path / "t")))
    got = st.to_table(out, "t-timeout")
    columns = ["s", "id", "wait_us", "error_code", "outcome"]
    assert rows(got, *columns) == rows(decide.result_timeouts(jobs, df, ["s", "id"], 5.0), *columns)


@pytest.mark.parametrize("seed", [3, 4])
def test_manual_matches_equal_the_batch_form(spark, tmp_path, rows, seed):
    """Several requests and answers a serial, answers before and after, at one time, and open requests."""
    from inspectlake.operators import events as ev

    rng = random.Random(seed)
    asks = spark.createDataFrame([(i, i % 2, f"SN{rng.randrange(4)}", BASE + rng.randrange(200) * 1_000_000) for i in range(50)], "request_id long, station_id int, serial string, requested_us long")
    done = spark.createDataFrame([(100 + i, i % 2, f"L_SN{rng.randrange(5)}", rng.choice(["OK", "NG", "x"]), BASE + rng.randrange(60) * 5_000_000) for i in range(40)], "sequence_id long, station_id int, seat_id string, decision string, ts_us long")
    out = st.manual_matches(shuffled(spark, str(tmp_path / "a"), asks, 3, seed), shuffled(spark, str(tmp_path / "d"), done, 3, seed), ["station_id"], 30, "1 hour", tick(spark, str(tmp_path / "t")))
    columns = ["request_id", "station_id", "serial", "result_sequence_id", "outcome"]
    got = rows(st.to_table(out, "t-manual"), *columns)
    assert got == rows(ev.match_manual_requests(asks, done, ["station_id"], 30), *columns)
    assert any(r[4] == "TIMEOUT" for r in got) and any(r[4] != "TIMEOUT" for r in got)


def test_answers_come_as_soon_as_they_are_certain(spark, tmp_path):
    """The watermark settles what lies behind it; a row behind the watermark is dropped; without a tick the rest stays open."""
    s = 1_000_000
    batches = [([(1, 0)], [(1, 4)]), ([(2, 100)], []), ([(3, 200)], []), ([(4, 300)], [(1, 2)])]
    for i, (a, r) in enumerate(batches):
        for name, data in (("a", a), ("r", r)):
            spark.createDataFrame([(k, BASE + t * s, k) for k, t in data], "k int, at_us long, ask_id long").coalesce(1).write.parquet(f"{tmp_path}/{name}/p{i}")
    read = lambda name: spark.readStream.schema("k int, at_us long, ask_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    from inspectlake.streaming.stateful import first_answers

    out = st.to_table(first_answers(read("a"), read("r"), ["k"], 10 * s, "20 seconds"), "t-first").collect()
    got = {r.k: (r.answer_us - BASE) // s if r.answer_us else None for r in out}
    assert got == {1: 4, 2: None, 3: None}
    assert len({r.version for r in out}) > 1


def test_views_are_judged_once(spark, tmp_path):
    """Frames of a view over several batches, a light twice, one missing, one that failed."""
    frames = [("a", "A", True, 0), ("a", "B", True, 1), ("a", "B", True, 2), ("b", "A", True, 3), ("b", "A", True, 4), ("c", "A", True, 5), ("c", "B", False, 6), ("d", "B", True, 100), ("d", "X", True, 101), ("d", "A", True, 102)]
    df = spark.createDataFrame([(v, light, ok, BASE + t * 1_000_000) for v, light, ok, t in frames], "view string, light_id string, passed boolean, at_us long")
    stream = feed(spark, str(tmp_path), df, ["at_us"], 5)
    out = st.to_table(st.quality_gate(stream, ["view"], ["A", "B"], 5, "1 second", tick(spark, str(tmp_path / "t"), BASE + 50_000_000)), "t-views").collect()
    got = {r.view: (r.frames, r.failed, r.missing, r.quality_pass) for r in out}
    assert got == {"a": (3, 0, [], True), "b": (2, 0, ["B"], False), "c": (2, 1, [], False)} and len(out) == 3  # d is still open


def test_idle_gap_sessions(spark, tmp_path):
    times = [0, 1, 2, 30, 31, 90, 200]
    df = spark.createDataFrame([(1, BASE + t * 1_000_000, "A") for t in times], "line int, us long, light_id string")
    s = feed(spark, str(tmp_path), df, ["us"], 2).withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", "5 seconds")
    out = st.to_table(st.idle_sessions(s, ["line"]), "t-sessions")
    assert sorted(r["frames"] for r in out.collect()) == [1, 2, 3]  # the last one is still open


def test_streams_that_wait_run_in_any_session(spark):
    """A session that names a store without lists and timers, as Spark's own default does."""
    import __spark_entry__ as entry

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, plain)
    try:
        assert entry.queries()["str_quality_gate"](spark, "/root/testdata/sf0.001").count() > 0
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)


def test_many_keys_cost_few_calls():
    """A bucket of 5000 keys appends once, sets one timer, and is settled by one call."""
    import json
    from types import SimpleNamespace

    import pandas as pd

    from inspectlake.streaming.stateful import ANSWER, ASK, _Waiting

    calls, blocks, timers = [], [], []
    state = SimpleNamespace(
        appendValue=lambda value: (calls.append("append"), blocks.append(value)), get=lambda: iter(blocks),
        put=lambda values: (calls.append("put"), blocks.__setitem__(slice(None), values)), clear=lambda: (calls.append("clear"), blocks.clear()))
    handle = SimpleNamespace(getListState=lambda *_: state, listTimers=lambda: iter(timers), registerTimer=lambda t: (calls.append("timer"), timers.append(t)), deleteTimer=timers.remove)
    waiting = _Waiting(10_000_000, True, False)
    waiting.init(handle)
    rows = [(f'{{"k":{k}}}', json.dumps([kind, at, k, None])) for k in range(5000) for kind, at in ((ASK, 1_000_000), (ANSWER, 3_000_000 + k))]
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert list(waiting.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["who", "what"])]), at(0))) == []
    assert calls == ["append", "timer"] and timers == [3001]
    (part,) = waiting.handleExpiredTimer((7,), at(3002), None)
    assert len(part) == 2001 and calls[2:] == ["put", "timer"]
    timers.remove(3001)
    (rest,) = waiting.handleExpiredTimer((7,), at(60_000), None)
    assert len(rest) == 2999 and calls[4:] == ["clear"] and list(rest["answer_us"])[-1] == 3_004_999


def test_waiting_keeps_odd_keys_and_numbers(spark, tmp_path):
    """Null keys meet each other, long numbers beside nulls stay exact, a question or answer without a time has no match."""
    from inspectlake.streaming.stateful import first_answers

    big, s = (1 << 62) + 1, 1_000_000
    asks = [("a\"\\\n", big, BASE, big), (None, big, BASE, None), (None, None, BASE, 5), ("t", 1, None, 6), ("u", 1, BASE, 7)]
    answers = [("a\"\\\n", big, BASE + s, big + 2, "x\"\n"), (None, big, BASE + s, None, None), (None, None, BASE, big, "y"), ("t", 1, BASE, 1, "z"), ("u", 1, None, 1, "z")]
    for name, data, schema in (("a", asks, "s string, k long, at_us long, ask_id long"), ("r", answers, "s string, k long, at_us long, ask_id long, d string")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/p0")
    read = lambda name, extra="": spark.readStream.schema("s string, k long, at_us long, ask_id long" + extra).parquet(f"{tmp_path}/{name}/*")
    out = st.to_table(first_answers(read("a"), read("r", ", d string"), ["s", "k"], 10 * s, "1 second", F.col("d"), ticks=tick(spark, str(tmp_path / "t"), after=1)), "t-odd")
    got = sorted((tuple(r)[:7] for r in out.select("s", "k", "at_us", "ask_id", "answer_us", "answer_id", "detail").collect()), key=str)
    want = [("a\"\\\n", big, BASE, big, BASE + s, big + 2, "x\"\n"), (None, big, BASE, None, BASE + s, None, None), (None, None, BASE, 5, BASE, big, "y"), ("t", 1, None, 6, None, None, None), ("u", 1, BASE, 7, None, None, None)]
    assert got == sorted(want, key=str)
