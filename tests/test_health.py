"""Station health against a plain step-by-step simulation."""

import random

from pyspark.sql import functions as F

from inspectlake.operators import health as h

SCHEMA = "s string, ts_us long, id long, kind string, decision string, error_code int"


def simulate(events, warning, critical):
    warning, critical = h.normal_limits(warning, critical)
    streak, alarm, state, out = 0, "None", "Ready", []

    def move(to):
        nonlocal state, alarm
        state = to
        if to == "Fault":
            alarm = "Critical"
        elif streak == 0:
            alarm = "None"

    def raise_alarm(code):
        nonlocal state, alarm
        if streak >= critical or code in (5, 8):
            alarm, state = "Critical", "Fault"
        elif streak >= warning or code != 0:
            alarm = "Warning"

    for kind, decision, code in events:
        if state == "Fault":
            move("Ready")
        if kind == "fault":
            raise_alarm(8)
            move("Fault")
        elif kind == "idle":
            move("Ready")
        else:
            move("Running")
            if decision in ("OK", "NG"):
                streak = 0
                if decision == "OK":
                    alarm = "None"
            else:
                streak += 1
                raise_alarm(code)
            if state != "Fault":
                move("Ready")
        out.append((streak, alarm, state))
    return out


def events_of(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choices(["result", "fault", "idle"], [8, 1, 1])[0]
        decision = rng.choice(["OK", "NG", "RECHECK", "RECHECK", "ERROR"])
        code = 0 if decision in ("OK", "NG") else rng.choice([0, 0, 7, 5, 8, 11])
        out.append((kind, decision, 8 if kind == "fault" else 0 if kind == "idle" else code))
    return out


def test_states_follow_the_simulation(spark):
    plans = {f"s{k}": events_of(k, 120) for k in range(4)}
    rows = [(s, i * 10, i, *e) for s, evs in plans.items() for i, e in enumerate(evs)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(s, i): w for s, evs in plans.items() for i, w in enumerate(simulate(evs, 2, 4))}
    for limit in (10**9, 30):
        out = h.station_states(df, ["s"], ["ts_us", "id"], 2, 4, limit).collect()
        assert {(r["s"], r["id"]): (r["streak"], r["alarm_level"], r["station_state"]) for r in out} == want


def test_three_rechecks(spark):
    df = spark.createDataFrame([("s", i, i, "result", "RECHECK", 7) for i in range(3)], SCHEMA)
    out = h.station_states(df, ["s"], ["ts_us", "id"], 2, 3).orderBy("id").collect()
    assert [r["alarm_level"] for r in out] == ["Warning", "Warning", "Critical"] and out[2]["station_state"] == "Fault"


def test_limits_are_normalised():
    assert h.normal_limits(0, 0) == (1, 2) and h.normal_limits(3, 2) == (3, 4) and h.normal_limits(2, 9) == (2, 9)


def test_backoff(spark):
    kinds = ["fault"] * 5 + ["idle", "fault", "result", "fault"]
    df = spark.createDataFrame([("s", i, i, k, "OK", 0) for i, k in enumerate(kinds)], SCHEMA)
    out = h.fault_backoff(df, ["s"], ["ts_us", "id"]).orderBy("id").collect()
    assert [r["backoff_ms"] for r in out] == [0, 0, 0, 200, 400, 0, 600, 0, 0]


def test_camera_reset_counts_anew(spark):
    flags = [True] * 4 + [False] + [True] * 3
    df = spark.createDataFrame([("c", i, f) for i, f in enumerate(flags)], "c string, i long, failed boolean")
    out = h.camera_resets(df, ["c"], ["i"], 3).orderBy("i").collect()
    assert [r["reset"] for r in out] == [False, False, True, False, False, False, False, True]
    assert [r["failures"] for r in out] == [1, 2, 3, 1, 0, 1, 2, 3]


def test_p95_rank_and_gate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [5, 1, 4, 2, 3, 3, 3, 9, 8, 7, 6]], "step string, ms double")
    r = h.timing_report(df).first()
    ordered = sorted([5, 1, 4, 2, 3, 3, 3, 9, 8, 7, 6])
    assert r["p95_ms"] == ordered[round(10 * 95 / 100)] and r["max_ms"] == 9
    limits = spark.createDataFrame([("a", 100.0, 8.5)], "step string, max_avg_ms double, max_ms_limit double")
    assert h.timing_gate(h.timing_report(df), limits).first()["max_exceeded"]


def test_retention_stops_when_enough_is_free(spark):
    files = spark.createDataFrame([(f"r/20240101/f{i}", i, 10) for i in range(6)] + [("r/tmp/x", 0, 99)], "path string, mtime long, bytes long")
    plan = h.retention_plan(files, 100, 5, 0.3)
    assert sorted(r["path"] for r in plan.collect()) == ["r/20240101/f0", "r/20240101/f1", "r/20240101/f2"]
    assert h.retention_plan(files, 100, 50, 0.3).count() == 0
