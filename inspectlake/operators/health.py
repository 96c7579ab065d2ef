"""Station health over ordered results: streaks, alarms, states, totals, backoff and presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.operators.ordered import Ordered

# Error codes.
DETECTOR_TIMEOUT, DEVICE_FAULT, LIGHT_FAULT, CAMERA_FAULT, TRIGGER_SYNC_FAULT = 5, 8, 10, 11, 12
DEVICE_FAULTS = [DEVICE_FAULT, LIGHT_FAULT, CAMERA_FAULT, TRIGGER_SYNC_FAULT]
CRITICAL_CODES = [DETECTOR_TIMEOUT, DEVICE_FAULT]


def normal_limits(warning: int, critical: int) -> tuple[int, int]:
    warning = 1 if warning == 0 else warning
    return warning, critical if critical > warning else warning + 1


def station_counters(results: DataFrame, keys: list[str]) -> DataFrame:
    decision, code = F.col("decision"), F.col("error_code")
    return results.groupBy(*keys).agg(
        F.count("*").alias("total_jobs"),
        F.count_if(decision == "OK").alias("ok_count"),
        F.count_if(decision == "NG").alias("ng_count"),
        F.count_if(decision == "RECHECK").alias("recheck_count"),
        F.count_if(decision == "ERROR").alias("error_count"),
        F.count_if(code == DETECTOR_TIMEOUT).alias("detector_timeout_count"),
        F.count_if(code.isin(DEVICE_FAULTS)).alias("device_fault_count"),
    )


def add_streak(rows: Ordered, counts: Column, resets: Column, name: str = "streak") -> Ordered:
    """Rows counted since the last reset; rows that do neither keep the value."""
    return (
        rows.running(_seen=("sum", counts.cast("long")))
        .running(_base=("last", F.when(resets, F.col("_seen"))))
        .with_columns(**{name: F.col("_seen") - F.coalesce("_base", F.lit(0))})
    )


def recheck_streaks(results: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None) -> DataFrame:
    """RECHECK and ERROR results in a row since the last OK or NG."""
    rows = Ordered(results, keys, order, hot_rows)
    out = add_streak(rows, F.col("decision").isin("RECHECK", "ERROR"), F.col("decision").isin("OK", "NG"))
    return out.result().drop("_seen", "_base")


def station_states(
    events: DataFrame,
    keys: list[str],
    order: list[str],
    warning: int = 3,
    critical: int = 5,
    hot_rows: int | None = None,
) -> DataFrame:
    """Streak, alarm level and state after each event.

    ``kind`` is ``result``, ``fault`` (the trigger wait failed) or ``idle`` (the wait ended quietly).
    Every event starts with the station leaving Fault; a state change while the streak is zero clears
    the alarm.  So an event either sets the alarm, clears it, or lets the last one stand, and the
    carried alarm is the last set or cleared value.  A row of kind ``seed`` before all others brings in
    an earlier state (``seed_streak``, ``seed_alarm``).
    """
    warning, critical = normal_limits(warning, critical)
    c = F.col
    if "seed_streak" not in events.columns:
        events = events.withColumns({"seed_streak": F.lit(0).cast("long"), "seed_alarm": F.lit(None).cast("string")})
    result, bad = c("kind") == "result", (c("kind") == "result") & c("decision").isin("RECHECK", "ERROR")
    counts = F.when(c("kind") == "seed", c("seed_streak")).otherwise(bad.cast("long"))
    streaked = add_streak(Ordered(events, keys, order, hot_rows), counts, result & c("decision").isin("OK", "NG"))
    before = c("streak") - bad.cast("long")
    raised = (
        F.when((c("streak") >= critical) | c("error_code").isin(CRITICAL_CODES), F.lit("Critical"))
        .when((c("streak") >= warning) | (c("error_code") != 0), F.lit("Warning"))
    )
    mark = (
        F.when(c("kind") == "seed", c("seed_alarm"))
        .when(c("kind") == "fault", F.lit("Critical"))
        .when(bad, F.coalesce(raised, F.when(before == 0, F.lit("None"))))
        .when(c("streak") == 0, F.lit("None"))
    )
    fault_now = (c("kind") == "fault") | (bad & (raised == "Critical"))
    return (
        streaked.with_columns(_mark=mark)
        .running(_alarm=("last", F.col("_mark")))
        .with_columns(
            alarm_level=F.coalesce("_alarm", F.lit("None")),
            station_state=F.when(F.coalesce(fault_now, F.lit(False)), F.lit("Fault")).otherwise(F.lit("Ready")),
        )
        .result()
        .drop("_seen", "_base", "_mark", "_alarm", "seed_streak", "seed_alarm")
    )


def alarm_levels(results: DataFrame, keys: list[str], order: list[str], warning: int = 3, critical: int = 5, hot_rows: int | None = None) -> DataFrame:
    """Alarm level after each result."""
    rows = results.withColumn("kind", F.lit("result"))
    return station_states(rows, keys, order, warning, critical, hot_rows).drop("kind", "station_state")


def running_totals(results: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None) -> DataFrame:
    """Counters as they stood when each event was written."""
    decision, code = F.col("decision"), F.col("error_code")
    flag = lambda cond: ("sum", cond.cast("long"))
    return (
        Ordered(results, keys, order, hot_rows)
        .running(
            total_jobs=("count", F.lit(1)),
            ok_count=flag(decision == "OK"),
            ng_count=flag(decision == "NG"),
            recheck_count=flag(decision == "RECHECK"),
            error_count=flag(decision == "ERROR"),
            detector_timeout_count=flag(code == DETECTOR_TIMEOUT),
            device_fault_count=flag(code.isin(DEVICE_FAULTS)),
        )
        .result()
    )


def fault_backoff(events: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None) -> DataFrame:
    """Trigger faults in a row and the wait after each; an accepted trigger ends the run."""
    out = add_streak(
        Ordered(events, keys, order, hot_rows), F.col("kind") == "fault", F.col("kind") == "result", "consecutive_faults"
    ).result()
    n = F.col("consecutive_faults")
    delay = F.when((F.col("kind") == "fault") & (n > 3), F.least((n - 3) * 200, F.lit(5000))).otherwise(0)
    return out.withColumn("backoff_ms", delay).drop("_seen", "_base")


def camera_resets(captures: DataFrame, keys: list[str], order: list[str], max_failures: int = 3, hot_rows: int | None = None) -> DataFrame:
    """Failures in a row per camera, counted anew after each reset mark."""
    out = add_streak(Ordered(captures, keys, order, hot_rows), F.col("failed"), ~F.col("failed"), "_run").result()
    run = F.col("_run")
    return out.withColumns(
        {
            "reset": F.col("failed") & (run % max_failures == 0),
            "failures": F.when(F.col("failed"), (run - 1) % max_failures + 1).otherwise(0),
        }
    ).drop("_seen", "_base", "_run")


def presence_runs(readings: DataFrame, keys: list[str], order: list[str], low_mm: int, high_mm: int, hot_rows: int | None = None) -> DataFrame:
    """Readings with ``in_range`` and, while in range, ``since_us``: the time the run began.

    A reading with ``seed_since`` (and no distance) continues a run that began earlier.
    """
    low, high = min(low_mm, high_mm), max(low_mm, high_mm)
    seed = F.col("seed_since") if "seed_since" in readings.columns else F.lit(None).cast("long")
    inside = F.when(seed.isNotNull(), F.lit(True)).otherwise(F.coalesce(F.col("distance_mm").between(low, high), F.lit(False)))
    start = F.when(F.col("in_range") & ~F.coalesce("_was", F.lit(False)), F.coalesce(seed, F.col("ts_us")))
    return (
        Ordered(readings.withColumn("in_range", inside), keys, order, hot_rows)
        .previous(_was=F.col("in_range"))
        .with_columns(_start=start)
        .running(since_us=("last", F.col("_start")))
        .with_columns(since_us=F.when(F.col("in_range"), F.col("since_us")))
        .result()
        .drop("_was", "_start")
    )


def stable_presence(
    readings: DataFrame,
    keys: list[str],
    order: list[str],
    low_mm: int,
    high_mm: int,
    stable_ms: int,
    hot_rows: int | None = None,
) -> DataFrame:
    """First reading per sensor whose distance has stayed in range for ``stable_ms``; null when none did."""
    rows = presence_runs(readings, keys, order, low_mm, high_mm, hot_rows)
    stable = F.col("in_range") & (F.col("ts_us") - F.col("since_us") >= max(stable_ms, 0) * 1000)
    hit = F.struct("ts_us", F.col(order[-1]).alias("id"), "distance_mm")
    return rows.groupBy(*keys).agg(F.min(F.when(stable, hit)).alias("hit")).select(
        *keys,
        F.col("hit.ts_us").alias("present_us"),
        F.col("hit.distance_mm").alias("distance_mm"),
        F.when(F.col("hit").isNull(), F.lit("timeout")).otherwise(F.lit("present")).alias("outcome"),
    )


def retention_plan(files: DataFrame, capacity_bytes: int, available_bytes: int, min_free_ratio: float, hot_rows: int | None = None) -> DataFrame:
    """Oldest files under date folders to delete until the free share is reached; nothing is deleted here."""
    if capacity_bytes <= 0:
        return files.where(F.lit(False))
    needed = min_free_ratio * capacity_bytes - available_bytes
    dated = files.where(F.col("path").rlike(r"(^|/)[0-9]{8}/"))
    summed = Ordered(dated, [], ["mtime", "path"], hot_rows).running(freed_bytes=("sum", F.col("bytes"))).result()
    return summed.where(F.col("freed_bytes") - F.col("bytes") < needed)


def timing_report(timings: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Per step: count, mean, nearest-rank p95 and maximum.

    The p95 is one exact rank, so values are first counted by value and only distinct values are ordered.
    """
    by_value = timings.groupBy("step", "ms").agg(F.count("*").alias("n"))
    ranked = Ordered(by_value, ["step"], ["ms"], hot_rows).running(upto=("sum", F.col("n"))).result()
    totals = timings.groupBy("step").agg(
        F.count("*").alias("count"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms")
    )
    target = F.rint((F.col("count") - 1) * 95 / 100) + 1
    p95 = ranked.join(totals.select("step", "count"), "step").where(F.col("upto") >= target).groupBy("step").agg(F.min("ms").alias("p95_ms"))
    return totals.join(p95, "step")


def timing_gate(report: DataFrame, limits: DataFrame) -> DataFrame:
    """Steps over their ``max_avg_ms`` or ``max_ms_limit``; limits are one row per step."""
    over_avg = F.coalesce(F.col("avg_ms") > F.col("max_avg_ms"), F.lit(False))
    over_max = F.coalesce(F.col("max_ms") > F.col("max_ms_limit"), F.lit(False))
    return (
        report.join(limits, "step")
        .where(over_avg | over_max)
        .select("step", "avg_ms", "max_ms", over_avg.alias("avg_exceeded"), over_max.alias("max_exceeded"))
    )
