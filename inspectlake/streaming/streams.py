"""Structured Streaming forms of the event, health and capture jobs.

Late rows are dropped after the watermark.  Streams that wait for an answer or an end keep keyed state with timers
(``stateful``).  Jobs that carry ordered state (health, presence, latest)
run the batch operators per micro-batch on top of a versioned state table, so a busy station is
spread over tasks exactly as in batch, and a retried batch starts from the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from inspectlake.operators import health as h
from inspectlake.operators.decide import CRC_MISMATCH, DETECTOR_TIMEOUT
from inspectlake.operators.events import normal_status, result_serials
from inspectlake.session import SETTINGS, STATE_STORE
from inspectlake.sinks.tables import fresh_folder, merge_latest, newest_version, write_version
from inspectlake.sources.json_lines import parse_detection_events, stream_lines
from inspectlake.streaming.stateful import first_answers, view_lights

LATENESS = "10 minutes"


def ingest(spark: SparkSession, path: str, lateness: str = LATENESS) -> DataFrame:
    """Detection events of a growing folder with an event time and watermark."""
    events = parse_detection_events(stream_lines(spark, path))
    return events.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", lateness)


def dedupe(events: DataFrame, identity: list[str]) -> DataFrame:
    """First arrival per identity; state is kept for the watermark's span only."""
    return events.dropDuplicatesWithinWatermark(identity)


def hourly_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    status = normal_status("decision")
    return events.groupBy(*keys, F.window("event_time", "1 hour")).agg(
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(n) for s, n in (("OK", "ok"), ("NG", "ng"), ("RECHECK", "recheck"), ("ERROR", "error"))],
    ).withColumn("hour_start", F.col("window.start")).drop("window")


def tact_windows(events: DataFrame, keys: list[str], span: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    rate = events.groupBy(*keys, F.window("event_time", span, slide)).agg(F.count("*").alias("results"))
    return rate.withColumn("window_end", F.col("window.end")).drop("window")


def idle_sessions(frames: DataFrame, keys: list[str], gap: str = "2 seconds") -> DataFrame:
    """Frames of a line with no pause longer than ``gap``."""
    s = frames.groupBy(*keys, F.session_window("event_time", gap)).agg(F.count("*").alias("frames"), F.approx_count_distinct("light_id").alias("lights"))
    return s.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "frames", "lights")


def result_timeouts(jobs: DataFrame, replies: DataFrame, keys: list[str], timeout_s: float = 5.0, lateness: str = LATENESS, ticks: DataFrame | None = None) -> DataFrame:
    """Earliest reply to each published job, or its timeout, once either is certain: the rows of the batch form.

    ``jobs`` has keys and published_us, ``replies`` keys, reply_us and corrupt; neither has a watermark of its own.
    """
    code = F.when(F.col("answer_us").isNull(), DETECTOR_TIMEOUT).when(F.col("detail") == "1", CRC_MISMATCH).otherwise(0)
    settled = first_answers(
        jobs.select(*keys, F.col("published_us").alias("at_us"), F.lit(0).alias("ask_id")),
        replies.select(*keys, F.col("reply_us").alias("at_us"), F.lit(0).alias("ask_id"), "corrupt"),
        keys, int(timeout_s * 1_000_000), lateness, F.col("corrupt").cast("int"), inclusive=True, by_detail=True, ticks=ticks,
    )
    out = settled.select(*keys, (F.col("answer_us") - F.col("at_us")).alias("wait_us"), code.alias("error_code"))
    return out.withColumn("outcome", F.when(F.col("error_code") == 0, F.lit("RESULT")).otherwise(F.lit("RECHECK")))


def manual_matches(requests: DataFrame, results: DataFrame, keys: list[str], timeout_s: int = 30, lateness: str = LATENESS, ticks: DataFrame | None = None) -> DataFrame:
    """First result that answers each manual request in time, or TIMEOUT once the wait is over: the rows of the batch form.

    ``requests`` has keys, request_id, serial and requested_us, ``results`` keys, seat_id, sequence_id, decision and ts_us.
    """
    settled = first_answers(
        requests.select(*keys, "serial", F.col("requested_us").alias("at_us"), F.col("request_id").alias("ask_id")),
        result_serials(results).select(*keys, "serial", F.col("ts_us").alias("at_us"), F.col("sequence_id").alias("ask_id"), "decision"),
        [*keys, "serial"], timeout_s * 1_000_000, lateness, F.col("decision"), ticks=ticks,
    )
    outcome = F.when(F.col("answer_us").isNull(), F.lit("TIMEOUT")).otherwise(normal_status("detail"))
    return settled.select(F.col("ask_id").alias("request_id"), *keys, "serial", F.col("at_us").alias("requested_us"), F.col("answer_id").alias("result_sequence_id"), outcome.alias("outcome"))


def quality_gate(frames: DataFrame, keys: list[str], expected: list[str], span_s: float = 5.0, lateness: str = LATENESS, ticks: DataFrame | None = None) -> DataFrame:
    """Each captured view once, when its capture is over: frames, failed, missing lights by name, quality_pass."""
    return view_lights(frames, keys, expected, int(span_s * 1_000_000), lateness, ticks)


# --- state per micro-batch ----------------------------------------------------------------------

HEALTH_STATE = ["seed_streak", "seed_alarm", "total_jobs", "ok_count", "ng_count", "recheck_count", "error_count"]


def health_batch(spark: SparkSession, batch: DataFrame, number: int, folder: str, keys: list[str], order: list[str], warning: int, critical: int, hot_rows: int | None = None) -> None:
    """Streak, alarm and state of one batch on top of the state before it."""
    seeds = newest_version(spark, f"{folder}/state", below=number)
    rows = batch.select(*keys, *order, "kind", "decision", "error_code").withColumns(
        {"seed_streak": F.lit(0).cast("long"), "seed_alarm": F.lit(None).cast("string")}
    )
    if seeds is not None:
        first = seeds.select(
            *keys,
            *[F.lit(-(1 << 62)).cast("long").alias(o) for o in order],
            F.lit("seed").alias("kind"),
            F.lit("").alias("decision"),
            F.lit(0).alias("error_code"),
            "seed_streak",
            "seed_alarm",
        )
        rows = rows.unionByName(first)
    states = h.station_states(rows, keys, order, warning, critical, hot_rows)
    write_version(states.where("kind <> 'seed'"), f"{folder}/events", number)
    done = spark.read.parquet(f"{folder}/events/version={number}")
    is_result = F.col("kind") == "result"
    count = lambda d: F.count_if(is_result & (F.col("decision") == d))
    tally = done.groupBy(*keys).agg(
        F.max_by(F.struct(F.col("streak").alias("seed_streak"), F.col("alarm_level").alias("seed_alarm")), F.struct(*order)).alias("_last"),
        F.count_if(is_result).alias("total_jobs"),
        *[count(d).alias(n) for d, n in (("OK", "ok_count"), ("NG", "ng_count"), ("RECHECK", "recheck_count"), ("ERROR", "error_count"))],
    ).select(*keys, "_last.*", *HEALTH_STATE[2:])
    if seeds is not None:
        old = seeds.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_o_{c}") for c in HEALTH_STATE])
        on = [tally[k] == old[f"_k_{k}"] for k in keys]
        both = tally.join(old, on, "full_outer")
        add = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_o_{c}", F.lit(0))
        tally = both.select(
            *[F.coalesce(k, f"_k_{k}").alias(k) for k in keys],
            *[F.coalesce(c, f"_o_{c}").alias(c) for c in HEALTH_STATE[:2]],
            *[add(c).alias(c) for c in HEALTH_STATE[2:]],
        )
    write_version(tally, f"{folder}/state", number)


def run_health(events: DataFrame, folder: str, keys: list[str], order: list[str], warning: int = 3, critical: int = 5, hot_rows: int | None = None):
    def step(batch: DataFrame, number: int) -> None:
        health_batch(batch.sparkSession, batch, number, folder, keys, order, warning, critical, hot_rows)

    return _for_each(events, step, folder)


def run_presence(readings: DataFrame, folder: str, keys: list[str], order: list[str], low_mm: int, high_mm: int, stable_ms: int, hot_rows: int | None = None):
    """First stable presence per sensor; the open run of each sensor is carried to the next batch."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = newest_version(spark, f"{folder}/state", below=number)
        rows = batch.select(*keys, *order, "distance_mm").withColumn("seed_since", F.lit(None).cast("long"))
        if before is not None:
            carried = before.where("NOT reported AND since_us IS NOT NULL").select(
                *keys, *[F.lit(-(1 << 62)).cast("long").alias(o) for o in order], F.lit(None).cast("int").alias("distance_mm"), F.col("since_us").alias("seed_since")
            )
            rows = rows.unionByName(carried)
        runs = h.presence_runs(rows, keys, order, low_mm, high_mm, hot_rows).where("seed_since IS NULL")
        stable = F.col("in_range") & (F.col("ts_us") - F.col("since_us") >= max(stable_ms, 0) * 1000)
        hit = F.struct(F.col("ts_us").alias("present_us"), F.col(order[-1]).alias("id"), "distance_mm")
        now = runs.groupBy(*keys).agg(F.min(F.when(stable, hit)).alias("_hit"), F.max_by(F.struct(F.col("since_us").alias("since")), F.struct(*order)).alias("_open"))
        if before is None:
            state = now.select(*keys, F.col("_open.since").alias("since_us"), F.col("_hit").isNotNull().alias("reported"), "_hit.present_us", "_hit.distance_mm")
        else:
            old = before.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("since_us").alias("_since"), F.col("reported").alias("_rep"), F.col("present_us").alias("_at"), F.col("distance_mm").alias("_d"))
            both = now.join(old, [now[k] == old[f"_k_{k}"] for k in keys], "full_outer")
            rep = F.coalesce("_rep", F.lit(False))
            state = both.select(
                *[F.coalesce(k, f"_k_{k}").alias(k) for k in keys],
                F.when(F.col("_open").isNotNull(), F.col("_open.since")).otherwise(F.col("_since")).alias("since_us"),
                (rep | F.col("_hit").isNotNull()).alias("reported"),
                F.when(rep, F.col("_at")).otherwise(F.col("_hit.present_us")).alias("present_us"),
                F.when(rep, F.col("_d")).otherwise(F.col("_hit.distance_mm")).alias("distance_mm"),
            )
        write_version(state, f"{folder}/state", number)

    return _for_each(readings, step, folder)


def run_latest(events: DataFrame, folder: str):
    """Latest event per station as a versioned snapshot."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write_version(merge_latest(newest_version(spark, f"{folder}/state", below=number), batch), f"{folder}/state", number)

    return _for_each(events, step, folder)


def run_collect(frames: DataFrame, folder: str, decision: str | None = None):
    """Everything available now: raw frame listing and samples of one decision, batch by batch."""
    from inspectlake.operators.datasets import with_decision
    from inspectlake.sinks.tables import raw_frame_rows

    def step(batch: DataFrame, number: int) -> None:
        write_version(raw_frame_rows(batch), f"{folder}/raw_frames", number)
        write_version(with_decision(batch, decision), f"{folder}/samples", number)

    return _for_each(frames, step, folder)


def _for_each(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str):
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


# --- running to completion ----------------------------------------------------------------------


def to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and return the written rows; each batch owns its folder.

    State is cut into as many parts as the cluster has cores, whatever batch queries use, and lives in the store that
    keeps lists, maps and timers, whatever store the session names.
    """
    spark = stream.sparkSession
    folder = fresh_folder(spark, name)

    def step(batch: DataFrame, number: int) -> None:
        write_version(batch, f"{folder}/out", number)

    settings = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), STATE_STORE: SETTINGS[STATE_STORE]}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def newest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of an update-mode table."""
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")
