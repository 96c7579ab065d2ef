"""Queries on station health, timings and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectlake.operators import decide, health as h
from inspectlake.plans.registry import query

ORDER = ["ts_us", "sequence_id"]
STREAK = """
WITH b AS (SELECT *, decision IN ('RECHECK','ERROR') AS bad, sum(CASE WHEN decision IN ('OK','NG') THEN 1 ELSE 0 END) OVER w AS island FROM v_results
  WINDOW w AS (PARTITION BY station_id ORDER BY ts_us, sequence_id)),
s AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, island ORDER BY ts_us, sequence_id) AS streak FROM b)"""


@query("agg_station_counters", """
SELECT station_id, count(*) AS total_jobs, count_if(decision = 'OK') AS ok_count, count_if(decision = 'NG') AS ng_count, count_if(decision = 'RECHECK') AS recheck_count,
  count_if(decision = 'ERROR') AS error_count, count_if(error_code = 5) AS detector_timeout_count, count_if(error_code IN (8, 10, 11, 12)) AS device_fault_count
FROM v_results GROUP BY station_id""")
def _(t):
    return h.station_counters(t.results, ["station_id"])


@query("win_recheck_streak", STREAK + " SELECT station_id, sequence_id, streak FROM s")
def _(t):
    rows = t.results.select("station_id", "sequence_id", "ts_us", "decision")
    return h.recheck_streaks(rows, ["station_id"], ORDER).select("station_id", "sequence_id", "streak")


@query("win_alarm_level", STREAK + """,
l AS (SELECT *, CASE WHEN NOT bad THEN 'None' WHEN streak >= 4 OR error_code IN (5, 8) THEN 'Critical' WHEN streak >= 3 OR error_code <> 0 THEN 'Warning'
  WHEN streak = 1 THEN 'None' END AS mark FROM s)
SELECT station_id, sequence_id, streak, last_value(mark IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY ts_us, sequence_id) AS alarm_level FROM l""")
def _(t):
    rows = t.results.select("station_id", "sequence_id", "ts_us", "decision", "error_code")
    return h.alarm_levels(rows, ["station_id"], ORDER, 3, 4).select("station_id", "sequence_id", "streak", "alarm_level")


# Clicks stand for quiet waits and device errors for failed trigger waits.
KINDS = """SELECT station_id, sequence_id, ts_us, decision, error_code,
  CASE WHEN error_code = 8 THEN 'fault' WHEN sequence_id % 5 = 2 AND decision = 'OK' THEN 'idle' ELSE 'result' END AS kind FROM {v_results}"""


STATE_SQL = f"""
WITH k AS ({KINDS}),
b AS (SELECT *, kind = 'result' AND decision IN ('RECHECK','ERROR') AS bad,
  sum(CASE WHEN kind = 'result' AND decision IN ('OK','NG') THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY ts_us, sequence_id) AS island FROM k),
s AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, island ORDER BY ts_us, sequence_id) AS streak FROM b),
l AS (SELECT *, CASE WHEN kind = 'fault' THEN 'Critical' WHEN bad AND (streak >= 3 OR error_code IN (5, 8)) THEN 'Critical' WHEN bad AND (streak >= 2 OR error_code <> 0) THEN 'Warning'
   WHEN bad AND streak = 1 THEN 'None' WHEN NOT bad AND streak = 0 THEN 'None' END AS mark FROM s)
SELECT station_id, sequence_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY ts_us, sequence_id), 'None') AS alarm_level,
  CASE WHEN kind = 'fault' OR (bad AND (streak >= 3 OR error_code IN (5, 8))) THEN 'Fault' ELSE 'Ready' END AS station_state FROM l"""


@query("win_station_state", STATE_SQL)
def _(t):
    return h.station_states(t.select(KINDS), ["station_id"], ORDER, 2, 3).select("station_id", "sequence_id", "alarm_level", "station_state")


@query("win_running_totals", """
SELECT station_id, sequence_id, count(*) OVER w AS total_jobs, count(*) FILTER (decision = 'OK') OVER w AS ok_count, count(*) FILTER (decision = 'NG') OVER w AS ng_count,
  count(*) FILTER (decision = 'RECHECK') OVER w AS recheck_count, count(*) FILTER (decision = 'ERROR') OVER w AS error_count,
  count(*) FILTER (error_code = 5) OVER w AS detector_timeout_count, count(*) FILTER (error_code IN (8,10,11,12)) OVER w AS device_fault_count
FROM v_results WINDOW w AS (PARTITION BY station_id ORDER BY ts_us, sequence_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    rows = t.results.select("station_id", "sequence_id", "ts_us", "decision", "error_code")
    return h.running_totals(rows, ["station_id"], ORDER).drop("ts_us", "decision", "error_code")


@query("win_fault_backoff", """
WITH k AS (SELECT station_id, sequence_id, ts_us, CASE decision WHEN 'OK' THEN 'fault' WHEN 'RECHECK' THEN 'idle' WHEN 'ERROR' THEN 'fault' ELSE 'result' END AS kind FROM v_results),
b AS (SELECT *, sum(CASE WHEN kind = 'result' THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY ts_us, sequence_id) AS island FROM k),
s AS (SELECT *, sum(CASE WHEN kind = 'fault' THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, island ORDER BY ts_us, sequence_id) AS n FROM b)
SELECT station_id, sequence_id, kind, n AS consecutive_faults, CASE WHEN kind = 'fault' AND n > 3 THEN least((n - 3) * 200, 5000) ELSE 0 END AS backoff_ms FROM s""")
def _(t):
    kind = F.when(F.col("decision").isin("OK", "ERROR"), "fault").when(F.col("decision") == "RECHECK", "idle").otherwise("result")
    rows = t.results.select("station_id", "sequence_id", "ts_us", kind.alias("kind"))
    return h.fault_backoff(rows, ["station_id"], ORDER).drop("ts_us")


@query("win_camera_reset", """
WITH b AS (SELECT sensor_id, event_id, ts_us, distance_mm > 215 AS failed, sum(CASE WHEN distance_mm > 215 THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY ts_us, event_id) AS island FROM v_readings),
s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id, island ORDER BY ts_us, event_id) AS n FROM b)
SELECT sensor_id, event_id, failed AND n % 3 = 0 AS reset, CASE WHEN failed THEN (n - 1) % 3 + 1 ELSE 0 END AS failures FROM s""")
def _(t):
    rows = t.readings.select("sensor_id", "event_id", "ts_us", (F.col("distance_mm") > 215).alias("failed"))
    return h.camera_resets(rows, ["sensor_id"], ["ts_us", "event_id"]).select("sensor_id", "event_id", "reset", "failures")


PRESENCE_SQL = """
WITH b AS (SELECT *, distance_mm BETWEEN 200 AND 260 AS inside, sum(CASE WHEN distance_mm BETWEEN 200 AND 260 THEN 0 ELSE 1 END) OVER (PARTITION BY sensor_id ORDER BY ts_us, event_id) AS island FROM v_readings),
s AS (SELECT *, min(ts_us) FILTER (inside) OVER (PARTITION BY sensor_id, island) AS since FROM b),
h AS (SELECT * FROM s WHERE inside AND ts_us - since >= 172800000000 QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY ts_us, event_id) = 1)
SELECT k.sensor_id, h.ts_us AS present_us, h.distance_mm, CASE WHEN h.ts_us IS NULL THEN 'timeout' ELSE 'present' END AS outcome
FROM (SELECT DISTINCT sensor_id FROM v_readings) k LEFT JOIN h USING (sensor_id)"""


@query("win_presence_stable", PRESENCE_SQL)
def _(t):
    return h.stable_presence(t.readings, ["sensor_id"], ["ts_us", "event_id"], 260, 200, 172_800_000)


@query("win_retention_plan", """
SELECT path, mtime, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY mtime, path ROWS UNBOUNDED PRECEDING) AS freed FROM v_files WHERE regexp_matches(path, '(^|/)[0-9]{8}/'))
WHERE freed - bytes < 0.3 * 10000000 - 2500000""")
def _(t):
    return h.retention_plan(t.files.select("path", "mtime", "bytes"), 10_000_000, 2_500_000, 0.3).drop("freed_bytes")


REPORT = """
WITH r AS (SELECT step, ms, row_number() OVER (PARTITION BY step ORDER BY ms) AS rn, count(*) OVER (PARTITION BY step) AS n FROM v_timings),
report AS (SELECT step, count(*) AS count, avg(ms) AS avg_ms, max(CASE WHEN rn = cast(round_even((n - 1) * 95 / 100, 0) AS bigint) + 1 THEN ms END) AS p95_ms, max(ms) AS max_ms FROM r GROUP BY step)"""


@query("agg_timing_report", REPORT + " SELECT step, count, round(avg_ms, 6) AS avg_ms, p95_ms, max_ms FROM report")
def _(t):
    return h.timing_report(t.timings).withColumn("avg_ms", F.round("avg_ms", 6)).select("step", "count", "avg_ms", "p95_ms", "max_ms")


@query("agg_timing_gate", REPORT + """ SELECT step, round(avg_ms, 6) AS avg_ms, max_ms, avg_ms > a AS avg_exceeded, max_ms > m AS max_exceeded
FROM report JOIN (VALUES ('view_ms', 50.0, 1000.0), ('click_ms', 49.0, 100.0), ('total_ms', 120.0, 900.0), ('error_ms', 500.0, 5000.0)) l(step, a, m) USING (step) WHERE avg_ms > a OR max_ms > m""")
def _(t):
    limits = t.values(
        [("view_ms", 50.0, 1000.0), ("click_ms", 49.0, 100.0), ("total_ms", 120.0, 900.0), ("error_ms", 500.0, 5000.0)],
        "step string, max_avg_ms double, max_ms_limit double",
    )
    return h.timing_gate(h.timing_report(t.timings), F.broadcast(limits)).withColumn("avg_ms", F.round("avg_ms", 6))


TIMEOUT_SQL = """
SELECT j.station_id, j.sequence_id, CASE WHEN r.reply_us IS NOT NULL THEN r.reply_us - j.published_us END AS wait_us,
  CASE WHEN r.reply_us IS NULL THEN 5 WHEN r.corrupt THEN 3 ELSE 0 END AS error_code, CASE WHEN r.reply_us IS NULL OR r.corrupt THEN 'RECHECK' ELSE 'RESULT' END AS outcome
FROM v_jobs j LEFT JOIN v_replies r ON r.station_id = j.station_id AND r.sequence_id = j.sequence_id AND r.reply_us BETWEEN j.published_us AND j.published_us + 5000000"""


@query("join_result_timeout", TIMEOUT_SQL)
def _(t):
    return decide.result_timeouts(t.jobs, t.replies, ["station_id", "sequence_id"])


CONTRACT_IN = """SELECT r.sequence_id, r.trigger_id, r.seat_id, CASE WHEN r.sequence_id % 97 = 3 THEN 'MAYBE' ELSE r.decision END AS decision, r.quality_pass, r.error_code, r.defect_count,
  j.sequence_id AS want_sequence_id, j.sequence_id + CASE WHEN j.sequence_id % 89 = 5 THEN 1 ELSE 1000 END AS want_trigger_id,
  CASE WHEN j.sequence_id % 83 = 9 THEN 'OTHER' ELSE r.seat_id END AS want_seat_id, r.defect_count + CASE WHEN r.sequence_id % 79 = 1 THEN 1 ELSE 0 END AS defect_rows
  FROM {v_results} r JOIN {v_jobs} j ON j.sequence_id = r.sequence_id"""


@query("chk_result_contract", f"""
WITH c AS ({CONTRACT_IN}), v AS (SELECT *, CASE WHEN trigger_id <> want_trigger_id THEN 'detector result trigger_id mismatch' WHEN seat_id <> want_seat_id THEN 'detector result seat_id mismatch'
  WHEN decision NOT IN ('OK','NG','RECHECK','ERROR') THEN 'detector result decision is invalid' WHEN defect_count <> defect_rows THEN 'detector result defect_count does not match payload'
  WHEN decision = 'OK' AND NOT quality_pass THEN 'detector result OK with quality_pass=false' WHEN decision = 'OK' AND error_code <> 0 THEN 'detector result OK with non-zero error_code'
  WHEN decision = 'OK' AND defect_count <> 0 THEN 'detector result OK with defects' WHEN decision = 'NG' AND NOT quality_pass THEN 'detector result NG with quality_pass=false'
  WHEN decision = 'NG' AND error_code <> 0 THEN 'detector result NG with non-zero error_code' WHEN decision = 'NG' AND defect_count = 0 THEN 'detector result NG without defects'
  WHEN decision = 'ERROR' AND error_code = 0 THEN 'detector result ERROR with empty error_code'
  WHEN decision = 'RECHECK' AND error_code = 0 AND NOT quality_pass THEN 'detector result RECHECK with quality_pass=false but no error_code' END AS violation FROM c)
SELECT sequence_id, coalesce(violation, '') AS violation, CASE WHEN violation IS NULL THEN decision ELSE 'RECHECK' END AS final_decision, CASE WHEN violation IS NULL THEN error_code ELSE 2 END AS final_error_code FROM v""")
def _(t):
    return decide.result_contract(t.select(CONTRACT_IN)).select(
        "sequence_id", F.coalesce("violation", F.lit("")).alias("violation"), "final_decision", "final_error_code"
    )
