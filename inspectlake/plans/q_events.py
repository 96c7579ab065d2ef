"""Queries on result and station events."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectlake.functions import text
from inspectlake.operators import events as ev
from inspectlake.plans.registry import query

JOB = ["station_id", "sequence_id"]
NORM = "CASE WHEN upper(decision) IN ('OK','NG','ERROR') THEN upper(decision) ELSE 'RECHECK' END"
SESSION_MS = 1704800000000
PHRASES = "[" + ", ".join(f"'{p.lower()}'" for p in ev.TARGET_MISSING_PHRASES) + "]"
MISSING = f"len(list_filter({PHRASES}, lambda p: contains(lower(message), p))) > 0"
CAM = "CASE WHEN pose_id <> '' AND pose_id <> camera_id THEN camera_id || '/' || pose_id ELSE camera_id END"
LABEL = "CASE WHEN class_name <> '' THEN class_name WHEN roi_name <> '' THEN roi_name ELSE defect_id END"
SAMPLING = "(asset_unavailable OR sample_enabled)"
STATUS_MESSAGE = f"""CASE WHEN {SAMPLING} THEN CASE WHEN message <> '' THEN message ELSE '{ev.TEXT_SAMPLING}' END
  WHEN message <> '' THEN message WHEN {NORM} = 'RECHECK' THEN '{ev.TEXT_RECHECK}' WHEN {NORM} = 'ERROR' THEN '{ev.TEXT_ERROR}' ELSE '' END"""
PRIMARY = f"""SELECT station_id, sequence_id, {LABEL} AS label, score, {CAM} AS camera FROM v_defects
  QUALIFY row_number() OVER (PARTITION BY station_id, sequence_id ORDER BY score DESC, pos) = 1"""


@query("flt_decision_norm", f"SELECT sequence_id, {NORM} AS status FROM v_controller")
def _(t):
    return t.controller.select("sequence_id", ev.normal_status("decision").alias("status"))


@query("flt_published_decision", "SELECT sequence_id, CASE WHEN decision = 'ERROR' THEN 'RECHECK' ELSE decision END AS published FROM v_results")
def _(t):
    return t.results.select("sequence_id", ev.published_decision("decision").alias("published"))


@query("flt_current_session", f"SELECT sequence_id, ts_us FROM v_results WHERE ts_us <= 0 OR ts_us >= ({SESSION_MS} - 2000) * 1000")
def _(t):
    return ev.current_session(t.results, "ts_us", SESSION_MS).select("sequence_id", "ts_us")


@query(
    "flt_controller_alerts",
    f"SELECT sequence_id, event, error_code FROM v_controller WHERE error_code <> 0 OR event IN {tuple(ev.ALERT_EVENTS)}",
)
def _(t):
    return ev.controller_alerts(t.controller).select("sequence_id", "event", "error_code")


@query("flt_target_missing", f"SELECT sequence_id, message FROM v_results WHERE {MISSING}")
def _(t):
    return t.results.where(ev.target_missing()).select("sequence_id", "message")


@query("prj_operation_mode", f"SELECT sequence_id, CASE WHEN {SAMPLING} THEN '{ev.MODE_SAMPLING}' WHEN {NORM} IN ('RECHECK','ERROR') THEN '{ev.MODE_RECHECK}' ELSE '{ev.MODE_ONLINE}' END AS mode FROM v_results")
def _(t):
    return t.results.select("sequence_id", ev.operation_mode(ev.normal_status("decision")).alias("mode"))


@query("prj_status_message", f"SELECT sequence_id, {STATUS_MESSAGE} AS status_message FROM v_results")
def _(t):
    return t.results.select("sequence_id", ev.status_message(ev.normal_status("decision")).alias("status_message"))


@query("win_primary_defect", PRIMARY)
def _(t):
    return ev.primary_defects(t.defects, JOB).select(*JOB, "best.label", "best.score", "best.camera")


@query("agg_decision_counts", f"""
SELECT station_id, count(*) AS total, count_if({NORM} = 'OK') AS ok, count_if({NORM} = 'NG') AS ng, count_if({NORM} = 'RECHECK') AS recheck,
  count_if({NORM} = 'ERROR') AS error, round_even(count_if({NORM} = 'OK') / greatest(count(*), 1) * 100.0, 2) AS ok_rate
FROM v_results GROUP BY station_id""")
def _(t):
    return ev.decision_counts(t.results, ["station_id"])


@query("agg_log_stats", """
SELECT count(*) AS total, count_if(s = 'OK') AS ok, count_if(s = 'NG') AS ng, count_if(s = 'RECHECK') AS recheck, count_if(s = 'ERROR') AS error,
  round_even(count_if(s = 'OK') / greatest(count(*), 1) * 100.0, 2) AS ok_rate
FROM (SELECT upper(decision) AS s FROM v_controller) WHERE s IN ('OK','NG','RECHECK','ERROR')""")
def _(t):
    return ev.log_stats(t.controller.withColumnRenamed("decision", "status"))


@query("agg_defect_distribution", f"""
SELECT p.label, count(*) AS ng_count FROM ({PRIMARY}) p JOIN v_results r ON r.station_id = p.station_id AND r.sequence_id = p.sequence_id
WHERE {NORM} = 'NG' AND p.label <> '' GROUP BY p.label""")
def _(t):
    return ev.defect_distribution(t.results, t.defects, JOB)


BY_CAMERA = f"""
WITH d AS (SELECT *, {CAM} AS camera, {LABEL} AS label FROM v_defects),
c AS (SELECT station_id, sequence_id, camera, count(*) AS n, max(score) AS score, arg_max(label, score * 100 - pos * 1e-3) AS label FROM d GROUP BY ALL),
e AS (SELECT station_id, sequence_id, sum(n) AS total, string_agg(camera || '(' || n || ')', ', ' ORDER BY camera) AS camera_summary FROM c GROUP BY ALL),
p AS ({PRIMARY}),
by_camera AS (
SELECT c.station_id, c.sequence_id, c.camera, c.n AS defect_count,
  CASE WHEN c.n > 1 THEN (CASE WHEN c.label <> '' THEN c.label ELSE 'NG' END) || ' x' || c.n ELSE c.label END AS defect_label, c.score AS confidence,
  CASE WHEN e.total <= 1 THEN p.label ELSE (CASE WHEN p.label <> '' THEN p.label ELSE 'NG' END) || ' / 共 ' || cast(e.total AS varchar) || ' 处' END AS defect_summary,
  e.camera_summary FROM c JOIN e USING (station_id, sequence_id) JOIN p USING (station_id, sequence_id))"""


@query("agg_defects_by_camera", BY_CAMERA + " SELECT * FROM by_camera")
def _(t):
    return ev.defects_by_camera(t.defects, JOB)


CAMERAS = ["TOP_BACK", "TOP_BACK/P2", "TOP_CUSHION", "TOP_CUSHION/P2"]


@query("prj_camera_status", BY_CAMERA + f""",
f AS (SELECT station_id, sequence_id, {CAM} AS camera, bool_and(failed) AS image_failed FROM v_images GROUP BY ALL),
x AS (SELECT r.station_id, r.sequence_id, k.camera, {NORM} AS status, message, {MISSING} AS missing FROM v_results r CROSS JOIN (SELECT unnest({CAMERAS}) AS camera) k)
SELECT x.station_id, x.sequence_id, x.camera,
  CASE WHEN status = 'NG' AND b.defect_label IS NOT NULL THEN 'ng' WHEN image_failed THEN 'warn' WHEN missing THEN 'warn' WHEN status = 'ERROR' THEN 'error'
    WHEN status = 'RECHECK' THEN 'warn' ELSE 'ok' END AS tile_status,
  CASE WHEN status = 'NG' AND b.defect_label IS NOT NULL THEN b.defect_label WHEN image_failed THEN '{ev.TEXT_IMAGE_FAILED}'
    WHEN missing THEN CASE WHEN message <> '' THEN message ELSE '{ev.TEXT_TARGET_MISSING}' END
    WHEN status IN ('ERROR','RECHECK') THEN CASE WHEN message <> '' THEN message ELSE status END ELSE '' END AS tile_label
FROM x LEFT JOIN f USING (station_id, sequence_id, camera) LEFT JOIN by_camera b USING (station_id, sequence_id, camera)""")
def _(t):
    return ev.camera_status(t.results, t.images, t.defects, CAMERAS, JOB)


@query("prj_event_message", """
SELECT sequence_id, CASE WHEN len(list_filter(q, lambda m: m <> '')) > 0 THEN array_to_string(list_filter(q, lambda m: m <> ''), '；')
  WHEN message <> '' THEN message WHEN etype <> '' THEN etype ELSE '' END AS event_message
FROM (SELECT sequence_id, message, CASE WHEN error_code <> 0 THEN decision ELSE '' END AS etype,
  CASE WHEN error_code = 7 THEN ['dark ' || seat_id, '', 'blur'] ELSE [] END AS q FROM v_results)""")
def _(t):
    rows = t.results.withColumn("etype", F.when(F.col("error_code") != 0, F.col("decision")).otherwise(F.lit(""))).withColumn(
        "q",
        F.when(F.col("error_code") == 7, F.array(F.concat(F.lit("dark "), "seat_id"), F.lit(""), F.lit("blur"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return rows.select("sequence_id", ev.event_message("q", "message", "etype").alias("event_message"))


@query("prj_quality_reasons", """
WITH f AS (SELECT sequence_id, frame_id, camera_id || '/' || light_id || ': ' || array_to_string(list_filter([CASE WHEN pixel_format <> 'MONO8' THEN 'format ' || pixel_format END,
    CASE WHEN dtype <> 'UINT8' THEN 'dtype ' || dtype END, CASE WHEN channels <> 1 THEN 'channels' END], lambda m: m IS NOT NULL), ', ') AS r,
    pixel_format <> 'MONO8' OR dtype <> 'UINT8' OR channels <> 1 AS bad FROM v_frames),
j AS (SELECT sequence_id, CASE WHEN bool_or(light_id = 'BAR_LEFT') THEN ['stray light'] ELSE [] END AS jm FROM v_frames GROUP BY 1),
l AS (SELECT sequence_id, list(r ORDER BY frame_id) AS fm FROM f WHERE bad GROUP BY 1)
SELECT sequence_id, array_to_string(list_concat(jm, coalesce(fm, []))[1:2], ' | ') AS reasons FROM j LEFT JOIN l USING (sequence_id)""")
def _(t):
    rule = lambda cond, msg: F.when(cond, msg)
    frames = t.frames.withColumn(
        "messages",
        F.array_compact(
            F.array(
                rule(F.col("pixel_format") != "MONO8", F.concat(F.lit("format "), "pixel_format")),
                rule(F.col("dtype") != "UINT8", F.concat(F.lit("dtype "), "dtype")),
                rule(F.col("channels") != 1, F.lit("channels")),
            )
        ),
    )
    stray = t.frames.where("light_id = 'BAR_LEFT'").groupBy("sequence_id").agg(F.lit("stray light").alias("message"), F.lit(0).cast("long").alias("frame_id"))
    reasons = ev.quality_reasons(stray, frames, ["sequence_id"], "frame_id", 2)
    every = t.frames.select("sequence_id").distinct().join(reasons, "sequence_id", "left")
    return every.select("sequence_id", F.coalesce(F.array_join("reasons", " | "), F.lit("")).alias("reasons"))


@query("prj_error_reason", """
SELECT sequence_id, array_to_string(list_filter([nullif(trim(CASE WHEN error_code <> 0 THEN decision || ' ' ELSE ' ' END), ''), nullif(trim(message), '')], lambda v: v IS NOT NULL), ': ') AS reason
FROM v_results""")
def _(t):
    rows = t.results.withColumn("etype", F.when(F.col("error_code") != 0, F.concat("decision", F.lit(" "))).otherwise(F.lit(" ")))
    return rows.select("sequence_id", ev.error_reason("etype", "message").alias("reason"))


@query("flt_log_status_camera", f"SELECT sequence_id, {CAM} AS camera FROM v_defects WHERE {CAM} = 'TOP_BACK/P2' AND class_name = 'scratch'")
def _(t):
    log = t.defects.select("sequence_id", ev.display_camera().alias("camera"), "class_name")
    return log.where((F.col("camera") == "TOP_BACK/P2") & (F.col("class_name") == "scratch")).drop("class_name")


@query("win_event_dedupe", """
SELECT sequence_id, trigger_id, seat_id, ts_us, decision FROM (SELECT * FROM v_results UNION ALL SELECT * FROM v_results WHERE decision = 'NG')
QUALIFY row_number() OVER (PARTITION BY station_id, sequence_id, trigger_id, seat_id, ts_us ORDER BY decision) = 1""")
def _(t):
    doubled = t.results.unionByName(t.results.where(F.col("decision") == "NG"))
    identity = ["station_id", "sequence_id", "trigger_id", "seat_id", "ts_us"]
    return ev.dedupe_events(doubled, identity, ["decision"]).select("sequence_id", "trigger_id", "seat_id", "ts_us", "decision")


@query("win_display_image", f"""
SELECT station_id, sequence_id, camera, kind, light_id, path FROM (SELECT *, {CAM} AS camera FROM v_images)
QUALIFY row_number() OVER (PARTITION BY station_id, sequence_id, camera ORDER BY CASE WHEN kind = 'raw_image' THEN 0 ELSE 1 END,
  CASE light_id WHEN 'DIFFUSE' THEN 0 WHEN 'POLAR_DIFFUSE' THEN 1 WHEN 'HIGH_LEFT' THEN 2 WHEN 'HIGH_RIGHT' THEN 3 ELSE 9 END, path) = 1""")
def _(t):
    return ev.display_image(t.images, JOB)


@query("win_tact_rate", """
SELECT recipe_id, sequence_id, count(*) OVER (PARTITION BY recipe_id ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS tact_rate FROM v_results""")
def _(t):
    return ev.tact_rate(t.results.select("recipe_id", "sequence_id", "ts_us"), ["recipe_id"], "ts_us", "sequence_id", 3600).drop("ts_us")


@query("lim_log_tail", "SELECT sequence_id, ts_us, decision FROM v_results ORDER BY ts_us DESC, sequence_id DESC LIMIT 500")
def _(t):
    return ev.log_tail(t.results.select("sequence_id", "ts_us", "decision"), [F.desc("ts_us"), F.desc("sequence_id")])


@query("set_log_union", f"""
SELECT r.station_id, r.sequence_id, ts_us, 'python_detector' AS source, coalesce(p.camera, '') AS camera_id, {NORM} AS status,
  CASE WHEN {MISSING} THEN message ELSE {STATUS_MESSAGE} END AS reason, coalesce(p.label, '') AS defect_type, coalesce(p.score, 0.0) AS confidence, trigger_id, seat_id, error_code
FROM v_results r LEFT JOIN ({PRIMARY}) p ON r.station_id = p.station_id AND r.sequence_id = p.sequence_id
UNION ALL
SELECT station_id, sequence_id, ts_us, 'cpp_controller', '', {NORM}, CASE WHEN message <> '' THEN message WHEN error <> '' THEN error ELSE event END, error, 0.0, trigger_id, seat_id, error_code
FROM v_controller WHERE error_code <> 0 OR event IN {tuple(ev.ALERT_EVENTS)}""")
def _(t):
    return ev.detection_log(t.results, t.defects, JOB).unionByName(ev.controller_log(t.controller, JOB))


@query("set_camera_union", f"SELECT DISTINCT camera FROM (SELECT {CAM} AS camera FROM v_images UNION ALL SELECT {CAM} FROM v_defects WHERE camera_id <> '')")
def _(t):
    return ev.camera_union(t.images, t.defects)


@query("set_failed_minus_ok", f"""
SELECT station_id, sequence_id, {CAM} AS camera FROM v_images WHERE failed EXCEPT SELECT station_id, sequence_id, {CAM} FROM v_images WHERE NOT failed""")
def _(t):
    return ev.failed_minus_ok(t.images, JOB)


@query("set_review_queue", """
WITH m AS (SELECT station_id, review_id, max(ts_us) AS marked_us FROM v_actions WHERE action = 'mark_review' GROUP BY ALL)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM v_actions a WHERE a.station_id = m.station_id AND a.review_id = m.review_id
  AND a.action IN ('review_confirm_defect','review_dismiss_as_ok') AND a.ts_us >= m.marked_us)""")
def _(t):
    return ev.review_queue(t.actions, ["station_id", "review_id"])


MANUAL_SQL = f"""
WITH s AS (SELECT *, CASE WHEN seat_id LIKE 'LINE\\_%' ESCAPE '\\' THEN substr(seat_id, 6) WHEN seat_id LIKE '%\\_%' ESCAPE '\\' THEN split_part(seat_id, '_', 1) ELSE seat_id END AS serial FROM v_seats),
j AS (SELECT q.request_id, q.station_id, q.serial, q.requested_us, s.sequence_id, {NORM} AS decision FROM v_requests q LEFT JOIN s
  ON s.station_id = q.station_id AND s.serial = q.serial AND s.ts_us >= q.requested_us AND s.ts_us < q.requested_us + 30 * 86400000000
  QUALIFY row_number() OVER (PARTITION BY q.request_id ORDER BY s.ts_us, s.sequence_id) = 1)
SELECT request_id, station_id, serial, requested_us, sequence_id AS result_sequence_id, CASE WHEN sequence_id IS NULL THEN 'TIMEOUT' ELSE decision END AS outcome FROM j"""


@query("join_manual_request", MANUAL_SQL)
def _(t):
    return ev.match_manual_requests(t.requests, t.seats, ["station_id"], timeout_s=30 * 86400)


@query("join_ng_ack", """
WITH a AS (SELECT station_id, sequence_id, ts_us FROM v_results WHERE decision = 'NG'),
j AS (SELECT a.*, x.action FROM a LEFT JOIN v_actions x ON x.station_id = a.station_id AND x.action IN ('confirm_defect','mark_review','false_alarm')
  AND x.acted_us >= a.ts_us + 1 AND x.acted_us < a.ts_us + 1 + 21600000000 QUALIFY row_number() OVER (PARTITION BY a.sequence_id ORDER BY x.acted_us, x.action_id) = 1)
SELECT station_id, sequence_id, coalesce(action, 'auto_confirm_defect') AS operator_action FROM j""")
def _(t):
    alerts = t.results.where(F.col("decision") == "NG").select("station_id", "sequence_id", (F.col("ts_us") + 1).alias("ts_us"))
    actions = t.actions.where(F.col("action").isin("confirm_defect", "mark_review", "false_alarm"))
    return ev.acknowledge_alerts(alerts, actions, ["station_id"], timeout_s=21600).drop("ts_us")


@query("chk_serial", """
SELECT c_custkey, serial, length(trim(serial)) <= 48 AND regexp_full_match(trim(serial), '[A-Za-z0-9._-]+') AS valid
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN ' ' || c_mktsegment || c_custkey || ' ' WHEN 2 THEN c_name || ' ' || c_name ELSE repeat('x', cast(c_custkey % 90 AS int)) END AS serial FROM customer)""")
def _(t):
    rows = t.select("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat(' ', c_mktsegment, c_custkey, ' ')
      WHEN 2 THEN concat(c_name, ' ', c_name) ELSE repeat('x', cast(c_custkey % 90 AS int)) END AS serial FROM {customer}""")
    return rows.select("c_custkey", "serial", ev.valid_serial("serial").alias("valid"))


@query("win_log_rotation_plan", """
SELECT source, path FROM v_files QUALIFY row_number() OVER (PARTITION BY source ORDER BY path DESC) > 5""")
def _(t):
    return ev.excess_logs(t.files.select("source", "path"), ["source"], "path")


@query("flt_retention_sample", """
SELECT sequence_id, decision FROM (SELECT *, sha256(recipe_id || '|' || sku || '|' || seat_id || '|' || sequence_id || '|' || trigger_id) AS h FROM v_results)
WHERE CASE decision WHEN 'OK' THEN ('0x' || substr(h, 1, 8))::bigint / 4294967296.0 + ('0x' || substr(h, 9, 8))::bigint / 18446744073709551616.0 < 0.2
  WHEN 'NG' THEN true ELSE true END""")
def _(t):
    from inspectlake.operators.decide import retained

    return retained(t.results, save_ok_ratio=0.2, save_ng=True, save_recheck=True).select("sequence_id", "decision")


@query("fn_names", """
SELECT sequence_id, decision_code, error_code, list_extract(['OK','NG','RECHECK','ERROR'], decision_code) AS decision_name,
  list_extract(['None','ProtocolMismatch','InvalidPayload','CrcMismatch','SlotUnavailable','DetectorTimeout','MissingFrame','QualityFailed','DeviceFault','InternalError','LightFault','CameraFault','TriggerSyncFault','ConfigurationError','Reserved14'], error_code + 1) AS error_name,
  list_extract([0, 2, 1, 3], decision_code) AS decision_rank,
  'MANUAL_' || strftime(make_timestamp(ts_us), '%Y%m%d%H%M%S') || lpad(cast(ts_us % 1000000 AS varchar), 6, '0') AS manual_serial,
  seat_id || '_' || strftime(make_timestamp(ts_us), '%H%M%S') || lpad(cast(ts_us % 1000000 AS varchar), 6, '0') AS trace_seat_id
FROM (SELECT *, CASE decision WHEN 'OK' THEN 1 WHEN 'NG' THEN 2 WHEN 'RECHECK' THEN 3 ELSE 4 END AS decision_code FROM v_results)""")
def _(t):
    r = t.results.withColumn("decision_code", text.decision_code("decision"))
    return r.select(
        "sequence_id", "decision_code", "error_code",
        text.decision_name("decision_code").alias("decision_name"), text.error_name("error_code").alias("error_name"),
        text.decision_rank("decision").alias("decision_rank"), text.manual_serial("ts_us").alias("manual_serial"),
        text.seat_id("seat_id", "ts_us").alias("trace_seat_id"),
    )


@query("fn_safe_names", """
SELECT doc_id, regexp_replace(path, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe_name, regexp_replace(lang || ' ' || path, '[^A-Za-z0-9_-]', '_', 'g') AS safe_path,
  regexp_replace(source || '.x', '[^\\p{L}\\p{N}_-]', '_', 'g') || '_' || substr(sha1(path), 1, 8) || '_' || doc_id || '_TOP_BACK_P1_seat_' || lang AS sample_id FROM v_files""")
def _(t):
    f = t.files.withColumns({"c": F.lit("TOP_BACK"), "p": F.lit("P1"), "r": F.lit("seat"), "n": F.concat("source", F.lit(".x"))})
    return f.select(
        "doc_id", text.safe_name("path").alias("safe_name"), text.safe_path_name(F.concat_ws(" ", "lang", "path")).alias("safe_path"),
        text.sample_id("n", "path", "doc_id", "c", "p", "r", "lang").alias("sample_id"),
    )


@query("fn_event_json", """
SELECT sequence_id, '{"sequence_id":' || sequence_id || ',"decision":"' || decision || '","seat_id":{"memoryview_bytes":' || length(seat_id) || '}}' AS event_json FROM v_results""")
def _(t):
    r = t.results.select("sequence_id", "decision", F.col("seat_id").cast("binary").alias("seat_id"))
    return r.select("sequence_id", text.event_json(["sequence_id", "decision", "seat_id"], ["seat_id"]).alias("event_json"))
