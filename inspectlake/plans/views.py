"""Inspection tables derived from the given tables.

Each view is one SELECT shared by Spark and the check engine.  ``{name}`` is a
given table or another view.  Five spellings differ between the two dialects
and are written as macros: ``@US(ts)`` (epoch microseconds), ``@UNNEST(a, b)``
(one row per value), ``@CRC`` (CRC-32 of a text), ``@POS`` (an array turned into rows with positions) and
``@GREY(e)`` (the grey value of a vector's component, in the component's own single precision).
No view drops rows of its table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# One inspection result per event; a user is a station.
VIEWS["v_results"] = """
SELECT event_id AS sequence_id, event_id + 1000 AS trigger_id, user_id AS station_id, @US(ts) AS ts_us,
  concat('SN', cast(event_id % 1000 AS varchar(20))) AS seat_id,
  CASE event_type WHEN 'purchase' THEN 'NG' WHEN 'signup' THEN 'RECHECK' WHEN 'error' THEN 'ERROR' ELSE 'OK' END AS decision,
  CASE WHEN event_type = 'signup' THEN (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 7 END)
       WHEN event_type = 'error' THEN (CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 11 ELSE 9 END) ELSE 0 END AS error_code,
  CASE WHEN event_type = 'error' OR (event_type = 'signup' AND event_id % 3 <> 0) THEN false ELSE true END AS quality_pass,
  CASE WHEN event_type = 'purchase' THEN 1 + event_id % 3 ELSE 0 END AS defect_count, value AS elapsed_ms,
  CASE WHEN event_type = 'signup' THEN (CASE event_id % 4 WHEN 0 THEN 'Target NOT found in roi' WHEN 1 THEN '' WHEN 2 THEN '目标丢失 seat' ELSE 'blur' END)
       WHEN event_type = 'error' THEN (CASE event_id % 3 WHEN 0 THEN '' ELSE concat('fault ', props) END) ELSE '' END AS message,
  event_type = 'error' AND event_id % 5 = 0 AS asset_unavailable,
  event_type = 'signup' AND event_id % 7 = 0 AS sample_enabled,
  CASE event_id % 3 WHEN 0 THEN 'line-a' WHEN 1 THEN 'line-b' ELSE 'line-c' END AS recipe_id,
  CASE WHEN event_id % 2 = 0 THEN 'SKU1' ELSE 'SKU2' END AS sku
  FROM {events}"""

# Up to three defects per NG result.
VIEWS["v_defects"] = """
SELECT d.sequence_id, d.station_id, d.ts_us, cast(d.i AS int) AS pos, concat(cast(d.sequence_id AS varchar(20)), '-', cast(d.i AS varchar(4))) AS defect_id,
  CASE WHEN (d.sequence_id + d.i) % 3 = 0 THEN 'scratch' WHEN (d.sequence_id + d.i) % 3 = 1 THEN '' ELSE 'stain' END AS class_name,
  CASE WHEN (d.sequence_id + d.i) % 4 = 0 THEN '' ELSE 'seat' END AS roi_name,
  CASE WHEN (d.sequence_id + d.i) % 2 = 0 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS camera_id,
  CASE WHEN (d.sequence_id + d.i) % 5 = 0 THEN 'P2' WHEN (d.sequence_id + d.i) % 2 = 0 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS pose_id,
  ((d.sequence_id * 7 + d.i * 13) % 100) / 100.0e0 AS score
  FROM (SELECT *, @UNNEST(0, 1, 2) AS i FROM {v_results}) d WHERE d.i < d.defect_count"""

# Controller log: the same events as station messages.
VIEWS["v_controller"] = """
SELECT event_id AS sequence_id, event_id + 1000 AS trigger_id, user_id AS station_id, @US(ts) AS ts_us,
  concat('SN', cast(event_id % 1000 AS varchar(20))) AS seat_id,
  CASE event_type WHEN 'purchase' THEN 'inspection_complete' WHEN 'signup' THEN 'inspection_recheck' WHEN 'error' THEN 'trigger_wait_failed'
    WHEN 'click' THEN 'signal_result_publish_failed' ELSE 'station_ready' END AS event,
  CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'view' THEN 'ng' WHEN 'click' THEN '' ELSE 'RECHECK' END AS decision,
  CASE WHEN event_type = 'error' THEN 8 ELSE 0 END AS error_code,
  CASE WHEN event_type = 'error' THEN 'DeviceFault' ELSE 'None' END AS error,
  CASE WHEN event_type = 'error' THEN 'Fault' ELSE 'Ready' END AS station_state,
  CASE WHEN event_type = 'error' THEN 'Critical' ELSE 'None' END AS alarm_level,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('m', cast(event_id % 50 AS varchar(10))) END AS message
  FROM {events}"""

# Published jobs and how long each reply took.
VIEWS["v_jobs"] = """
SELECT event_id AS sequence_id, user_id AS station_id, @US(ts) AS published_us FROM {events}"""
VIEWS["v_replies"] = """
SELECT event_id AS sequence_id, user_id AS station_id, @US(ts) + cast(floor(value * 20) AS bigint) * 1000 AS reply_us,
  event_type = 'error' AND event_id % 10 = 0 AS corrupt FROM {events}"""

# Distance sensor readings.
VIEWS["v_readings"] = """
SELECT user_id AS sensor_id, event_id, @US(ts) AS ts_us, cast(200 + (cast(floor(value) AS int) % 120) AS int) AS distance_mm FROM {events}"""

# One timing row per job and step.
VIEWS["v_timings"] = """
SELECT event_id AS sequence_id, concat(event_type, '_ms') AS step, value AS ms FROM {events}
UNION ALL SELECT event_id AS sequence_id, 'total_ms' AS step, value * 2 AS ms FROM {events}"""

# Good samples form the bank; every sample is scored against it.
VIEWS["v_bank"] = "SELECT vec_id, embedding FROM {embeddings} WHERE label < 8"
VIEWS["v_queries"] = "SELECT vec_id, embedding, label FROM {embeddings}"

# Six frames a job: two cameras, three lights; a few frames carry a stray light.
VIEWS["v_frames"] = """
SELECT vec_id AS frame_id, cast(floor(vec_id / 6) AS bigint) AS sequence_id,
  CASE WHEN vec_id % 6 < 3 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS camera_id,
  CASE WHEN vec_id % 12 < 3 OR vec_id % 30 = 7 THEN '' WHEN vec_id % 18 = 4 THEN 'P2' WHEN vec_id % 18 = 10 THEN 'P3' WHEN vec_id % 6 < 3 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS pose_id,
  CASE WHEN vec_id % 23 = 5 THEN 'BAR_LEFT' WHEN vec_id % 3 = 0 THEN 'DIFFUSE' WHEN vec_id % 3 = 1 THEN 'POLAR_DIFFUSE' ELSE 'HIGH_LEFT' END AS light_id,
  cast(CASE WHEN vec_id % 37 = 8 THEN 0 ELSE vec_id % 3 END AS int) AS light_seq_index, cast(vec_id % 31 AS int) AS frame_index,
  8 AS width, 8 AS height, CASE WHEN vec_id % 41 = 3 THEN 4 ELSE 8 END AS stride_bytes, CASE WHEN vec_id % 53 = 9 THEN 3 ELSE 1 END AS channels,
  CASE WHEN vec_id % 29 = 7 THEN 'MONO12' ELSE 'MONO8' END AS pixel_format, 'MONO' AS color_order,
  CASE WHEN vec_id % 43 = 11 THEN 'UINT16' ELSE 'UINT8' END AS dtype, 8 AS bit_depth,
  1000000 + vec_id * 100 - (CASE WHEN vec_id % 17 = 1 THEN 500 ELSE 0 END) AS timestamp_us,
  800 + label * 30 AS exposure_us, 1.0e0 + label * 0.05e0 AS gain,
  CASE WHEN vec_id % 19 = 4 THEN 0 ELSE cast(floor(vec_id / 6) AS bigint) + 1 END AS shot_id,
  CASE WHEN vec_id % 47 = 10 THEN 0 ELSE 5000 + cast(floor(vec_id / 3) AS bigint) END AS robot_timestamp_us,
  100.0e0 + (CASE WHEN vec_id % 21 = 5 THEN 2.0e0 ELSE 0.0e0 END) AS robot_x, 0.0e0 AS robot_rx,
  CASE WHEN vec_id % 61 = 5 THEN 'SKU9' ELSE 'SKU1' END AS sku, label, concat('r', cast(cast(floor(vec_id / 6) AS bigint) % 2 AS varchar(4))) AS recipe_id,
  CASE WHEN vec_id % 59 = 13 THEN 'cal_old' ELSE 'cal1' END AS calibration_id
  FROM {embeddings}"""

# Frame pixels: a 64-value vector read as an 8 x 8 grey image.
VIEWS["v_pixels"] = """
SELECT vec_id AS frame_id, cast(pos % 8 AS int) AS x, cast(floor(pos / 8) AS int) AS y, cast(@GREY(e) AS int) AS v
  FROM @POS(vec_id, embedding, {embeddings})"""

# Frames of jobs that mostly pass the gate: two views, three lights; recipes k0 to k5 differ in registration, poses,
# regions, models and channels.
VIEWS["v_inspect_frames"] = """
SELECT frame_id, sequence_id, recipe_id, camera_id, CASE WHEN camera_id = 'CAM_B' AND recipe_id = 'k2' THEN 'P2' WHEN frame_id % 12 < 3 THEN '' ELSE camera_id END AS pose_id,
  CASE WHEN frame_id % 97 = 5 THEN 'BAR_LEFT' WHEN frame_id % 3 = 0 THEN 'DIFFUSE' WHEN frame_id % 3 = 1 THEN 'POLAR_DIFFUSE' ELSE 'HIGH_LEFT' END AS light_id,
  cast(frame_id % 3 AS int) AS light_seq_index, cast(frame_id % 31 AS int) AS frame_index, 8 AS width, 8 AS height, 8 AS stride_bytes, 1 AS channels,
  CASE WHEN frame_id % 89 = 7 THEN 'MONO12' ELSE 'MONO8' END AS pixel_format, 'MONO' AS color_order, 'UINT8' AS dtype, 8 AS bit_depth,
  1000000 + frame_id * 100 - (CASE WHEN frame_id % 83 = 1 THEN 500 ELSE 0 END) AS timestamp_us, 800 + label * 10 AS exposure_us, 1.0e0 + label * 0.01e0 AS gain,
  CASE WHEN frame_id % 101 = 10 THEN 0 ELSE sequence_id + 1 END AS shot_id, 5000 + sequence_id AS robot_timestamp_us, 100.0e0 + (CASE WHEN frame_id % 79 = 5 THEN 2.0e0 ELSE 0.0e0 END) AS robot_x, 0.0e0 AS robot_rx,
  CASE WHEN sequence_id % 29 = 3 THEN 'SKU9' ELSE 'SKU1' END AS sku, CASE WHEN sequence_id % 17 = 4 THEN 'cal_old' ELSE 'cal1' END AS calibration_id, label
  FROM (SELECT vec_id AS frame_id, cast(floor(vec_id / 6) AS bigint) AS sequence_id, CASE WHEN vec_id % 6 < 3 THEN 'CAM_A' ELSE 'CAM_B' END AS camera_id, label,
    CASE WHEN floor(vec_id / 6) % 7 = 6 THEN 'k3' WHEN floor(vec_id / 6) % 11 = 5 THEN 'k4' WHEN floor(vec_id / 6) % 13 = 7 THEN 'k5' WHEN floor(vec_id / 6) % 3 = 0 THEN 'k0' WHEN floor(vec_id / 6) % 3 = 1 THEN 'k1' ELSE 'k2' END AS recipe_id FROM {embeddings}) e"""
# Bank vectors of the inspection models.
VIEWS["v_inspect_bank"] = """
SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'm_a' ELSE 'm_net' END AS model_key, array(0.5e0 + embedding[0] / 8, 0.1e0 + embedding[1] / 16, 0.2e0 + embedding[2] / 8, 0.12e0 + embedding[3] / 16) AS embedding
  FROM {embeddings} WHERE label < 6
UNION ALL SELECT vec_id + 1000000000, 'm_b', array(0.5e0 + embedding[4] / 8, 0.1e0 + embedding[5] / 16, 0.3e0 + embedding[6] / 8, 0.12e0 + embedding[7] / 16) FROM {embeddings} WHERE label >= 4"""

# Defect candidates from order lines; sixteen orders make one job.
VIEWS["v_candidates"] = """
SELECT cast(floor(l_orderkey / 16) AS bigint) AS sequence_id, CASE WHEN l_linenumber % 2 = 0 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS camera_id,
  CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'P1' END AS pose_id, 'seat' AS roi_name,
  cast(l_partkey % 60 AS int) AS x0, cast(l_suppkey % 40 AS int) AS y0,
  cast(l_partkey % 60 + 10 + cast(l_quantity AS int) % 20 AS int) AS x1, cast(l_suppkey % 40 + 8 + l_linenumber AS int) AS y1,
  round(l_discount * 10, 2) AS score,
  CASE cast(l_quantity AS int) % 3 WHEN 0 THEN 'DIFFUSE' WHEN 1 THEN 'HIGH_LEFT' ELSE 'HIGH_RIGHT' END AS light_id,
  CASE WHEN l_tax > 0.04 THEN 0.3e0 END AS recheck_score, CASE WHEN l_tax > 0.06 THEN 0.9e0 END AS ng_score, l_orderkey AS ordinal
  FROM {lineitem}"""

# Returned lines are the true defects.
VIEWS["v_truth"] = """
SELECT cast(floor(l_orderkey / 16) AS bigint) AS sequence_id, CASE WHEN l_linenumber % 2 = 0 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS camera_id, 'seat' AS roi_name,
  cast(l_partkey % 60 AS int) AS x0, cast(l_suppkey % 40 AS int) AS y0,
  cast(l_partkey % 60 + 12 AS int) AS x1, cast(l_suppkey % 40 + 10 AS int) AS y1, l_orderkey AS ordinal
  FROM {lineitem} WHERE l_returnflag = 'R'"""

VIEWS["v_captures"] = """
SELECT concat(camera_id, '_', cast(timestamp_us AS varchar(20)), '_L', cast(light_seq_index + 1 AS varchar(4)),
  CASE WHEN frame_id % 7 = 0 THEN '_original.PNG' WHEN frame_id % 11 = 3 THEN '.png' ELSE '_original.png' END) AS file_name FROM {v_frames}"""

VIEWS["v_manifest"] = """
SELECT concat('s', cast(sequence_id AS varchar(20)), '_', light_id) AS sample_id, concat('trace/', cast(sequence_id AS varchar(20))) AS source_trace_dir,
  concat('r', cast(sequence_id % 3 AS varchar(4))) AS recipe_id, concat('SN', cast(sequence_id AS varchar(20))) AS seat_id, sequence_id,
  CASE WHEN label = 9 THEN 'NG' ELSE 'OK' END AS decision, label <> 8 AS quality_pass, camera_id, CASE WHEN pose_id = '' THEN camera_id ELSE pose_id END AS pose_id,
  'seat' AS roi_name, light_id, concat('img/', cast(frame_id AS varchar(20)), '.png') AS image_path,
  CASE WHEN sequence_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN label < 3 THEN 'verified' ELSE 'unlabeled' END AS label_status,
  label = 9 AS has_defect, cast(8 + label % 3 AS int) AS image_w, cast(6 + label % 2 AS int) AS image_h, frame_id
  FROM {v_frames}"""

# Files of a trace tree.
VIEWS["v_files"] = """
SELECT concat('trace/', CASE WHEN doc_id % 9 = 0 THEN 'tmp' ELSE concat('202401', lpad(cast(1 + doc_id % 28 AS varchar(4)), 2, '0')) END, '/', source, '_', cast(doc_id AS varchar(20)), '.json') AS path,
  doc_id % 97 AS mtime, n_chars AS bytes, source, doc_id, lang FROM {documents}"""

# Two display images per result, some of them unreadable.
VIEWS["v_images"] = """
SELECT sequence_id, station_id, camera_id, CASE WHEN sequence_id % 5 = 0 THEN 'P2' ELSE camera_id END AS pose_id,
  CASE WHEN (sequence_id + i) % 4 = 0 THEN 'overlay' ELSE 'raw_image' END AS kind,
  CASE (sequence_id + i) % 3 WHEN 0 THEN 'HIGH_LEFT' WHEN 1 THEN 'DIFFUSE' ELSE 'OTHER' END AS light_id,
  concat('img/', cast(sequence_id AS varchar(20)), '_', cast(i AS varchar(4)), '.png') AS path, (sequence_id + i) % 6 = 0 AS failed
  FROM (SELECT sequence_id, station_id, i, CASE WHEN i = 1 THEN 'TOP_CUSHION' ELSE 'TOP_BACK' END AS camera_id FROM (SELECT sequence_id, station_id, @UNNEST(0, 1, 2) AS i FROM {v_results}) r) c"""

# Operator actions on seats.
VIEWS["v_actions"] = """
SELECT event_id AS action_id, user_id AS station_id, cast(event_id % 1000 AS bigint) AS review_id, @US(ts) AS ts_us, @US(ts) AS acted_us,
  CASE event_type WHEN 'click' THEN 'mark_review' WHEN 'view' THEN 'review_confirm_defect' WHEN 'signup' THEN 'review_dismiss_as_ok'
    WHEN 'purchase' THEN 'confirm_defect' ELSE 'false_alarm' END AS action FROM {events}"""

# Serials typed in by operators, and results whose seat ids wrap the serial in three ways.
VIEWS["v_requests"] = """
SELECT o_orderkey AS request_id, o_custkey % 50 AS station_id, concat('SN', cast(o_orderkey % 40 AS varchar(20))) AS serial,
  @US(o_orderdate) + o_orderkey AS requested_us FROM {orders}"""
VIEWS["v_seats"] = """
SELECT o_orderkey AS sequence_id, o_custkey % 50 AS station_id,
  CASE o_orderkey % 3 WHEN 0 THEN concat('SN', cast((o_orderkey * 7) % 40 AS varchar(20))) WHEN 1 THEN concat('LINE_SN', cast((o_orderkey * 7) % 40 AS varchar(20)))
    ELSE concat('SN', cast((o_orderkey * 7) % 40 AS varchar(20)), '_', lpad(cast(o_orderkey AS varchar(20)), 12, '0')) END AS seat_id,
  @US(o_orderdate) + o_orderkey * 3 AS ts_us, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'NG' ELSE 'x' END AS decision FROM {orders}"""

# Two recipes: one with camera defaults only, one with an explicit extra pose.
VIEWS["v_recipe"] = """
SELECT * FROM (VALUES ('r0', 'SKU1', 'DIFFUSE', 'POLAR_DIFFUSE'), ('r1', 'SKU1', 'POLAR_DIFFUSE', 'DIFFUSE')) AS t(recipe_id, recipe_sku, base_light_id, fallback_light_id)"""
VIEWS["v_recipe_views"] = """
SELECT * FROM (VALUES ('r0', 'TOP_BACK', 'TOP_BACK', 'm_back', 'net', 'DIFFUSE'), ('r0', 'TOP_CUSHION', 'TOP_CUSHION', 'm_cushion', '', 'HIGH_LEFT'),
  ('r1', 'TOP_BACK', 'TOP_BACK', 'm_back', '', 'DIFFUSE'), ('r1', 'TOP_CUSHION', 'TOP_CUSHION', 'm_cushion', 'net', 'DIFFUSE'), ('r1', 'TOP_CUSHION', 'P2', 'm_pose', '', 'POLAR_DIFFUSE'))
  AS t(recipe_id, camera_id, pose_id, model_key, safety_net_key, view_base_light)"""
VIEWS["v_recipe_lights"] = """
SELECT * FROM (VALUES ('r0', 0, 'DIFFUSE', true), ('r0', 1, 'POLAR_DIFFUSE', true), ('r0', 2, 'HIGH_LEFT', true), ('r0', 3, 'HIGH_RIGHT', false),
  ('r1', 0, 'DIFFUSE', true), ('r1', 1, 'POLAR_DIFFUSE', true), ('r1', 2, 'HIGH_LEFT', true), ('r1', 3, 'HIGH_RIGHT', false)) AS t(recipe_id, pos, light_id, required)"""

# Regions per camera; one reaches outside the image.
VIEWS["v_rois"] = """
SELECT * FROM (VALUES ('TOP_BACK', 'seat', 0, 1, 1, 6, 5), ('TOP_BACK', 'edge', 1, 0, 4, 7, 7), ('TOP_CUSHION', 'seat', 0, 2, 0, 7, 6), ('TOP_CUSHION', 'wide', 2, 0, 0, 9, 3))
  AS t(camera_id, roi_name, class_id, rx0, ry0, rx1, ry1)"""
# Region detections: normalised boxes, some outside the frame or of an unknown class.
VIEWS["v_roi_detections"] = """
SELECT vec_id AS det_id, cast(floor(vec_id / 5) AS bigint) AS frame_key, CASE WHEN floor(vec_id / 5) % 2 = 0 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS camera_id, label % 3 AS class_id,
  0.3e0 + label * 0.07e0 AS confidence, (vec_id % 11) / 50.0e0 AS bx0, (vec_id % 7) / 40.0e0 AS by0, (vec_id % 11) / 50.0e0 + 0.5e0 + (vec_id % 13) / 30.0e0 AS bx1, (vec_id % 7) / 40.0e0 + 0.6e0 AS by1 FROM {embeddings}"""
# Detector rows: eight numbers per detection.
VIEWS["v_raw"] = "SELECT vec_id AS det_id, embedding, label FROM {embeddings}"

# Event log lines as the stations write them: some broken, blank or of another schema.
VIEWS["v_event_lines"] = """
SELECT sequence_id AS line_no, station_id, CASE WHEN sequence_id % 50 = 3 THEN '{"schema":"x.display_event.v1","sequence_id":' WHEN sequence_id % 50 = 4 THEN '  ' WHEN sequence_id % 50 = 6 THEN '[1,2]'
  ELSE concat('{"schema":"', CASE WHEN sequence_id % 50 = 5 THEN 'x.other.v1' ELSE 'x.display_event.v1' END, '","sequence_id":', CASE WHEN sequence_id % 9 = 0 THEN concat('"', cast(sequence_id AS varchar(20)), '"') ELSE cast(sequence_id AS varchar(20)) END,
    CASE WHEN sequence_id % 11 = 2 THEN '' WHEN sequence_id % 11 = 3 THEN ',"decision":""' ELSE concat(',"decision":"', decision, '"') END, ',"error_code":', cast(error_code AS varchar(4)),
    CASE WHEN sequence_id % 13 = 1 THEN '' ELSE concat(',"defect_count":', cast(defect_count AS varchar(4))) END, ',"quality_pass":', CASE WHEN quality_pass THEN 'true' ELSE 'false' END,
    CASE WHEN sequence_id % 17 = 3 THEN ',"source":""' WHEN sequence_id % 17 = 4 THEN ',"source":"rig2"' ELSE '' END, ',"timestamp_ms":', cast(cast(floor(ts_us / 1000) AS bigint) AS varchar(20)),
    ',"defects":[', CASE WHEN decision = 'NG' THEN concat('{"defect_id":"d', cast(sequence_id AS varchar(20)), '","camera_id":"TOP_BACK","score":0.5},7,{"defect_id":"e","camera_id":"TOP_CUSHION","pose_id":"P2","class_name":"stain"}') ELSE '' END, ']',
    ',"error":', CASE WHEN asset_unavailable THEN '{"asset":{"kind":"bank"}}' WHEN decision = 'ERROR' AND sequence_id % 5 = 1 THEN '{"asset_unavailable":true}' WHEN decision = 'ERROR' THEN '{"asset":{}}' ELSE '{}' END,
    CASE WHEN sample_enabled THEN ',"sample_collection":{"enabled":true}' ELSE '' END, '}') END AS value, sequence_id, trigger_id, seat_id, decision, error_code, ts_us FROM {v_results}"""
VIEWS["v_controller_lines"] = """
SELECT sequence_id AS line_no, CASE WHEN sequence_id % 40 = 3 THEN '{"event":' ELSE concat('{"timestamp_us":', cast(ts_us AS varchar(20)), ',"event":"', event, '","sequence_id":', cast(sequence_id AS varchar(20)),
  CASE WHEN decision = '' THEN '' ELSE concat(',"decision":"', decision, '"') END, ',"error_code":', cast(error_code AS varchar(4)), ',"message":"', message, '"}') END AS value, event, decision, error_code, message, ts_us, sequence_id FROM {v_controller}"""
# One journal per station; a few journals hold a broken line.
VIEWS["v_journal_lines"] = """
SELECT event_id AS line_no, user_id AS station_id, event_type, CASE WHEN event_id % 397 = 5 THEN '{"record_type":' WHEN event_type = 'click' THEN concat('{"record_type":"operator_action","record":{"id":', cast(event_id AS varchar(20)), '}}')
  WHEN event_type = 'view' THEN '{"record_type":"log","record":5}' ELSE concat('{"record_type":"log","record":{"id":', cast(event_id AS varchar(20)), ',"status":"', upper(event_type), '","confidence":', cast(event_id % 7 AS varchar(4)), '}}') END AS value FROM {events}"""
VIEWS["v_review_files"] = """
SELECT event_id AS file_id, CASE event_id % 3 WHEN 0 THEN concat('[{"id":', cast(event_id AS varchar(20)), ',"review_status":"pending"},3,{"id":', cast(event_id + 1 AS varchar(20)), ',"status":"NG"}]') WHEN 1 THEN concat('{"id":', cast(event_id AS varchar(20)), '}') ELSE '[{"id":' END AS value FROM {events}"""
# Manifest lines over the frames, with a few rows that must be refused.
VIEWS["v_manifest_lines"] = """
SELECT frame_id AS line_no, concat('{"sample_id":"', CASE WHEN frame_id % 37 = 1 THEN '' ELSE sample_id END, '","camera_id":"', camera_id, '","roi_name":"seat","light_id":"', light_id, '"', CASE WHEN frame_id % 41 = 2 THEN '' ELSE concat(',"image_path":"', image_path, '"') END,
  CASE WHEN frame_id % 2 = 0 THEN concat(',"pose_id":"', pose_id, '"') ELSE '' END, CASE WHEN frame_id % 3 = 0 THEN concat(',"split":"', split, '"') ELSE '' END, CASE WHEN frame_id % 5 = 0 THEN ',"has_defect":false' ELSE '' END,
  CASE frame_id % 6 WHEN 0 THEN ',"ground_truth":[{"bbox_xyxy_pixel":[1,2,3,4],"severity":"critical"},{"bbox_xyxy_pixel":[5,5,9,9]}]' WHEN 1 THEN ',"ground_truth_bbox":[[2,2,4,4]],"bbox_xyxy_pixel":[[0,0,1,1]]' WHEN 2 THEN ',"bbox_xyxy_pixel":[[0,0,1,1],[3,3,3,3]]'
    WHEN 3 THEN CASE WHEN frame_id % 4 = 1 THEN ',"bbox_xyxy_pixel":[[4,0,1,1]]' ELSE ',"ground_truth":[]' END WHEN 4 THEN CASE WHEN frame_id % 5 = 1 THEN ',"ground_truth":[{"bbox_xyxy_pixel":[1,2,3]}]' ELSE '' END ELSE '' END, '}') AS value,
  frame_id, sample_id, camera_id, pose_id, light_id, image_path, split FROM {v_manifest}"""
# Files of result directories.
VIEWS["v_trace_files"] = """
SELECT concat('trace/', cast(sequence_id AS varchar(20)), '/result.json') AS path, concat('{"sequence_id":', cast(sequence_id AS varchar(20)), CASE WHEN sequence_id % 3 = 0 THEN '' ELSE concat(',"seat_id":"', seat_id, '"') END, CASE WHEN sequence_id % 19 = 4 THEN '' ELSE concat(',"decision":"', decision, '"') END, '}') AS value FROM {v_results} WHERE error_code <> 9
UNION ALL SELECT concat('trace/', cast(sequence_id AS varchar(20)), '/job.json'), concat('{"seat_id":"J', seat_id, '","recipe_id":"rj"}') FROM {v_results} WHERE decision <> 'NG'
UNION ALL SELECT concat('trace/', cast(sequence_id AS varchar(20)), '/recipe_summary.json'), '{"recipe_id":"rs"}' FROM {v_results} WHERE decision = 'OK'"""
VIEWS["v_image_paths"] = """
SELECT frame_id, CASE frame_id % 7 WHEN 0 THEN concat(camera_id, '/seat/', light_id, '.png') WHEN 1 THEN concat(camera_id, '/P2/seat/', light_id, '.PNG') WHEN 2 THEN concat(camera_id, '_', light_id, '.png') WHEN 3 THEN concat(camera_id, '_P_7_', light_id, '.png')
  WHEN 4 THEN concat('CAM9_x_', light_id, '.png') WHEN 5 THEN concat(camera_id, '_', light_id, '.json') ELSE concat('EYE_IN_HAND_', light_id, '.png') END AS path, concat(CASE frame_id % 4 WHEN 0 THEN 'OTHER' ELSE camera_id END, CASE frame_id % 3 WHEN 0 THEN '_P_1' ELSE '' END, '_seat.png') AS overlay FROM {v_frames}"""

# Frame records of a payload: byte ranges, stated and true checksums.
VIEWS["v_payload"] = """
SELECT sequence_id, frame_id, cast(frame_id % 6 AS int) AS frame_pos, camera_id, pose_id, light_id, stride_bytes, height, pixel_format,
  100 + (frame_id % 6) * 64 - (CASE WHEN frame_id % 67 = 9 THEN 10 ELSE 0 END) AS image_offset, CASE WHEN frame_id % 71 = 20 THEN 20 ELSE 64 END AS image_size,
  concat('img', cast(frame_id AS varchar(20))) AS image_text, @CRC(concat('img', cast(frame_id AS varchar(20)))) + (CASE WHEN frame_id % 73 = 30 THEN 1 ELSE 0 END) AS image_crc32
  FROM {v_frames}"""

_SPARK = {"POS": "(SELECT {0}, posexplode({1}) AS (pos, e) FROM {2})"}
_DUCK = {"POS": "(SELECT {0}, unnest(range(len({1}))) AS pos, unnest({1}) AS e FROM {2})"}


# Spark divides, and adds decimals, in double precision; the value is defined with a single one after every step.
_GREY = r"floor(cast(cast((\1 + cast(0.6 AS float)) / cast(1.2 AS float) AS float) * cast(255 AS float) AS float))"
_DUCK_GREY = r"floor((\1 + 0.6) / 1.2 * 255)"

_CRC = r"@CRC\((concat\('\w+', cast\(\w+ AS varchar\(20\)\)\))\)"

# The check engine has no CRC-32: bit by bit over the characters of an ASCII text.
_DUCK_CRC = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::bigint), "
    "lambda c, b: list_reduce(range(8), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint)"
)


def spark_text(sql: str) -> str:
    sql = re.sub(r"@US\((\w+)\)", r"unix_micros(cast(\1 AS timestamp))", sql)
    sql = re.sub(_CRC, r"crc32(cast(\1 AS binary))", sql)
    sql = re.sub(r"@GREY\((\w+)\)", _GREY, sql)
    sql = re.sub(r"@UNNEST\(([^)]*)\)", r"explode(array(\1))", sql)
    return re.sub(r"@POS\((\w+), (\w+), (\{\w+\})\)", lambda m: _SPARK["POS"].format(*m.groups()), sql)


def duck_text(sql: str) -> str:
    sql = re.sub(r"\barray\(([^)]*)\)", lambda m: "[" + re.sub(r"embedding\[(\d+)\]", lambda k: f"embedding[{int(k.group(1)) + 1}]::double", m.group(1)) + "]", sql)
    sql = re.sub(r"@US\((\w+)\)", r"epoch_us(\1)", sql)
    sql = re.sub(_CRC, lambda m: _DUCK_CRC.format(m.group(1)), sql)
    sql = re.sub(r"@GREY\((\w+)\)", _DUCK_GREY, sql)
    sql = re.sub(r"@UNNEST\(([^)]*)\)", r"unnest([\1])", sql)
    sql = re.sub(r"@POS\((\w+), (\w+), (\{\w+\})\)", lambda m: _DUCK["POS"].format(*m.groups()), sql)
    return re.sub(r"\{([a-z]\w*)\}", r"\1", sql)


def _views_of(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in seen:
            _views_of(VIEWS[name], seen)
            seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Check SQL with the views it names written in front as common tables."""
    names = _views_of(sql, [])
    sql = duck_text(sql).strip()
    if not names:
        return sql
    parts = [f"{n} AS ({duck_text(VIEWS[n]).strip()})" for n in names]
    recursive = "RECURSIVE " if re.match(r"(?i)WITH\s+RECURSIVE\b", sql) else ""
    body = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", sql)
    return f"WITH {recursive}" + ",\n".join(parts) + ("\n" + body if body is sql else ",\n" + body)


class Tables:
    """Given tables and derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        # Naive timestamps are UTC wall time everywhere.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder, self._cache = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BASE_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif f"v_{name}" in VIEWS:
                self._cache[name] = self.select(VIEWS[f"v_{name}"])
            else:
                raise AttributeError(name)
        return self._cache[name]

    def select(self, sql: str) -> DataFrame:
        """SELECT over given tables and views, named as ``{table}`` or ``{v_view}``."""
        names = set(re.findall(r"\{([a-z]\w*)\}", sql))
        # Braces of JSON texts are doubled, so that only table names are filled in.
        plain = re.sub(r"\{[a-z]\w*\}|[{}]", lambda m: m.group() * (2 if len(m.group()) == 1 else 1), spark_text(sql))
        return self.spark.sql(plain, **{n: getattr(self, n.removeprefix("v_")) for n in names})

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small dimension as a local relation, whose size the planner knows."""
        fields = to_arrow_schema(self.spark.createDataFrame([], schema).schema)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)]
        return self.spark.createDataFrame(pa.table(columns, schema=fields))
