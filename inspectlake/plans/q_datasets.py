"""Queries on sources, training sets, recipes, assets and payload integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectlake.operators import datasets as ds, payloads as pl, recipes as rc
from inspectlake.plans.registry import query
from inspectlake.sources import json_lines as js, paths

J = "json_extract_string"


def lines(t, view, keep):
    return getattr(t, view).select(*keep, "value")


@query("src_detection_events", """
SELECT sequence_id, CASE WHEN sequence_id % 11 IN (2, 3) THEN 'RECHECK' ELSE decision END AS decision, error_code, cast(floor(ts_us / 1000) AS bigint) AS timestamp_ms, CASE WHEN sequence_id % 17 = 4 THEN 'rig2' ELSE 'python_detector' END AS source,
  CASE WHEN sequence_id % 13 = 1 THEN CASE WHEN decision = 'NG' THEN 2 ELSE 0 END ELSE CASE WHEN decision = 'NG' THEN 1 + sequence_id % 3 ELSE 0 END END AS defect_count, CASE WHEN decision = 'NG' THEN 'd' || sequence_id || ':TOP_BACK:0.5|e:P2:0.0' ELSE '' END AS defects
FROM v_event_lines WHERE sequence_id % 50 NOT IN (3, 4, 5, 6)""")
def _(t):
    e = js.parse_detection_events(lines(t, "event_lines", []))
    shown = F.transform("defects", lambda d: F.concat_ws(":", d["defect_id"], d["pose_id"], d["score"].cast("string")))
    return e.select("sequence_id", "decision", "error_code", "timestamp_ms", "source", "defect_count", F.array_join(shown, "|").alias("defects"))


@query("prj_asset_unavailable", """
SELECT l.sequence_id, r.asset_unavailable OR (r.decision = 'ERROR' AND l.sequence_id % 5 = 1) AS asset_unavailable, r.asset_unavailable OR (r.decision = 'ERROR' AND l.sequence_id % 5 = 1) OR r.sample_enabled AS sample_collection
FROM v_event_lines l JOIN v_results r USING (sequence_id) WHERE l.sequence_id % 50 NOT IN (3, 4, 5, 6)""")
def _(t):
    return js.parse_detection_events(lines(t, "event_lines", [])).select("sequence_id", "asset_unavailable", "sample_collection")


@query("src_controller_events", """
SELECT sequence_id, event, CASE WHEN decision = '' THEN 'RECHECK' ELSE decision END AS decision, error_code, ts_us AS timestamp_us, message FROM v_controller_lines WHERE sequence_id % 40 <> 3""")
def _(t):
    e = js.parse_controller_events(lines(t, "controller_lines", []))
    return e.select("sequence_id", "event", "decision", "error_code", "timestamp_us", "message")


@query("src_operator_log", """
SELECT station_id, line_no, line_no AS id, upper(event_type) AS status, (line_no % 7)::double AS confidence FROM v_journal_lines j WHERE event_type NOT IN ('click','view') AND station_id NOT IN (SELECT station_id FROM v_journal_lines WHERE line_no % 397 = 5)
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY line_no DESC) <= 20""")
def _(t):
    log = js.parse_operator_log(lines(t, "journal_lines", ["station_id", "line_no"]), ["station_id"], "line_no", 20)
    return log.select("station_id", "line_no", "id", "status", "confidence")


@query("src_reviews", """
SELECT file_id, file_id AS id, '' AS status, 'pending' AS review_status FROM v_review_files WHERE file_id % 3 = 0 UNION ALL SELECT file_id, file_id + 1, 'NG', '' FROM v_review_files WHERE file_id % 3 = 0""")
def _(t):
    r = js.parse_reviews(lines(t, "review_files", ["file_id"]))
    return r.select("file_id", "id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("review_status", F.lit("")).alias("review_status"))


MANIFEST_SQL = """WITH m AS (SELECT *, CASE WHEN frame_id % 37 = 1 THEN 'missing sample_id' WHEN frame_id % 41 = 2 THEN 'missing image_path' WHEN frame_id % 6 = 3 AND frame_id % 4 = 1 THEN 'bad bbox_xyxy_pixel' WHEN frame_id % 6 = 4 AND frame_id % 5 = 1 THEN 'bad ground truth' END AS issue,
  CASE frame_id % 6 WHEN 0 THEN '1,2,3,4/critical|5,5,9,9/' WHEN 1 THEN '2,2,4,4/' WHEN 2 THEN '0,0,1,1/|3,3,3,3/' ELSE '' END AS truth FROM v_manifest_lines)"""


def manifest(t):
    return js.parse_manifest(lines(t, "manifest_lines", ["line_no"]))


@query("src_manifest", MANIFEST_SQL + """ SELECT line_no, coalesce(issue, '') AS issue, camera_id, CASE WHEN frame_id % 2 = 0 THEN pose_id ELSE camera_id END AS pose_id, CASE WHEN frame_id % 3 = 0 THEN split ELSE 'unassigned' END AS split, 'unlabeled' AS label_status,
  CASE WHEN frame_id % 5 = 0 THEN false ELSE frame_id % 6 IN (0, 1, 2) OR (frame_id % 6 = 3 AND frame_id % 4 = 1) OR (frame_id % 6 = 4 AND frame_id % 5 = 1) END AS has_defect FROM m""")
def _(t):
    return manifest(t).select("line_no", F.coalesce("issue", F.lit("")).alias("issue"), "camera_id", "pose_id", "split", "label_status", "has_defect")


@query("src_manifest_ground_truth", MANIFEST_SQL + " SELECT line_no, coalesce(issue, '') AS issue, CASE WHEN issue IS NULL THEN truth ELSE '' END AS truth FROM m")
def _(t):
    rows = manifest(t)
    shown = F.array_join(F.transform("ground_truth", lambda g: F.concat(F.array_join(g["bbox"].cast("array<string>"), ","), F.lit("/"), g["severity"])), "|")
    return rows.select("line_no", F.coalesce("issue", F.lit("")).alias("issue"), F.when(F.col("issue").isNull(), shown).otherwise("").alias("truth"))


@query("src_result_traces", """
SELECT 'trace/' || sequence_id AS trace_dir, sequence_id, CASE WHEN sequence_id % 3 <> 0 THEN seat_id WHEN decision <> 'NG' THEN 'J' || seat_id ELSE '' END AS seat_id, CASE WHEN sequence_id % 19 = 4 THEN '' ELSE decision END AS decision,
  CASE WHEN decision = 'OK' THEN 'rs' WHEN decision <> 'NG' THEN 'rj' ELSE '' END AS recipe_id, CASE WHEN sequence_id % 19 = 4 THEN 'missing decision' ELSE '' END AS issue FROM v_results WHERE error_code <> 9""")
def _(t):
    return js.result_traces(t.trace_files).select("trace_dir", "sequence_id", "seat_id", "decision", "recipe_id", F.coalesce("issue", F.lit("")).alias("issue"))


@query("src_trace_images", """
WITH p AS (SELECT *, string_split(path, '/') AS s FROM v_image_paths WHERE lower(path) LIKE '%.png'), f AS (SELECT *, len(s) AS n, regexp_replace(s[-1], '\\.[^.]*$', '') AS stem FROM p),
l AS (SELECT *, CASE WHEN n > 1 THEN stem WHEN stem LIKE '%POLAR_DIFFUSE' THEN 'POLAR_DIFFUSE' WHEN stem LIKE '%HIGH_LEFT' THEN 'HIGH_LEFT' WHEN stem LIKE '%DIFFUSE' THEN 'DIFFUSE' END AS light_id FROM f),
c AS (SELECT *, rtrim(substr(stem, 1, length(stem) - length(light_id)), '_') AS prefix FROM l WHERE light_id IS NOT NULL),
k AS (SELECT *, CASE WHEN n > 1 THEN s[1] WHEN starts_with(prefix, 'TOP_CUSHION') THEN 'TOP_CUSHION' WHEN starts_with(prefix, 'EYE_IN_HAND') THEN 'EYE_IN_HAND' WHEN starts_with(prefix, 'TOP_BACK') THEN 'TOP_BACK' ELSE prefix END AS camera_id FROM c)
SELECT frame_id, camera_id, CASE WHEN n = 3 THEN s[1] WHEN n = 4 THEN s[2] WHEN ltrim(substr(prefix, length(camera_id) + 1), '_') = '' THEN camera_id ELSE ltrim(substr(prefix, length(camera_id) + 1), '_') END AS pose_id, 'seat' AS roi_name, light_id FROM k""")
def _(t):
    return paths.trace_images(t.image_paths).select("frame_id", "camera_id", "pose_id", "roi_name", "light_id")


@query("src_overlay_images", """
WITH s AS (SELECT frame_id, overlay[:-5] AS stem FROM v_image_paths), c AS (SELECT *, CASE WHEN starts_with(stem, 'TOP_CUSHION_') THEN 'TOP_CUSHION' WHEN starts_with(stem, 'TOP_BACK_') THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS camera_id FROM s),
x AS (SELECT *, ltrim(substr(stem, length(camera_id) + 1), '_') AS suffix FROM c)
SELECT frame_id, camera_id, CASE WHEN contains(suffix, '_') THEN regexp_extract(suffix, '^(.*)_[^_]*$', 1) ELSE camera_id END AS pose_id, CASE WHEN contains(suffix, '_') THEN regexp_extract(suffix, '([^_]*)$', 1) ELSE suffix END AS roi_name FROM x""")
def _(t):
    return paths.overlay_images(t.image_paths, "overlay").select("frame_id", "camera_id", "pose_id", "roi_name")


CAPTURES = """cp AS (SELECT file_name, regexp_extract(file_name, '^(.+)_([0-9]+)_(L[0-9]+)_', 1) AS camera_id, cast(regexp_extract(file_name, '^(.+)_([0-9]+)_(L[0-9]+)_', 2) AS bigint) AS timestamp_us, regexp_extract(file_name, '^(.+)_([0-9]+)_(L[0-9]+)_', 3) AS capture_light
  FROM v_captures WHERE regexp_matches(lower(file_name), '^.+_[0-9]+_l[0-9]+_.+\\.png$'))"""


def captures(t):
    return paths.capture_files(t.captures, t.recipe_lights.where("recipe_id = 'r0'").select("pos", "light_id"))


@query("src_capture_files", f"WITH {CAPTURES} SELECT file_name, camera_id, timestamp_us, light_id FROM cp JOIN v_recipe_lights l ON l.recipe_id = 'r0' AND capture_light = 'L' || (pos + 1)")
def _(t):
    return captures(t).select("file_name", "camera_id", "timestamp_us", "light_id")


SESSIONS = f"""WITH {CAPTURES}, o AS (SELECT *, sum(CASE WHEN capture_light = 'L1' THEN 1 ELSE 0 END) OVER w AS g, row_number() OVER w AS n FROM cp WINDOW w AS (PARTITION BY camera_id ORDER BY timestamp_us, capture_light, file_name)),
q AS (SELECT *, g + max(CASE WHEN n = 1 AND capture_light <> 'L1' THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id) AS sample_index FROM o),
ss AS (SELECT camera_id, sample_index, count(*) AS files, count(*) > count(DISTINCT capture_light) AS has_duplicate_light, count(DISTINCT capture_light) AS lights FROM q GROUP BY ALL)"""


def sessions(t):
    return ds.capture_sessions(captures(t), ["L1", "L2", "L3"], ["camera_id"], ["timestamp_us", "capture_light", "file_name"])


@query("win_capture_sessions", SESSIONS + " SELECT camera_id, sample_index, files, has_duplicate_light, NOT has_duplicate_light AND lights = 3 AS complete FROM ss")
def _(t):
    return sessions(t).drop("lights")


@query("join_common_samples", SESSIONS + " SELECT sample_index FROM ss WHERE NOT has_duplicate_light AND lights = 3 GROUP BY 1 HAVING count(DISTINCT camera_id) = 2")
def _(t):
    return ds.common_samples(sessions(t), ["TOP_BACK", "TOP_CUSHION"])


ZIP_VIEW = "SELECT concat('C', cast(station_id AS varchar(20))) AS camera_id, concat('L', cast(1 + CASE WHEN station_id % 3 = 0 THEN 0 ELSE pos % 2 END AS varchar(4))) AS capture_light, ts_us AS timestamp_us, sequence_id, pos FROM {v_defects}"


@query("win_capture_zip", """
WITH c AS (SELECT 'C' || station_id AS camera_id, 'L' || (1 + CASE WHEN station_id % 3 = 0 THEN 0 ELSE pos % 2 END) AS capture_light, ts_us AS timestamp_us, sequence_id, pos FROM v_defects),
k AS (SELECT camera_id, count(DISTINCT capture_light) AS l, count_if(capture_light = 'L1') AS a, count_if(capture_light = 'L2') AS b FROM c GROUP BY 1)
SELECT camera_id, capture_light, sequence_id, pos, row_number() OVER (PARTITION BY camera_id, capture_light ORDER BY timestamp_us, sequence_id, pos) AS sequence_index, '' AS issue FROM c WHERE camera_id IN (SELECT camera_id FROM k WHERE l = 2 AND a = b)
UNION ALL SELECT camera_id, '', 0, 0, 0, CASE WHEN l < 2 THEN 'missing light' ELSE 'unequal counts' END FROM k WHERE NOT (l = 2 AND a = b)""")
def _(t):
    groups, bad = ds.capture_zip(t.select(ZIP_VIEW), ["L1", "L2"], ["timestamp_us", "sequence_id", "pos"])
    good = groups.select("camera_id", "capture_light", "sequence_id", "pos", "sequence_index", F.lit("").alias("issue"))
    zero = lambda n, k: F.lit(0).cast(k).alias(n)
    return good.unionByName(bad.select("camera_id", F.lit("").alias("capture_light"), zero("sequence_id", "long"), zero("pos", "int"), zero("sequence_index", "long"), "issue"))


# --- manifests ---------------------------------------------------------------------------------


@query("flt_training_ok", "SELECT sample_id, camera_id FROM v_manifest WHERE decision = 'OK' AND quality_pass AND split = 'train'")
def _(t):
    return ds.training_ok(t.manifest, "train").select("sample_id", "camera_id")


@query("flt_decision", "SELECT sample_id, camera_id FROM v_manifest WHERE decision = 'NG'")
def _(t):
    return ds.with_decision(t.manifest, "NG").select("sample_id", "camera_id")


BASE = "CASE WHEN sample_id LIKE '%\\_' || light_id ESCAPE '\\' THEN substr(sample_id, 1, length(sample_id) - length(light_id) - 1) ELSE sample_id END AS group_sample_id"


@query("agg_sample_groups", f"""
SELECT group_sample_id, camera_id, pose_id, string_agg(light_id, '|' ORDER BY light_id) AS lights, count(*) AS rows, arg_min(decision, light_id || image_path) AS decision, arg_min(label_status, light_id || image_path) AS label_status FROM (SELECT *, {BASE} FROM v_manifest) GROUP BY group_sample_id, source_trace_dir, camera_id, pose_id, roi_name""")
def _(t):
    g = ds.sample_groups(t.manifest)
    return g.select("group_sample_id", "camera_id", "pose_id", F.array_join("lights", "|").alias("lights"), "rows", "decision", "label_status")


@query("agg_group_consistency", f"""
SELECT group_sample_id, camera_id, pose_id, CASE WHEN count(*) > count(DISTINCT light_id) THEN 'duplicate light' WHEN count(DISTINCT decision) > 1 THEN 'decision differs' WHEN count(DISTINCT split) > 1 THEN 'split differs' ELSE 'label_status differs' END AS issue
FROM (SELECT *, {BASE} FROM v_manifest) GROUP BY group_sample_id, source_trace_dir, camera_id, pose_id, roi_name HAVING count(*) > count(DISTINCT light_id) OR count(DISTINCT decision) > 1 OR count(DISTINCT split) > 1 OR count(DISTINCT label_status) > 1""")
def _(t):
    return ds.group_conflicts(t.manifest).select("group_sample_id", "camera_id", "pose_id", "issue")


@query("agg_group_truth", """
WITH d AS (SELECT sequence_id, camera_id, x0 // 8 AS x, y0 // 8 AS y, min(ordinal) AS o FROM v_truth GROUP BY ALL) SELECT sequence_id, camera_id, x, y, row_number() OVER (PARTITION BY sequence_id, camera_id ORDER BY o, x, y) AS truth_no FROM d""")
def _(t):
    rows = t.truth.select("sequence_id", "camera_id", F.expr("cast(x0 div 8 AS int)").alias("x"), F.expr("cast(y0 div 8 AS int)").alias("y"), "ordinal")
    return ds.group_truth(rows, ["sequence_id", "camera_id"], ["ordinal"], ["x", "y"])


@query("join_defect_images", """
SELECT m.sample_id, m.camera_id, m.light_id, b.x0 IS NOT NULL AS has_defect, coalesce(b.x0, -1) AS x0, coalesce(b.y0, -1) AS y0, coalesce(b.x1, -1) AS x1, coalesce(b.y1, -1) AS y1 FROM v_manifest m LEFT JOIN v_truth b ON b.sequence_id = m.sequence_id AND b.camera_id = m.camera_id""")
def _(t):
    rows = ds.image_boxes(t.manifest.drop("has_defect"), t.truth, ["sequence_id", "camera_id"])
    return rows.select("sample_id", "camera_id", "light_id", "has_defect", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("agg_defect_images", """
SELECT m.sample_id, m.camera_id, m.light_id, coalesce(n, 0) AS defects, n IS NOT NULL AS has_defect FROM v_manifest m LEFT JOIN (SELECT sequence_id, camera_id, count(*) AS n FROM v_truth GROUP BY 1, 2) b ON b.sequence_id = m.sequence_id AND b.camera_id = m.camera_id""")
def _(t):
    return ds.defect_images(t.manifest.drop("has_defect"), t.truth, ["sequence_id", "camera_id"]).select("sample_id", "camera_id", "light_id", "defects", "has_defect")


SETS = "CASE {0} ELSE 'all' END AS section, CASE {1} ELSE '' END AS value"


def _section(by):
    return SETS.format(" ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by), " ".join(f"WHEN grouping({c}) = 0 THEN {c}" for c in by))


@query("agg_dataset_summary", f"SELECT {_section(['decision', 'camera_id', 'label_status'])}, count(*) AS samples, count(DISTINCT source_trace_dir) AS traces, count_if(has_defect) AS defect_samples FROM v_manifest GROUP BY GROUPING SETS ((), (decision), (camera_id), (label_status))")
def _(t):
    return ds.dataset_summary(t.manifest)


@query("agg_capture_summary", f"""SELECT {_section(['camera_id', 'light_id', 'roi_name', 'split', 'label_status'])}, count(*) AS samples, count(DISTINCT sequence_id || camera_id || pose_id || roi_name) AS groups FROM v_manifest GROUP BY GROUPING SETS ((), (camera_id), (light_id), (roi_name), (split), (label_status))
UNION ALL SELECT 'skipped', '', 0, count(*) FROM (SELECT DISTINCT sequence_id FROM v_frames WHERE light_id = 'BAR_LEFT')""")
def _(t):
    return ds.capture_summary(t.manifest, t.frames.where("light_id = 'BAR_LEFT'").select("sequence_id").distinct())


@query("agg_image_sizes", """
WITH s AS (SELECT camera_id, pose_id, roi_name, image_w, image_h, count(*) AS n FROM v_manifest GROUP BY ALL)
SELECT camera_id, pose_id, roi_name, sum(n) AS samples, min(image_w) AS width_min, max(image_w) AS width_max, round_even(sum(image_w * n) / sum(n), 2) AS width_avg, min(image_h) AS height_min, max(image_h) AS height_max, round_even(sum(image_h * n) / sum(n), 2) AS height_avg,
  string_agg(image_w || 'x' || image_h || ':' || n, '|' ORDER BY image_w, image_h) AS distinct_sizes FROM s GROUP BY 1, 2, 3""")
def _(t):
    return ds.image_sizes(t.manifest).withColumn("distinct_sizes", F.array_join("distinct_sizes", "|"))


@query("agg_input_shapes", """
SELECT 1 AS channels, image_h, image_w, count(*) AS samples, min(min(image_h)) OVER () AS height_min, max(max(image_h)) OVER () AS height_max, min(min(image_w)) OVER () AS width_min, max(max(image_w)) OVER () AS width_max, count(*) OVER () = 1 AS fixed_input_size FROM v_manifest GROUP BY 2, 3""")
def _(t):
    return ds.input_shapes(t.manifest.withColumn("channels", F.lit(1)))


@query("set_trace_dirs", "SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1) AS trace_dir FROM v_trace_files WHERE path LIKE '%/result.json'")
def _(t):
    return ds.trace_dirs([t.trace_files.where("path LIKE '%1/%'"), t.trace_files])


@query("set_lights_union", "SELECT ordinal, x0, y0, score, CASE WHEN light_id = 'DIFFUSE' THEN 'DIFFUSE|POLAR_DIFFUSE' ELSE light_id || '|DIFFUSE|POLAR_DIFFUSE' END AS lights FROM v_candidates")
def _(t):
    rows = t.candidates.withColumns({"a": F.array("light_id"), "b": F.array(F.lit("DIFFUSE"), F.lit("POLAR_DIFFUSE"))})
    return rows.select("ordinal", "x0", "y0", "score", F.array_join(ds.lights_union("a", "b"), "|").alias("lights"))


@query("join_raw_fallback", """
WITH r AS (SELECT DISTINCT sequence_id, camera_id, CASE sequence_id % 3 WHEN 0 THEN 'DIFFUSE' WHEN 1 THEN 'HIGH_LEFT' ELSE 'HIGH_RIGHT' END AS light_id FROM v_frames)
SELECT r.*, coalesce((SELECT min(frame_id) FROM v_frames f WHERE f.sequence_id = r.sequence_id AND f.camera_id = r.camera_id AND f.light_id = r.light_id), (SELECT min(frame_id) FROM v_frames f WHERE f.sequence_id = r.sequence_id AND f.camera_id = r.camera_id)) AS raw_frame_id,
  NOT EXISTS (SELECT 1 FROM v_frames f WHERE f.sequence_id = r.sequence_id AND f.camera_id = r.camera_id AND f.light_id = r.light_id) AS is_fallback FROM r""")
def _(t):
    light = F.when(F.col("sequence_id") % 3 == 0, "DIFFUSE").when(F.col("sequence_id") % 3 == 1, "HIGH_LEFT").otherwise("HIGH_RIGHT")
    regions = t.frames.select("sequence_id", "camera_id").distinct().withColumn("light_id", light)
    return ds.raw_fallback(regions, t.frames, ["sequence_id", "camera_id"])


@query("agg_content_hash", "SELECT doc_id AS path, sha256(text) AS sha256 FROM documents")
def _(t):
    return paths.content_hashes(t.documents.select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))


# --- payloads ----------------------------------------------------------------------------------

HEADERS = "SELECT sequence_id, cast(count(*) AS int) + CASE WHEN sequence_id % 29 = 3 THEN 1 ELSE 0 END AS frame_count, cast(count(DISTINCT concat(camera_id, '/', pose_id)) AS int) AS view_count, 484 AS payload_size, 100 AS region_start FROM {v_payload} GROUP BY sequence_id"


@query("chk_payload_integrity", f"""
WITH h AS ({HEADERS}), p AS (SELECT v_payload.*, payload_size, region_start, frame_count FROM v_payload JOIN h USING (sequence_id)),
c AS (SELECT *, CASE WHEN image_offset < region_start OR image_size < stride_bytes * height OR image_offset + image_size > payload_size THEN 2 WHEN @CRC(concat('img', cast(frame_id AS varchar(20)))) <> image_crc32 THEN 3 WHEN pixel_format NOT IN ('MONO8') THEN 2 ELSE 0 END AS code FROM p),
j AS (SELECT sequence_id, any_value(frame_count) AS fc, count(*) AS n, arg_min(code, frame_pos) FILTER (code <> 0) AS first FROM c GROUP BY 1),
o AS (SELECT DISTINCT a.sequence_id FROM p a JOIN p b ON a.sequence_id = b.sequence_id AND a.frame_pos < b.frame_pos AND a.image_offset < b.image_offset + b.image_size AND b.image_offset < a.image_offset + a.image_size)
SELECT sequence_id, CASE WHEN n <> fc THEN 2 WHEN first IS NOT NULL THEN first WHEN sequence_id IN (SELECT sequence_id FROM o) THEN 2 ELSE 0 END AS error_code FROM j""")
def _(t):
    frames = t.payload.withColumn("image", F.col("image_text").cast("binary"))
    return pl.payload_integrity(frames, t.select(HEADERS), ["sequence_id"], ["MONO8"])


@query("agg_overlap_ranges", """
SELECT DISTINCT b.sequence_id, b.frame_id FROM v_payload a JOIN v_payload b ON a.sequence_id = b.sequence_id AND a.frame_id <> b.frame_id AND (a.image_offset, a.image_offset + a.image_size, a.frame_id) < (b.image_offset, b.image_offset + b.image_size, b.frame_id) AND b.image_offset < a.image_offset + a.image_size""")
def _(t):
    rows = t.payload.withColumn("image_end", F.col("image_offset") + F.col("image_size"))
    return pl.overlapping_ranges(rows, ["sequence_id"], "image_offset", "image_end", "frame_id").select("sequence_id", "frame_id")


RECORDS = """SELECT sequence_id, defect_count, defect_count + CASE WHEN sequence_id % 91 = 2 THEN 1 ELSE 0 END AS meta_defect_count, 512 + 400 * defect_count + CASE WHEN sequence_id % 93 = 4 THEN 8 ELSE 0 END AS payload_size, seat_id, concat('img', seat_id) AS payload_text,
  @CRC(concat('img', cast(seat_id AS varchar(20)))) + CASE WHEN sequence_id % 95 = 6 THEN 1 ELSE 0 END AS payload_crc32, @CRC(concat('hdr', cast(seat_id AS varchar(20)))) + CASE WHEN sequence_id % 97 = 8 THEN 1 ELSE 0 END AS header_crc32 FROM {v_results}"""


@query("chk_result_payload", f"""
SELECT sequence_id, payload_crc32, CASE WHEN meta_defect_count <> defect_count OR payload_size <> 512 + 400 * defect_count THEN 2 WHEN sequence_id % 95 = 6 OR sequence_id % 97 = 8 THEN 3 ELSE 0 END AS error_code FROM ({RECORDS})""")
def _(t):
    rows = t.select(RECORDS).withColumns({"payload": F.col("payload_text").cast("binary"), "header": F.concat(F.lit("hdr"), "seat_id").cast("binary")})
    return rows.select("sequence_id", "payload_crc32", pl.result_payload_code(512, 400).alias("error_code"))


PLAN = [("r0", i, c, light, 8, 8, 1) for i, (c, light) in enumerate((c, light) for c in ("TOP_BACK", "TOP_CUSHION") for light in ("DIFFUSE", "POLAR_DIFFUSE", "HIGH_LEFT"))]
BUNDLE = "SELECT sequence_id, recipe_id, cast(frame_id % 6 AS int) AS position, camera_id, light_id, width, height, channels, 8 * channels - CASE WHEN frame_id % 57 = 3 THEN 4 ELSE 0 END AS stride_bytes, 64 * channels - CASE WHEN frame_id % 39 = 4 THEN 10 ELSE 0 END AS image_size FROM {v_frames}"


@query("join_bundle_expected", f"""
WITH p AS (SELECT * FROM (VALUES {', '.join(str(r) for r in PLAN)}) x(recipe_id, position, wc, wl, ww, wh, wch)), p2 AS (SELECT 'r0' AS recipe_id, position, wc, wl, ww, wh, wch FROM p UNION ALL SELECT 'r1', position, wc, wl, ww, wh, wch FROM p),
f AS ({BUNDLE}), x AS (SELECT f.*, CASE WHEN camera_id <> wc OR light_id <> wl THEN 'order' WHEN width <> ww OR height <> wh OR channels <> wch OR stride_bytes < width * channels THEN 'shape' WHEN image_size < stride_bytes * height THEN 'size' END AS i FROM f JOIN p2 USING (recipe_id, position)),
g AS (SELECT sequence_id, count(*) AS n, arg_min(i, position) FILTER (i IS NOT NULL) AS first FROM x GROUP BY 1)
SELECT sequence_id, CASE WHEN n <> 6 THEN 'frame count' ELSE coalesce(first, '') END AS issue, CASE WHEN n <> 6 THEN 6 WHEN first IS NOT NULL THEN 2 ELSE 0 END AS error_code FROM g""")
def _(t):
    plan = t.values(PLAN + [("r1", *r[1:]) for r in PLAN], "recipe_id string, position int, want_camera string, want_light string, want_width int, want_height int, want_channels int")
    return pl.bundle_against_plan(t.select(BUNDLE), plan, ["sequence_id"])


# --- recipes and assets ------------------------------------------------------------------------

# A supplier is a recipe, a part one of its views or models.
R_VIEWS = """SELECT cast(p_partkey % 100 AS varchar(10)) AS recipe_id, CASE p_size % 3 WHEN 0 THEN 'TOP_BACK' ELSE 'TOP_CUSHION' END AS camera_id, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'P2' ELSE concat('P', cast(p_partkey AS varchar(10))) END AS pose_id, p_size % 7 <> 3 AS enabled,
  CASE WHEN p_size % 5 = 0 THEN 'm_own' END AS model_key, CASE p_size % 6 WHEN 0 THEN 'DIFFUSE' WHEN 1 THEN 'BAR' END AS base_light_id, CASE WHEN p_size % 8 = 2 THEN 'net' ELSE '' END AS safety_net_key, p_partkey FROM {part}"""
R_DEFAULTS = "SELECT cast(s_suppkey % 100 AS varchar(10)) AS recipe_id, max(concat('m', cast(s_nationkey % 3 AS varchar(4)))) AS model_key, max(CASE WHEN s_nationkey % 2 = 0 THEN 'HIGH_LEFT' ELSE 'DIFFUSE' END) AS base_light_id FROM {supplier} GROUP BY 1"
DIMS = f"""rv AS ({R_VIEWS}), rd AS ({R_DEFAULTS}), dv AS (SELECT p_partkey, recipe_id, camera_id, CASE WHEN pose_id = '' THEN camera_id ELSE pose_id END AS pose_id, coalesce(rv.model_key, rd.model_key) AS model_key, coalesce(rv.base_light_id, rd.base_light_id) AS base_light_id, safety_net_key FROM rv LEFT JOIN rd USING (recipe_id) WHERE enabled)"""


def recipe_views(t):
    return rc.inherit_defaults(t.select(R_VIEWS), t.select(R_DEFAULTS), ["model_key", "base_light_id"])


@query("src_recipe_dims", f"WITH {DIMS} SELECT p_partkey, recipe_id, camera_id, pose_id, model_key, base_light_id FROM dv")
def _(t):
    return recipe_views(t).select("p_partkey", "recipe_id", "camera_id", "pose_id", "model_key", "base_light_id")


R_LIGHTS = "SELECT cast(c_custkey % 100 AS varchar(10)) AS recipe_id, c_custkey AS pos, CASE c_nationkey % 9 WHEN 0 THEN 'DIFFUSE' WHEN 1 THEN 'HIGH_LEFT' ELSE concat('L', cast(c_custkey AS varchar(10))) END AS light_id, c_nationkey % 4 = 0 AS required, c_nationkey % 10 <> 7 AS in_order FROM {customer}"
R_MODELS = "SELECT cast(s_suppkey % 100 AS varchar(10)) AS recipe_id, CASE s_nationkey % 4 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' WHEN 2 THEN 'net' ELSE 'm_own' END AS model_key, max(CASE WHEN s_nationkey % 5 = 1 THEN 'safety_net' ELSE 'primary' END) AS role, 'patchcore_knn' AS backend, max(CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'bank' END) AS memory_bank_path, min(CASE WHEN s_nationkey % 6 = 0 THEN 'none' ELSE 'onnx' END) AS embedding_backend, max(s_suppkey) AS pos, max(CASE WHEN s_nationkey % 2 = 0 THEN 'patchcore' ELSE 'supervised' END) AS model_family FROM {supplier} GROUP BY 1, 2"


@query("chk_recipe_lights", f"""
WITH {DIMS}, li AS ({R_LIGHTS}), mo AS ({R_MODELS}), o AS (SELECT recipe_id, light_id, count(*) AS n, bool_or(required) AS required FROM li GROUP BY 1, 2), io AS (SELECT DISTINCT recipe_id, light_id FROM li WHERE in_order),
rf AS (SELECT DISTINCT recipe_id, model_key, 'primary' AS want FROM dv UNION SELECT recipe_id, safety_net_key, 'safety_net' FROM dv WHERE safety_net_key <> ''), lk AS (SELECT rf.*, mo.role FROM rf LEFT JOIN mo USING (recipe_id, model_key))
SELECT recipe_id, 'duplicate light' AS issue, light_id AS item FROM o WHERE n > 1 UNION ALL SELECT recipe_id, 'required light not in order', light_id FROM o WHERE required AND (recipe_id, light_id) NOT IN (SELECT (recipe_id, light_id) FROM io)
UNION ALL SELECT DISTINCT recipe_id, 'base light not in order', base_light_id FROM dv WHERE NOT EXISTS (SELECT 1 FROM io WHERE io.recipe_id = dv.recipe_id AND io.light_id = dv.base_light_id) UNION ALL SELECT DISTINCT recipe_id, 'base light not required', base_light_id FROM dv WHERE NOT EXISTS (SELECT 1 FROM o WHERE required AND o.recipe_id = dv.recipe_id AND o.light_id = dv.base_light_id)
UNION ALL SELECT recipe_id, 'duplicate view', camera_id || '/' || pose_id FROM dv GROUP BY recipe_id, camera_id, pose_id HAVING count(*) > 1 UNION ALL SELECT recipe_id, 'unknown model', model_key FROM lk WHERE role IS NULL UNION ALL SELECT recipe_id, 'wrong model role', model_key FROM lk WHERE role <> want
UNION ALL SELECT recipe_id, 'memory bank path missing', model_key FROM mo WHERE memory_bank_path = '' UNION ALL SELECT recipe_id, 'embedding backend missing', model_key FROM mo WHERE embedding_backend = 'none'""")
def _(t):
    return rc.recipe_issues(recipe_views(t), t.select(R_LIGHTS), t.select(R_MODELS))


@query("prj_default_model", f"""WITH mo AS ({R_MODELS}) SELECT recipe_id, arg_min(model_key, CASE WHEN embedding_backend <> 'none' THEN 0 ELSE 1000000 END + pos) AS model_key FROM mo WHERE embedding_backend <> 'none' OR model_family = 'patchcore' GROUP BY 1""")
def _(t):
    return rc.default_model(t.select(R_MODELS), ["recipe_id"])


@query("chk_thresholds", """SELECT * FROM (SELECT p_partkey, CASE WHEN r < 0 OR r > 1 THEN 'recheck_score out of range' WHEN g < 0 OR g > 1 THEN 'ng_score out of range' WHEN r > g THEN 'recheck_score above ng_score' END AS issue FROM (SELECT p_partkey, p_size / 48.0::double AS r, p_retailprice / 1600.0::double AS g FROM part)) WHERE issue IS NOT NULL""")
def _(t):
    rows = t.part.select("p_partkey", (F.col("p_size") / 48.0).alias("r"), (F.col("p_retailprice") / 1600.0).alias("g"))
    return rows.select("p_partkey", rc.threshold_issue("r", "g").alias("issue")).where("issue IS NOT NULL")


POLY = "CASE WHEN p_size % 11 = 0 THEN 2 ELSE 4 END"


@query("chk_roi_polygon", """
WITH p AS (SELECT p_partkey, p_size AS s, CASE WHEN p_size % 11 = 0 THEN 2 ELSE 4 END AS n, p_size % 3 AS a, p_size % 5 AS b FROM part), q AS (SELECT *, [(0, 0), (a, 0), (a, b), (0, b)][1:n] AS pts FROM p)
SELECT p_partkey, CASE WHEN n < 3 THEN 'fewer than 3 points' WHEN len(list_distinct(pts)) <> n THEN 'repeated point' WHEN a * b = 0 THEN 'no area' END AS issue FROM q WHERE n < 3 OR len(list_distinct(pts)) <> n OR a * b = 0""")
def _(t):
    a, b, zero = F.col("p_size") % 3, F.col("p_size") % 5, F.lit(0)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.slice(F.array(pt(zero, zero), pt(a, zero), pt(a, b), pt(zero, b)), F.lit(1), F.when(F.col("p_size") % 11 == 0, 2).otherwise(4))
    return t.part.withColumn("pts", points).select("p_partkey", rc.polygon_issue("pts").alias("issue")).where("issue IS NOT NULL")


@query("src_calibration_dims", """
WITH u AS (SELECT p_partkey AS view_id, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS camera_id, p_size AS calibration_id, p_size % 5 = 2 AS own FROM part),
k AS (SELECT DISTINCT p_size AS calibration_id, CASE WHEN p_size % 2 = 0 OR p_size % 7 = 0 THEN 'A' ELSE 'B' END AS cc, p_size % 13 = 1 AS bad FROM part WHERE p_size <> 40)
SELECT view_id, CASE WHEN cc IS NULL THEN 'calibration missing' WHEN cc <> camera_id THEN 'camera mismatch' WHEN bad THEN 'matrix needs 9 finite numbers' WHEN NOT own AND calibration_id % 17 = 3 THEN 'no region' ELSE '' END AS issue, CASE WHEN own THEN 'own' WHEN cc IS NULL OR calibration_id % 17 = 3 THEN '' ELSE 'seat' END AS roi_name FROM u LEFT JOIN k USING (calibration_id)""")
def _(t):
    views = t.part.select(F.col("p_partkey").alias("view_id"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("camera_id"), F.col("p_size").alias("calibration_id"))
    size = t.part.where("p_size <> 40").select(F.col("p_size").alias("calibration_id")).distinct()
    one = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    k = F.col("calibration_id")
    cals = size.select(k, F.when((k % 2 == 0) | (k % 7 == 0), "A").otherwise("B").alias("calibration_camera"), F.when(k % 13 == 1, F.slice(one, 1, 8)).otherwise(one).alias("matrix"))
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3))])
    own = size.where(k % 17 != 3).select(k, F.lit("seat").alias("roi_name"), pts.alias("points"))
    view_rois = t.part.where("p_size % 5 = 2").select(F.col("p_partkey").alias("view_id"), F.lit("own").alias("roi_name"), pts.alias("points"))
    rows = rc.calibration_dims(cals, own, view_rois, views)
    return rows.select("view_id", F.coalesce("issue", F.lit("")).alias("issue"), F.coalesce("roi_name", F.lit("")).alias("roi_name"))


ASSETS = """SELECT p_partkey AS model_key, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS pca_key, p_size AS bank_key, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS index_key, CASE WHEN p_size % 9 = 1 THEN 512 ELSE 1536 END AS embedding_dim,
  CASE WHEN p_size % 10 = 3 THEN 'v2' ELSE 'v1' END AS want_pca_version, 'a,b' AS input_channels, '8x8' AS spatial_shape FROM {part}"""
PCA_ROWS = "SELECT DISTINCT p_size AS pca_key, 1536 AS pca_input_dim, CASE WHEN p_size % 3 = 0 THEN 1536 ELSE 256 END AS pca_output_dim, 'v1' AS pca_version FROM {part} WHERE p_size <> 22"
BANK_ROWS = "SELECT DISTINCT p_size AS bank_key, CASE WHEN p_size % 3 = 0 THEN 1536 WHEN p_size % 8 = 5 THEN 128 ELSE 256 END AS bank_dim, 'v1' AS bank_pca_version, p_size * 100 - 100 AS bank_vectors, p_size % 12 <> 4 AS calibrated, CASE WHEN p_size % 14 = 6 THEN 'a' ELSE 'a,b' END AS bank_channels, CASE WHEN p_size % 15 = 7 THEN '4x4' ELSE '8x8' END AS bank_shape, concat('h', cast(p_size AS varchar(4))) AS bank_hash FROM {part} WHERE p_size <> 30"
INDEX_ROWS = "SELECT DISTINCT p_size AS index_key, CASE WHEN p_size % 3 = 0 THEN 1536 ELSE 256 END AS index_dim, p_size * 100 - 100 + CASE WHEN p_size % 16 = 9 THEN 1 ELSE 0 END AS index_vectors, concat('h', cast(CASE WHEN p_size % 18 = 10 THEN 0 ELSE p_size END AS varchar(4))) AS index_hash FROM {part} WHERE p_size <> 33"


@query("join_asset_consistency", f"""
WITH m AS ({ASSETS}), p AS ({PCA_ROWS}), b AS ({BANK_ROWS}), i AS ({INDEX_ROWS}), j AS (SELECT m.*, p.* EXCLUDE (pca_key), b.* EXCLUDE (bank_key), i.* EXCLUDE (index_key) FROM m LEFT JOIN p ON p.pca_key = m.pca_key LEFT JOIN b ON b.bank_key = m.bank_key LEFT JOIN i ON i.index_key = m.index_key)
SELECT model_key, 'error' AS severity, 'pca missing' AS issue FROM j WHERE pca_key IS NOT NULL AND pca_input_dim IS NULL UNION ALL SELECT model_key, 'error', 'pca input dimension' FROM j WHERE pca_input_dim <> embedding_dim UNION ALL SELECT model_key, 'error', 'pca version' FROM j WHERE pca_version <> want_pca_version
UNION ALL SELECT model_key, 'error', 'bank missing' FROM j WHERE bank_dim IS NULL UNION ALL SELECT model_key, 'error', 'bank dimension' FROM j WHERE bank_dim <> CASE WHEN pca_key IS NOT NULL THEN pca_output_dim ELSE embedding_dim END UNION ALL SELECT model_key, 'error', 'bank pca version' FROM j WHERE bank_pca_version <> want_pca_version
UNION ALL SELECT model_key, 'error', 'bank empty' FROM j WHERE bank_vectors <= 0 UNION ALL SELECT model_key, 'error', 'bank not calibrated' FROM j WHERE NOT calibrated UNION ALL SELECT model_key, 'error', 'input channels' FROM j WHERE bank_channels <> input_channels UNION ALL SELECT model_key, 'error', 'spatial shape' FROM j WHERE bank_shape <> spatial_shape
UNION ALL SELECT model_key, 'warning', 'index missing' FROM j WHERE index_key IS NOT NULL AND index_dim IS NULL UNION ALL SELECT model_key, 'error', 'index dimension' FROM j WHERE index_dim <> bank_dim UNION ALL SELECT model_key, 'error', 'index size' FROM j WHERE index_vectors <> bank_vectors UNION ALL SELECT model_key, 'warning', 'index built from other vectors' FROM j WHERE index_hash <> bank_hash""")
def _(t):
    return rc.asset_issues(t.select(ASSETS), t.select(PCA_ROWS), t.select(BANK_ROWS), t.select(INDEX_ROWS))
