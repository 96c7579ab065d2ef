"""Queries of the image quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectlake.operators import quality as q
from inspectlake.plans.registry import query
from inspectlake.plans.views import spark_text

JOB = ["sequence_id"]
POSE = "CASE WHEN pose_id = '' THEN camera_id ELSE pose_id END"
BUNDLES = f"b AS (SELECT DISTINCT sequence_id, recipe_id, camera_id, {POSE} AS pose FROM v_frames), c AS (SELECT recipe_id, camera_id, {POSE} AS pose, model_key, safety_net_key, view_base_light FROM v_recipe_views)"
REQ = f"r AS (SELECT f.*, {POSE} AS pose, l.pos FROM v_frames f JOIN v_recipe_lights l ON l.recipe_id = f.recipe_id AND l.light_id = f.light_id AND l.required)"
META = "CASE WHEN pixel_format <> 'MONO8' THEN 'unsupported pixel_format: ' || pixel_format END, CASE WHEN color_order <> 'MONO' THEN 'unsupported color_order: ' || color_order END, CASE WHEN dtype <> 'UINT8' OR bit_depth <> 8 THEN 'unsupported dtype/bit depth: ' || dtype || '/' || bit_depth END, CASE WHEN channels <> 1 THEN 'expected mono channel count 1, got ' || channels END, CASE WHEN stride_bytes < width * channels THEN 'stride smaller than active row width: ' || stride_bytes || ' < ' || width * channels END"


@query("chk_frame_meta", f"SELECT frame_id, array_to_string(m, ' | ') AS messages FROM (SELECT frame_id, list_filter([{META}], lambda x: x IS NOT NULL) AS m FROM v_frames) WHERE len(m) > 0")
def _(t):
    rows = t.frames.select("frame_id", q.frame_meta_messages().alias("m")).where(F.size("m") > 0)
    return rows.select("frame_id", F.array_join("m", " | ").alias("messages"))


FILED = "SELECT *, CASE WHEN frame_id % 44 = 2 THEN 'TOP_X' ELSE camera_id END AS bundle_camera, CASE WHEN frame_id % 31 = 7 THEN 'HIGH_RIGHT' ELSE light_id END AS bundle_light FROM {v_frames}"


@query("chk_frame_identity", f"""
WITH f AS ({FILED}) SELECT DISTINCT sequence_id, 'sku mismatch: job=' || sku || ' recipe=' || recipe_sku AS message FROM f JOIN v_recipe USING (recipe_id) WHERE sku <> recipe_sku
UNION ALL SELECT sequence_id, bundle_camera || '/' || bundle_light || ': frame camera_id mismatch ' || camera_id FROM f WHERE camera_id <> bundle_camera
UNION ALL SELECT sequence_id, bundle_camera || '/' || bundle_light || ': frame light_id mismatch ' || light_id FROM f WHERE light_id <> bundle_light""")
def _(t):
    return q.identity_messages(t.select(FILED), t.recipe, JOB)


@query("chk_frame_supported", """
SELECT * FROM (SELECT frame_id, camera_id || '/' || light_id || ': ' || CASE WHEN pixel_format <> 'MONO8' THEN 'unsupported pixel_format ' || pixel_format WHEN dtype <> 'UINT8' THEN 'unsupported dtype ' || dtype
  WHEN channels <> 1 THEN 'expected mono image' WHEN stride_bytes < width * channels THEN 'stride smaller than row size' WHEN 64 - frame_id % 7 * (CASE WHEN frame_id % 33 = 6 THEN 1 ELSE 0 END) < stride_bytes * height THEN 'image shorter than stride' END AS issue FROM v_frames) WHERE issue IS NOT NULL""")
def _(t):
    size = F.lit(64) - F.col("frame_id") % 7 * F.when(F.col("frame_id") % 33 == 6, 1).otherwise(0)
    return t.frames.withColumn("bytes", size).select("frame_id", q.frame_supported("bytes").alias("issue")).where("issue IS NOT NULL")


@query("join_missing_views", f"""
WITH {BUNDLES}, j AS (SELECT DISTINCT sequence_id, recipe_id FROM b), need AS (SELECT sequence_id, c.camera_id, c.pose FROM j JOIN c USING (recipe_id))
SELECT sequence_id, camera_id, CASE WHEN pose = camera_id THEN camera_id || ': missing configured camera bundle' ELSE camera_id || '/' || pose || ': missing configured camera pose bundle' END AS message FROM need n
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sequence_id = n.sequence_id AND b.camera_id = n.camera_id AND (b.pose = n.pose OR n.pose = n.camera_id))""")
def _(t):
    return q.missing_views(t.frames, t.recipe_views, JOB)


CONFIG = f"""WITH {BUNDLES}, k AS (SELECT b.*, e.model_key IS NOT NULL OR ((b.pose = b.camera_id OR NOT p.posed) AND d.model_key IS NOT NULL) AS view_enabled,
  CASE WHEN e.model_key IS NOT NULL THEN e.model_key WHEN b.pose = b.camera_id OR NOT p.posed THEN d.model_key END AS model_key,
  CASE WHEN e.model_key IS NOT NULL THEN e.safety_net_key WHEN b.pose = b.camera_id OR NOT p.posed THEN d.safety_net_key END AS safety_net_key,
  CASE WHEN e.model_key IS NOT NULL THEN e.view_base_light WHEN b.pose = b.camera_id OR NOT p.posed THEN d.view_base_light END AS view_base_light FROM b
  LEFT JOIN c e ON e.recipe_id = b.recipe_id AND e.camera_id = b.camera_id AND e.pose = b.pose
  LEFT JOIN c d ON d.recipe_id = b.recipe_id AND d.camera_id = b.camera_id AND d.pose = d.camera_id
  LEFT JOIN (SELECT recipe_id, camera_id, bool_or(pose <> camera_id) AS posed FROM c GROUP BY ALL) p ON p.recipe_id = b.recipe_id AND p.camera_id = b.camera_id)"""


def configured(t):
    return q.view_config(q.bundles(t.frames, JOB).withColumnRenamed("pose", "pose_id"), t.recipe_views)


@query("join_view_config", CONFIG + " SELECT sequence_id, camera_id, pose, view_enabled, coalesce(model_key, '') AS model_key FROM k")
def _(t):
    return configured(t).select("sequence_id", "camera_id", "pose", "view_enabled", F.coalesce("model_key", F.lit("")).alias("model_key"))


@query("join_unexpected_views", CONFIG + """ SELECT sequence_id, camera_id, CASE WHEN pose = camera_id THEN camera_id ELSE camera_id || '/' || pose END || ': camera pose not enabled by recipe' AS message FROM k WHERE NOT view_enabled
UNION ALL SELECT sequence_id, camera_id, camera_id || '/' || pose || ': duplicate camera pose bundle' FROM (SELECT DISTINCT sequence_id, camera_id, pose_id, CASE WHEN pose_id = '' THEN camera_id ELSE pose_id END AS pose FROM v_frames) GROUP BY sequence_id, camera_id, pose HAVING count(*) > 1""")
def _(t):
    return q.unexpected_views(t.frames, t.recipe_views, JOB).unionByName(q.duplicate_bundles(t.frames, JOB))


@query("join_missing_lights", f"""
WITH {BUNDLES} SELECT b.sequence_id, b.camera_id, b.camera_id || ': missing required light ' || l.light_id AS message FROM b JOIN v_recipe_lights l ON l.recipe_id = b.recipe_id AND l.required
WHERE NOT EXISTS (SELECT 1 FROM v_frames f WHERE f.sequence_id = b.sequence_id AND f.camera_id = b.camera_id AND (CASE WHEN f.pose_id = '' THEN f.camera_id ELSE f.pose_id END) = b.pose AND f.light_id = l.light_id)""")
def _(t):
    return q.missing_lights(t.frames, t.recipe_lights, JOB)


@query("agg_light_sequence", f"""
WITH k AS (SELECT f.*, {POSE} AS pose, l.pos FROM v_frames f LEFT JOIN v_recipe_lights l ON l.recipe_id = f.recipe_id AND l.light_id = f.light_id)
SELECT sequence_id, camera_id, camera_id || '/' || light_id || ': light not in configured light_order' AS message FROM k WHERE pos IS NULL
UNION ALL SELECT sequence_id, camera_id, camera_id || '/' || light_id || ': light_seq_index ' || light_seq_index || ' does not match configured order ' || pos FROM k WHERE light_seq_index <> pos
UNION ALL SELECT DISTINCT sequence_id, camera_id, message FROM (SELECT sequence_id, camera_id, pose, camera_id || ': duplicate light_seq_index in captured lights' AS message FROM k WHERE pos IS NOT NULL GROUP BY ALL HAVING count(*) > count(DISTINCT light_seq_index))""")
def _(t):
    return q.light_sequence(t.frames, t.recipe_lights, JOB)


@query("agg_capture_consistency", f"""
WITH {REQ}, s AS (SELECT sequence_id, camera_id, pose, count(*) AS n, min(timestamp_us) AS t0, max(timestamp_us) - min(timestamp_us) AS span, count(DISTINCT frame_index) AS fi, count(DISTINCT light_seq_index) AS ls FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT sequence_id, camera_id, camera_id || ': invalid frame timestamp' AS message FROM s WHERE t0 <= 0
UNION ALL SELECT sequence_id, camera_id, camera_id || ': capture timestamp span ' || span || 'us exceeds 300us' FROM s WHERE span > 300
UNION ALL SELECT sequence_id, camera_id, camera_id || ': duplicate frame_index in required lights' FROM s WHERE fi <> n
UNION ALL SELECT sequence_id, camera_id, camera_id || ': duplicate light_seq_index in required lights' FROM s WHERE ls <> n""")
def _(t):
    return q.capture_consistency(t.frames, t.recipe_lights, JOB, 300)


@query("win_monotonic_ts", f"""
WITH {REQ} SELECT DISTINCT sequence_id, camera_id, message FROM (SELECT sequence_id, camera_id, pose, camera_id || ': timestamps are not monotonic by required light order' AS message,
  timestamp_us < lag(timestamp_us) OVER (PARTITION BY sequence_id, camera_id, pose ORDER BY pos) AS falling FROM r) WHERE falling""")
def _(t):
    return q.monotonic_times(t.frames, t.recipe_lights, JOB)


@query("agg_exposure_gain", f"""
WITH {REQ}, s AS (SELECT sequence_id, camera_id, pose, max(exposure_us) - min(exposure_us) AS de, max(gain) - min(gain) AS dg FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT sequence_id, camera_id, camera_id || ': exposure delta ' || de || 'us exceeds 120us' AS message FROM s WHERE de > 120
UNION ALL SELECT sequence_id, camera_id, camera_id || ': gain delta ' || printf('%.3f', dg) || ' exceeds 0.225' FROM s WHERE dg > 0.225""")
def _(t):
    return q.exposure_gain(t.frames, t.recipe_lights, JOB, 120, 0.225)


POSE_RULES = f"""
WITH {REQ}, s AS (SELECT sequence_id, camera_id, pose, CASE WHEN pose = camera_id THEN camera_id ELSE camera_id || '/' || pose END AS label, count(*) AS n, count_if(shot_id <> 0) AS shots, count(DISTINCT shot_id) AS sv,
  count_if(robot_timestamp_us <> 0) AS times, count(DISTINCT robot_timestamp_us) AS tv, arg_min(robot_x, pos) AS fx, min(robot_x) AS lo, max(robot_x) AS hi FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT sequence_id, camera_id, label || ': mixed empty and non-empty shot_id in required lights' AS message FROM s WHERE shots > 0 AND shots < n
UNION ALL SELECT sequence_id, camera_id, label || ': inconsistent shot_id in required lights' FROM s WHERE shots = n AND sv <> 1
UNION ALL SELECT sequence_id, camera_id, label || ': mixed empty and non-empty robot_timestamp_us in required lights' FROM s WHERE times < n
UNION ALL SELECT sequence_id, camera_id, label || ': inconsistent robot_timestamp_us in required lights' FROM s WHERE times = n AND tv <> 1
UNION ALL SELECT sequence_id, camera_id, label || ': inconsistent robot_tcp_xyz_mm in required lights' FROM s WHERE hi - fx > 0.5 OR fx - lo > 0.5"""


@query("agg_pose_consistency", POSE_RULES)
def _(t):
    return q.pose_consistency(t.frames, t.recipe_lights, JOB, ["robot_x"], ["robot_rx"], 0.5)


STATS = """e AS (SELECT frame_id, avg(v) AS mean_gray, avg(CASE WHEN v >= 180 THEN 1.0 ELSE 0.0 END) AS saturation_ratio, avg(CASE WHEN v <= 60 THEN 1.0 ELSE 0.0 END) AS dark_ratio FROM v_pixels GROUP BY 1),
n AS (SELECT *, lag(v) OVER (PARTITION BY frame_id, y ORDER BY x) AS l, lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) AS r, lag(v) OVER (PARTITION BY frame_id, x ORDER BY y) AS u, lead(v) OVER (PARTITION BY frame_id, x ORDER BY y) AS d FROM v_pixels),
s AS (SELECT frame_id, avg(abs(l + r + u + d - 4 * v)) AS sharpness, least(avg(abs(v - l)), avg(abs(v - u))) AS motion_gradient FROM n GROUP BY 1)"""


@query("agg_frame_exposure", f"WITH {STATS} SELECT frame_id, round(mean_gray, 6) AS mean_gray, round(saturation_ratio, 6) AS saturation_ratio, round(dark_ratio, 6) AS dark_ratio FROM e")
def _(t):
    rows = q.pixel_exposure(t.pixels, ["frame_id"], 180, 60)
    return rows.select("frame_id", *[F.round(c, 6).alias(c) for c in ("mean_gray", "saturation_ratio", "dark_ratio")])


@query("agg_frame_sharpness", f"WITH {STATS} SELECT frame_id, round(sharpness, 6) AS sharpness FROM s")
def _(t):
    return q.frame_statistics(wide_images(t), ["frame_id"], kind=WIDE).select("frame_id", F.round("sharpness", 6).alias("sharpness"))


@query("agg_frame_motion", f"WITH {STATS} SELECT frame_id, round(motion_gradient, 6) AS motion_gradient FROM s")
def _(t):
    return q.frame_statistics(wide_images(t), ["frame_id"], kind=WIDE).select("frame_id", F.round("motion_gradient", 6).alias("motion_gradient"))


LIMITS = {"max_saturation_ratio": 0.12, "max_dark_ratio": 0.1, "min_mean_gray": 115.0, "max_mean_gray": 140.0, "min_sharpness": 60.0, "min_motion_gradient": 20.0}


def frame_images(t, frames=None, size=1):
    """Frames with their image as bytes, ``size`` a value, from the vector read as an 8 x 8 picture."""
    grey = F.expr(spark_text(f"transform(embedding, e -> right(lpad(hex(cast(@GREY(e) AS bigint)), 16, '0'), {2 * size}))"))
    images = t.embeddings.select(F.col("vec_id").alias("frame_id"), F.unhex(F.array_join(grey, "")).alias("image"))
    return (t.frames if frames is None else frames).drop("stride_bytes").withColumn("stride_bytes", F.lit(8 * size)).join(images, "frame_id")


# Components may lie outside the range that bytes stand for: pixels are then below 0 or above 255.
WIDE = ">i4"


def wide_images(t):
    return frame_images(t, size=4)


def frame_reports(t):
    stats = q.frame_statistics(wide_images(t), ["frame_id"], 180, 60, WIDE)
    rows = t.frames.join(stats, "frame_id").withColumn("m", F.concat(q.frame_meta_messages(), q.statistic_messages(LIMITS)))
    return rows.withColumn("passed", F.size("m") == 0)


REPORTS = f"""{STATS}, fr AS (SELECT f.*, e.mean_gray, e.saturation_ratio, e.dark_ratio, s.sharpness, s.motion_gradient, list_filter([{META}, CASE WHEN saturation_ratio > 0.12 THEN 'overexposure saturation ratio exceeded' END,
  CASE WHEN dark_ratio > 0.1 THEN 'underexposure dark ratio exceeded' END, CASE WHEN mean_gray < 115 THEN 'underexposure mean gray below threshold' END, CASE WHEN mean_gray > 140 THEN 'overexposure mean gray above threshold' END,
  CASE WHEN sharpness < 60 THEN 'sharpness below threshold' END, CASE WHEN motion_gradient < 20 THEN 'motion blur gradient below threshold' END], lambda x: x IS NOT NULL) AS m FROM v_frames f JOIN e USING (frame_id) JOIN s USING (frame_id))"""


@query("agg_frame_report", f"WITH {REPORTS} SELECT frame_id, round(mean_gray, 6) AS mean_gray, round(sharpness, 6) AS sharpness, round(motion_gradient, 6) AS motion_gradient, array_to_string(m, ' | ') AS messages FROM fr")
def _(t):
    rows = frame_reports(t)
    return rows.select("frame_id", *[F.round(c, 6).alias(c) for c in ("mean_gray", "sharpness", "motion_gradient")], F.array_join("m", " | ").alias("messages"))


STABLE = f"""fs AS (SELECT f.*, e.mean_gray, f.label < 8 AS passed, {POSE} AS pose FROM v_frames f JOIN e USING (frame_id)),
st AS (SELECT sequence_id, camera_id, pose, max(mean_gray) - min(mean_gray) AS delta FROM fs JOIN v_recipe_lights l ON l.recipe_id = fs.recipe_id AND l.light_id = fs.light_id AND l.required WHERE passed GROUP BY ALL HAVING count(*) >= 2)"""


@query("agg_light_stability", f"WITH {STATS}, {STABLE} SELECT sequence_id, camera_id, camera_id || ': required light mean delta ' || printf('%.2f', delta) || ' exceeds 4.10' AS message FROM st WHERE delta > 4.1")
def _(t):
    rows = t.frames.join(q.pixel_exposure(t.pixels, ["frame_id"]), "frame_id").withColumn("passed", F.col("label") < 8)
    return q.light_stability(rows, t.recipe_lights, JOB, 4.1)


@query("agg_job_quality", f"""
WITH {BUNDLES}, {REPORTS},
m AS (SELECT b.sequence_id FROM b JOIN v_recipe_lights l ON l.recipe_id = b.recipe_id AND l.required
  WHERE NOT EXISTS (SELECT 1 FROM v_frames f WHERE f.sequence_id = b.sequence_id AND f.camera_id = b.camera_id AND (CASE WHEN f.pose_id = '' THEN f.camera_id ELSE f.pose_id END) = b.pose AND f.light_id = l.light_id)
  UNION ALL SELECT DISTINCT sequence_id FROM v_frames JOIN v_recipe USING (recipe_id) WHERE sku <> recipe_sku),
x AS (SELECT sequence_id, count(*) AS frames, count_if(len(m) > 0) AS failed_frames FROM fr GROUP BY 1), y AS (SELECT sequence_id, count(*) AS messages FROM m GROUP BY 1)
SELECT sequence_id, frames, failed_frames, coalesce(messages, 0) AS messages, coalesce(messages, 0) = 0 AND failed_frames = 0 AS quality_pass FROM x LEFT JOIN y USING (sequence_id)""")
def _(t):
    same = t.frames.withColumns({"bundle_camera": F.col("camera_id"), "bundle_light": F.col("light_id")})
    checks = [q.missing_lights(t.frames, t.recipe_lights, JOB), q.identity_messages(same, t.recipe, JOB)]
    return q.job_quality(frame_reports(t), checks, JOB)
