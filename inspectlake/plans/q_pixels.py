"""Queries on regions, pixels, channels, registration and detector output."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectlake.operators import detect as d, pixels as px, tiles as ti
from inspectlake.plans.q_quality import CONFIG, WIDE, configured, wide_images
from inspectlake.plans.registry import query

CUBE = ["sequence_id", "camera_id"]
CHANNELS = [
    ("TOP_BACK", "m_back", 0, "ch0_diffuse"), ("TOP_BACK", "m_back", 1, "aux_specular_removed"),
    ("TOP_BACK", "m_back", 2, "max_min:DIFFUSE:POLAR_DIFFUSE:HIGH_LEFT"), ("TOP_CUSHION", "m_cushion", 0, "local_contrast:HIGH_LEFT"),
    ("TOP_CUSHION", "m_cushion", 1, "light: POLAR_DIFFUSE"), ("TOP_CUSHION", "m_cushion", 2, "aux_local_contrast"), ("TOP_CUSHION", "m_cushion", 3, "light:A:B"),
]
SPEC_SQL = """sp(camera_id, channel, pos, op, need, light_id) AS (VALUES ('TOP_BACK', 'ch0_diffuse', 0, 'light', 1, 'DIFFUSE'), ('TOP_BACK', 'aux_specular_removed', 1, 'abs_diff', 2, 'DIFFUSE'), ('TOP_BACK', 'aux_specular_removed', 1, 'abs_diff', 2, 'POLAR_DIFFUSE'),
  ('TOP_BACK', 'max_min:DIFFUSE:POLAR_DIFFUSE:HIGH_LEFT', 2, 'max_min', 3, 'DIFFUSE'), ('TOP_BACK', 'max_min:DIFFUSE:POLAR_DIFFUSE:HIGH_LEFT', 2, 'max_min', 3, 'POLAR_DIFFUSE'), ('TOP_BACK', 'max_min:DIFFUSE:POLAR_DIFFUSE:HIGH_LEFT', 2, 'max_min', 3, 'HIGH_LEFT'),
  ('TOP_CUSHION', 'local_contrast:HIGH_LEFT', 0, 'local_contrast', 1, 'HIGH_LEFT'), ('TOP_CUSHION', 'light: POLAR_DIFFUSE', 1, 'light', 1, 'POLAR_DIFFUSE'), ('TOP_CUSHION', 'aux_local_contrast', 2, 'local_contrast', 1, 'DIFFUSE'))"""
BUILT = f"""WITH {SPEC_SQL}, p AS (SELECT f.sequence_id, f.camera_id, f.light_id, x, y, v FROM v_pixels JOIN v_frames f USING (frame_id)),
mn AS (SELECT sequence_id, camera_id, light_id, floor(avg(v)) AS mean FROM p GROUP BY ALL),
c AS (SELECT p.sequence_id, p.camera_id, channel, pos, need, x, y, count(*) AS have, CASE any_value(op) WHEN 'light' THEN max(v) WHEN 'local_contrast' THEN abs(max(v) - max(mean)) ELSE max(v) - min(v) END AS value
  FROM p JOIN sp USING (camera_id, light_id) JOIN mn ON mn.sequence_id = p.sequence_id AND mn.camera_id = p.camera_id AND mn.light_id = p.light_id GROUP BY ALL HAVING count(*) = need)"""


def specs(t):
    return px.channel_specs(t.values(CHANNELS, "camera_id string, model_key string, pos int, channel string"))


def frame_tiles(t, *more):
    return ti.image_tiles(wide_images(t), ["frame_id", *more], kind=WIDE)


def channels(t):
    return ti.light_channels(frame_tiles(t, *CUBE, "light_id"), specs(t), CUBE, ["camera_id"])


@query("join_light_channels", BUILT + " SELECT sequence_id, camera_id, channel, x, y, cast(value AS int) AS value FROM c")
def _(t):
    return ti.pixels(channels(t)[0], [*CUBE, "channel"], "value")


@query("join_evidence_lights", f"""
WITH {SPEC_SQL} SELECT j.sequence_id, j.camera_id, CASE WHEN j.camera_id = 'TOP_BACK' THEN 'DIFFUSE|POLAR_DIFFUSE|HIGH_LEFT' ELSE 'HIGH_LEFT|POLAR_DIFFUSE|DIFFUSE' END AS lights FROM (SELECT DISTINCT sequence_id, camera_id FROM v_frames) j""")
def _(t):
    per_model = px.evidence_lights(specs(t), ["camera_id", "model_key"], "pos")
    return t.frames.select(*CUBE).distinct().join(per_model, "camera_id").select(*CUBE, F.array_join("evidence_lights", "|").alias("lights"))


@query("agg_feature_tensor", BUILT + " SELECT sequence_id, camera_id, channel, cast(y * 8 + x AS int) AS i, round(least(greatest(value / 255.0, 0.0), 1.0)::float, 6) AS value FROM c")
def _(t):
    built = channels(t)[0]
    whole = ti.tensor_shapes(built, CUBE).where("issue IS NULL").select(*CUBE, "channel", "width")
    parts = ti.feature_tensors(built, CUBE, 255.0).join(whole, [*CUBE, "channel"]).select("*", F.posexplode("values").alias("k", "v"))
    at = (F.col("ty") * ti.TILE + F.floor(F.col("k") / F.col("w"))) * F.col("width") + F.col("tx") * ti.TILE + F.col("k") % F.col("w")
    return parts.select(*CUBE, "channel", at.cast("int").alias("i"), F.round(F.col("v"), 6).alias("value"))


@query("agg_stat_embedding", BUILT + """, s AS (SELECT sequence_id, camera_id, channel, pos, avg(least(greatest(value / 255.0, 0.0), 1.0)) AS m, stddev_pop(least(greatest(value / 255.0, 0.0), 1.0)) AS d FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, camera_id ORDER BY pos) - 1 AS k FROM s), k AS (SELECT DISTINCT sequence_id, camera_id FROM s)
SELECT k.sequence_id, k.camera_id, i, round(coalesce(CASE WHEN i % 2 = 0 THEN m ELSE d END, 0.0), 6) AS value FROM k CROSS JOIN (SELECT unnest(range(7)) AS i) n LEFT JOIN r ON r.sequence_id = k.sequence_id AND r.camera_id = k.camera_id AND r.k = i // 2""")
def _(t):
    pos = specs(t).select("channel", "pos")
    rows = ti.statistical_embedding(channels(t)[0], CUBE, pos, 7, 255.0)
    return rows.select(*CUBE, F.posexplode("embedding").alias("i", "v")).select(*CUBE, "i", F.round("v", 6).alias("value"))


@query("agg_feature_summary", BUILT + " SELECT sequence_id, camera_id, string_agg(DISTINCT channel, '|' ORDER BY channel) AS features, count(DISTINCT channel) AS channels, max(y) + 1 AS height, max(x) + 1 AS width FROM c GROUP BY 1, 2")
def _(t):
    return ti.feature_summary(channels(t)[0], CUBE).withColumn("features", F.array_join("features", "|"))


def frame_rois(t):
    return px.frame_rois(t.frames, t.rois, ["camera_id"])


@query("join_frame_roi", "SELECT frame_id, roi_name, rx1 < width AND ry1 < height AND rx0 >= 0 AND ry0 >= 0 AS in_image FROM v_frames JOIN v_rois USING (camera_id)")
def _(t):
    return frame_rois(t).select("frame_id", "roi_name", "in_image")


CROP = "cr AS (SELECT frame_id, roi_name, x - rx0 AS x, y - ry0 AS y, v FROM v_pixels JOIN v_frames USING (frame_id) JOIN v_rois USING (camera_id) WHERE rx1 < 8 AND x BETWEEN rx0 AND rx1 AND y BETWEEN ry0 AND ry1)"


@query("join_roi_crop", f"WITH {CROP} SELECT * FROM cr")
def _(t):
    return ti.pixels(ti.crop(frame_tiles(t), frame_rois(t), ["frame_id"]), ["frame_id", "roi_name"])


@query("flt_roi_mask", f"WITH {CROP} SELECT frame_id, roi_name, x, y, CASE WHEN (x + 2 * y) % 3 = 0 AND roi_name = 'seat' THEN 0 ELSE v END AS v FROM cr")
def _(t):
    # The mask of a region as a picture: nothing where x + 2y divides by three.
    picture = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when((i % 8 + 2 * F.floor(i / 8)) % 3 == 0, "00").otherwise("ff")), ""))
    area = lambda a, b: F.col(b) - F.col(a) + 1
    sizes = t.rois.where("roi_name = 'seat'").select("camera_id", "roi_name", area("rx0", "rx1").alias("width"), area("ry0", "ry1").alias("height"))
    masks = ti.image_tiles(sizes.select("*", F.lit(8).alias("stride_bytes"), picture.alias("image")), ["camera_id", "roi_name"])
    cropped = ti.crop(frame_tiles(t), frame_rois(t), ["frame_id"]).join(t.frames.select("frame_id", "camera_id"), "frame_id")
    return ti.pixels(ti.apply_mask(cropped, masks, ["frame_id", "roi_name"], ["camera_id", "roi_name"]), ["frame_id", "roi_name"])


@query("join_roi_warp", """
WITH g AS (SELECT frame_id, width, height, gx, gy, least(greatest(0.5 * gx + 0.25 * gy + (frame_id % 5) * 0.5, 0.0), 7.0) AS sx, least(greatest(0.25 * gx + 1.0 * gy - 0.5, 0.0), 7.0) AS sy FROM v_frames, (SELECT unnest(range(6)) AS gx), (SELECT unnest(range(5)) AS gy)),
n AS (SELECT *, floor(sx) AS ax, floor(sy) AS ay, sx - floor(sx) AS dx, sy - floor(sy) AS dy FROM g)
SELECT n.frame_id, gx AS x, gy AS y, cast(round_even(sum(v * (CASE WHEN p.x = ax THEN 1 - dx ELSE 0 END + CASE WHEN p.x = least(ax + 1, 7) THEN dx ELSE 0 END) * (CASE WHEN p.y = ay THEN 1 - dy ELSE 0 END + CASE WHEN p.y = least(ay + 1, 7) THEN dy ELSE 0 END)), 0) AS int) AS v
FROM n JOIN v_pixels p ON p.frame_id = n.frame_id AND p.x BETWEEN ax AND ax + 1 AND p.y BETWEEN ay AND ay + 1 GROUP BY ALL""")
def _(t):
    shift = (F.col("frame_id") % 5) * 0.5
    matrix = F.array(F.lit(0.5), F.lit(0.25), shift, F.lit(0.25), F.lit(1.0), F.lit(-0.5), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    targets = t.frames.select("frame_id", "width", "height", F.lit("seat").alias("roi_name"), matrix.alias("matrix"), F.lit(6).alias("out_w"), F.lit(5).alias("out_h"))
    return ti.pixels(ti.warp(frame_tiles(t), targets, ["frame_id"]), ["frame_id"])


@query("join_base_light", CONFIG + """,
f AS (SELECT v.frame_id, v.light_id, k.sequence_id, k.camera_id, k.pose, k.view_base_light, fallback_light_id, v.frame_id % 9 AS x0 FROM v_frames v JOIN k ON k.sequence_id = v.sequence_id AND k.camera_id = v.camera_id AND k.pose = CASE WHEN v.pose_id = '' THEN v.camera_id ELSE v.pose_id END JOIN v_recipe r ON r.recipe_id = k.recipe_id),
g AS (SELECT sequence_id, camera_id, pose, view_base_light, fallback_light_id, max(CASE WHEN light_id = view_base_light THEN x0 END) AS b, max(CASE WHEN light_id = fallback_light_id THEN x0 END) AS fb, arg_min(x0, light_id || lpad(frame_id::varchar, 12, '0')) AS a FROM f GROUP BY ALL)
SELECT sequence_id, camera_id, pose, CASE WHEN b IS NOT NULL THEN view_base_light ELSE fallback_light_id END AS base_light_id, b IS NOT NULL OR fb IS NOT NULL AS has_base, coalesce(b, fb, a) AS x0, coalesce(b, fb, a) + 3 AS x1 FROM g""")
def _(t):
    from inspectlake.operators.quality import POSE

    frames = t.frames.withColumns({"pose": POSE(), "x0": F.col("frame_id") % 9, "y0": F.lit(1), "x1": F.col("frame_id") % 9 + 3, "y1": F.lit(5)})
    views = configured(t).select("sequence_id", "recipe_id", "camera_id", "pose", "view_base_light").join(t.recipe.select("recipe_id", "fallback_light_id"), "recipe_id")
    cube = [*CUBE, "pose"]
    rows = px.base_light(frames, views, ["recipe_id", *cube], cube, "fallback_light_id", ["x0", "y0", "x1", "y1"])
    return rows.select(*cube, "base_light_id", "has_base", "x0", "x1")


@query("join_patch_assembly", """
WITH c AS (SELECT vec_id, 0 AS layer, 4 AS h, unnest(range(16)) // 4 AS r, unnest(range(16)) % 4 AS c, unnest(range(16)) * 2 AS o, 2 AS w FROM embeddings UNION ALL SELECT vec_id, 1, 2, unnest(range(4)) // 2, unnest(range(4)) % 2, 32 + unnest(range(4)) * 3, 3 FROM embeddings)
SELECT e.vec_id, i AS patch_row, j AS patch_col, round(list_sum(list_concat(embedding[a.o + 1:a.o + 2], embedding[b.o + 1:b.o + 3])::double[]), 6) AS total, 5 AS dim
FROM embeddings e, (SELECT unnest(range(5)) AS i) x, (SELECT unnest(range(3)) AS j) y, c a, c b WHERE a.vec_id = e.vec_id AND b.vec_id = e.vec_id AND a.layer = 0 AND b.layer = 1
  AND a.r = i * 4 // 5 AND a.c = j * 4 // 3 AND b.r = i * 2 // 5 AND b.c = j * 2 // 3""")
def _(t):
    fine = t.embeddings.select("vec_id", F.expr("explode(transform(sequence(0, 15), i -> struct(0 AS layer, 4 AS layer_h, 4 AS layer_w, cast(i div 4 AS int) AS row, i % 4 AS col, slice(embedding, i * 2 + 1, 2) AS vector)))").alias("c"))
    coarse = t.embeddings.select("vec_id", F.expr("explode(transform(sequence(0, 3), i -> struct(1 AS layer, 2 AS layer_h, 2 AS layer_w, cast(i div 2 AS int) AS row, i % 2 AS col, slice(embedding, 32 + i * 3 + 1, 3) AS vector)))").alias("c"))
    grid = px.assemble_patches(fine.union(coarse).select("vec_id", "c.*"), ["vec_id"], 5, 3)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return grid.select("vec_id", "patch_row", "patch_col", F.round(total, 6).alias("total"), F.size("embedding").alias("dim"))


@query("join_registration_fixed", """
WITH f AS (SELECT sequence_id, camera_id, light_id, frame_id % 9 AS x0, 1 AS y0, frame_id % 9 + 30 AS x1, 25 AS y1, light_id <> 'BAR_LEFT' AS known FROM v_frames),
c AS (SELECT *, unnest([x0, x1, x1, x0]) AS px, unnest([y0, y0, y1, y1]) AS py FROM f),
e AS (SELECT *, CASE light_id WHEN 'DIFFUSE' THEN 0.0 WHEN 'POLAR_DIFFUSE' THEN sqrt((0.02 * px) ** 2 + 0.25) WHEN 'HIGH_LEFT' THEN sqrt((px / (1 + 0.001 * py) - px) ** 2 + (py / (1 + 0.001 * py) - py) ** 2) END AS err FROM c),
g AS (SELECT sequence_id, camera_id, bool_or(light_id = 'DIFFUSE') AS hb, bool_or(NOT known) AS nm, max(err) AS mx, avg(err) AS av FROM e GROUP BY ALL)
SELECT sequence_id, camera_id, round(CASE WHEN NOT hb OR nm THEN 999.0 ELSE mx END, 6) AS max_error_px, round(CASE WHEN NOT hb OR nm THEN 999.0 ELSE av END, 6) AS mean_error_px, hb AND NOT nm AND mx <= 0.9 AS is_pass,
  CASE WHEN NOT hb THEN 'missing base light' WHEN nm THEN 'missing alignment matrix for BAR_LEFT' WHEN mx <= 0.9 THEN 'fixed calibration alignment pass' ELSE 'registration error exceeds threshold' END AS message FROM g""")
def _(t):
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    moved, tilted = [1.02, 0.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.001, 1.0]
    rows = [(c, light, m) for c in ("TOP_BACK", "TOP_CUSHION") for light, m in (("DIFFUSE", one), ("POLAR_DIFFUSE", moved), ("HIGH_LEFT", tilted))]
    alignment = t.values(rows, "camera_id string, light_id string, matrix array<double>")
    frames = t.frames.withColumns({"x0": F.col("frame_id") % 9, "y0": F.lit(1), "x1": F.col("frame_id") % 9 + 30, "y1": F.lit(25), "base": F.lit("DIFFUSE")})
    out = px.fixed_registration(frames, alignment, CUBE, ["camera_id"], "base", 0.9)
    return out.withColumns({c: F.round(c, 6) for c in ("max_error_px", "mean_error_px")})


def image_pairs(t):
    rows = wide_images(t).select(*CUBE, "frame_id", "light_id", "image", "width", "height")
    base = rows.where("light_id = 'DIFFUSE'").select(*CUBE, F.col("image").alias("base"))
    return rows.where("light_id <> 'DIFFUSE'").withColumnRenamed("image", "moving").join(base, CUBE)


def searched(t):
    return px.search_registration(image_pairs(t), [*CUBE, "frame_id"], 2, 50, 0.02, 0.2, WIDE)


SEARCH = """
WITH b AS (SELECT sequence_id, camera_id, frame_id FROM v_frames WHERE light_id = 'DIFFUSE'), m AS (SELECT f.sequence_id, f.camera_id, f.frame_id, b.frame_id AS base_id FROM v_frames f JOIN b USING (sequence_id, camera_id) WHERE light_id <> 'DIFFUSE'),
o AS (SELECT dx, dy, greatest(abs(dx), abs(dy)) AS ring FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
s AS (SELECT sequence_id, camera_id, m.frame_id, dx, dy, ring, count(*) AS n, sum(a.v)::double AS sa, sum(q.v)::double AS sb, sum(a.v * a.v)::double AS saa, sum(q.v * q.v)::double AS sbb, sum(a.v * q.v)::double AS sab
  FROM m JOIN v_pixels a ON a.frame_id = m.base_id CROSS JOIN o JOIN v_pixels q ON q.frame_id = m.frame_id AND q.x = a.x + dx AND q.y = a.y + dy GROUP BY ALL),
c AS (SELECT *, (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) AS corr FROM s),
r AS (SELECT frame_id, ring, max(m) OVER (PARTITION BY frame_id ORDER BY ring) AS best FROM (SELECT frame_id, ring, max(corr) AS m FROM c GROUP BY ALL)),
st AS (SELECT frame_id, coalesce(min(ring) FILTER (ring > 0 AND best - before < 0.02), 2) AS stop FROM (SELECT *, lag(best) OVER (PARTITION BY frame_id ORDER BY ring) AS before FROM r) GROUP BY 1),
w AS (SELECT c.*, stop FROM c JOIN st USING (frame_id) WHERE ring <= stop QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY corr DESC, ring, dy, dx) = 1),
al AS (SELECT sequence_id, camera_id, frame_id, dx, dy, corr, (2 * stop + 1) ** 2 AS iterations, corr >= 0.2 AS converged, sqrt(dx * dx + dy * dy) AS error_px FROM w)"""


@query("join_registration_search", SEARCH + " SELECT frame_id, dx, dy, round(corr, 6) AS correlation, cast(iterations AS int) AS iterations, converged, round(error_px, 6) AS error_px FROM al")
def _(t):
    return searched(t).select("frame_id", "dx", "dy", F.round("correlation", 6).alias("correlation"), "iterations", "converged", F.round("error_px", 6).alias("error_px"))


@query("join_registration_apply", SEARCH + """, g AS (SELECT sequence_id, camera_id FROM al GROUP BY ALL HAVING bool_and(converged) AND max(error_px) <= 2.5), sh AS (SELECT al.* FROM al JOIN g USING (sequence_id, camera_id))
SELECT sh.frame_id, p.x, p.y, q.v FROM sh JOIN v_pixels p ON p.frame_id = sh.frame_id JOIN v_pixels q ON q.frame_id = sh.frame_id AND q.x = greatest(0, least(7, p.x + dx)) AND q.y = greatest(0, least(7, p.y + dy))""")
def _(t):
    found = searched(t)
    passed = px.registration_report(found, CUBE, 2.5).where("is_pass").select(*CUBE)
    shifts = found.join(passed, CUBE).select("frame_id", "dx", "dy", F.lit(8).alias("width"), F.lit(8).alias("height"))
    return ti.pixels(ti.apply_shifts(frame_tiles(t), shifts, ["frame_id"]), ["frame_id"])


@query("join_calibration", """
SELECT frame_id, CASE WHEN f.calibration_id <> c.cal THEN 'calibration_id' WHEN width <> cw OR height <> 8 THEN 'image_size' ELSE '' END AS mismatch FROM v_frames f JOIN (VALUES ('TOP_BACK', 'cal1', 8), ('TOP_CUSHION', 'cal1', 9)) c(camera_id, cal, cw) USING (camera_id)""")
def _(t):
    from inspectlake.operators.recipes import match_calibration

    dims = t.values([("TOP_BACK", "cal1", 8, 8), ("TOP_CUSHION", "cal1", 9, 8)], "camera_id string, want_calibration string, image_w int, image_h int")
    return match_calibration(t.frames, dims, ["camera_id"]).select("frame_id", "mismatch")


@query("join_semantic_light", "SELECT frame_id, CASE light_id WHEN 'DIFFUSE' THEN 'DOME' WHEN 'HIGH_LEFT' THEN 'BAR_1' ELSE light_id END AS physical_light FROM v_frames")
def _(t):
    from inspectlake.operators.recipes import physical_light

    dims = t.values([("DIFFUSE", "DOME"), ("HIGH_LEFT", "BAR_1")], "semantic_light string, mapped_light string")
    return physical_light(t.frames.withColumnRenamed("light_id", "semantic_light"), dims).select("frame_id", "physical_light")


@query("join_model_routing", CONFIG + """,
x AS (SELECT k.sequence_id, k.camera_id, k.pose, roi_name, CASE WHEN roi_name = 'edge' THEN 'm_edge' ELSE k.model_key END AS model_key, safety_net_key FROM k JOIN v_rois r ON r.camera_id = k.camera_id WHERE view_enabled)
SELECT sequence_id, camera_id, pose, roi_name, model_key, 'primary' AS role FROM x UNION ALL SELECT sequence_id, camera_id, pose, roi_name, safety_net_key, 'safety_net' FROM x WHERE safety_net_key <> ''""")
def _(t):
    from inspectlake.operators.recipes import route_models

    views = configured(t).where("view_enabled").select("sequence_id", "recipe_id", "camera_id", "pose", "model_key", "safety_net_key")
    view = ["sequence_id", "recipe_id", "camera_id", "pose"]
    regions = views.select(*view).join(t.rois.select("camera_id", "roi_name"), "camera_id")
    overrides = t.values([("TOP_BACK", "edge", "m_edge")], "camera_id string, roi_name string, roi_model_key string")
    return route_models(regions, views, overrides, view, ["camera_id", "roi_name"]).select(*CUBE, "pose", "roi_name", "model_key", "role")


# --- detector output ---------------------------------------------------------------------------

DECODED = """WITH k AS (SELECT det_id, label, embedding[1]::double AS a, embedding[2]::double AS b, embedding[3]::double AS c, embedding[4]::double AS d, embedding[5:8]::double[] AS s FROM v_raw),
z AS (SELECT det_id, label, a - c / 2 AS x0, b - d / 2 AS y0, a + c / 2 AS x1, b + d / 2 AS y1, list_max(s) AS score, list_position(s, list_max(s)) - 1 AS class_id FROM k WHERE list_max(s) >= 0.05)"""


@query("prj_decode_detections", DECODED + " SELECT det_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(score, 6) AS score, class_id::double AS class_id FROM z")
def _(t):
    rows = t.raw.select("det_id", F.slice("embedding", 1, 8).alias("raw"))
    out = d.decode_class_scores(rows, "raw", 0.05)
    return out.select("det_id", *[F.round(c, 6).alias(c) for c in (*d.BOX, "score")], "class_id")


@query("flt_detection_valid", """
WITH r AS (SELECT det_id, embedding[1]::double AS x0, embedding[2]::double AS y0, embedding[1]::double + embedding[3]::double + 0.2 AS x1, embedding[2]::double + 0.5 AS y1, embedding[4]::double * 3 AS score, CASE label WHEN 3 THEN 1.5 WHEN 4 THEN -1 ELSE label END AS class_id FROM v_raw),
i AS (SELECT *, CASE WHEN score < 0 OR score > 1 THEN 'score out of range' WHEN score < 0.1 THEN 'below threshold' WHEN class_id <> round_even(class_id, 0) THEN 'class is not an integer' WHEN class_id < 0 THEN 'class out of range'
  WHEN least(x0, y0, x1, y1) < 0 OR greatest(x0, y0, x1, y1) > 1 THEN 'box out of range' WHEN x1 < x0 OR y1 < y0 THEN 'box reversed' ELSE '' END AS issue FROM r)
SELECT det_id, round(x0 * 639, 6) AS x0, round(y1 * 479, 6) AS y1, issue FROM i WHERE issue <> 'below threshold'""")
def _(t):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = t.raw.select(
        "det_id", e(0).alias("x0"), e(1).alias("y0"), (e(0) + e(2) + 0.2).alias("x1"), (e(1) + 0.5).alias("y1"), (e(3) * 3).alias("score"),
        F.when(F.col("label") == 3, 1.5).when(F.col("label") == 4, -1.0).otherwise(F.col("label").cast("double")).alias("class_id"),
    )
    out = d.check_detections(rows, 640, 480, 0.1, normalised=True)
    return out.select("det_id", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"), F.coalesce("issue", F.lit("")).alias("issue"))


@query("prj_decode_masks", """
SELECT det_id, 'rows' AS form, cast(i % 3 AS int) AS x, cast(i // 3 AS int) AS y, (embedding[6 + i + 1]::double >= 0.02)::int AS m FROM v_raw, (SELECT unnest(range(9)) AS i) WHERE embedding[5]::double >= 0.03
UNION ALL SELECT det_id, 'proto', cast(i % 4 AS int), cast(i // 4 AS int), (1 / (1 + exp(-greatest(-80.0, least(80.0, list_sum(list_transform(range(4), lambda k: embedding[60 + k + 1]::double * 9 * embedding[k * 15 + i + 1]::double)))))) >= 0.505)::int
  FROM v_raw, (SELECT unnest(range(15)) AS i)""")
def _(t):
    flat = d.decode_mask_rows(t.raw.select("det_id", F.slice("embedding", 1, 15).alias("raw")), "raw", 0.03, 0.02)
    coefs = t.raw.select("det_id", F.posexplode(F.slice("embedding", 61, 4)).alias("k", "c")).select("det_id", "k", (F.col("c").cast("double") * 9).alias("c"))
    protos = t.raw.select("det_id", F.posexplode(F.slice("embedding", 1, 60)).alias("i", "v")).select(
        "det_id", F.floor(F.col("i") / 15).cast("int").alias("k"), (F.col("i") % 15 % 4).alias("x"), F.floor(F.col("i") % 15 / 4).cast("int").alias("y"), F.col("v").cast("double").alias("v"))
    proto = d.decode_proto_masks(coefs, protos, ["det_id"], ["det_id"], 0.505)
    return flat.select("det_id", F.lit("rows").alias("form"), "x", "y", "m").unionByName(proto.select("det_id", F.lit("proto").alias("form"), "x", "y", "m"))


LOCATED = """WITH j AS (SELECT det.*, t.roi_name, t.rx0, t.ry0, t.rx1, t.ry1, cast(round_even(bx0 * 7, 0) AS int) AS x0, cast(round_even(by0 * 7, 0) AS int) AS y0, cast(round_even(bx1 * 7, 0) AS int) AS x1, cast(round_even(by1 * 7, 0) AS int) AS y1
  FROM v_roi_detections det LEFT JOIN v_rois t ON t.camera_id = det.camera_id AND t.class_id = det.class_id),
e AS (SELECT *, greatest(abs(rx0 - x0), abs(ry0 - y0), abs(rx1 - x1), abs(ry1 - y1))::double AS pose_error_px, CASE WHEN roi_name IS NULL THEN 'class without template' WHEN bx1 > 1 OR by1 > 1 THEN 'box out of range' END AS i FROM j),
l AS (SELECT *, CASE WHEN i IS NULL AND pose_error_px > 3 THEN 'pose error' ELSE i END AS issue FROM e WHERE i IS NOT NULL OR confidence >= 0.4),
bst AS (SELECT * FROM l WHERE issue IS NULL QUALIFY row_number() OVER (PARTITION BY frame_key, roi_name ORDER BY confidence DESC, pose_error_px, det_id) = 1),
bb AS (SELECT b.frame_key, b.roi_name, b.x0, b.y0, b.x1, b.y1, b.confidence, bool_or(g.x0 <> b.x0 OR g.y0 <> b.y0 OR g.x1 <> b.x1 OR g.y1 <> b.y1) AS conflict FROM bst b JOIN l g ON g.issue IS NULL AND g.frame_key = b.frame_key AND g.roi_name = b.roi_name GROUP BY ALL)"""


def located(t):
    return d.locate_by_detection(t.roi_detections, t.rois, ["camera_id"], 8, 8, 0.4, 3.0)


@query("join_roi_detection", LOCATED + " SELECT det_id, coalesce(roi_name, '') AS roi_name, coalesce(pose_error_px, -1) AS pose_error_px, coalesce(issue, '') AS issue FROM l")
def _(t):
    return located(t).select("det_id", F.coalesce("roi_name", F.lit("")).alias("roi_name"), F.coalesce("pose_error_px", F.lit(-1.0)).alias("pose_error_px"), F.coalesce("issue", F.lit("")).alias("issue"))


@query("win_roi_best", LOCATED + " SELECT frame_key, roi_name, x0, y0, x1, y1, confidence, conflict FROM bb")
def _(t):
    return d.best_regions(located(t), ["frame_key"], "det_id").select("frame_key", "roi_name", *d.BOX, "confidence", "conflict")


@query("agg_roi_report", LOCATED + """, w AS (SELECT DISTINCT frame_key, camera_id FROM v_roi_detections), q AS (SELECT w.frame_key, count_if(bb.conflict IS NULL) AS missing, count_if(coalesce(bb.conflict, false)) AS conflicts FROM w JOIN v_rois r USING (camera_id) LEFT JOIN bb ON bb.frame_key = w.frame_key AND bb.roi_name = r.roi_name GROUP BY 1),
n AS (SELECT frame_key, count(*) AS n FROM l WHERE issue IS NOT NULL GROUP BY 1) SELECT frame_key, missing, conflicts, coalesce(n, 0) AS issues, missing = 0 AND conflicts = 0 AND coalesce(n, 0) = 0 AS is_pass FROM q LEFT JOIN n USING (frame_key)""")
def _(t):
    rows = located(t)
    best = d.best_regions(rows, ["frame_key"], "det_id")
    views = t.roi_detections.select("frame_key", "camera_id").distinct()
    return d.region_report(views, t.rois, best.join(views, "frame_key"), rows, ["frame_key", "camera_id"], ["camera_id"]).drop("camera_id")


@query("join_roi_segmentation", """
WITH mk AS (SELECT det_id, cast(i % 4 AS int) AS x, cast(i // 4 AS int) AS y, embedding[i + 1]::double >= 0.12 AS m FROM v_raw, (SELECT unnest(range(16)) AS i)),
s AS (SELECT det_id, min(x) FILTER (m) AS px0, min(y) FILTER (m) AS py0, max(x) FILTER (m) AS px1, max(y) FILTER (m) AS py1, count_if(m) AS n FROM mk GROUP BY 1),
dt AS (SELECT det_id, camera_id, class_id, 0.0 AS mx0, 1.0 AS my0, 7.0 AS mx1, 6.0 AS my1 FROM v_roi_detections),
j AS (SELECT dt.*, s.*, t.roi_name, rx0, ry0, rx1, ry1, greatest(0, least(7, round_even(mx0 + px0 * 2.0, 0))) AS x0, greatest(0, least(7, round_even(my0 + py0 * 1.5, 0))) AS y0,
  greatest(0, least(7, round_even(mx0 + (px1 + 1) * 2.0, 0) - 1)) AS x1, greatest(0, least(7, round_even(my0 + (py1 + 1) * 1.5, 0) - 1)) AS y1, n * 3.0 AS area FROM dt JOIN s ON s.det_id = dt.det_id LEFT JOIN v_rois t ON t.camera_id = dt.camera_id AND t.class_id = dt.class_id)
SELECT det_id, CASE WHEN roi_name IS NULL THEN 'class without template' WHEN n = 0 THEN 'mask empty' WHEN area < 6.4 THEN 'mask area below limit' WHEN area > 25.6 THEN 'mask area above limit'
  WHEN greatest(rx0 - x0, ry0 - y0, x1 - rx1, y1 - ry1, 0) > 1 THEN 'mask boundary error' ELSE '' END AS issue, coalesce(cast(x0 AS int), -1) AS x0, coalesce(cast(y1 AS int), -1) AS y1 FROM j""")
def _(t):
    masks = t.raw.select("det_id", F.posexplode(F.slice("embedding", 1, 16)).alias("i", "e")).select(
        "det_id", (F.col("i") % 4).alias("x"), F.floor(F.col("i") / 4).cast("int").alias("y"), (F.col("e").cast("double") >= 0.12).cast("int").alias("m"))
    dets = t.roi_detections.select("det_id", "camera_id", "class_id", F.lit(0.0).alias("mx0"), F.lit(1.0).alias("my0"), F.lit(7.0).alias("mx1"), F.lit(6.0).alias("my1"))
    out = d.locate_by_mask(masks, dets, t.rois, ["det_id"], ["camera_id"], 8, 8, 1.0, 0.1, 0.4, 1.0)
    return out.select("det_id", F.coalesce("issue", F.lit("")).alias("issue"), F.coalesce("x0", F.lit(-1)).alias("x0"), F.coalesce("y1", F.lit(-1)).alias("y1"))


@query("join_roi_template", """
WITH v AS (SELECT DISTINCT sequence_id, camera_id FROM v_frames), h AS (SELECT DISTINCT sequence_id, camera_id FROM v_frames WHERE light_id = 'DIFFUSE')
SELECT sequence_id, camera_id, roi_name, 1.0 AS confidence, true AS is_pass, 'template ROI pass' AS message FROM v JOIN h USING (sequence_id, camera_id) JOIN v_rois USING (camera_id)
UNION ALL SELECT v.sequence_id, v.camera_id, '', 0.0, false, 'missing Dome ROI source light: DIFFUSE' FROM v WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sequence_id = v.sequence_id AND h.camera_id = v.camera_id)""")
def _(t):
    views = t.frames.select(*CUBE).distinct().withColumn("source_light", F.lit("DIFFUSE"))
    return d.locate_by_template(views, t.frames, t.rois, CUBE, ["camera_id"]).drop("pose_error_px")
