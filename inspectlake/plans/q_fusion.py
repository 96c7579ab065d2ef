"""Queries on candidates, fusion, decisions and detection evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectlake.functions import boxes as bx
from inspectlake.operators import decide, fusion as fu
from inspectlake.plans.registry import query

REGION = ["sequence_id", "camera_id", "pose_id", "roi_name"]
TIE = ["ordinal", "light_id"]
IOU = lambda a, b: (
    f"(greatest(least({a}.x1,{b}.x1)-greatest({a}.x0,{b}.x0)+1,0)*greatest(least({a}.y1,{b}.y1)-greatest({a}.y0,{b}.y0)+1,0)) / "
    f"(({a}.x1-{a}.x0+1)*({a}.y1-{a}.y0+1)+({b}.x1-{b}.x0+1)*({b}.y1-{b}.y0+1)-"
    f"greatest(least({a}.x1,{b}.x1)-greatest({a}.x0,{b}.x0)+1,0)*greatest(least({a}.y1,{b}.y1)-greatest({a}.y0,{b}.y0)+1,0))"
)
CAP, THR = 8, 0.3

FOLD = f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, camera_id, pose_id, roi_name ORDER BY score DESC, ordinal, light_id, x0, y0, x1, y1) AS n FROM v_candidates),
f AS (SELECT sequence_id, camera_id, pose_id, roi_name, n, [struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, score := score, lights := [light_id], rs := recheck_score, ng := ng_score, supp := 0)] AS kept, 0 AS overflow FROM c WHERE n = 1
UNION ALL
SELECT sequence_id, camera_id, pose_id, roi_name, n,
  CASE WHEN m > 0 THEN list_transform(kept, lambda k, i: CASE WHEN i = m THEN struct_pack(x0 := least(k.x0, c.x0), y0 := least(k.y0, c.y0), x1 := greatest(k.x1, c.x1), y1 := greatest(k.y1, c.y1), score := k.score,
      lights := CASE WHEN list_contains(k.lights, c.light_id) THEN k.lights ELSE list_append(k.lights, c.light_id) END, rs := k.rs, ng := k.ng, supp := k.supp + 1) ELSE k END)
    WHEN len(kept) < {CAP} THEN list_append(kept, struct_pack(x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1, score := c.score, lights := [c.light_id], rs := c.recheck_score, ng := c.ng_score, supp := 0)) ELSE kept END,
  overflow + CASE WHEN m = 0 AND len(kept) >= {CAP} THEN 1 ELSE 0 END
FROM (SELECT f.sequence_id, f.camera_id, f.pose_id, f.roi_name, c.n, f.kept, f.overflow, struct_pack(x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1, score := c.score, light_id := c.light_id, recheck_score := c.recheck_score, ng_score := c.ng_score) AS c,
    coalesce(list_position(list_transform(f.kept, lambda k: {IOU('k', 'c')} >= {THR}), true), 0) AS m
  FROM f JOIN c ON c.sequence_id = f.sequence_id AND c.camera_id = f.camera_id AND c.pose_id = f.pose_id AND c.roi_name = f.roi_name AND c.n = f.n + 1)),
done AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY sequence_id, camera_id, pose_id, roi_name ORDER BY n DESC) = 1),
merged AS (SELECT sequence_id, camera_id, pose_id, roi_name, i - 1 AS kept_index, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1, k.score AS score, array_to_string(k.lights, '|') AS lights, k.rs AS recheck_score, k.ng AS ng_score,
  (k.x1 - k.x0 + 1) * (k.y1 - k.y0 + 1) AS area_px, k.supp AS suppressed, CASE WHEN i = 1 THEN overflow ELSE 0 END AS overflow
  FROM (SELECT *, unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS i FROM done))"""
DECIDED = """,
decided AS (SELECT * FROM (SELECT *, CASE WHEN score >= coalesce(ng_score, 0.8) AND area_px >= 300 AND (x1 - x0 + 1) / (y1 - y0 + 1) BETWEEN 0.5 AND 3.0 THEN 'NG'
  WHEN score >= coalesce(recheck_score, 0.5) THEN 'RECHECK' END AS decision FROM merged) WHERE decision IS NOT NULL)"""


def candidates(t):
    return t.candidates.withColumn("evidence_lights", F.array("light_id")).withColumn("area_px", bx.bbox_area(*fu.BOX))


def merged(t):
    return fu.merge_candidates(candidates(t), REGION, TIE, THR, CAP)


def decided(t):
    return decide.filter_defects(merged(t), 0.5, 0.8, 300, 0.5, 3.0)


@query("win_nms_merge", FOLD + " SELECT sequence_id, camera_id, pose_id, kept_index, x0, y0, x1, y1, score, lights, area_px, suppressed, overflow FROM merged")
def _(t):
    return merged(t).select(
        "sequence_id", "camera_id", "pose_id", "kept_index", *fu.BOX, "score", F.array_join("evidence_lights", "|").alias("lights"), "area_px", "suppressed", "overflow"
    )


@query("agg_fusion_summary", FOLD + """ SELECT sequence_id, sum(suppressed + 1 + overflow) AS input_count, count(*) AS output_count, sum(suppressed) AS suppressed_count, sum(overflow) AS overflow_count FROM merged GROUP BY 1""")
def _(t):
    return fu.fusion_summary(merged(t), ["sequence_id"])


@query("srt_fused", FOLD + " SELECT sequence_id, camera_id, pose_id, roi_name, score, x0, y0, x1, y1 FROM merged ORDER BY camera_id, pose_id, roi_name, score DESC")
def _(t):
    return fu.fused_order(merged(t)).select("sequence_id", "camera_id", "pose_id", "roi_name", "score", *fu.BOX)


@query("flt_defect_decision", FOLD + DECIDED + " SELECT sequence_id, camera_id, pose_id, kept_index, score, decision, CASE WHEN decision = 'NG' THEN 'critical' ELSE 'suspect' END AS severity FROM decided")
def _(t):
    return decided(t).select("sequence_id", "camera_id", "pose_id", "kept_index", "score", "decision", "severity")


@query("win_defect_ids", FOLD + DECIDED + """ SELECT sequence_id || '-' || (row_number() OVER (PARTITION BY sequence_id ORDER BY camera_id, pose_id, roi_name, score DESC, kept_index) - 1) AS defect_id, x0, y0, x1, y1 FROM decided""")
def _(t):
    return fu.number_defects(decided(t), ["sequence_id"]).select("defect_id", *fu.BOX)


@query("lim_defects", FOLD + DECIDED + """ SELECT sequence_id, slot, x0, y0, array_to_string(string_split(lights, '|')[1:2], '|') AS lights FROM
  (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY camera_id, pose_id, score DESC, kept_index) - 1 AS slot FROM decided) WHERE slot < 6""")
def _(t):
    order = ["camera_id", "pose_id", F.desc("score"), "kept_index"]
    rows = fu.limit_defects(decided(t), ["sequence_id"], order, 6, 2)
    return rows.select("sequence_id", "slot", "x0", "y0", F.array_join("evidence_lights", "|").alias("lights"))


@query("agg_job_decision", FOLD + DECIDED + """,
jobs AS (SELECT sequence_id, sum(overflow) AS overflow_count, sequence_id % 10 <> 4 AS quality_pass FROM merged GROUP BY 1),
n AS (SELECT sequence_id, count_if(decision = 'NG') AS ng, count_if(decision = 'RECHECK') AS re FROM decided GROUP BY 1),
d AS (SELECT jobs.*, coalesce(ng, 0) AS ng, coalesce(re, 0) AS re, CASE WHEN ng > 0 THEN 'NG' WHEN re > 0 THEN 'RECHECK' ELSE 'OK' END AS found FROM jobs LEFT JOIN n USING (sequence_id))
SELECT sequence_id, CASE WHEN NOT quality_pass OR (found = 'OK' AND overflow_count > 0) THEN 'RECHECK' ELSE found END AS decision,
  CASE WHEN NOT quality_pass THEN 7 WHEN found = 'OK' AND overflow_count > 0 THEN 13 ELSE 0 END AS error_code, quality_pass, CASE WHEN quality_pass THEN ng + re ELSE 0 END AS defect_count FROM d""")
def _(t):
    judged = decide.judge_candidates(merged(t), 0.5, 0.8, 300, 0.5, 3.0)
    jobs = t.candidates.select("sequence_id").distinct().withColumn("quality_pass", F.col("sequence_id") % 10 != 4)
    return decide.job_decisions(jobs, judged, ["sequence_id"])


CHECKED = """SELECT ordinal, x0, CASE WHEN ordinal % 31 = 0 THEN x0 - 1 ELSE x1 END AS x1, y0, y1, CASE WHEN ordinal % 37 = 1 THEN score + 2 ELSE score END AS score,
  CASE WHEN ordinal % 41 = 2 THEN 0 ELSE 5 END AS area_px, CASE WHEN ordinal % 43 = 3 THEN '' ELSE light_id END AS light FROM {v_candidates}"""


@query("chk_candidate", f"""SELECT * FROM (SELECT ordinal, CASE WHEN score < 0 OR score > 1 THEN 'invalid candidate score' WHEN x1 < x0 OR y1 < y0 THEN 'invalid candidate bbox'
  WHEN area_px <= 0 THEN 'invalid candidate area' WHEN light = '' THEN 'candidate evidence_lights is empty' END AS issue FROM ({CHECKED})) WHERE issue IS NOT NULL""")
def _(t):
    rows = t.select(CHECKED).withColumn("evidence_lights", F.filter(F.array("light"), lambda v: v != ""))
    return fu.split_candidates(rows)[1].select("ordinal", "issue")


@query("join_iou", f"""
WITH p AS (SELECT *, row_number() OVER () AS k FROM v_candidates), x AS (SELECT sequence_id, camera_id, ordinal, x0, y0, x1, y1 FROM v_candidates)
SELECT p.sequence_id, p.camera_id, p.ordinal AS left_id, q.ordinal AS right_id, round({IOU('p', 'q')}, 6) AS iou FROM x p JOIN v_truth q ON q.sequence_id = p.sequence_id AND q.camera_id = p.camera_id WHERE {IOU('p', 'q')} >= 0.4""")
def _(t):
    pairs = fu.overlapping_pairs(t.candidates, t.truth, ["sequence_id", "camera_id"], "ordinal", "ordinal", 0.4)
    return pairs.withColumn("iou", F.round("iou", 6))


MATCH = f"""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, camera_id ORDER BY ordinal, x0, y0, x1, y1) AS n FROM v_candidates WHERE score >= 0.2),
g AS (SELECT sequence_id, camera_id, list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1) ORDER BY ordinal, x0, y0, x1, y1) AS gts FROM v_truth GROUP BY 1, 2),
k AS (SELECT sequence_id, camera_id FROM p UNION SELECT sequence_id, camera_id FROM g),
s AS (SELECT k.sequence_id, k.camera_id, cast(0 AS bigint) AS n, coalesce(gts, []) AS gts, cast([] AS bigint[]) AS used, 0 AS fp FROM k LEFT JOIN g USING (sequence_id, camera_id)
UNION ALL
SELECT sequence_id, camera_id, n, gts, CASE WHEN best >= 0.5 THEN list_append(used, list_position(ious, best)) ELSE used END, fp + CASE WHEN best >= 0.5 THEN 0 ELSE 1 END
FROM (SELECT *, coalesce(list_max(ious), 0) AS best FROM (SELECT s.sequence_id, s.camera_id, p.n, gts, used, fp,
   list_transform(gts, lambda t, i: CASE WHEN list_contains(used, i) THEN 0.0 ELSE {IOU('t', 'p')} END) AS ious
   FROM s JOIN p ON p.sequence_id = s.sequence_id AND p.camera_id = s.camera_id AND p.n = s.n + 1))),
e AS (SELECT sequence_id, camera_id, len(used) AS true_positives, fp AS false_positives, len(gts) - len(used) AS false_negatives FROM s QUALIFY row_number() OVER (PARTITION BY sequence_id, camera_id ORDER BY n DESC) = 1)"""


def matched(t):
    return fu.match_detections(t.candidates, t.truth, ["sequence_id", "camera_id"], ["ordinal"], 0.5, 0.2)


@query("join_eval_match", MATCH + """ SELECT *, CASE WHEN true_positives + false_positives > 0 THEN round(true_positives / (true_positives + false_positives), 6) ELSE 1.0 END AS precision,
  CASE WHEN true_positives + false_negatives > 0 THEN round(true_positives / (true_positives + false_negatives), 6) ELSE 1.0 END AS recall FROM e""")
def _(t):
    return fu.precision_recall(matched(t)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("agg_eval_totals", MATCH + """,
m AS (SELECT *, 'seat' AS roi_name, CASE sequence_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'unknown' END AS split FROM e),
a AS (SELECT CASE WHEN grouping(roi_name) = 0 THEN 'by_roi_name' WHEN grouping(camera_id) = 0 THEN 'by_camera_id' WHEN grouping(split) = 0 THEN 'by_split' ELSE 'overall' END AS level,
  CASE WHEN grouping(roi_name) = 0 THEN roi_name WHEN grouping(camera_id) = 0 THEN camera_id WHEN grouping(split) = 0 THEN split ELSE '' END AS value, count(*) AS samples,
  sum(true_positives) AS tp, sum(false_positives) AS fp, sum(false_negatives) AS fn FROM m GROUP BY GROUPING SETS ((), (roi_name), (camera_id), (split)))
SELECT level, value, samples, tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM a""")
def _(t):
    split = F.when(F.col("sequence_id") % 3 == 0, "train").when(F.col("sequence_id") % 3 == 1, "test").otherwise("")
    rows = matched(t).withColumns({"roi_name": F.lit("seat"), "split": split})
    totals = fu.evaluation_totals(rows, ["roi_name", "camera_id", "split"])
    return totals.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("join_pixels_in_defects", """
SELECT frame_id, x, y FROM v_pixels p WHERE EXISTS (SELECT 1 FROM (SELECT l_orderkey AS f, l_linenumber % 8 AS x0, l_suppkey % 8 AS y0, l_linenumber % 8 + 2 AS x1, l_suppkey % 8 + 1 AS y1 FROM lineitem) b
  WHERE b.f = p.frame_id AND p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1)""")
def _(t):
    boxes = t.select("SELECT l_orderkey AS frame_id, l_linenumber % 8 AS x0, l_suppkey % 8 AS y0, l_linenumber % 8 + 2 AS x1, l_suppkey % 8 + 1 AS y1 FROM {lineitem}")
    return fu.points_in_boxes(t.pixels, boxes, ["frame_id"], 8).select("frame_id", "x", "y")


@query("fn_boxes", """
WITH m AS (SELECT ordinal, light_id, x0, y0, x1, y1, score, [1.0, 0.1, x0, 0.05, 1.0, y0, CASE WHEN ordinal % 11 = 0 THEN 0.0 ELSE 0.001 END, 0.0, CASE WHEN ordinal % 11 = 0 THEN 0.0 ELSE 1.0 END] AS m FROM v_candidates),
p AS (SELECT *, m[7] * 3 + m[8] * 4 + m[9] AS w FROM m)
SELECT ordinal, light_id, x0, y0, x1, y1, score, (x1 - x0 + 1) * (y1 - y0 + 1) AS area, least(x0, 20) AS ox0, greatest(y1, 30) AS oy1,
  round(CASE WHEN abs(w) >= 1e-9 THEN (m[1] * 3 + m[2] * 4 + m[3]) / w ELSE -1 END, 6) AS hx, round(CASE WHEN abs(w) >= 1e-9 THEN (m[4] * 3 + m[5] * 4 + m[6]) / w ELSE -1 END, 6) AS hy,
  round(score * 639, 6) AS dx, round(greatest(0.0, least(99.0, (x0 - 4.0) / 0.5)), 6) AS ux,
  cast(round_even(x0 + 2.5, 0) AS int) AS mx, cast(round_even(y0 + 3.5, 0) AS int) AS my,
  (x1 - x0 + 1) / (y1 - y0 + 1) BETWEEN 0.5 AND 2.0 AS aspect, abs((x0 * y0 - x1 * y0) + (x1 * y1 - x1 * y0) + (x1 * y1 - x0 * y1) + (x0 * y0 - x0 * y1)) / 2.0 AS poly FROM p""")
def _(t):
    c = t.candidates.withColumn(
        "m",
        F.array(
            F.lit(1.0), F.lit(0.1), F.col("x0").cast("double"), F.lit(0.05), F.lit(1.0), F.col("y0").cast("double"),
            F.when(F.col("ordinal") % 11 == 0, 0.0).otherwise(0.001), F.lit(0.0), F.when(F.col("ordinal") % 11 == 0, 0.0).otherwise(1.0),
        ),
    )
    hx, hy = bx.apply_homography("m", 3, 4)
    outer = bx.bbox_outer(fu.BOX, [20, 20, 30, 30])
    mapped = bx.map_bbox([2.5, 3.5, 4.0, 4.0], fu.BOX)
    pt = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    corners = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"))
    return c.withColumn("corners", corners).select(
        "ordinal", "light_id", *fu.BOX, "score", bx.bbox_area(*fu.BOX).alias("area"), outer[0].alias("ox0"), outer[3].alias("oy1"),
        F.round(F.coalesce(hx, F.lit(-1.0)), 6).alias("hx"), F.round(F.coalesce(hy, F.lit(-1.0)), 6).alias("hy"),
        F.round(bx.denorm_bbox(["score"] * 4, 640, 480)[0], 6).alias("dx"),
        F.round(bx.unletterbox_bbox(fu.BOX, 4.0, 4.0, 0.5, 100, 100)[0], 6).alias("ux"),
        mapped[0].alias("mx"), mapped[1].alias("my"), bx.aspect_ok(*fu.BOX, 0.5, 2.0).alias("aspect"), bx.polygon_area("corners").alias("poly"),
    )
