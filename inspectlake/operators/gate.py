"""The image quality gate of whole jobs, with every limit taken from the recipe's row.

A recipe is data: its limits are typed columns of a dimension table, and frames carry them through a join by recipe.
All checks are one chain of aggregates over frame metadata: frame messages, then one row per (job, view) with the lights
of the recipe's order as a short array, then one row per job.  An array never holds more than a recipe names (lights,
views); what a recipe does not name is counted, not gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.operators import quality as q
from inspectlake.operators.ordered import cut_lineage

#: What a recipe takes where it says nothing.
DEFAULTS = {
    "max_saturation_ratio": ("double", 0.01),
    "max_dark_ratio": ("double", 0.01),
    "min_mean_gray": ("double", 20.0),
    "max_mean_gray": ("double", 235.0),
    "min_sharpness": ("double", 1.0),
    "min_motion_gradient": ("double", 1.0),
    "max_light_mean_delta": ("double", 80.0),
    "max_registration_error_px": ("double", 1.5),
    "max_capture_span_us": ("long", 500_000),
    "max_exposure_delta_us": ("long", 200),
    "max_gain_delta": ("double", 0.2),
    "require_monotonic_timestamps": ("boolean", True),
    "require_unique_frame_indices": ("boolean", True),
    "max_pose_delta": ("double", 1e-4),
    "method": ("string", "fixed_calibration"),
    "max_iterations": ("int", 30),
    "convergence_epsilon": ("double", 1e-4),
    "search_radius_px": ("int", 2),
    "min_correlation": ("double", 0.05),
    "ng_score": ("double", 0.35),
    "recheck_score": ("double", 0.20),
    "min_area_px": ("int", 1),
    "min_aspect_ratio": ("double", 0.0),
    "max_aspect_ratio": ("double", 0.0),
    "iou_threshold": ("double", 0.5),
    "max_candidates_per_roi": ("int", 16),
}
_STATISTICS = ["max_saturation_ratio", "max_dark_ratio", "min_mean_gray", "max_mean_gray", "min_sharpness", "min_motion_gradient"]
_LIGHT = ["timestamp_us", "frame_index", "light_seq_index", "exposure_us", "gain", "shot_id", "robot_timestamp_us"]


def recipe_rules(recipes: DataFrame) -> DataFrame:
    """``recipes`` with every limit as a typed column; a missing column or a null is the default."""
    value = lambda name, kind, default: (F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in recipes.columns else F.lit(default)).cast(kind)
    return recipes.withColumns({name: value(name, kind, default) for name, (kind, default) in DEFAULTS.items()})


def recipe_arrays(views: DataFrame, lights: DataFrame) -> DataFrame:
    """recipe_id with its views as (camera_id, pose), its required lights, and whether it needs robot poses."""
    by_view = views.groupBy("recipe_id").agg(F.sort_array(F.collect_set(F.struct("camera_id", q.POSE().alias("pose")))).alias("want_views"))
    by_light = lights.where("required").groupBy("recipe_id").agg(F.array_sort(F.collect_set(F.struct("pos", "light_id"))).alias("want_lights"))
    return by_view.join(by_light, "recipe_id", "full").join(q.robot_pose_required(views), "recipe_id", "left")


def _short(stats: Column) -> Column:
    return F.when(stats.isNull(), F.array(F.lit("image shorter than stride"))).otherwise(F.array().cast("array<string>"))


def frame_reports(frames: DataFrame, rules: DataFrame) -> DataFrame:
    """Metadata of ``frames`` with statistics and ``messages``; images are read here only."""
    stats = q.frame_statistics(frames, ["frame_id"])
    meta = q.frame_meta_messages()
    measured = F.concat(_short(F.col("mean_gray")), q.statistic_messages({k: F.col(k) for k in _STATISTICS}))
    rows = frames.drop("image").join(stats, "frame_id").join(rules.select("recipe_id", *_STATISTICS), "recipe_id", "left")
    # A frame with bad metadata is not measured.
    rows = rows.withColumn("messages", F.when(F.size(meta) > 0, meta).otherwise(measured)).withColumn("passed", F.size("messages") == 0)
    return rows.drop(*_STATISTICS)


def _far(lights: Column, names: list[str], limit: Column) -> Column:
    first = lights[0]
    apart = lambda x: reduce(lambda a, b: a | b, [F.abs(x[n] - first[n]) > limit for n in names])
    return F.exists(lights, apart)


def view_reports(reports: DataFrame, rules: DataFrame, views: DataFrame, lights: DataFrame, job: list[str], xyz: list[str], rpy: list[str]) -> DataFrame:
    """One row per (job, view): ``messages`` of the view, and how many of its frames failed or break the light order.

    ``reports`` is what frame_reports gives.  A view is a camera and pose; no pose is the camera's own.
    """
    c = F.col
    label = [c("camera_id"), "/", c("light_id")]
    known = reports.withColumn("pose", q.POSE()).join(lights.select("recipe_id", "light_id", "pos", "required"), ["recipe_id", "light_id"], "left")
    stray = [c("pos").isNull(), c("light_seq_index") != c("pos")]
    filed = q._messages(
        [
            (stray[0], q._text(*label, ": light not in configured light_order")),
            (stray[1], q._text(*label, ": light_seq_index ", c("light_seq_index"), " does not match configured order ", c("pos"))),
        ]
    )
    known = known.withColumn("filed", filed)
    # One row per light of the order; a light that comes again is a broken capture.
    light = F.struct("pos", "light_id", "required", *_LIGHT, *xyz, *rpy, "mean_gray", "passed")
    keys = [*job, "recipe_id", "camera_id", "pose"]
    per_light = known.groupBy(*keys, "light_id").agg(
        F.min_by(F.when(c("pos").isNotNull(), light), "frame_id").alias("light"), F.count("*").alias("times"), F.count_if(~c("passed")).alias("failed"),
        F.sum(F.size("filed")).alias("stray"), F.collect_set(F.coalesce("pose_id", F.lit(""))).alias("raw"), F.min("filed").alias("filed"),
        F.max("sku").alias("sku"), F.min("sku").alias("sku0"), *([F.max("capture_mode").alias("capture_mode")] if "capture_mode" in reports.columns else []),
    )
    mode = [F.max("capture_mode").alias("capture_mode")] if "capture_mode" in reports.columns else []
    per_view = per_light.groupBy(*keys).agg(
        F.array_sort(F.collect_list("light")).alias("lights"), F.sum("times").alias("frames"), F.sum("failed").alias("failed_frames"), F.sum("stray").alias("stray_lights"),
        F.array_distinct(F.flatten(F.collect_set("raw"))).alias("raw"), F.min(F.when(F.size("filed") > 0, F.col("filed")[0])).alias("first_stray"),
        F.min(F.when((c("times") > 1) & c("light").isNotNull(), c("light_id"))).alias("again"), F.max("sku").alias("sku"), F.min("sku0").alias("sku0"), *mode,
    )
    # One row per view: what follows looks at the recipe's row and at the lights of the view.
    dims = rules.withColumn("known_recipe", F.lit(True)).join(recipe_arrays(views, lights), "recipe_id", "left")
    rows = cut_lineage(per_view).join(cut_lineage(dims), "recipe_id", "left").withColumn("required_lights", F.filter("lights", lambda x: x["required"]))
    r = c("required_lights")
    take = lambda name: F.transform(r, lambda x: x[name])
    low, high = (lambda n: F.array_min(take(n))), (lambda n: F.array_max(take(n)))
    distinct = lambda n: F.size(F.array_distinct(take(n)))
    count = lambda test: F.size(F.filter(r, test))
    moved = lambda x: reduce(lambda a, b: a | b, [F.abs(x[n]) > 1e-6 for n in xyz + rpy])
    s = {
        "n": F.size(r), "t0": low("timestamp_us"), "span": high("timestamp_us") - low("timestamp_us"), "frames": distinct("frame_index"), "seqs": distinct("light_seq_index"),
        "e0": low("exposure_us"), "de": high("exposure_us") - low("exposure_us"), "g0": low("gain"), "dg": high("gain") - low("gain"),
        "shots": count(lambda x: x["shot_id"] != 0), "shot_values": distinct("shot_id"), "times": count(lambda x: x["robot_timestamp_us"] != 0), "time_values": distinct("robot_timestamp_us"), "posed": count(moved),
    }
    cam = c("camera_id")
    view_label = F.when(c("pose") == cam, cam).otherwise(F.concat_ws("/", "camera_id", "pose"))
    need_pose = F.coalesce("pose_required", F.lit(False))
    if mode:
        need_pose = need_pose | ~F.coalesce("capture_mode", F.lit(0)).isin(0, 1)
    falling = F.exists(F.sequence(F.lit(1), F.size(r) - 1), lambda i: r[i]["timestamp_us"] < r[i - 1]["timestamp_us"])
    capture = [
        *q.capture_rules(s, cam, c("max_capture_span_us"), c("require_unique_frame_indices")),
        (c("require_monotonic_timestamps") & F.when(s["n"] >= 2, falling), q._text(cam, ": timestamps are not monotonic by required light order")),
        *q.pose_rules(s, view_label, need_pose, _far(r, xyz, c("max_pose_delta")), _far(r, rpy, c("max_pose_delta"))),
        *q.exposure_rules(s, cam, c("max_exposure_delta_us"), c("max_gain_delta")),
    ]
    steady = F.filter(r, lambda x: x["passed"])
    greys = F.transform(steady, lambda x: x["mean_gray"])
    delta = F.array_max(greys) - F.array_min(greys)
    digits = lambda v: F.format_string("%.2f", F.bround(v, 2))
    seqs = F.transform(F.col("lights"), lambda x: x["light_seq_index"])
    accepted = F.exists("want_views", lambda v: (v["camera_id"] == cam) & (v["pose"] == c("pose")))
    # A camera without further poses accepts any pose as its own.
    posed = F.exists("want_views", lambda v: (v["camera_id"] == cam) & (v["pose"] != cam))
    default = F.exists("want_views", lambda v: (v["camera_id"] == cam) & (v["pose"] == cam))
    rules = [
        (F.size("raw") > 1, q._text(cam, "/", c("pose"), ": duplicate camera pose bundle")),
        (~F.coalesce(accepted | (default & ((c("pose") == cam) | ~posed)), F.lit(False)), q._text(view_label, ": camera pose not enabled by recipe")),
        (c("again").isNotNull(), q._text(cam, "/", c("again"), ": light captured more than once")),
        (F.size(F.array_distinct(seqs)) != F.size(seqs), q._text(cam, ": duplicate light_seq_index in captured lights")),
        *[((s["n"] >= 2) & rule, message) for rule, message in capture],
        ((F.size(steady) >= 2) & (delta > c("max_light_mean_delta")), q._text(cam, ": required light mean delta ", digits(delta), " exceeds ", digits(c("max_light_mean_delta")))),
    ]
    have = F.transform("lights", lambda x: x["light_id"])
    lacking = F.transform(F.filter("want_lights", lambda x: ~F.array_contains(have, x["light_id"])), lambda x: F.concat(cam, F.lit(": missing required light "), x["light_id"]))
    messages = F.concat(F.coalesce(lacking, F.array().cast("array<string>")), q._messages(rules))
    return rows.select(*keys, "frames", "failed_frames", "stray_lights", "first_stray", "want_views", "known_recipe", "sku", "sku0", "recipe_sku", messages.alias("messages"))


def job_reports(view_rows: DataFrame, job: list[str]) -> DataFrame:
    """One row per job: ``quality_pass``, numbers of messages and failed frames, and the messages on the job itself."""
    c = F.col
    mine = F.exists("want_views", lambda v: v["camera_id"] == c("camera_id"))
    seen = F.when(mine, F.struct("camera_id", "pose"))
    jobs = view_rows.groupBy(*job, "recipe_id").agg(
        F.sum("frames").alias("frames"), F.sum("failed_frames").alias("failed_frames"), F.sum(F.size("messages") + c("stray_lights")).alias("view_messages"),
        F.collect_set(F.when(mine, c("camera_id"))).alias("cameras"), F.collect_set(F.when(F.array_contains("want_views", seen), seen)).alias("seen"), F.first("want_views").alias("want_views"),
        F.max("known_recipe").alias("known_recipe"), F.max("sku").alias("sku"), F.min("sku0").alias("sku0"), F.first("recipe_sku").alias("recipe_sku"),
    )
    gone = F.filter(
        "want_views", lambda v: ~F.array_contains(c("seen"), v) & ~((v["pose"] == v["camera_id"]) & F.array_contains(c("cameras"), v["camera_id"]))
    )
    said = lambda v: F.when(v["pose"] == v["camera_id"], F.concat(v["camera_id"], F.lit(": missing configured camera bundle"))).otherwise(
        F.concat_ws("/", v["camera_id"], F.concat(v["pose"], F.lit(": missing configured camera pose bundle")))
    )
    other = F.when(c("sku") != c("recipe_sku"), c("sku")).when(c("sku0") != c("recipe_sku"), c("sku0"))
    own = q._messages([(c("known_recipe").isNull(), q._text("unknown recipe: ", c("recipe_id"))), (other.isNotNull(), q._text("sku mismatch: job=", other, " recipe=", c("recipe_sku")))])
    jobs = jobs.withColumn("messages", F.concat(own, F.coalesce(F.transform(gone, said), F.array().cast("array<string>"))))
    total = c("view_messages") + F.size("messages")
    return jobs.select(*job, "recipe_id", "frames", "failed_frames", total.alias("message_count"), "messages", ((total == 0) & (c("failed_frames") == 0)).alias("quality_pass"))
