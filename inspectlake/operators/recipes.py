"""Recipe, calibration and model-asset dimensions: inheritance, routing and constraint checks.

Dimension tables join by key; Spark broadcasts them when their size allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.functions.boxes import polygon_area


def inherit_defaults(views: DataFrame, defaults: DataFrame, fields: list[str]) -> DataFrame:
    """Enabled views with every unset field taken from their recipe's defaults; an empty pose is the camera's own."""
    base = defaults.select("recipe_id", *[F.col(f).alias(f"_d_{f}") for f in fields])
    filled = {f: F.coalesce(f, f"_d_{f}") for f in fields}
    pose = F.when(F.coalesce("pose_id", F.lit("")) == "", F.col("camera_id")).otherwise(F.col("pose_id"))
    return (
        views.where(F.coalesce("enabled", F.lit(True)))
        .join(base, "recipe_id", "left")
        .withColumns({**filled, "pose_id": pose})
        .drop(*[f"_d_{f}" for f in fields])
    )


def _issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def recipe_issues(views: DataFrame, lights: DataFrame, models: DataFrame) -> DataFrame:
    """Broken recipe constraints: (recipe_id, issue, item).

    ``lights`` has recipe_id, pos, light_id, required; ``views`` their base light and model keys;
    ``models`` recipe_id, model_key, role, backend, memory_bank_path, embedding_backend.
    """
    row = lambda df, issue, item: df.select("recipe_id", F.lit(issue).alias("issue"), F.col(item).cast("string").alias("item"))
    once = lights.groupBy("recipe_id", "light_id").agg(F.count("*").alias("n"), F.max("required").alias("required"))
    ordered = lights.where("in_order").select("recipe_id", "light_id").distinct()
    base = views.select("recipe_id", F.col("base_light_id").alias("light_id"), "camera_id")
    refs = views.select("recipe_id", "model_key", F.lit("primary").alias("want")).unionByName(
        views.where(F.coalesce("safety_net_key", F.lit("")) != "").select("recipe_id", F.col("safety_net_key").alias("model_key"), F.lit("safety_net").alias("want"))
    ).distinct()
    known = models.select("recipe_id", "model_key", "role")
    linked = refs.join(known, ["recipe_id", "model_key"], "left")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    knn = models.where("backend = 'patchcore_knn'")
    twice = views.groupBy("recipe_id", "camera_id", "pose_id").agg(F.count("*").alias("n")).where("n > 1").withColumn("view", F.concat_ws("/", "camera_id", "pose_id"))
    return _issues(
        [
            row(once.where("n > 1"), "duplicate light", "light_id"),
            row(once.where("required").join(ordered, ["recipe_id", "light_id"], "left_anti"), "required light not in order", "light_id"),
            row(base.join(ordered, ["recipe_id", "light_id"], "left_anti").select("recipe_id", "light_id").distinct(), "base light not in order", "light_id"),
            row(base.join(once.where("required"), ["recipe_id", "light_id"], "left_anti").select("recipe_id", "light_id").distinct(), "base light not required", "light_id"),
            row(twice, "duplicate view", "view"),
            row(linked.where("role IS NULL"), "unknown model", "model_key"),
            row(linked.where("role <> want"), "wrong model role", "model_key"),
            row(knn.where(empty("memory_bank_path")), "memory bank path missing", "model_key"),
            row(knn.where(empty("embedding_backend") | (F.col("embedding_backend") == "none")), "embedding backend missing", "model_key"),
        ]
    )


def threshold_issue(recheck: str, ng: str) -> Column:
    """Thresholds must be finite shares in order."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)
    return (
        F.when(bad(recheck), F.lit("recheck_score out of range"))
        .when(bad(ng), F.lit("ng_score out of range"))
        .when(F.col(recheck) > F.col(ng), F.lit("recheck_score above ng_score"))
    )


def polygon_issue(points: str) -> Column:
    """A region needs three points, none twice, around some area; points are structs (x, y)."""
    p = F.col(points)
    return (
        F.when(F.size(p) < 3, F.lit("fewer than 3 points"))
        .when(F.size(F.array_distinct(p)) != F.size(p), F.lit("repeated point"))
        .when(polygon_area(p) <= 0, F.lit("no area"))
    )


def calibration_dims(calibrations: DataFrame, own_rois: DataFrame, view_rois: DataFrame, views: DataFrame) -> DataFrame:
    """Regions of each view: the view's own file replaces those of its calibration.

    Every row carries ``issue``: another camera's calibration, a bad matrix or a bad polygon.
    """
    c = F.col
    used = views.join(calibrations, "calibration_id", "left")
    overridden = view_rois.select("view_id").distinct().withColumn("_own", F.lit(True))
    flagged = used.join(overridden, "view_id", "left")
    from_view = flagged.where("_own").join(view_rois, "view_id")
    from_calibration = flagged.where("_own IS NULL").join(own_rois, "calibration_id", "left")
    columns = ["view_id", "camera_id", "calibration_id", "calibration_camera", "matrix", "roi_name", "points"]
    rows = from_view.select(*columns).unionByName(from_calibration.select(*columns))
    finite = (F.size("matrix") == 9) & ~F.exists("matrix", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    issue = (
        F.when(c("calibration_camera").isNull(), F.lit("calibration missing"))
        .when(c("calibration_camera") != c("camera_id"), F.lit("camera mismatch"))
        .when(~finite, F.lit("matrix needs 9 finite numbers"))
        .when(c("roi_name").isNull(), F.lit("no region"))
        .otherwise(polygon_issue("points"))
    )
    return rows.withColumn("issue", issue)


def match_calibration(frames: DataFrame, dims: DataFrame, on: list[str]) -> DataFrame:
    """Frames with ``mismatch``: their calibration id or image size is not the view's."""
    c = F.col
    mismatch = (
        F.when(c("calibration_id") != c("want_calibration"), F.lit("calibration_id"))
        .when((c("width") != c("image_w")) | (c("height") != c("image_h")), F.lit("image_size"))
        .otherwise(F.lit(""))
    )
    return frames.join(dims, on).withColumn("mismatch", mismatch)


def physical_light(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Semantic light names mapped to mounted lights; an unmapped name stands for itself."""
    return rows.join(mapping, "semantic_light", "left").withColumn("physical_light", F.coalesce("mapped_light", "semantic_light"))


def route_models(regions: DataFrame, views: DataFrame, overrides: DataFrame, on: list[str], roi_on: list[str]) -> DataFrame:
    """Model per region: its own, else the view's; plus one row for a safety-net model."""
    joined = regions.join(views, on).join(overrides, roi_on, "left")
    primary = joined.withColumn("model_key", F.coalesce("roi_model_key", "model_key")).withColumn("role", F.lit("primary"))
    net = joined.where(F.coalesce("safety_net_key", F.lit("")) != "").withColumn("model_key", F.col("safety_net_key")).withColumn("role", F.lit("safety_net"))
    return primary.unionByName(net).drop("roi_model_key", "safety_net_key")


def default_model(models: DataFrame, recipe: list[str]) -> DataFrame:
    """First model with an embedding backend, else the first of the PatchCore family."""
    embeds = (F.coalesce("embedding_backend", F.lit("none")) != "none").cast("int")
    usable = models.where((embeds == 1) | (F.col("model_family") == "patchcore"))
    return usable.groupBy(*recipe).agg(F.min_by("model_key", F.struct(-embeds, F.col("pos"))).alias("model_key"))


def asset_issues(models: DataFrame, pca: DataFrame, banks: DataFrame, indexes: DataFrame) -> DataFrame:
    """Models against their PCA, bank and index: (model_key, severity, issue), one row per problem."""
    c = F.col
    joined = (
        models.join(pca, "pca_key", "left").join(banks, "bank_key", "left").join(indexes, "index_key", "left")
    )
    rule = lambda cond, severity, issue: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue")))
    has_pca, has_bank, has_index = c("pca_key").isNotNull(), c("bank_dim").isNotNull(), c("index_dim").isNotNull()
    vector_dim = F.when(has_pca, c("pca_output_dim")).otherwise(c("embedding_dim"))
    rules = F.array_compact(
        F.array(
            rule(has_pca & c("pca_input_dim").isNull(), "error", "pca missing"),
            rule(c("pca_input_dim") != c("embedding_dim"), "error", "pca input dimension"),
            rule(c("pca_version") != c("want_pca_version"), "error", "pca version"),
            rule(~has_bank, "error", "bank missing"),
            rule(has_bank & (c("bank_dim") != vector_dim), "error", "bank dimension"),
            rule(has_bank & (c("bank_pca_version") != c("want_pca_version")), "error", "bank pca version"),
            rule(has_bank & (c("bank_vectors") <= 0), "error", "bank empty"),
            rule(has_bank & ~c("calibrated"), "error", "bank not calibrated"),
            rule(has_bank & (c("bank_channels") != c("input_channels")), "error", "input channels"),
            rule(has_bank & (c("bank_shape") != c("spatial_shape")), "error", "spatial shape"),
            rule(c("index_key").isNotNull() & ~has_index, "warning", "index missing"),
            rule(has_index & (c("index_dim") != c("bank_dim")), "error", "index dimension"),
            rule(has_index & (c("index_vectors") != c("bank_vectors")), "error", "index size"),
            rule(has_index & (c("index_hash") != c("bank_hash")), "warning", "index built from other vectors"),
        )
    )
    return joined.select("model_key", F.explode(rules).alias("r")).select("model_key", "r.severity", "r.issue")
