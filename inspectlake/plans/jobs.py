"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inspectlake.functions import text
from inspectlake.operators import anomaly as an, datasets as ds, decide, events as ev, fusion as fu, gate, health as h, pixels as px, quality as q, tiles as ti
from inspectlake.operators.ordered import cut_lineage
from inspectlake.operators.recipes import route_models
from inspectlake.sources import json_lines as js, paths

JOB = ["sequence_id"]
INTERNAL_ERROR = 9


def score_embeddings(queries: DataFrame, bank: DataFrame, patches_per_image: int, images: int = 500) -> DataFrame:
    """Calibrate the bank on itself, score every query and decide it: vec_id, distance, score, decision."""
    stats = an.calibrate_thresholds(an.calibrate_distances(bank), patches_per_image, images)
    value = lambda name: stats.select(name).scalar()
    scored = an.nearest_distances(queries, bank).withColumn(
        "score", an.anomaly_score("distance", value("distance_mean"), value("distance_p99"))
    )
    whole = scored.withColumns(
        {"x0": F.lit(0), "y0": F.lit(0), "x1": F.lit(63), "y1": F.lit(47), "area_px": F.lit(3072),
         "recheck_score": value("recheck_score"), "ng_score": value("ng_score"), "camera_id": F.lit("TOP_BACK")}
    )
    # One row per query already: the whole-image candidate decides its job.
    judged = decide.judge_candidates(whole).withColumn("decision", F.coalesce("decision", F.lit("OK")))
    return judged.select("vec_id", "distance", "score", "decision")


def train_bank(
    samples: DataFrame, components: int, coreset_ratio: float, patches_per_image: int, images: int = 500, greedy: bool = False, version: str = "v1"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """OK samples to scoring assets: (bank vectors, PCA, calibrated thresholds).

    ``samples`` has vec_id, embedding, decision, quality_pass and split.
    """
    good = ds.training_ok(samples).select("vec_id", "embedding")
    pca = an.fit_pca(good, components, version)
    model = pca.orderBy("component").collect()
    small = an.pca_project(good, [r["weights"] for r in model], model[0]["mean"])
    bank = an.coreset_greedy(small, coreset_ratio) if greedy else an.coreset_stride(small, coreset_ratio)
    bank = bank.select("vec_id", "embedding")
    thresholds = an.calibrate_thresholds(an.calibrate_distances(bank), patches_per_image, images)
    return bank, pca, thresholds


VIEW = [*JOB, "recipe_id", "camera_id", "pose"]
REGION = [*VIEW, "roi_name"]
PLAN = ["recipe_id", "camera_id", "pose", "roi_name"]


def _registration(crops: DataFrame, regions: DataFrame, alignments: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per region whether its lights lie on its base light (``aligned``), and the shifts found for moved lights.

    A view's base light is its own, else the recipe's fallback; the recipe says whether lights are searched or follow
    from the calibration's matrices.
    """
    limits = ["max_registration_error_px", "method", "max_iterations", "convergence_epsilon", "search_radius_px", "min_correlation", "fallback_light_id"]
    lit = regions.where("in_image").select(*REGION, "light_id", "frame_id", "calibration_id", "view_base_light", "rx0", "ry0", "rx1", "ry1").join(rules.select("recipe_id", *limits), "recipe_id")
    own = lit.groupBy(*REGION).agg(F.max(F.col("light_id") == F.col("view_base_light")).alias("own"))
    lit = cut_lineage(lit.join(own, REGION)).withColumn("base", F.when(F.col("own"), F.col("view_base_light")).otherwise(F.col("fallback_light_id")))
    cubes = lit.groupBy(*REGION, "method", "max_registration_error_px").agg(F.max(F.col("light_id") == F.col("base")).alias("has_base"))

    searched = lit.where("method = 'ecc'")
    images = cut_lineage(ti.whole(crops.join(searched.select(*REGION).distinct(), REGION, "left_semi"), [*REGION, "light_id"]))
    base = images.join(searched.where("light_id = base").select(*REGION, "light_id"), [*REGION, "light_id"], "left_semi").select(*REGION, F.col("image").alias("base"))
    moving = images.withColumnRenamed("image", "moving").join(searched.where("light_id <> base").drop("base", "frame_id"), [*REGION, "light_id"]).join(base, REGION)
    c = F.col
    found = px.search_registration(moving, [*REGION, "light_id"], c("search_radius_px"), c("max_iterations"), c("convergence_epsilon"), c("min_correlation"))
    found = cut_lineage(found)
    report = found.groupBy(*REGION).agg(F.max("error_px").alias("error_px"), F.min("converged").alias("converged"))

    boxed = lit.where("method <> 'ecc'").withColumnsRenamed({"rx0": "x0", "ry0": "y0", "rx1": "x1", "ry1": "y1"})
    fixed = px.fixed_registration(boxed, alignments, REGION, ["calibration_id"], "base", float("inf")).select(*REGION, c("max_error_px").alias("fixed_px"), "is_pass")
    judged = cubes.join(report, REGION, "left").join(fixed, REGION, "left")
    ecc = F.coalesce("converged", F.lit(True)) & (F.coalesce("error_px", F.lit(0.0)) <= c("max_registration_error_px"))
    matrices = F.coalesce(c("is_pass") & (c("fixed_px") <= c("max_registration_error_px")), F.lit(False))
    aligned = judged.select(*REGION, (c("has_base") & F.when(c("method") == "ecc", ecc).otherwise(matrices)).alias("aligned"))
    size = regions.where("in_image").select(*REGION, (c("rx1") - c("rx0") + 1).alias("width"), (c("ry1") - c("ry0") + 1).alias("height")).distinct()
    return aligned, found.where("dx <> 0 OR dy <> 0").select(*REGION, "light_id", "dx", "dy").join(size, REGION)


def inspect(
    frames: DataFrame, recipes: DataFrame, views: DataFrame, lights: DataFrame, rois: DataFrame, models: DataFrame, channels: DataFrame, banks: DataFrame,
    alignments: DataFrame, overrides: DataFrame, embedding_dim: int, xyz: list[str], rpy: list[str],
) -> DataFrame:
    """Frames to one decision per job; the first failing stage decides.

    Everything that differs between recipes is data: ``recipes`` holds limits (gate.DEFAULTS), sku and fallback light;
    ``views`` per (recipe, camera, pose) model, safety net, base light, region template, calibration and image size;
    ``rois`` boxes per template; ``overrides`` models of single regions; ``channels`` the input channels per model;
    ``models`` a model's calibration (mean, p99) and thresholds; ``banks`` vectors per model; ``alignments`` matrices per
    calibration and light.

    Stages, as they end a job: the quality gate (RECHECK/7), a calibration or region that does not fit the image
    (ERROR/9), lights that do not lie on each other (RECHECK/7), a model channel without its light (ERROR/9), a model
    without bank or calibration (RECHECK/13), and the scored candidates.  Images are read twice: measured, and cut into
    tiles for the jobs that passed the gate.
    """
    c = F.col
    rules = cut_lineage(gate.recipe_rules(recipes))
    seen = gate.view_reports(gate.frame_reports(frames, rules), rules, views, lights, JOB, xyz, rpy)
    # One small row per job, used by every later stage.
    jobs = cut_lineage(gate.job_reports(seen, JOB).select(*JOB, "recipe_id", c("quality_pass").alias("gate_pass")))
    passed = frames.join(jobs.where("gate_pass").select(*JOB), JOB, "left_semi")
    meta = cut_lineage(q.view_config(passed.drop("image", "channels"), views))
    misfit = (c("calibration_id") != c("want_calibration")) | (c("width") != c("image_w")) | (c("height") != c("image_h"))
    regions = cut_lineage(px.frame_rois(meta, rois, ["roi_template"]))
    broken = meta.where(misfit).select(*JOB).union(regions.where("NOT in_image").select(*JOB)).distinct().withColumn("broken", F.lit(True))

    tiles = ti.image_tiles(passed, ["frame_id"])
    crops = cut_lineage(ti.crop(tiles, regions, ["frame_id"]).join(meta.select("frame_id", *VIEW, "light_id"), "frame_id").drop("frame_id"))
    aligned, shifts = _registration(crops, regions, alignments, rules)
    aligned = cut_lineage(aligned)
    unaligned = aligned.where("NOT aligned").select(*JOB).distinct().withColumn("unaligned", F.lit(True))
    lit = [*REGION, "light_id"]
    shifts = cut_lineage(shifts)
    moved = cut_lineage(crops.join(shifts, lit, "left_anti").unionByName(ti.apply_shifts(crops.join(shifts, lit, "left_semi"), shifts, lit)))

    settings = meta.select(*VIEW, "model_key", "safety_net_key").distinct()
    inside = regions.where("in_image").select(*REGION).distinct()
    routes = cut_lineage(route_models(inside, settings, overrides, VIEW, ["recipe_id", "camera_id", "roi_name"]).select(*REGION, "model_key", "role"))
    specs = px.channel_specs(channels)
    plans = routes.select(*PLAN, "model_key").distinct().join(specs, "model_key")
    plans = cut_lineage(plans)
    built, missing = ti.light_channels(moved, plans.drop("model_key", "pos").distinct(), REGION, PLAN)
    bad_names = routes.join(specs.where("NOT valid"), "model_key", "left_semi")
    no_channel = missing.select(*JOB).union(bad_names.select(*JOB)).distinct().withColumn("no_channel", F.lit(True))

    ready = models.where("mean IS NOT NULL AND p99 IS NOT NULL").join(banks.select("model_key").distinct(), "model_key", "left_semi")
    no_asset = routes.join(ready, "model_key", "left_anti").select(*JOB).distinct().withColumn("no_asset", F.lit(True))
    positions = plans.where("valid").select(*PLAN, "model_key", "channel", "pos")
    vectors = ti.statistical_embedding(built, REGION, positions, embedding_dim, per_model=[*PLAN, "model_key"])
    keyed = cut_lineage(vectors.join(ready.select("model_key"), "model_key", "left_semi").withColumn("vec_id", F.monotonically_increasing_id()))
    near = an.nearest_distances(keyed.select("vec_id", "model_key", "embedding"), banks, groups=["model_key"])
    scored = keyed.drop("embedding").join(near, "vec_id").join(ready, "model_key").withColumn("score", an.anomaly_score("distance", c("mean"), c("p99")))

    boxes = inside.join(regions.select(*REGION, c("rx0").alias("x0"), c("ry0").alias("y0"), c("rx1").alias("x1"), c("ry1").alias("y1")).distinct(), REGION)
    shown = px.evidence_lights(specs, ["model_key"], "pos")
    # A bank's own thresholds win; the recipe's stand in for what it lacks.
    limits = rules.select("recipe_id", c("recheck_score").alias("_recheck"), c("ng_score").alias("_ng"), "min_area_px", "min_aspect_ratio", "max_aspect_ratio", "iou_threshold", "max_candidates_per_roi")
    candidates = (
        scored.join(boxes, REGION).join(routes, [*REGION, "model_key"]).join(shown, "model_key").join(limits, "recipe_id")
        .where(c("score") >= F.coalesce("recheck_score", "_recheck"))
    )
    candidates = cut_lineage(candidates)
    fused = fu.merge_candidates(candidates, REGION, ["role"], c("iou_threshold"), c("max_candidates_per_roi")).join(limits, "recipe_id")
    judged = decide.judge_candidates(fused, c("_recheck"), c("_ng"), c("min_area_px"), c("min_aspect_ratio"), c("max_aspect_ratio"))

    flagged = jobs
    for flag in (broken, unaligned, no_channel, no_asset):
        flagged = flagged.join(flag, JOB, "left")
    flagged = cut_lineage(flagged)
    decided = decide.job_decisions(flagged.select(*JOB, c("gate_pass").alias("quality_pass")), judged, JOB)
    on = lambda name: F.coalesce(name, F.lit(False))
    end = (
        F.when(~c("gate_pass"), F.struct(F.lit("RECHECK").alias("d"), F.lit(decide.QUALITY_FAILED).alias("e"), F.lit(False).alias("q")))
        .when(on("broken"), F.struct(F.lit("ERROR").alias("d"), F.lit(INTERNAL_ERROR).alias("e"), F.lit(False).alias("q")))
        .when(on("unaligned"), F.struct(F.lit("RECHECK").alias("d"), F.lit(decide.QUALITY_FAILED).alias("e"), F.lit(False).alias("q")))
        .when(on("no_channel"), F.struct(F.lit("ERROR").alias("d"), F.lit(INTERNAL_ERROR).alias("e"), F.lit(False).alias("q")))
        .when(on("no_asset"), F.struct(F.lit("RECHECK").alias("d"), F.lit(decide.CONFIGURATION_ERROR).alias("e"), F.lit(True).alias("q")))
    )
    out = decided.join(flagged, JOB).withColumn("_end", end)
    return out.select(
        *JOB,
        F.coalesce("_end.d", "decision").alias("decision"),
        F.coalesce("_end.e", "error_code").alias("error_code"),
        F.coalesce("_end.q", "quality_pass").alias("quality_pass"),
        F.when(c("_end").isNull(), c("defect_count")).otherwise(0).alias("defect_count"),
    )


def collect_traces(files: DataFrame, images: DataFrame, defects: DataFrame, split: str = "unassigned", label: str = "unlabeled") -> tuple[DataFrame, DataFrame]:
    """Result directories and their images to manifest samples and a summary.

    ``images`` has trace_dir and a ``path`` relative to its image folder; ``defects`` trace_dir, region and box.
    """
    traces = js.result_traces(files).where("issue IS NULL").drop("issue")
    listed = paths.trace_images(images).join(traces, "trace_dir")
    joined = ds.defect_images(listed, defects, ["trace_dir", "camera_id", "pose_id", "roi_name"])
    name = F.substring_index("trace_dir", "/", -1)
    samples = joined.withColumns({"split": F.lit(split), "label_status": F.lit(label)}).withColumn(
        "sample_id", text.sample_id(name, "trace_dir", "sequence_id", "camera_id", "pose_id", "roi_name", "light_id")
    ).withColumnRenamed("trace_dir", "source_trace_dir")
    return samples, ds.dataset_summary(samples)


def collect_captures(files: DataFrame, lights: DataFrame, rois: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Capture names to samples per region, cameras set aside, and a summary."""
    captures = paths.capture_files(files, lights)
    groups, skipped = ds.capture_zip(captures, required, ["timestamp_us", "file_name"])
    samples = groups.join(rois.select("camera_id", "roi_name"), "camera_id").select(
        F.col("sequence_index").alias("sequence_id"), "camera_id", F.col("camera_id").alias("pose_id"), "roi_name", "light_id", F.col("file_name").alias("image_path"),
        F.lit("unassigned").alias("split"), F.lit("unlabeled").alias("label_status"),
    )
    return samples, skipped, ds.capture_summary(samples, skipped)


def evaluate(predictions: DataFrame, truths: DataFrame, images: DataFrame, keys: list[str], order: list[str], iou: float = 0.5, score: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Per-image counts and the totals by region, camera and split; ``images`` names the images and their split."""
    counts = fu.match_detections(predictions, truths, keys, order, iou, score)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("true_positives", "false_positives", "false_negatives")}
    per_image = fu.precision_recall(images.join(counts, keys, "left").withColumns(zero))
    return per_image, fu.evaluation_totals(per_image, ["roi_name", "camera_id", "split"])


def score_captures(samples: DataFrame, vectors: DataFrame, bank: DataFrame, stats: dict[str, float], sample_index: int) -> DataFrame:
    """Score one capture number over all cameras: decision and strongest region per camera."""
    chosen = samples.where(F.col("sequence_id") == sample_index).join(vectors, "image_path")
    near = an.nearest_distances(chosen.select("vec_id", "embedding"), bank)
    scored = chosen.join(near, "vec_id").withColumn("score", an.anomaly_score("distance", stats["mean"], stats["p99"]))
    decision = F.when(F.max("score") >= stats["ng"], F.lit("NG")).when(F.max("score") >= stats["recheck"], F.lit("RECHECK")).otherwise(F.lit("OK"))
    return scored.groupBy("sequence_id", "camera_id").agg(
        decision.alias("decision"), F.max("score").alias("max_score"), F.max_by("roi_name", F.struct("score", "roi_name")).alias("roi_name"), F.count("*").alias("regions")
    )


def line_report(results: DataFrame, defects: DataFrame, actions: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Counts, defect labels, health, alarms and open reviews of a line."""
    identity = [*keys, "sequence_id", "trigger_id", "seat_id", "ts_us"]
    once = ev.dedupe_events(results, identity, ["decision"])
    order = ["ts_us", "sequence_id"]
    slim = once.select(*keys, *order, "decision", "error_code")
    alarms = h.alarm_levels(slim, keys, order)
    current = alarms.groupBy(*keys).agg(F.max_by("alarm_level", F.struct(*order)).alias("alarm_level"), F.max("streak").alias("longest_streak"))
    return {
        "counts": ev.decision_counts(once, keys),
        "labels": ev.defect_distribution(once, defects, [*keys, "sequence_id"]),
        "counters": h.station_counters(once, keys),
        "alarms": current,
        "reviews": ev.review_queue(actions, [*keys, "review_id"]).groupBy(*keys).agg(F.count("*").alias("open_reviews")),
    }
