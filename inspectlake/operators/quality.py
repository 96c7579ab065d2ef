"""Image quality gate: frame, bundle and job checks.

Every check returns message rows (job keys, camera, text), so a job passes when no check names it.
Frame statistics come as pixel rows (``pixel_*``) and, for full-size frames, as ``frame_statistics``
over image bytes; both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from inspectlake.operators.tiles import image_values

POSE = lambda: F.when(F.coalesce("pose_id", F.lit("")) == "", F.col("camera_id")).otherwise(F.col("pose_id"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _messages(rules: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules]))


def _rows(df: DataFrame, keys: list[str], messages: Column) -> DataFrame:
    return df.select(*keys, F.explode(messages).alias("message"))


# --- frame metadata -----------------------------------------------------------------------------


def frame_meta_messages() -> Column:
    """Problems with a frame's format; a frame without a shape is not looked at further."""
    c = F.col
    early = [
        (c("pixel_format") != "MONO8", _text("unsupported pixel_format: ", c("pixel_format"))),
        (c("color_order") != "MONO", _text("unsupported color_order: ", c("color_order"))),
        ((c("dtype") != "UINT8") | (c("bit_depth") != 8), _text("unsupported dtype/bit depth: ", c("dtype"), "/", c("bit_depth"))),
    ]
    shapeless = (c("width") <= 0) | (c("height") <= 0) | (c("channels") <= 0)
    row_width = c("width") * c("channels")
    late = [
        (shapeless, F.lit("invalid image shape")),
        (~shapeless & (c("channels") != 1), _text("expected mono channel count 1, got ", c("channels"))),
        (~shapeless & (c("stride_bytes") < row_width), _text("stride smaller than active row width: ", c("stride_bytes"), " < ", row_width)),
    ]
    return _messages(early + late)


def frame_supported(image_bytes: str | None = None) -> Column:
    """First reason a frame cannot be preprocessed, null when it can."""
    c = F.col
    label = F.concat(c("camera_id"), F.lit("/"), c("light_id"), F.lit(": "))
    issue = (
        F.when(c("pixel_format") != "MONO8", _text("unsupported pixel_format ", c("pixel_format")))
        .when(c("dtype") != "UINT8", _text("unsupported dtype ", c("dtype")))
        .when(c("channels") != 1, F.lit("expected mono image"))
        .when(c("stride_bytes") < c("width") * c("channels"), F.lit("stride smaller than row size"))
    )
    if image_bytes:
        issue = issue.when(c(image_bytes) < c("stride_bytes") * c("height"), F.lit("image shorter than stride"))
    return F.when(issue.isNotNull(), F.concat(label, issue))


def identity_messages(frames: DataFrame, recipes: DataFrame, job: list[str]) -> DataFrame:
    """Job sku against the recipe's, and frames filed under another camera or light."""
    sku = frames.join(recipes.select("recipe_id", "recipe_sku"), "recipe_id")
    jobs = sku.where(F.col("sku") != F.col("recipe_sku")).select(
        *job, _text("sku mismatch: job=", F.col("sku"), " recipe=", F.col("recipe_sku")).alias("message")
    )
    c = F.col
    label = [c("bundle_camera"), "/", c("bundle_light")]
    filed = _messages(
        [
            (c("camera_id") != c("bundle_camera"), _text(*label, ": frame camera_id mismatch ", c("camera_id"))),
            (c("light_id") != c("bundle_light"), _text(*label, ": frame light_id mismatch ", c("light_id"))),
        ]
    )
    return jobs.distinct().unionByName(_rows(frames, job, filed))


# --- views and lights ---------------------------------------------------------------------------


def bundles(frames: DataFrame, job: list[str]) -> DataFrame:
    """Distinct (job, camera, view pose) that were captured."""
    return frames.select(*job, "recipe_id", "camera_id", POSE().alias("pose")).distinct()


def missing_views(frames: DataFrame, views: DataFrame, job: list[str]) -> DataFrame:
    """Configured views without frames; a camera's default view accepts any of its poses."""
    seen = bundles(frames, job)
    required = seen.select(*job, "recipe_id").distinct().join(
        views.select("recipe_id", "camera_id", POSE().alias("pose")).distinct(), "recipe_id"
    )
    open_views = required.join(seen.select(*job, "camera_id", "pose"), [*job, "camera_id", "pose"], "left_anti")
    default = F.col("pose") == F.col("camera_id")
    any_pose = seen.select(*job, "camera_id").distinct()
    missing = open_views.where(~default).unionByName(open_views.where(default).join(any_pose, [*job, "camera_id"], "left_anti"))
    text = F.when(default, _text(F.col("camera_id"), ": missing configured camera bundle")).otherwise(
        _text(F.col("camera_id"), "/", F.col("pose"), ": missing configured camera pose bundle")
    )
    return missing.select(*job, "camera_id", text.alias("message"))


def view_config(rows: DataFrame, views: DataFrame) -> DataFrame:
    """Rows with the settings of their view: the exact pose, else the camera default if it has no other poses."""
    settings = [c for c in views.columns if c not in ("recipe_id", "camera_id", "pose_id")]
    config = views.withColumn("pose", POSE())
    exact = config.select("recipe_id", "camera_id", "pose", F.struct(*settings).alias("_exact"))
    default = F.when(F.col("pose") == F.col("camera_id"), F.struct(*settings))
    per_camera = config.groupBy("recipe_id", "camera_id").agg(
        F.first(default, ignorenulls=True).alias("_default"), F.max(F.col("pose") != F.col("camera_id")).alias("_posed")
    )
    joined = rows.withColumn("pose", POSE()).join(exact, ["recipe_id", "camera_id", "pose"], "left").join(per_camera, ["recipe_id", "camera_id"], "left")
    usable = F.when((F.col("pose") == F.col("camera_id")) | ~F.col("_posed"), F.col("_default"))
    chosen = F.coalesce("_exact", usable)
    return joined.withColumn("_view", chosen).select(
        *rows.columns, "pose", F.col("_view").isNotNull().alias("view_enabled"), *[F.col(f"_view.{s}").alias(s) for s in settings]
    )


def unexpected_views(frames: DataFrame, views: DataFrame, job: list[str]) -> DataFrame:
    """Captured views the recipe does not accept."""
    seen = bundles(frames, job).withColumn("pose_id", F.col("pose")).drop("pose")
    label = F.when(F.col("pose") == F.col("camera_id"), F.col("camera_id")).otherwise(F.concat_ws("/", "camera_id", "pose"))
    return (
        view_config(seen, views).where(~F.col("view_enabled")).select(*job, "camera_id", F.concat(label, F.lit(": camera pose not enabled by recipe")).alias("message"))
    )


def duplicate_bundles(bundle_rows: DataFrame, job: list[str]) -> DataFrame:
    """Views delivered more than once in a job (raw poses that name the same view)."""
    raw = bundle_rows.select(*job, "camera_id", "pose_id", POSE().alias("pose")).distinct()
    twice = raw.groupBy(*job, "camera_id", "pose").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return twice.select(*job, "camera_id", _text(F.col("camera_id"), "/", F.col("pose"), ": duplicate camera pose bundle").alias("message"))


def missing_lights(frames: DataFrame, lights: DataFrame, job: list[str]) -> DataFrame:
    """Required lights without a frame, per captured view."""
    wanted = bundles(frames, job).join(lights.where("required").select("recipe_id", "light_id"), "recipe_id")
    have = frames.select(*job, "camera_id", POSE().alias("pose"), "light_id").distinct()
    lacking = wanted.join(have, [*job, "camera_id", "pose", "light_id"], "left_anti")
    return lacking.select(*job, "camera_id", _text(F.col("camera_id"), ": missing required light ", F.col("light_id")).alias("message"))


# --- capture consistency ------------------------------------------------------------------------


def light_sequence(frames: DataFrame, lights: DataFrame, job: list[str]) -> DataFrame:
    """Lights outside the order, wrong sequence numbers, and numbers used twice."""
    c = F.col
    known = frames.withColumn("pose", POSE()).join(lights.select("recipe_id", "light_id", "pos"), ["recipe_id", "light_id"], "left")
    label = [c("camera_id"), "/", c("light_id")]
    wrong = _messages(
        [
            (c("pos").isNull(), _text(*label, ": light not in configured light_order")),
            (
                c("light_seq_index") != c("pos"),
                _text(*label, ": light_seq_index ", c("light_seq_index"), " does not match configured order ", c("pos")),
            ),
        ]
    )
    twice = (
        known.where(c("pos").isNotNull())
        .groupBy(*job, "camera_id", "pose", "light_seq_index")
        .agg(F.count("*").alias("n"))
        .where(c("n") > 1)
        .select(*job, "camera_id", "pose")
        .distinct()
        .select(*job, "camera_id", _text(c("camera_id"), ": duplicate light_seq_index in captured lights").alias("message"))
    )
    return _rows(known, [*job, "camera_id"], wrong).unionByName(twice)


def _required(frames: DataFrame, lights: DataFrame, job: list[str]) -> tuple[DataFrame, list[str]]:
    rows = frames.withColumn("pose", POSE()).join(
        lights.where("required").select("recipe_id", "light_id", "pos"), ["recipe_id", "light_id"]
    )
    return rows, [*job, "camera_id", "pose"]


def _limit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def capture_rules(s: dict[str, Column], camera: Column, max_span_us, unique_frames) -> list[tuple[Column, Column]]:
    """Rules on a view's n lights: earliest time t0, span, distinct frames and seqs; limits are values or columns."""
    return [
        (s["t0"] <= 0, _text(camera, ": invalid frame timestamp")),
        (s["span"] > _limit(max_span_us), _text(camera, ": capture timestamp span ", s["span"], "us exceeds ", _limit(max_span_us), "us")),
        (_limit(unique_frames) & (s["frames"] != s["n"]), _text(camera, ": duplicate frame_index in required lights")),
        (s["seqs"] != s["n"], _text(camera, ": duplicate light_seq_index in required lights")),
    ]


def exposure_rules(s: dict[str, Column], camera: Column, max_exposure_us, max_gain) -> list[tuple[Column, Column]]:
    """Rules on least value and spread of exposure (e0, de) and gain (g0, dg)."""
    digits = lambda v: F.format_string("%.3f", F.bround(v.cast("double"), 3))
    return [
        (s["e0"] <= 0, _text(camera, ": invalid exposure_us")),
        (s["de"] > _limit(max_exposure_us), _text(camera, ": exposure delta ", s["de"], "us exceeds ", _limit(max_exposure_us), "us")),
        (s["g0"] <= 0, _text(camera, ": invalid gain")),
        (s["dg"] > _limit(max_gain), _text(camera, ": gain delta ", digits(s["dg"]), " exceeds ", digits(_limit(max_gain)))),
    ]


def pose_rules(s: dict[str, Column], label: Column, required, far_xyz: Column, far_rpy: Column) -> list[tuple[Column, Column]]:
    """Rules on how many of n lights have a shot id, a robot time and a pose, and on how far poses lie apart."""
    some, full = (lambda k: s[k] > 0), (lambda k: s[k] == s["n"])
    need, has_pose = _limit(required), s["posed"] > 0
    rules = [
        (need & ~full("shots"), "missing shot_id in required robot lights"),
        (~(need & ~full("shots")) & some("shots") & ~full("shots"), "mixed empty and non-empty shot_id in required lights"),
        (full("shots") & (s["shot_values"] != 1), "inconsistent shot_id in required lights"),
        (need & ~full("times"), "missing robot_timestamp_us in required robot lights"),
        (
            ~(need & ~full("times")) & ((some("times") & ~full("times")) | (~some("times") & has_pose)),
            "mixed empty and non-empty robot_timestamp_us in required lights",
        ),
        (full("times") & (s["time_values"] != 1), "inconsistent robot_timestamp_us in required lights"),
        (need & ~full("posed"), "missing robot TCP/RPY pose in required robot lights"),
        (has_pose & far_xyz, "inconsistent robot_tcp_xyz_mm in required lights"),
        (has_pose & far_rpy, "inconsistent robot_rpy_deg in required lights"),
    ]
    return [(rule, F.concat(label, F.lit(f": {message}"))) for rule, message in rules]


def robot_pose_required(views: DataFrame) -> DataFrame:
    """recipe_id, pose_required: whether a recipe has posed views or one camera several times."""
    per_camera = views.groupBy("recipe_id", "camera_id").agg(F.count("*").alias("n"), F.max(POSE() != F.col("camera_id")).alias("posed"))
    return per_camera.groupBy("recipe_id").agg(F.max(F.col("posed") | (F.col("n") > 1)).alias("pose_required"))


def capture_consistency(frames: DataFrame, lights: DataFrame, job: list[str], max_span_us: int, unique_frames: bool = True) -> DataFrame:
    """Time span, positive times and repeated numbers over a view's required lights (two at least)."""
    rows, view = _required(frames, lights, job)
    c = F.col
    stats = rows.groupBy(*view).agg(
        F.count("*").alias("n"),
        F.min("timestamp_us").alias("t0"),
        (F.max("timestamp_us") - F.min("timestamp_us")).alias("span"),
        F.countDistinct("frame_index").alias("frames"),
        F.countDistinct("light_seq_index").alias("seqs"),
    ).where(c("n") >= 2)
    values = {k: c(k) for k in ("n", "t0", "span", "frames", "seqs")}
    return _rows(stats, [*job, "camera_id"], _messages(capture_rules(values, c("camera_id"), max_span_us, unique_frames)))


def monotonic_times(frames: DataFrame, lights: DataFrame, job: list[str]) -> DataFrame:
    """Views whose times fall in the order of the required lights; one row per light is compared."""
    rows, view = _required(frames, lights, job)
    rows = rows.groupBy(*view, "pos").agg(F.max("timestamp_us").alias("timestamp_us"))
    before = F.lag("timestamp_us").over(Window.partitionBy(*view).orderBy("pos"))
    falling = rows.withColumn("before", before).where(F.col("timestamp_us") < F.col("before")).select(*view).distinct()
    return falling.select(
        *job, "camera_id", _text(F.col("camera_id"), ": timestamps are not monotonic by required light order").alias("message")
    )


def exposure_gain(frames: DataFrame, lights: DataFrame, job: list[str], max_exposure_us: int, max_gain: float) -> DataFrame:
    rows, view = _required(frames, lights, job)
    c = F.col
    stats = rows.groupBy(*view).agg(
        F.count("*").alias("n"),
        F.min("exposure_us").alias("e0"),
        (F.max("exposure_us") - F.min("exposure_us")).alias("de"),
        F.min("gain").alias("g0"),
        (F.max("gain") - F.min("gain")).alias("dg"),
    ).where(c("n") >= 2)
    values = {k: c(k) for k in ("e0", "de", "g0", "dg")}
    return _rows(stats, [*job, "camera_id"], _messages(exposure_rules(values, c("camera_id"), max_exposure_us, max_gain)))


def pose_consistency(
    frames: DataFrame, lights: DataFrame, job: list[str], xyz: list[str], rpy: list[str], tolerance: float = 1e-4, required: bool | str = False
) -> DataFrame:
    """Shot ids and robot times all set, none set or mixed; poses within tolerance of the first required light.

    ``required`` holds for all jobs, or names a boolean column of ``frames`` that says so for each job.

    The first light's pose is carried as an aggregate and compared with per-view extremes, so a view
    is never gathered.
    """
    rows, view = _required(frames, lights, job)
    c = F.col
    moved = reduce(lambda a, b: a | b, [F.abs(c(v)) > 1e-6 for v in xyz + rpy])
    aggs = [
        F.count("*").alias("n"),
        F.count_if(c("shot_id") != 0).alias("shots"),
        F.countDistinct("shot_id").alias("shot_values"),
        F.count_if(c("robot_timestamp_us") != 0).alias("times"),
        F.countDistinct("robot_timestamp_us").alias("time_values"),
        F.count_if(moved).alias("posed"),
    ]
    if isinstance(required, str):
        aggs.append(F.coalesce(F.max(required), F.lit(False)).alias("_required"))
    for v in xyz + rpy:
        aggs += [F.min_by(v, "pos").alias(f"_f_{v}"), F.min(v).alias(f"_lo_{v}"), F.max(v).alias(f"_hi_{v}")]
    stats = rows.groupBy(*view).agg(*aggs).where(c("n") >= 2)
    label = F.when(c("pose") == c("camera_id"), c("camera_id")).otherwise(F.concat_ws("/", "camera_id", "pose"))
    far = lambda names: reduce(
        lambda a, b: a | b,
        [(c(f"_hi_{v}") - c(f"_f_{v}") > tolerance) | (c(f"_f_{v}") - c(f"_lo_{v}") > tolerance) for v in names],
    )
    values = {k: c(k) for k in ("n", "shots", "shot_values", "times", "time_values", "posed")}
    need = c("_required") if isinstance(required, str) else required
    return _rows(stats, [*job, "camera_id"], _messages(pose_rules(values, label, need, far(xyz), far(rpy))))


# --- pixels -------------------------------------------------------------------------------------


def pixel_exposure(pixels: DataFrame, frame: list[str], high: int = 250, low: int = 5) -> DataFrame:
    share = lambda cond: F.avg(cond.cast("double"))
    return pixels.groupBy(*frame).agg(
        F.avg("v").alias("mean_gray"), share(F.col("v") >= high).alias("saturation_ratio"), share(F.col("v") <= low).alias("dark_ratio")
    )


def frame_statistics(frames: DataFrame, keys: list[str], high: int = 250, low: int = 5, kind: str = "u1") -> DataFrame:
    """The five statistics from image bytes, a batch of frames at a time; a short image gives nulls.  ``kind`` is numpy's name of a value."""
    columns = ["mean_gray", "saturation_ratio", "dark_ratio", "sharpness", "motion_gradient"]

    def measure(image, width, height, stride):
        data = image_values(image, width, height, stride, kind)
        if data is None:
            return (None,) * 5
        sharp = motion = 0.0
        if min(width, height) >= 2:
            # First differences serve both: their sizes are the motion value, their own differences the Laplacian.
            grey = data.astype(np.int16 if data.itemsize == 1 else np.int64)
            across, down = np.diff(grey, axis=1), np.diff(grey, axis=0)
            motion = min(float(np.abs(d).mean()) for d in (across, down))
            if min(width, height) >= 3:
                sharp = float(np.abs(np.diff(across, axis=1)[1:-1] + np.diff(down, axis=0)[:, 1:-1]).mean())
        return float(data.mean()), float((data >= high).mean()), float((data <= low).mean()), sharp, motion

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = [measure(*r) for r in zip(batch["image"], batch["width"], batch["height"], batch["stride_bytes"])]
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(stats, columns=columns, dtype="float64")], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys).schema)
    slim = frames.select(*keys, "image", "width", "height", "stride_bytes")
    return slim.mapInPandas(run, f"{fields}, " + ", ".join(f"{c} double" for c in columns))


def statistic_messages(limits: dict[str, float | Column]) -> Column:
    """Texts for statistics outside ``limits``, values or columns (max_saturation_ratio, max_dark_ratio, min/max_mean_gray, min_sharpness, min_motion_gradient)."""
    c = F.col
    return _messages(
        [
            (c("saturation_ratio") > limits["max_saturation_ratio"], F.lit("overexposure saturation ratio exceeded")),
            (c("dark_ratio") > limits["max_dark_ratio"], F.lit("underexposure dark ratio exceeded")),
            (c("mean_gray") < limits["min_mean_gray"], F.lit("underexposure mean gray below threshold")),
            (c("mean_gray") > limits["max_mean_gray"], F.lit("overexposure mean gray above threshold")),
            (c("sharpness") < limits["min_sharpness"], F.lit("sharpness below threshold")),
            (c("motion_gradient") < limits["min_motion_gradient"], F.lit("motion blur gradient below threshold")),
        ]
    )


def light_stability(frames: DataFrame, lights: DataFrame, job: list[str], max_delta: float) -> DataFrame:
    """Views whose passing required lights differ too much in mean gray; ``frames`` has mean_gray and passed."""
    rows, view = _required(frames.where("passed"), lights, job)
    stats = rows.groupBy(*view).agg(F.count("*").alias("n"), (F.max("mean_gray") - F.min("mean_gray")).alias("delta"))
    over = stats.where((F.col("n") >= 2) & (F.col("delta") > max_delta))
    text = _text(F.col("camera_id"), ": required light mean delta ", F.format_string("%.2f", F.bround("delta", 2)), f" exceeds {max_delta:.2f}")
    return over.select(*job, "camera_id", text.alias("message"))


def job_quality(frame_reports: DataFrame, messages: list[DataFrame], job: list[str]) -> DataFrame:
    """Pass per job: no message from any check and every frame passed."""
    said = reduce(lambda a, b: a.unionByName(b), [m.select(*job, "message") for m in messages])
    counts = said.groupBy(*job).agg(F.count("*").alias("messages"))
    frames = frame_reports.groupBy(*job).agg(F.count("*").alias("frames"), F.count_if(~F.col("passed")).alias("failed_frames"))
    n = F.coalesce("messages", F.lit(0))
    return frames.join(counts, job, "left").select(
        *job, "frames", "failed_frames", n.alias("messages"), ((n == 0) & (F.col("failed_frames") == 0)).alias("quality_pass")
    )
