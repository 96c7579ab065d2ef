"""Regions of frames, channel names, base lights, patch grids and registration; ``tiles`` has the work on image values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.functions.boxes import apply_homography

# Short channel names.
CHANNEL_ALIASES = {
    "ch0_diffuse": "light:DIFFUSE",
    "ch1_polar_diffuse": "light:POLAR_DIFFUSE",
    "ch2_high_left": "light:HIGH_LEFT",
    "ch3_high_right": "light:HIGH_RIGHT",
    "ch4_high_max_min": "max_min:HIGH_LEFT:HIGH_RIGHT",
    "optional_dark_low_lr_diff": "abs_diff:LOW_LEFT:LOW_RIGHT",
    "optional_dark_low_max_min": "max_min:LOW_LEFT:LOW_RIGHT",
    "aux_local_contrast": "local_contrast:DIFFUSE",
    "aux_specular_removed": "abs_diff:DIFFUSE:POLAR_DIFFUSE",
}
UNALIGNED = 999.0


# --- regions ------------------------------------------------------------------------------------


def frame_rois(frames: DataFrame, rois: DataFrame, view: list[str]) -> DataFrame:
    """Each frame once per region of its view, with ``in_image`` false where the region leaves the frame."""
    inside = (F.col("rx0") >= 0) & (F.col("ry0") >= 0) & (F.col("rx1") < F.col("width")) & (F.col("ry1") < F.col("height"))
    return frames.join(rois, view).withColumn("in_image", inside)


# --- light channels -----------------------------------------------------------------------------


def channel_specs(channels: DataFrame) -> DataFrame:
    """Channel names (with their keys) as operation and ordered lights; ``valid`` is false for an unknown form."""
    alias = F.create_map(*[F.lit(v) for pair in CHANNEL_ALIASES.items() for v in pair])
    parts = F.transform(F.split(F.coalesce(alias[F.col("channel")], F.col("channel")), ":"), lambda p: F.trim(p))
    lights = F.slice(parts, F.lit(2), F.size(parts))
    n, op = F.size(lights), parts[0]
    whole = ~F.exists(parts, lambda p: p == "")
    valid = whole & (
        (op.isin("light", "local_contrast") & (n == 1)) | ((op == "abs_diff") & (n == 2)) | ((op == "max_min") & (n >= 2))
    )
    return channels.select("*", op.alias("operation"), lights.alias("lights"), valid.alias("valid"))


def evidence_lights(specs: DataFrame, model: list[str], pos: str) -> DataFrame:
    """Lights behind a model's channels, first mention first (a model has few channels)."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, "lights")))
    return specs.where("valid").groupBy(*model).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["lights"]))).alias("evidence_lights"))


def base_light(frames: DataFrame, views: DataFrame, on: list[str], cube: list[str], fallback: str, box: list[str]) -> DataFrame:
    """Per cube the view's base light, else the fallback; its box, else the box of any frame."""
    rows = frames.join(views, on)
    is_base, is_fallback = F.col("light_id") == F.col("view_base_light"), F.col("light_id") == F.col(fallback)
    pick = lambda cond: F.max(F.when(cond, F.struct(*box)))
    agg = rows.groupBy(*cube, "view_base_light", fallback).agg(
        pick(is_base).alias("b"), pick(is_fallback).alias("f"), F.min_by(F.struct(*box), F.struct("light_id", "frame_id")).alias("any")
    )
    base = F.when(F.col("b").isNotNull(), F.col("view_base_light")).otherwise(F.col(fallback))
    chosen = F.coalesce("b", "f", "any")
    return agg.select(*cube, base.alias("base_light_id"), (F.col("b").isNotNull() | F.col("f").isNotNull()).alias("has_base"), *[chosen[c].alias(c) for c in box])


# --- patch grids --------------------------------------------------------------------------------


def assemble_patches(cells: DataFrame, image: list[str], height: int, width: int) -> DataFrame:
    """Layer maps on one grid: the nearest cell of every layer, vectors joined in layer order.

    ``cells`` has image keys, layer, layer_h, layer_w, row, col and vector.
    """
    layers = cells.select(*image, "layer", "layer_h", "layer_w").distinct()
    grid = layers.withColumn("patch_row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "patch_col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    nearest = lambda i, size, target: F.least(F.floor(F.col(i) * F.col(size) / target), F.col(size) - 1).cast("int")
    wanted = grid.withColumns({"row": nearest("patch_row", "layer_h", height), "col": nearest("patch_col", "layer_w", width)})
    joined = wanted.join(cells.select(*image, "layer", "row", "col", "vector"), [*image, "layer", "row", "col"])
    ordered = F.array_sort(F.collect_list(F.struct("layer", "vector")))
    return joined.groupBy(*image, "patch_row", "patch_col").agg(F.flatten(F.transform(ordered, lambda s: s["vector"])).alias("embedding"))


# --- registration -------------------------------------------------------------------------------


def fixed_registration(frames: DataFrame, alignment: DataFrame, cube: list[str], on: list[str], base: str, max_error_px: float) -> DataFrame:
    """Corner displacement of every light by its calibration matrix; no base light or matrix fails the cube.

    ``frames`` has the region box (x0, y0, x1, y1) and the cube's ``base`` light.
    """
    rows = frames.join(alignment.select(*on, "light_id", "matrix"), [*on, "light_id"], "left")
    pt = lambda x, y: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"))
    corners = rows.withColumn("p", F.explode(F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"))))
    mx, my = apply_homography("matrix", "p.cx", "p.cy")
    moved = F.sqrt((mx - F.col("p.cx")) * (mx - F.col("p.cx")) + (my - F.col("p.cy")) * (my - F.col("p.cy")))
    error = F.coalesce(moved, F.lit(UNALIGNED))
    agg = corners.withColumn("error", error).groupBy(*cube).agg(
        F.max(F.col("light_id") == F.col(base)).alias("has_base"),
        F.max(F.col("matrix").isNull()).alias("no_matrix"),
        F.min(F.when(F.col("matrix").isNull(), F.col("light_id"))).alias("bare"),
        F.max("error").alias("max_e"),
        F.avg("error").alias("mean_e"),
    )
    broken = ~F.col("has_base") | F.col("no_matrix")
    top = F.when(broken, F.lit(UNALIGNED)).otherwise(F.col("max_e"))
    ok = ~broken & (F.col("max_e") <= max_error_px)
    message = (
        F.when(~F.col("has_base"), F.lit("missing base light"))
        .when(F.col("no_matrix"), F.concat(F.lit("missing alignment matrix for "), "bare"))
        .when(ok, F.lit("fixed calibration alignment pass"))
        .otherwise(F.lit("registration error exceeds threshold"))
    )
    return agg.select(
        *cube, top.alias("max_error_px"), F.when(broken, F.lit(UNALIGNED)).otherwise(F.col("mean_e")).alias("mean_error_px"), ok.alias("is_pass"), message.alias("message")
    )


def _correlation(base: np.ndarray, moving: np.ndarray, dx: int, dy: int) -> float:
    h, w = min(base.shape[0], moving.shape[0]), min(base.shape[1], moving.shape[1])
    a = base[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)]
    b = moving[max(dy, 0) : h - max(-dy, 0), max(dx, 0) : w - max(-dx, 0)]
    if a.size < 4:
        return -1.0
    var_a = (a * a).sum() - a.sum() ** 2 / a.size
    var_b = (b * b).sum() - b.sum() ** 2 / b.size
    spread = float(np.sqrt(max(var_a * var_b, 0.0)))
    return -1.0 if spread <= 1e-9 else float(((a * b).sum() - a.sum() * b.sum() / a.size) / spread)


def search_registration(
    pairs: DataFrame,
    keys: list[str],
    radius: int | Column = 3,
    max_iterations: int | Column = 50,
    epsilon: float | Column = 1e-4,
    min_correlation: float | Column = 0.8,
    kind: str = "u1",
) -> DataFrame:
    """Best whole-pixel shift of ``moving`` against ``base`` (image bytes, width, height): one row per pair.

    Rings of growing distance, stopping when a ring gains less than ``epsilon`` or after ``max_iterations``
    tries; the first best shift wins.  Only two images are in hand at a time.  The limits are numbers or columns;
    ``kind`` is numpy's name of an image's value.
    """

    def search(base, moving, width, height, radius, max_iterations, epsilon, min_correlation):
        a = np.frombuffer(base, dtype=kind).reshape(height, width).astype(np.float64)
        b = np.frombuffer(moving, dtype=kind).reshape(height, width).astype(np.float64)
        best, shift, last, tries = -1.0, (0, 0), -1.0, 0
        for ring in range(min(radius, 10) + 1):
            steps = [(x, y) for y in range(-ring, ring + 1) for x in range(-ring, ring + 1) if max(abs(x), abs(y)) == ring]
            for dx, dy in steps[: max_iterations - tries]:
                value = _correlation(a, b, dx, dy)
                if value > best:
                    best, shift = value, (dx, dy)
            tries += min(len(steps), max_iterations - tries)
            if tries >= max_iterations or (ring > 0 and abs(best - last) < epsilon):
                break
            last = best
        return shift[0], shift[1], best, tries, best >= min_correlation and best >= 0.0, float(np.hypot(*shift))

    names = ["dx", "dy", "correlation", "iterations", "converged", "error_px"]
    inputs = ["base", "moving", "width", "height", "_radius", "_tries", "_gain", "_least"]
    limits = {"_radius": (radius, "int"), "_tries": (max_iterations, "int"), "_gain": (epsilon, "double"), "_least": (min_correlation, "double")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [search(*r) for r in zip(*(batch[c] for c in inputs))]
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    limited = pairs.withColumns({n: (v if isinstance(v, Column) else F.lit(v)).cast(kind) for n, (v, kind) in limits.items()})
    return limited.select(*keys, *inputs).mapInPandas(
        run, f"{fields}, dx int, dy int, correlation double, iterations int, converged boolean, error_px double"
    )


def registration_report(alignments: DataFrame, cube: list[str], max_error_px: float | Column) -> DataFrame:
    """Per cube: pass only if every light converged and the largest shift is within the limit."""
    agg = alignments.groupBy(*cube).agg(
        F.max("error_px").alias("max_error_px"), F.avg("error_px").alias("mean_error_px"), F.min("converged").alias("all_converged")
    )
    return agg.withColumn("is_pass", F.col("all_converged") & (F.col("max_error_px") <= max_error_px)).drop("all_converged")
