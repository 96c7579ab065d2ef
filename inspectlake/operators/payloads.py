"""Integrity of frame payloads, result records and captured bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.operators.ordered import Ordered

# Error codes.
INVALID_PAYLOAD, CRC_MISMATCH, MISSING_FRAME = 2, 3, 6


def overlapping_ranges(frames: DataFrame, job: list[str], start: str, end: str, tie: str, hot_rows: int | None = None) -> DataFrame:
    """Byte ranges that begin before an earlier range of the same payload has ended."""
    rows = (
        Ordered(frames, job, [start, end, tie], hot_rows).running(_end=("max", F.col(end))).previous(_before=F.col("_end")).result()
    )
    return rows.where(F.col(start) < F.col("_before")).drop("_end", "_before")


def frame_code(known_formats: list[str], payload_size: str, region_start: str) -> Column:
    """Error code of one frame record: its byte range, its checksum, its format name; 0 when good."""
    c = F.col
    outside = (
        (c("image_offset") < c(region_start))
        | (c("image_size") < c("stride_bytes") * c("height"))
        | (c("image_size") <= 0)
        | (c("image_offset") + c("image_size") > c(payload_size))
    )
    return (
        F.when(outside, INVALID_PAYLOAD)
        .when(F.crc32("image") != c("image_crc32"), CRC_MISMATCH)
        .when(~c("pixel_format").isin(known_formats), INVALID_PAYLOAD)
        .otherwise(0)
    )


def payload_integrity(frames: DataFrame, headers: DataFrame, job: list[str], known_formats: list[str]) -> DataFrame:
    """Error code per payload: stated counts, then the first bad frame, overlaps and repeated lights.

    ``headers`` has job keys, frame_count, view_count, payload_size, region_start.  Frames collapse to
    one row per job with map-side partials.
    """
    c = F.col
    rows = frames.join(headers, job).withColumn("code", frame_code(known_formats, "payload_size", "region_start"))
    end = rows.withColumn("image_end", c("image_offset") + c("image_size"))
    clash = overlapping_ranges(end, job, "image_offset", "image_end", "frame_pos").select(*job).distinct().withColumn("_clash", F.lit(True))
    lit = frames.groupBy(*job, "camera_id", "pose_id", "light_id").agg(F.count("*").alias("n"))
    repeated = lit.groupBy(*job).agg(F.max(c("n") > 1).alias("_twice"), F.countDistinct("camera_id", "pose_id").alias("_views"))
    per_job = rows.groupBy(*job).agg(
        F.count("*").alias("_frames"), F.min(F.when(c("code") != 0, F.struct("frame_pos", "code"))).alias("_first")
    )
    joined = headers.join(per_job, job, "left").join(clash, job, "left").join(repeated, job, "left")
    code = (
        F.when(F.coalesce("_frames", F.lit(0)) != c("frame_count"), INVALID_PAYLOAD)
        .when(c("_first").isNotNull(), c("_first.code"))
        .when(F.coalesce("_clash", F.lit(False)) | c("_twice") | (c("_views") != c("view_count")), INVALID_PAYLOAD)
        .otherwise(0)
    )
    return joined.select(*job, code.alias("error_code"))


def result_payload_code(header_bytes: int, defect_bytes: int, max_defects: int = 32) -> Column:
    """Error code of a result record from its stated sizes and checksums; 0 when it can be read."""
    c = F.col
    sized = (
        (c("payload_size") == header_bytes + c("defect_count") * defect_bytes)
        & (c("defect_count") <= max_defects)
        & (c("meta_defect_count") == c("defect_count"))
    )
    return (
        F.when(~sized, INVALID_PAYLOAD)
        .when((F.crc32("payload") != c("payload_crc32")) | (F.crc32("header") != c("header_crc32")), CRC_MISMATCH)
        .otherwise(0)
    )


def bundle_against_plan(frames: DataFrame, plan: DataFrame, job: list[str], recipe: str = "recipe_id") -> DataFrame:
    """First difference between captured frames and the planned views and lights, per job.

    ``frames`` has job keys, recipe, position, camera_id, light_id, width, height, channels, stride_bytes
    and image_size; ``plan`` has recipe, position and the wanted camera, light and shape.
    """
    c = F.col
    jobs = frames.select(*job, recipe).distinct()
    wanted = jobs.join(plan, recipe)
    counts = frames.groupBy(*job).agg(F.count("*").alias("got")).join(wanted.groupBy(*job).agg(F.count("*").alias("want")), job)
    both = wanted.drop(recipe).join(frames.drop(recipe), [*job, "position"], "full_outer")
    issue = (
        F.when((c("camera_id") != c("want_camera")) | (c("light_id") != c("want_light")), F.lit("order"))
        .when(
            (c("image_size") <= 0) | (c("width") != c("want_width")) | (c("height") != c("want_height")) | (c("channels") != c("want_channels"))
            | (c("stride_bytes") < c("width") * c("channels")),
            F.lit("shape"),
        )
        .when(c("image_size") < c("stride_bytes") * c("height"), F.lit("size"))
    )
    first = both.withColumn("issue", issue).groupBy(*job).agg(F.min(F.when(c("issue").isNotNull(), F.struct("position", "issue"))).alias("_first"))
    joined = counts.join(first, job)
    short = c("got") != c("want")
    return joined.select(
        *job,
        F.when(short, F.lit("frame count")).otherwise(F.coalesce("_first.issue", F.lit(""))).alias("issue"),
        F.when(short, MISSING_FRAME).when(c("_first").isNotNull(), INVALID_PAYLOAD).otherwise(0).alias("error_code"),
    )
