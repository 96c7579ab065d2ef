"""File listings turned into camera, pose, region and light columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values.
KNOWN_LIGHTS = ["DIFFUSE", "POLAR_DIFFUSE", "HIGH_LEFT"]
KNOWN_CAMERAS = ["TOP_BACK", "TOP_CUSHION", "EYE_IN_HAND"]
OVERLAY_CAMERAS = ["TOP_BACK", "TOP_CUSHION"]


def list_files(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """Path, modification time and size of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "modificationTime", "length")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images as (path, width, height, channels, image bytes)."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(root)
    return rows.select("image.origin", "image.width", "image.height", "image.nChannels", F.col("image.data").alias("image")).toDF(
        "path", "width", "height", "channels", "image"
    )


def _longest(text: Column, names: list[str], test) -> Column:
    """Longest of ``names`` that passes ``test(text, name)``."""
    out = F.lit(None).cast("string")
    for name in sorted(names, key=len):
        out = F.when(test(text, name), F.lit(name)).otherwise(out)
    return out


def _trim_underscores(text: Column) -> Column:
    return F.regexp_replace(text, "_+$", "")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def trace_images(files: DataFrame, path: str = "path", below: str = "images") -> DataFrame:
    """Image paths in three layouts: camera/roi/light, camera/pose/roi/light, and flat ``camera[_pose]_light``.

    ``path`` is relative to the image folder.  A flat name without a known light is left out.
    """
    p = F.col(path)
    parts = F.split(p, "/")
    depth = F.size(parts)
    stem = _stem(p)
    light = _longest(stem, KNOWN_LIGHTS, lambda t, n: t.endswith(n))
    prefix = _trim_underscores(F.substring(stem, F.lit(1), F.length(stem) - F.length(light)))
    camera = F.coalesce(_longest(prefix, KNOWN_CAMERAS, lambda t, n: (t == n) | t.startswith(n + "_")), prefix)
    rest = F.regexp_replace(F.substring(prefix, F.length(camera) + 1, F.length(prefix)), "^_+", "")
    flat = depth == 1
    is_image = F.lower(p).endswith(".png") & (~flat | p.endswith(".png"))
    fields = {
        "camera_id": F.when(flat, camera).otherwise(parts[0]),
        "pose_id": F.when(flat, F.when(rest == "", camera).otherwise(rest)).when(depth == 3, parts[0]).otherwise(parts[1]),
        "roi_name": F.when(flat, F.lit("seat")).otherwise(parts[depth - 2]),
        "light_id": F.when(flat, light).otherwise(stem),
    }
    rows = files.where(is_image & depth.isin(1, 3, 4)).withColumns(fields)
    return rows.where(F.col("light_id").isNotNull())


def overlay_images(files: DataFrame, path: str = "path", cameras: list[str] | None = None) -> DataFrame:
    """Overlay names ``camera[_pose]_roi``: longest camera prefix, the rest split at its last underscore."""
    cameras = cameras or OVERLAY_CAMERAS
    stem = _stem(F.col(path))
    first = sorted(cameras, key=len, reverse=True)[0]
    camera = F.coalesce(_longest(stem, cameras, lambda t, n: (t == n) | t.startswith(n + "_")), F.lit(first))
    suffix = F.regexp_replace(F.substring(stem, F.length(camera) + 1, F.length(stem)), "^_+", "")
    split = suffix.contains("_")
    roi = F.when(split, F.substring_index(suffix, "_", -1)).otherwise(suffix)
    pose = F.when(split, F.substring(suffix, F.lit(1), F.length(suffix) - F.length(roi) - 1)).otherwise(camera)
    return files.withColumns({"camera_id": camera, "pose_id": pose, "roi_name": roi})


def capture_files(files: DataFrame, lights: DataFrame, name: str = "file_name") -> DataFrame:
    """Names ``<camera>_<time>_L<n>_....png`` in any case, with the recipe light at position n."""
    pattern = r"(?i)^(.+)_([0-9]+)_(L[0-9]+)_.+\.png$"
    get = lambda i: F.regexp_extract(name, pattern, i)
    rows = files.where(F.col(name).rlike(pattern)).select(
        name, get(1).alias("camera_id"), get(2).cast("long").alias("timestamp_us"), F.upper(get(3)).alias("capture_light")
    )
    mapped = lights.select(F.concat(F.lit("L"), (F.col("pos") + 1).cast("string")).alias("capture_light"), "light_id", "pos")
    return rows.join(mapped, "capture_light")


def content_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of every file's bytes; ``files`` has path and content (see ``binaryFile``)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
