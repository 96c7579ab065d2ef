"""Detector rows and masks, detection checks, and region location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inspectlake.functions.boxes import denorm_bbox, iou_xyxy

BOX = ["x0", "y0", "x1", "y1"]


def decode_row_table(rows: DataFrame, raw: str) -> DataFrame:
    """Rows that already are x0, y0, x1, y1, score, class."""
    names = [*BOX, "score", "class_id"]
    return rows.select("*", *[F.col(raw)[i].cast("double").alias(n) for i, n in enumerate(names)]).drop(raw)


def decode_class_scores(rows: DataFrame, raw: str, min_score: float) -> DataFrame:
    """Centre boxes with one score per class: best class (first on a tie), corner box, score at least ``min_score``."""
    r = F.transform(F.col(raw), lambda v: v.cast("double"))
    scored = rows.withColumn("_r", r).withColumn("_s", F.slice("_r", 5, F.size("_r") - 4)).withColumn("score", F.array_max("_s"))
    kept = scored.where(F.col("score") >= min_score)
    x, y, hw, hh = (F.col("_r")[i] for i in range(4))
    return kept.select(
        *[c for c in rows.columns if c != raw],
        (x - hw / 2).alias("x0"), (y - hh / 2).alias("y0"), (x + hw / 2).alias("x1"), (y + hh / 2).alias("y1"),
        "score", (F.array_position("_s", F.col("score")) - 1).cast("double").alias("class_id"),
    )


def decode_mask_rows(rows: DataFrame, raw: str, min_score: float, mask_threshold: float) -> DataFrame:
    """Rows with six numbers and a square mask: kept detections, one row per mask pixel."""
    r = F.transform(F.col(raw), lambda v: v.cast("double"))
    kept = rows.withColumn("_r", r).where(F.col("_r")[4] >= min_score)
    side = F.rint(F.sqrt(F.size("_r") - F.lit(6))).cast("int")
    pixels = kept.select(*[c for c in rows.columns if c != raw], F.col("_r")[4].alias("score"), side.alias("side"), F.posexplode(F.slice("_r", 7, F.size("_r"))).alias("p", "value"))
    return pixels.select(
        *[c for c in pixels.columns if c not in ("p", "value", "side")],
        (F.col("p") % F.col("side")).cast("int").alias("x"), F.floor(F.col("p") / F.col("side")).cast("int").alias("y"),
        (F.col("value") >= mask_threshold).cast("int").alias("m"),
    )


def decode_proto_masks(coefficients: DataFrame, protos: DataFrame, det: list[str], frame: list[str], mask_threshold: float) -> DataFrame:
    """Masks as a weighted sum of the frame's prototypes: sigmoid of the sum against the threshold.

    ``coefficients`` has det and frame keys, k, c; ``protos`` has frame keys, k, x, y, v.
    """
    logits = coefficients.join(protos, [*frame, "k"]).groupBy(*det, "x", "y").agg(F.sum(F.col("c") * F.col("v")).alias("logit"))
    clipped = F.greatest(F.lit(-80.0), F.least(F.lit(80.0), F.col("logit")))
    return logits.withColumn("m", (F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped)) >= mask_threshold).cast("int")).drop("logit")


def _bad_number(*columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return out


def check_detections(detections: DataFrame, width: int, height: int, min_score: float, normalised: bool = False) -> DataFrame:
    """Detections at or above ``min_score`` in pixels, with ``issue`` for rows that fail their job."""
    c = F.col
    box = [c(b) for b in BOX]
    outside = F.lit(False)
    for b, limit in zip(box, (width, height, width, height)):
        outside = outside | (b < 0) | (b > (1.0 if normalised else limit - 1))
    issue = (
        F.when(_bad_number("score") | (c("score") < 0) | (c("score") > 1), F.lit("score out of range"))
        .when(c("score") < min_score, F.lit("below threshold"))
        .when(_bad_number("class_id") | (c("class_id") != F.rint("class_id")), F.lit("class is not an integer"))
        .when(c("class_id") < 0, F.lit("class out of range"))
        .when(_bad_number(*BOX), F.lit("box is not finite"))
        .when(outside, F.lit("box out of range"))
        .when((box[2] < box[0]) | (box[3] < box[1]), F.lit("box reversed"))
    )
    pixels = denorm_bbox(box, max(width, 1), max(height, 1)) if normalised else box
    return detections.withColumn("issue", issue).where(F.coalesce(c("issue") != "below threshold", F.lit(True))).select(
        *[n for n in detections.columns if n not in BOX], *[p.alias(n) for n, p in zip(BOX, pixels)], "issue"
    )


# --- regions ------------------------------------------------------------------------------------

TEMPLATE = ["rx0", "ry0", "rx1", "ry1"]


def locate_by_template(views: DataFrame, lights: DataFrame, templates: DataFrame, view: list[str], on: list[str]) -> DataFrame:
    """Every template of a view at confidence 1; a view without its source light has none.

    ``views`` names the ``source_light`` each view needs, ``lights`` the lights it has.
    """
    have = lights.select(*view, F.col("light_id").alias("source_light")).distinct()
    ready = views.join(have, [*view, "source_light"], "left_semi").join(templates, on)
    lacking = views.join(have, [*view, "source_light"], "left_anti")
    found = ready.select(*view, "roi_name", F.lit(1.0).alias("confidence"), F.lit(0.0).alias("pose_error_px"), F.lit(True).alias("is_pass"), F.lit("template ROI pass").alias("message"))
    missing = lacking.select(
        *view, F.lit("").alias("roi_name"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("pose_error_px"), F.lit(False).alias("is_pass"),
        F.concat(F.lit("missing Dome ROI source light: "), "source_light").alias("message"),
    )
    return found.unionByName(missing)


def locate_by_detection(
    detections: DataFrame, templates: DataFrame, on: list[str], width: int, height: int, min_confidence: float, max_error_px: float
) -> DataFrame:
    """Normalised detection boxes against their class's template: rounded corners, pose error and ``issue``.

    A row below ``min_confidence`` is dropped; the issue column keeps every other problem.
    """
    c = F.col
    raw = ["bx0", "by0", "bx1", "by1"]
    joined = detections.join(templates, [*on, "class_id"], "left")
    outside = F.lit(False)
    for b in raw:
        outside = outside | (c(b) < 0) | (c(b) > 1)
    corner = [F.rint(v).cast("int") for v in denorm_bbox(raw, width, height)]
    located = joined.withColumns(dict(zip(BOX, corner)))
    error = F.greatest(*[F.abs(c(t) - c(b)) for t, b in zip(TEMPLATE, BOX)]).cast("double")
    issue = (
        F.when(_bad_number(*raw, "confidence"), F.lit("not finite"))
        .when((c("confidence") < 0) | (c("confidence") > 1), F.lit("confidence out of range"))
        .when(c("roi_name").isNull(), F.lit("class without template"))
        .when(outside, F.lit("box out of range"))
        .when((c("bx1") < c("bx0")) | (c("by1") < c("by0")), F.lit("box reversed"))
    )
    rows = located.withColumns({"pose_error_px": error, "issue": issue}).where(c("issue").isNotNull() | (c("confidence") >= min_confidence))
    return rows.withColumn("issue", F.when(c("issue").isNull() & (c("pose_error_px") > max_error_px), F.lit("pose error")).otherwise(c("issue")))


def locate_by_mask(
    masks: DataFrame, detections: DataFrame, templates: DataFrame, det: list[str], on: list[str], width: int, height: int,
    min_area_px: float, min_area_ratio: float, max_area_ratio: float, max_error_px: float,
) -> DataFrame:
    """Mask pixels to a source box: scale, clamp, area limits, and overshoot past the template as pose error.

    ``detections`` has det keys, ``class_id`` and the mask's source box (mx0, my0, mx1, my1).
    """
    c = F.col
    stats = masks.groupBy(*det).agg(
        F.min(F.when(c("m") > 0, c("x"))).alias("px0"), F.min(F.when(c("m") > 0, c("y"))).alias("py0"),
        F.max(F.when(c("m") > 0, c("x"))).alias("px1"), F.max(F.when(c("m") > 0, c("y"))).alias("py1"),
        F.sum((c("m") > 0).cast("int")).alias("on_px"), (F.max("x") + 1).alias("mask_w"), (F.max("y") + 1).alias("mask_h"),
    )
    rows = detections.join(stats, det).join(templates, [*on, "class_id"], "left")
    sx = F.greatest(F.lit(1.0), c("mx1") - c("mx0") + 1) / c("mask_w")
    sy = F.greatest(F.lit(1.0), c("my1") - c("my0") + 1) / c("mask_h")
    clamp = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), v.cast("int")))
    box = [
        clamp(F.rint(c("mx0") + c("px0") * sx), width), clamp(F.rint(c("my0") + c("py0") * sy), height),
        clamp(F.rint(c("mx0") + (c("px1") + 1) * sx) - 1, width), clamp(F.rint(c("my0") + (c("py1") + 1) * sy) - 1, height),
    ]
    area = c("on_px") * sx * sy
    floor_area = max(float(min_area_px), width * height * min_area_ratio)
    located = rows.withColumns({**dict(zip(BOX, box)), "area": area})
    error = F.greatest(
        c("rx0") - c("x0"), c("ry0") - c("y0"), c("x1") - c("rx1"), c("y1") - c("ry1"), F.lit(0)
    ).cast("double")
    issue = (
        F.when(c("roi_name").isNull(), F.lit("class without template"))
        .when(c("on_px") == 0, F.lit("mask empty"))
        .when(c("area") < floor_area, F.lit("mask area below limit"))
        .when(c("area") > width * height * max_area_ratio, F.lit("mask area above limit"))
        .when(error > max_error_px, F.lit("mask boundary error"))
    )
    return located.withColumns({"pose_error_px": error, "issue": issue})


def best_regions(located: DataFrame, view: list[str], tie: str, min_iou: float | None = None) -> DataFrame:
    """Best location per region (confidence, then error) and whether another one contradicts it.

    ``min_iou`` None: any other box contradicts; otherwise one that overlaps less.  The best row is an
    aggregate joined back, so no region's rows are gathered.
    """
    good = located.where(F.col("issue").isNull())
    fields = F.struct(*BOX, "confidence", "pose_error_px")
    best = good.groupBy(*view, "roi_name").agg(
        F.min_by(fields, F.struct(-F.col("confidence"), F.col("pose_error_px"), F.col(tie))).alias("best")
    )
    joined = good.join(best, [*view, "roi_name"])
    if min_iou is None:
        differs = F.lit(False)
        for b in BOX:
            differs = differs | (F.col(b) != F.col(f"best.{b}"))
    else:
        differs = iou_xyxy(BOX, [f"best.{b}" for b in BOX]) < min_iou
    return joined.groupBy(*view, "roi_name", "best").agg(F.max(differs).alias("conflict")).select(*view, "roi_name", "best.*", "conflict")


def region_report(views: DataFrame, templates: DataFrame, best: DataFrame, located: DataFrame, view: list[str], on: list[str]) -> DataFrame:
    """Pass per view: every template located, nothing contradictory and no row with an issue."""
    wanted = views.select(*view).distinct().join(templates.select(*on, "roi_name"), on)
    joined = wanted.join(best.select(*view, "roi_name", "conflict"), [*view, "roi_name"], "left")
    counts = joined.groupBy(*view).agg(
        F.count_if(F.col("conflict").isNull()).alias("missing"), F.count_if(F.coalesce("conflict", F.lit(False))).alias("conflicts")
    )
    issues = located.where(F.col("issue").isNotNull()).groupBy(*view).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return counts.join(issues, view, "left").select(
        *view, "missing", "conflicts", n.alias("issues"), ((F.col("missing") == 0) & (F.col("conflicts") == 0) & (n == 0)).alias("is_pass")
    )
