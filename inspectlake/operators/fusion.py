"""Candidate checks, greedy box merging, overlap joins and detection matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inspectlake.functions.boxes import bbox_area, iou_xyxy
from inspectlake.operators.islands import box_cells, home_cell, split_islands
from inspectlake.operators.ordered import HOT_GROUP_ROWS, largest_group

BOX = ["x0", "y0", "x1", "y1"]


def candidate_issue() -> Column:
    """Why a candidate cannot be fused; null when it can."""
    score = F.col("score")
    return (
        F.when(score.isNull() | F.isnan(score) | (score < 0) | (score > 1), F.lit("invalid candidate score"))
        .when((F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0")), F.lit("invalid candidate bbox"))
        .when(F.col("area_px") <= 0, F.lit("invalid candidate area"))
        .when(F.size("evidence_lights") == 0, F.lit("candidate evidence_lights is empty"))
    )


def split_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good candidates, and the rejected ones with their issue."""
    checked = candidates.withColumn("issue", candidate_issue())
    return checked.where(F.col("issue").isNull()).drop("issue"), checked.where(F.col("issue").isNotNull())


def _plain(column: pa.Array) -> list:
    numeric = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if numeric and not column.null_count else column.to_pylist()


def _runs(batch: pa.RecordBatch, n: int) -> list[tuple[int, int, tuple]]:
    """Start, end and key of each stretch of rows with the same first ``n`` columns."""
    rows = batch.num_rows
    change = np.zeros(max(rows - 1, 0), dtype=bool)
    for column in batch.columns[:n]:
        later, earlier = column.slice(1), column.slice(0, max(rows - 1, 0))
        differs = pc.or_kleene(pc.not_equal(later, earlier), pc.xor(pc.is_null(later), pc.is_null(earlier)))
        change |= pc.fill_null(differs, False).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), rows] if rows else [0]
    return [(a, b, tuple(c[a].as_py() for c in batch.columns[:n])) for a, b in zip(edges, edges[1:])]


_CANDIDATE = [*BOX, "score", "evidence_lights", "recheck_score", "ng_score"]
_KEPT = {"kept_index": "int", "suppressed": "long", "overflow": "long", "first_box": "array<int>"}


def _merge_stream(groups: list[str], out_schema: pa.Schema, limits: list[int]):
    """Fold sorted rows group by group; only the kept boxes of one group are ever held.

    ``limits`` are the places of the overlap threshold and the cap in the group's key.
    """

    def first_overlap(kept, x0, y0, x1, y1, iou_threshold):
        area = (x1 - x0 + 1) * (y1 - y0 + 1)
        for k in kept:
            w = (k[2] if k[2] < x1 else x1) - (k[0] if k[0] > x0 else x0) + 1
            if w > 0:
                h = (k[3] if k[3] < y1 else y1) - (k[1] if k[1] > y0 else y0) + 1
                inter = w * h if h > 0 else 0
            else:
                inter = 0
            union = (k[2] - k[0] + 1) * (k[3] - k[1] + 1) + area - inter
            if (inter / union if union > 0 else 0.0) >= iou_threshold:
                return k
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(groups)
        key, kept, overflow, out = None, [], 0, []

        def close():
            for i, k in enumerate(kept):
                out.append((*key, *k[:8], *k[10], i, k[8], overflow if i == 0 else 0, k[9]))

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        for batch in batches:
            values = list(zip(*[_plain(column) for column in batch.columns[n:]]))
            for start, end, group in _runs(batch, n):
                if group != key:
                    if key is not None:
                        close()
                    key, kept, overflow = group, [], 0
                iou_threshold, cap = (key[i] for i in limits)
                for x0, y0, x1, y1, score, lights, recheck, ng, *tied in values[start:end]:
                    k = first_overlap(kept, x0, y0, x1, y1, iou_threshold)
                    if k is not None:
                        k[0], k[1], k[2], k[3] = min(k[0], x0), min(k[1], y0), max(k[2], x1), max(k[3], y1)
                        for light in lights:
                            if light not in k[5]:
                                k[5].append(light)
                        k[8] += 1
                    elif len(kept) < cap:
                        kept.append([x0, y0, x1, y1, score, list(dict.fromkeys(lights)), recheck, ng, 0, [x0, y0, x1, y1], tied])
                    else:
                        overflow += 1
            if out:
                yield flush()
        if key is not None:
            close()
            yield flush()

    return run


def merge_candidates(
    candidates: DataFrame,
    keys: list[str],
    tie: list[str],
    iou_threshold: float | Column = 0.5,
    cap: int | Column = 16,
    hot_rows: int | None = None,
) -> DataFrame:
    """Greedy merge per region: best score first, into the first kept box that overlaps enough.

    Output is one row per kept box with its outer box, lights, thresholds and ``suppressed`` count;
    ``overflow`` (candidates beyond ``cap``) stands on the region's first row.  Equal scores are taken in
    the order of ``tie`` (that of the input), and of their box only after it; of equal boxes the lower thresholds come first,
    so that the result does not follow the order in which a shuffle brings rows.  A region above ``hot_rows`` is first cut into islands that cannot influence each
    other, folded in parallel, and the cap is applied to the islands' kept boxes in score order.

    The threshold (above 0) and the cap are numbers, or columns that are the same in a region.
    """
    if not isinstance(iou_threshold, Column) and iou_threshold <= 0:
        raise ValueError("iou_threshold must be above 0")
    column = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    candidates = candidates.withColumns({"_iou": column(iou_threshold, "double"), "_cap": column(cap, "int")})
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    hot = largest_group(candidates, keys) > limit
    rows = split_islands(candidates, keys, ["score", *tie], limit) if hot else candidates
    groups = [*keys, "_iou", "_cap", *(["island_x", "island_y"] if hot else [])]
    needed = rows.select(*groups, *_CANDIDATE, F.struct(*tie).alias("_tie"))
    order = [F.desc("score"), "_tie", *BOX, "evidence_lights", "recheck_score", "ng_score"]
    sorted_rows = needed.repartition(*groups).sortWithinPartitions(*groups, *order)
    sorted_rows = sorted_rows if hot else sorted_rows.drop("_tie")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema] + [f"{n} {t}" for n, t in _KEPT.items()]
    arrow = to_arrow_schema(StructType.fromDDL(", ".join(fields)))
    kept = sorted_rows.mapInArrow(_merge_stream(groups, arrow, [len(keys), len(keys) + 1]), ", ".join(fields))
    if hot:
        kept = _cap_region(kept, keys)
    return kept.drop("first_box", "_tie", "_iou", "_cap").withColumn("area_px", bbox_area(*BOX))


def _cap_region(kept: DataFrame, keys: list[str]) -> DataFrame:
    in_order = Window.partitionBy(*keys).orderBy(F.desc("score"), "_tie", "first_box", "kept_index", "island_x", "island_y")
    size = F.col("suppressed") + 1
    whole = kept.groupBy(*keys).agg(F.sum(size + F.col("overflow")).alias("_all"))
    top = kept.withColumn("_rank", F.row_number().over(in_order)).where(F.col("_rank") <= F.col("_cap"))
    inside = top.groupBy(*keys).agg(F.sum(size).alias("_in"))
    counts = whole.join(inside, keys)
    return (
        top.join(counts, keys)
        .withColumns(
            {
                "overflow": F.when(F.col("_rank") == 1, F.col("_all") - F.col("_in")).otherwise(0).cast("long"),
                "kept_index": (F.col("_rank") - 1).cast("int"),
            }
        )
        .drop("_rank", "_all", "_in", "island_x", "island_y")
    )


def fusion_summary(kept: DataFrame, keys: list[str]) -> DataFrame:
    return kept.groupBy(*keys).agg(
        F.sum(F.col("suppressed") + 1 + F.col("overflow")).alias("input_count"),
        F.count("*").alias("output_count"),
        F.sum("suppressed").alias("suppressed_count"),
        F.sum("overflow").alias("overflow_count"),
    )


def number_defects(defects: DataFrame, job: list[str], sequence: str = "sequence_id") -> DataFrame:
    """``sequence-index`` over a job's defects in fused order (regions are capped, so jobs are short)."""
    fused = Window.partitionBy(*job).orderBy("camera_id", "pose_id", "roi_name", F.desc("score"), "kept_index")
    index = (F.row_number().over(fused) - 1).cast("string")
    return defects.withColumn("defect_id", F.concat_ws("-", F.col(sequence).cast("string"), index))


def fused_order(kept: DataFrame) -> DataFrame:
    return kept.orderBy("camera_id", "pose_id", "roi_name", F.desc("score"))


def limit_defects(defects: DataFrame, job: list[str], order: list, max_defects: int = 32, max_lights: int = 8) -> DataFrame:
    """First ``max_defects`` per result and ``max_lights`` evidence lights each, as the result record holds them."""
    ranked = defects.withColumn("slot", F.row_number().over(Window.partitionBy(*job).orderBy(*order)) - 1)
    return ranked.where(F.col("slot") < max_defects).withColumn("evidence_lights", F.slice("evidence_lights", 1, max_lights))


PARTNERS = 1024


def overlapping_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], id_left: str, id_right: str, min_iou: float, cell: int = 32, partners: int = PARTNERS
) -> DataFrame:
    """Pairs of boxes in one region with IoU at or above ``min_iou`` (> 0).

    While no region holds more than ``partners`` right boxes they are compared directly.  Beyond that boxes
    meet only in grid cells they share, so boxes that do not touch are never paired.
    """
    if min_iou <= 0:
        raise ValueError("min_iou must be above 0")
    a = left.select(*keys, F.col(id_left).alias("left_id"), *BOX)
    b = right.select(*keys, F.col(id_right).alias("right_id"), *BOX)
    crowded = largest_group(b, keys) > partners
    on = keys + (["cell_x", "cell_y"] if crowded else [])
    if crowded:
        a, b = box_cells(a, cell), box_cells(b, cell)
    b = b.select(*on, "right_id", *[F.col(c).alias(f"r_{c}") for c in BOX])
    # Uncrowded, the hashed side of a region is small by the check above.
    pairs = a.join(b if crowded else b.hint("shuffle_hash"), on)
    if crowded:
        pairs = pairs.where(home_cell(F.greatest("x0", "r_x0"), F.greatest("y0", "r_y0"), cell))
    iou = iou_xyxy(BOX, [f"r_{c}" for c in BOX])
    return pairs.withColumn("iou", iou).where(F.col("iou") >= min_iou).select(*keys, "left_id", "right_id", "iou")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: int = 32) -> DataFrame:
    """Points inside any box of their image, each once."""
    b = box_cells(boxes.select(*keys, *BOX), cell).distinct()
    p = points.withColumns({"cell_x": F.floor(F.col("x") / cell), "cell_y": F.floor(F.col("y") / cell)})
    on = [p[k] == b[k] for k in [*keys, "cell_x", "cell_y"]] + [
        p["x"].between(b["x0"], b["x1"]), p["y"].between(b["y0"], b["y1"])
    ]
    return p.join(b, on, "left_semi").drop("cell_x", "cell_y")


_COUNTS = ["true_positives", "false_positives", "false_negatives"]
_FEW = 48


def _match_stream(groups: list[str], out_schema: pa.Schema, iou_threshold: float):
    """Fold sorted rows image by image: first its truths, then its predictions in order."""

    def best_few(truths, free, x0, y0, x1, y1):
        area, best, at = (x1 - x0 + 1) * (y1 - y0 + 1), 0.0, -1
        for i, t in enumerate(truths):
            if free[i]:
                w = (t[2] if t[2] < x1 else x1) - (t[0] if t[0] > x0 else x0) + 1
                h = (t[3] if t[3] < y1 else y1) - (t[1] if t[1] > y0 else y0) + 1
                if w > 0 and h > 0:
                    iou = w * h / ((t[2] - t[0] + 1) * (t[3] - t[1] + 1) + area - w * h)
                    if iou > best:
                        best, at = iou, i
        return best, at

    def best_many(boxes, free, x0, y0, x1, y1):
        w = np.minimum(boxes[:, 2], x1) - np.maximum(boxes[:, 0], x0) + 1
        h = np.minimum(boxes[:, 3], y1) - np.maximum(boxes[:, 1], y0) + 1
        inter = np.where((w > 0) & (h > 0), w * h, 0)
        areas = (boxes[:, 2] - boxes[:, 0] + 1) * (boxes[:, 3] - boxes[:, 1] + 1)
        iou = np.where(free, inter / (areas + (x1 - x0 + 1) * (y1 - y0 + 1) - inter), 0.0)
        at = int(iou.argmax())
        return iou[at], at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(groups)
        key, truths, boxes, free, tp, fp, out = None, [], None, None, 0, 0, []

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        for batch in batches:
            values = list(zip(*[_plain(column) for column in batch.columns[n:]]))
            for start, end, group in _runs(batch, n):
                if group != key:
                    if key is not None:
                        out.append((*key, tp, fp, len(truths) - tp))
                    key, truths, free, tp, fp = group, [], None, 0, 0
                for is_pred, *box in values[start:end]:
                    if not is_pred:
                        truths.append(box)
                        continue
                    if free is None:
                        free = np.ones(len(truths), dtype=bool) if len(truths) > _FEW else [True] * len(truths)
                        boxes = np.array(truths, dtype=np.int64) if len(truths) > _FEW else truths
                    best, at = (best_many if len(truths) > _FEW else best_few)(boxes, free, *box)
                    if best > 0.0 and best >= iou_threshold:
                        free[at] = False
                        tp += 1
                    else:
                        fp += 1
            if out:
                yield flush()
        if key is not None:
            out.append((*key, tp, fp, len(truths) - tp))
            yield flush()

    return run


def match_detections(
    predictions: DataFrame,
    truths: DataFrame,
    keys: list[str],
    order: list[str],
    iou_threshold: float = 0.5,
    score_threshold: float = 0.0,
    hot_rows: int | None = None,
) -> DataFrame:
    """TP, FP and FN per image; predictions in ``order`` each take the free truth they overlap most.

    Only boxes that touch can match, so an image above ``hot_rows`` is cut into islands first and the
    counts are added up.
    """
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    shape = lambda df, pred: df.select(*keys, F.lit(pred).alias("is_pred"), *BOX, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = shape(predictions.where(F.col("score") >= score_threshold), True).unionByName(shape(truths, False))
    ties = [f"_o{i}" for i in range(len(order))]
    hot = largest_group(rows, keys) > limit
    if hot:
        rows = split_islands(rows, keys, ["is_pred", *ties], limit)
    groups = keys + (["island_x", "island_y"] if hot else [])
    sorted_rows = (
        rows.repartition(*groups).sortWithinPartitions(*groups, "is_pred", *ties, *BOX).select(*groups, "is_pred", *BOX)
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*groups).schema] + [f"{c} long" for c in _COUNTS]
    arrow = to_arrow_schema(StructType.fromDDL(", ".join(fields)))
    counts = sorted_rows.mapInArrow(_match_stream(groups, arrow, iou_threshold), ", ".join(fields))
    if hot:
        counts = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return counts


def precision_recall(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.withColumns(
        {
            "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0),
            "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0),
        }
    )


def evaluation_totals(image_counts: DataFrame, breakdowns: list[str]) -> DataFrame:
    """Overall row plus one row per value of each breakdown column; blank values are ``unknown``."""
    named = image_counts.withColumns(
        {c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(F.col(c)) for c in breakdowns}
    )
    sets = named.groupingSets([[], *[[c] for c in breakdowns]], *breakdowns)
    level, value = F.lit("overall"), F.lit("")
    for c in breakdowns:
        level = F.when(F.grouping(c) == 0, F.lit(f"by_{c}")).otherwise(level)
        value = F.when(F.grouping(c) == 0, F.col(c)).otherwise(value)
    sums = [F.sum(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives")]
    totals = sets.agg(level.alias("level"), value.alias("value"), F.count("*").alias("samples"), *sums)
    return precision_recall(totals.select("level", "value", "samples", "true_positives", "false_positives", "false_negatives"))
