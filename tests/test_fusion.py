"""Merging, deciding and matching: hand values, brute force, and hot regions."""

import random

from pyspark.sql import functions as F

from inspectlake.functions.boxes import bbox_area, iou_xyxy
from inspectlake.operators import decide, fusion as fu

SCHEMA = "r string, x0 int, y0 int, x1 int, y1 int, score double, evidence_lights array<string>, recheck_score double, ng_score double, ordinal long"


def frame(spark, items):
    return spark.createDataFrame([("r", *b, s, lights, None, None, i) for i, (s, b, lights) in enumerate(items)], SCHEMA)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    inter = max(w, 0) * max(h, 0)
    area = lambda c: (c[2] - c[0] + 1) * (c[3] - c[1] + 1)
    return inter / (area(a) + area(b) - inter)


def greedy(items, iou, cap):
    kept, over = [], 0
    for score, box, i in sorted(items, key=lambda c: (-c[0], c[2])):
        for k in kept:
            if overlap(k[0], box) >= iou:
                k[0] = (min(k[0][0], box[0]), min(k[0][1], box[1]), max(k[0][2], box[2]), max(k[0][3], box[3]))
                k[1] += 1
                break
        else:
            if len(kept) < cap:
                kept.append([box, 0, score])
            else:
                over += 1
    return [(k[0], k[1], k[2]) for k in kept], over


def test_overlapping_pair_becomes_one(spark):
    items = [(0.80, (10, 10, 30, 30), ["HIGH_LEFT"]), (0.90, (11, 11, 29, 29), ["HIGH_RIGHT"]), (0.70, (40, 40, 50, 50), ["HIGH_LEFT"])]
    out = fu.merge_candidates(frame(spark, items), ["r"], ["ordinal"]).orderBy("kept_index").collect()
    first = out[0]
    assert len(out) == 2 and first["suppressed"] == 1 and first["score"] == 0.90
    assert (first["x0"], first["y0"], first["x1"], first["y1"], first["area_px"]) == (10, 10, 30, 30, 441)
    assert first["evidence_lights"] == ["HIGH_RIGHT", "HIGH_LEFT"]


def test_cap_counts_overflow(spark):
    items = [(0.9 - i / 10, (i * 20, 0, i * 20 + 5, 5), ["A"]) for i in range(4)]
    out = fu.merge_candidates(frame(spark, items), ["r"], ["ordinal"], cap=2).collect()
    assert len(out) == 2 and sum(r["overflow"] for r in out) == 2


def test_equal_scores_keep_the_input_order(spark):
    boxes = [(40, 40, 50, 50), (0, 0, 10, 10)]
    for pair in (boxes, boxes[::-1]):
        for limit in (10**9, 1):
            out = fu.merge_candidates(frame(spark, [(0.9, b, ["A"]) for b in pair]), ["r"], ["ordinal"], cap=1, hot_rows=limit).collect()
            assert [(r["x0"], r["overflow"]) for r in out] == [(pair[0][0], 1)]


def test_candidates_equal_but_for_thresholds_in_any_order(spark):
    rows = [("r", 0, 0, 9, 9, 0.9, ["A"], low, high, 0) for low, high in ((0.3, 0.9), (0.3, None), (None, 0.9), (None, None), (0.2, 0.95))]
    for limit in (None, 1):
        found = set()
        for given in (rows, rows[::-1], rows[2:] + rows[:2]):
            out = fu.merge_candidates(spark.createDataFrame(given, SCHEMA).coalesce(1), ["r"], ["ordinal"], hot_rows=limit).collect()
            found |= {(len(out), o["recheck_score"], o["ng_score"], o["suppressed"]) for o in out}
        assert found == {(1, None, None, 4)}


def test_hot_region_matches_brute_force(spark):
    rng = random.Random(5)
    items = []
    for i in range(600):
        x, y = rng.randrange(3000), rng.randrange(60)
        items.append((rng.randrange(100) / 100, (x, y, x + rng.randrange(5, 40), y + rng.randrange(5, 30)), i))
    df = spark.createDataFrame([("r", *b, s, ["A"], None, None, i) for s, b, i in items], SCHEMA)
    for cap in (1000, 12):
        want, over = greedy(items, 0.3, cap)
        for limit in (10**9, 50):
            out = fu.merge_candidates(df, ["r"], ["ordinal"], 0.3, cap, hot_rows=limit).orderBy("kept_index").collect()
            got = [((r["x0"], r["y0"], r["x1"], r["y1"]), r["suppressed"], r["score"]) for r in out]
            assert sorted(got) == sorted(want)
            assert sum(r["overflow"] for r in out) == over
    assert [r["kept_index"] for r in out] == list(range(12))


def match(preds, truths, thr):
    used, tp = set(), 0
    for p in preds:
        best, at = 0.0, -1
        for j, t in enumerate(truths):
            if j not in used and overlap(p, t) > best:
                best, at = overlap(p, t), j
        if at >= 0 and best >= thr:
            used.add(at)
            tp += 1
    return tp, len(preds) - tp, len(truths) - tp


def test_matching_against_brute_force_and_hot_image(spark):
    rng = random.Random(9)
    box = lambda: (lambda x, y: (x, y, x + rng.randrange(8, 25), y + rng.randrange(8, 20)))(rng.randrange(2000), rng.randrange(40))
    preds, truths = [box() for _ in range(300)], [box() for _ in range(250)]
    p = spark.createDataFrame([("i", *b, 0.5, n) for n, b in enumerate(preds)], "i string, x0 int, y0 int, x1 int, y1 int, score double, n long")
    t = spark.createDataFrame([("i", *b, n) for n, b in enumerate(truths)], "i string, x0 int, y0 int, x1 int, y1 int, n long")
    want = match(preds, truths, 0.3)
    for limit in (10**9, 40):
        r = fu.match_detections(p, t, ["i"], ["n"], 0.3, hot_rows=limit).first()
        assert (r["true_positives"], r["false_positives"], r["false_negatives"]) == want


def test_matching_empty_sides(spark):
    box = "i string, x0 int, y0 int, x1 int, y1 int, score double, n long"
    some = spark.createDataFrame([("i", 0, 0, 9, 9, 0.9, 1)], box)
    none = some.where("false")
    missed = fu.precision_recall(fu.match_detections(none, some, ["i"], ["n"])).first()
    extra = fu.precision_recall(fu.match_detections(some, none, ["i"], ["n"])).first()
    assert (missed["false_negatives"], missed["recall"], missed["precision"]) == (1, 0.0, 1.0)
    assert (extra["false_positives"], extra["precision"], extra["recall"]) == (1, 0.0, 1.0)


def test_iou_values(spark):
    cases = [((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 5, 5), (20, 20, 30, 30)), ((0, 0, 10, 10), (5, 5, 15, 15))]
    df = spark.createDataFrame([(*a, *b) for a, b in cases], "a int, b int, c int, d int, e int, f int, g int, h int")
    got = [r[0] for r in df.select(iou_xyxy(list("abcd"), list("efgh"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and 0.1 < got[2] < 0.2


def decided(spark, score, box, recheck, ng, **limits):
    df = spark.createDataFrame([(*box, score, recheck, ng)], "x0 int, y0 int, x1 int, y1 int, score double, recheck_score double, ng_score double")
    return [r["decision"] for r in decide.filter_defects(df.withColumn("area_px", bbox_area(*fu.BOX)), 0.2, 0.35, **limits).collect()]


def test_defect_decisions(spark):
    assert decided(spark, 0.88, (0, 0, 9, 9), 0.2, 0.95) == ["RECHECK"]
    assert decided(spark, 0.22, (0, 0, 9, 9), 0.5, 0.9) == []
    assert decided(spark, 0.95, (0, 0, 100, 1), None, None, min_aspect=0.5, max_aspect=2.0) == ["RECHECK"]
    assert decided(spark, 0.95, (0, 0, 9, 9), None, None, min_aspect=0.5, max_aspect=2.0) == ["NG"]


def test_overflow_turns_ok_into_recheck(spark):
    jobs = spark.createDataFrame([(1, True, 1), (2, False, 0)], "sequence_id long, quality_pass boolean, overflow_count int")
    none = spark.createDataFrame([], "sequence_id long, decision string")
    got = {r["sequence_id"]: (r["decision"], r["error_code"]) for r in decide.job_decisions(jobs, none, ["sequence_id"]).collect()}
    assert got == {1: ("RECHECK", 13), 2: ("RECHECK", 7)}


def test_points_in_boxes_across_cells(spark):
    points = spark.createDataFrame([(1, x, y) for x in range(0, 80, 3) for y in range(0, 80, 7)], "i int, x int, y int")
    boxes = spark.createDataFrame([(1, 5, 5, 40, 33), (1, 30, 20, 70, 60)], "i int, x0 int, y0 int, x1 int, y1 int")
    got = {(r["x"], r["y"]) for r in fu.points_in_boxes(points, boxes, ["i"], 16).collect()}
    want = {(x, y) for x in range(0, 80, 3) for y in range(0, 80, 7) if (5 <= x <= 40 and 5 <= y <= 33) or (30 <= x <= 70 and 20 <= y <= 60)}
    assert got == want
