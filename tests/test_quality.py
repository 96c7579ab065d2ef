"""Frame statistics, gate messages, shifts and warps on small images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectlake.operators import detect as d, pixels as px, quality as q

GRID = "frame_id long, width int, height int, stride_bytes int, image binary"


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(2)
    sizes = [(8, 6, 8), (5, 5, 9), (3, 3, 3), (2, 2, 2), (1, 4, 1)]
    arrays, rows, pix = {}, [], []
    for i, (w, h, s) in enumerate(sizes):
        a = rng.integers(0, 256, size=(h, s), dtype=np.uint8)
        a[0, 0], a[-1, w - 1] = 255, 0
        arrays[i] = a[:, :w].astype(int)
        rows.append((i, w, h, s, bytearray(a.tobytes())))
        pix += [(i, x, y, int(a[y, x])) for y in range(h) for x in range(w)]
    return arrays, spark.createDataFrame(rows, GRID), spark.createDataFrame(pix, "frame_id long, x int, y int, v int")


def test_pixel_rows_and_image_bytes_agree(images):
    arrays, frames, pixels = images
    whole = {r["frame_id"]: r for r in q.frame_statistics(frames, ["frame_id"]).collect()}
    exposure = {r["frame_id"]: r for r in q.pixel_exposure(pixels, ["frame_id"]).collect()}
    def sharpness(a):
        around = [abs(int(a[y - 1, x] + a[y + 1, x] + a[y, x - 1] + a[y, x + 1] - 4 * a[y, x])) for y in range(1, len(a) - 1) for x in range(1, len(a[0]) - 1)]
        return sum(around) / len(around) if around else 0.0

    def motion(a):
        if min(a.shape) < 2:
            return 0.0
        return min(np.abs(a[:, 1:] - a[:, :-1]).mean(), np.abs(a[1:] - a[:-1]).mean())

    for i, a in arrays.items():
        assert abs(whole[i]["mean_gray"] - a.mean()) < 1e-9 and abs(exposure[i]["mean_gray"] - a.mean()) < 1e-9
        for c in ("saturation_ratio", "dark_ratio"):
            assert abs(whole[i][c] - exposure[i][c]) < 1e-12
        assert abs(whole[i]["sharpness"] - sharpness(a)) < 1e-9
        assert abs(whole[i]["motion_gradient"] - motion(a)) < 1e-9
    assert whole[3]["sharpness"] == 0.0 and whole[4]["motion_gradient"] == 0.0


def test_short_image_has_no_statistics(spark):
    df = spark.createDataFrame([(1, 4, 4, 4, bytearray(10))], GRID)
    assert q.frame_statistics(df, ["frame_id"]).first()["mean_gray"] is None


FRAME = "sequence_id int, recipe_id string, camera_id string, pose_id string, light_id string, light_seq_index int, frame_index int, timestamp_us long"


def test_view_and_light_messages(spark):
    lights = spark.createDataFrame([("r", 0, "A", True), ("r", 1, "B", True), ("r", 2, "C", False)], "recipe_id string, pos int, light_id string, required boolean")
    views = spark.createDataFrame([("r", "T", "", "m"), ("r", "U", "P1", "m")], "recipe_id string, camera_id string, pose_id string, model_key string")
    frames = spark.createDataFrame(
        [(1, "r", "T", "P9", "A", 0, 1, 100), (1, "r", "T", "P9", "B", 1, 1, 50), (2, "r", "U", "P1", "A", 1, 1, 5), (2, "r", "U", "P2", "Z", 0, 1, 5)], FRAME
    )
    text = lambda df: sorted((r["sequence_id"], r["message"]) for r in df.collect())
    assert text(q.missing_views(frames, views, ["sequence_id"])) == [(1, "U/P1: missing configured camera pose bundle"), (2, "T: missing configured camera bundle")]
    assert text(q.unexpected_views(frames, views, ["sequence_id"])) == [(2, "U/P2: camera pose not enabled by recipe")]
    assert text(q.missing_lights(frames, lights, ["sequence_id"])) == [(2, "U: missing required light A"), (2, "U: missing required light B"), (2, "U: missing required light B")]
    assert text(q.monotonic_times(frames, lights, ["sequence_id"])) == [(1, "T: timestamps are not monotonic by required light order")]
    assert (1, "T: duplicate frame_index in required lights") in text(q.capture_consistency(frames, lights, ["sequence_id"], 10))
    assert (1, "T: capture timestamp span 50us exceeds 10us") in text(q.capture_consistency(frames, lights, ["sequence_id"], 10))
    assert text(q.light_sequence(frames, lights, ["sequence_id"])) == [(2, "U/A: light_seq_index 1 does not match configured order 0"), (2, "U/Z: light not in configured light_order")]


def test_shift_search_finds_a_known_move(spark):
    rng = np.random.default_rng(4)
    scene = rng.integers(0, 255, size=(24, 24), dtype=np.uint8)
    base, moving = scene[4:16, 4:16].copy(), scene[2:14, 5:17].copy()
    df = spark.createDataFrame([(1, bytearray(base.tobytes()), bytearray(moving.tobytes()), 12, 12), (2, bytearray(144), bytearray(144), 12, 12)], "k int, base binary, moving binary, width int, height int")
    out = {r["k"]: r for r in px.search_registration(df, ["k"], 3, 200, 0.0, 0.9).collect()}
    assert (out[1]["dx"], out[1]["dy"], out[1]["converged"]) == (-1, 2, True) and out[1]["correlation"] > 0.999
    assert not out[2]["converged"] and out[2]["correlation"] == -1.0


def test_channel_names(spark):
    df = spark.createDataFrame([("ch4_high_max_min",), ("abs_diff:A",), ("max_min:A:B:C",), ("light:",), ("light:A",)], "channel string")
    out = {r["channel"]: (r["operation"], list(r["lights"]), r["valid"]) for r in px.channel_specs(df).collect()}
    assert out["ch4_high_max_min"] == ("max_min", ["HIGH_LEFT", "HIGH_RIGHT"], True)
    assert out["max_min:A:B:C"][2] and out["light:A"][2] and not out["abs_diff:A"][2] and not out["light:"][2]


def test_decode_takes_the_first_best_class(spark):
    df = spark.createDataFrame([(1, [10.0, 20.0, 4.0, 6.0, 0.7, 0.7, 0.1]), (2, [0.0] * 7)], "k int, raw array<double>")
    out = d.decode_class_scores(df, "raw", 0.7).collect()
    assert len(out) == 1 and (out[0]["x0"], out[0]["y0"], out[0]["x1"], out[0]["y1"], out[0]["class_id"]) == (8, 17, 12, 23, 0)


def test_frame_boxes(spark):
    from inspectlake.functions import boxes as bx

    move = [1.0, 0.0, 10.5, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0]
    flat = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(move, 8, 6, 100, 50, 2, 3), (None, 8, 6, 100, 50, 2, 3), (flat, 8, 6, 100, 50, 2, 3)], "m array<double>, w int, h int, sw int, sh int, ox int, oy int")
    out = [tuple(r) for r in df.select(*bx.frame_bbox("m", "w", "h", "sw", "sh", "ox", "oy")).collect()]
    assert out == [(10, 0, 18, 2), (2, 3, 9, 8), (2, 3, 9, 8)]
