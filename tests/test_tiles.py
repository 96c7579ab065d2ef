"""Work on tiles against the same work on whole arrays, for tiles that do and do not divide the image."""

import numpy as np
import pytest

from inspectlake.operators import pixels as px, tiles as ti

IMAGE = "k int, camera_id string, light_id string, image binary, width int, height int, stride_bytes int"


def scene(seed, h, w):
    return np.random.default_rng(seed).integers(0, 256, size=(h, w), dtype=np.uint8)


def frame(spark, rows):
    return spark.createDataFrame([(k, c, light, bytearray(a.tobytes()), a.shape[1], a.shape[0], a.shape[1]) for k, c, light, a in rows], IMAGE)


def arrays(tiles, keys, tile):
    """Image by key, put together by hand; every pixel must be there once."""
    parts = {}
    for r in tiles.collect():
        parts.setdefault(tuple(r[k] for k in keys), []).append(r)
    out = {}
    for key, rows in parts.items():
        a = np.full((max(r.ty * tile + r.h for r in rows), max(r.tx * tile + r.w for r in rows)), -1)
        for r in rows:
            part = a[r.ty * tile : r.ty * tile + r.h, r.tx * tile : r.tx * tile + r.w]
            assert (part == -1).all()
            part[:] = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w)
        assert (a >= 0).all()
        out[key] = a
    return out


@pytest.mark.parametrize("tile", [4, 5, 64])
def test_cut_crop_and_whole(spark, tile):
    images = {1: scene(1, 13, 17), 2: scene(2, 4, 4), 3: scene(3, 1, 30)}
    tiles = ti.image_tiles(frame(spark, [(k, "T", "A", a) for k, a in images.items()]), ["k"], tile)
    assert {k: v.tolist() for (k,), v in arrays(tiles, ["k"], tile).items()} == {k: a.tolist() for k, a in images.items()}
    boxes = [(1, "a", 3, 2, 15, 12), (1, "b", 0, 0, 16, 0), (2, "a", 3, 3, 3, 3), (3, "a", 7, 0, 29, 0), (2, "out", 0, 0, 4, 4)]
    rois = spark.createDataFrame([(*b, not b[1] == "out") for b in boxes], "k int, roi_name string, rx0 int, ry0 int, rx1 int, ry1 int, in_image boolean")
    cropped = ti.crop(tiles, rois, ["k"], tile)
    want = {(k, n): images[k][y0 : y1 + 1, x0 : x1 + 1].tolist() for k, n, x0, y0, x1, y1 in boxes if n != "out"}
    assert {key: v.tolist() for key, v in arrays(cropped, ["k", "roi_name"], tile).items()} == want
    whole = {(r.k, r.roi_name): np.frombuffer(r.image, np.uint8).reshape(r.height, r.width).tolist() for r in ti.whole(cropped, ["k", "roi_name"], tile).collect()}
    assert whole == want


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_warp_and_shift(spark, tile):
    """Affine, perspective and horizon matrices; shifts that leave the image altogether."""
    a = scene(4, 20, 23)
    tiles = ti.image_tiles(frame(spark, [(1, "T", "A", a)]), ["k"], tile)
    matrices = {
        "same": [1.0, 0.0, 0.5, 0.0, 1.0, 9.0, 0.0, 0.0, 1.0], "turn": [0.6, -0.8, 9.0, 0.8, 0.6, -2.0, 0.0, 0.0, 1.0],
        "tilt": [1.1, 0.1, 1.0, 0.05, 0.9, 0.3, 0.01, 0.02, 1.0], "horizon": [1.0, 0.2, 0.0, 0.1, 1.0, 0.0, -0.2, 0.0, 1.0],
    }
    targets = spark.createDataFrame([(1, n, m, 11, 9, 23, 20) for n, m in matrices.items()], "k int, roi_name string, matrix array<double>, out_w int, out_h int, width int, height int")
    got = arrays(ti.warp(tiles, targets, ["k"], tile), ["roi_name"], tile)
    for name, m in matrices.items():
        want = np.zeros((9, 11))
        for y in range(9):
            for x in range(11):
                w = m[6] * x + m[7] * y + m[8]
                sx, sy = ((m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w) if abs(w) >= 1e-9 else (0, 0)
                sx, sy = min(max(sx, 0), 22), min(max(sy, 0), 19)
                x0, y0 = int(sx), int(sy)
                dx, dy, x1, y1 = sx - x0, sy - y0, min(x0 + 1, 22), min(y0 + 1, 19)
                want[y, x] = np.rint(a[y0, x0] * (1 - dx) * (1 - dy) + a[y0, x1] * dx * (1 - dy) + a[y1, x0] * (1 - dx) * dy + a[y1, x1] * dx * dy)
        assert np.abs(got[(name,)] - want).max() == 0, name
    for dx, dy in [(2, -3), (-30, 5), (0, 0), (40, 40)]:
        shifts = spark.createDataFrame([(1, dx, dy, 23, 20)], "k int, dx int, dy int, width int, height int")
        moved = arrays(ti.apply_shifts(tiles, shifts, ["k"], tile), ["k"], tile)[(1,)]
        assert (moved == a[np.ix_(np.clip(np.arange(20) + dy, 0, 19), np.clip(np.arange(23) + dx, 0, 22))]).all()


@pytest.mark.parametrize("tile", [3, 64])
def test_channels_masks_and_embeddings(spark, tile):
    lit = {c: scene(10 + i, 8, 10) for i, c in enumerate("ABC")}
    tiles = ti.image_tiles(frame(spark, [(1, "T", c, a) for c, a in lit.items()]), ["k", "camera_id", "light_id"], tile)
    names = ["light:A", "abs_diff:A:B", "max_min:A:B:C", "local_contrast:C", "light:D"]
    channels = spark.createDataFrame([("T", i, n) for i, n in enumerate(names)], "camera_id string, pos int, channel string")
    built, missing = ti.light_channels(tiles, px.channel_specs(channels), ["k", "camera_id"], ["camera_id"])
    i16 = {c: a.astype(int) for c, a in lit.items()}
    want = {
        "light:A": i16["A"], "abs_diff:A:B": abs(i16["A"] - i16["B"]), "max_min:A:B:C": np.maximum.reduce(list(i16.values())) - np.minimum.reduce(list(i16.values())),
        "local_contrast:C": abs(i16["C"] - int(i16["C"].mean())),
    }
    got = arrays(built, ["channel"], tile)
    assert {k[0]: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items()}
    assert [r.channel for r in missing.collect()] == ["light:D"]
    vector = ti.statistical_embedding(built, ["k"], channels.select("channel", "pos"), 9, 200.0).first().embedding
    scaled = [np.clip(want[n] / 200.0, 0, 1) for n in names[:4]]
    assert np.allclose(vector, [v for s in scaled for v in (s.mean(), s.std())] + [0.0], atol=1e-9)
    shapes = {r.channel: (r.height, r.width, r.issue) for r in ti.tensor_shapes(built.where("NOT (channel = 'light:A' AND tx = 0 AND ty = 0)"), ["k"], tile).collect()}
    assert shapes["abs_diff:A:B"] == (8, 10, None)
    assert tile == 64 or shapes["light:A"][2] == "feature channel length mismatch"
    mask = (scene(20, 8, 10) > 128).astype(np.uint8)
    masks = ti.image_tiles(frame(spark, [(1, "T", "A", mask)]), ["camera_id", "light_id"], tile)
    hidden = arrays(ti.apply_mask(tiles, masks, ["light_id"], ["camera_id", "light_id"]), ["light_id"], tile)
    assert (hidden[("A",)] == lit["A"] * mask).all() and (hidden[("B",)] == lit["B"]).all()


def test_repeated_and_missing_lights_are_reported(spark):
    specs = px.channel_specs(spark.createDataFrame([("T", 0, "abs_diff:A:B"), ("T", 1, "light:B")], "camera_id string, pos int, channel string"))
    a = scene(6, 2, 2)
    tiles = ti.image_tiles(frame(spark, [(k, "T", light, a) for k, lights in ((1, "AB"), (2, "AAB"), (3, "A"), (4, "AA")) for light in lights]), ["k", "camera_id", "light_id"])
    built, missing = ti.light_channels(tiles, specs, ["k", "camera_id"], ["camera_id"])
    assert sorted((r.k, r.channel) for r in missing.collect()) == [(2, "abs_diff:A:B"), (3, "abs_diff:A:B"), (3, "light:B"), (4, "abs_diff:A:B"), (4, "light:B")]
    assert sorted((r.k, r.channel) for r in built.collect()) == [(1, "abs_diff:A:B"), (1, "light:B"), (2, "light:B")]


def test_a_frame_of_real_size_is_a_few_hundred_rows(spark):
    a = scene(7, 3072, 4096)
    tiles = ti.image_tiles(frame(spark, [(1, "T", "A", a)]), ["k"])
    assert tiles.count() == 192
    roi = spark.createDataFrame([(1, "seat", 100, 50, 3999, 2949, True)], "k int, roi_name string, rx0 int, ry0 int, rx1 int, ry1 int, in_image boolean")
    cropped = ti.crop(tiles, roi, ["k"])
    assert cropped.count() == 16 * 12
    assert ti.whole(cropped, ["k"]).first().image == a[50:2950, 100:4000].tobytes()
    assert ti.image_tiles(spark.createDataFrame([(1, None, 4, 4, 4), (2, bytearray(3), 4, 4, 4), (3, bytearray(1), 0, 4, 0)], "k int, image binary, width int, height int, stride_bytes int"), ["k"]).count() == 0
