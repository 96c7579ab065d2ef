"""Images as tables of binary tiles: crops, warps, shifts, masks, light channels, tensors and embeddings.

An image is a few hundred rows (keys, tx, ty, w, h, data) instead of one row per pixel: tile (tx, ty) holds the grey
values of the square that begins at (tx * TILE, ty * TILE), row by row, a byte or (images with values outside a byte)
four bytes each.  Work on values happens in Arrow batches, a
tile at a time; which tiles meet is a Spark join.  Three shapes cover everything:

- a tile alone (``map_rows``): masks, sums, scaling;
- tiles of several lights at the same place (``light_channels``): one group per place, as many rows as lights;
- an output tile and the source tiles it looks at (``gather``): the output tile asks for a rectangle of its source,
  the tiles under it are cut where they are read, and only the cuts travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inspectlake.functions.boxes import apply_homography
from inspectlake.operators.ordered import cut_lineage

TILE = 256
OUT_BYTES = 4 << 20
PLACE = ["tx", "ty", "w", "h"]
_BYTES = "tx int, ty int, w int, h int, data binary"
_WIDE = np.dtype("<i4")


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema)


def _grey(data: bytes, w: int, h: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) < 4 * w * h else _WIDE, w * h).reshape(h, w)


def map_rows(df: DataFrame, keep: list[str], added: str, work: Callable[..., Iterator[tuple]], inputs: list[str]) -> DataFrame:
    """``keep`` columns and those of ``added`` for every tuple that ``work(*inputs)`` yields for a row."""
    schema = to_arrow_schema(StructType.fromDDL(_fields(df, keep) + added))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batch, at, out):
            columns = list(zip(*out)) if out else [()] * (len(schema) - n)
            kept = [batch.column(k).take(pa.array(at, pa.int64())).cast(schema.field(k).type) for k in range(n)]
            return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[n:])]], schema=schema)

        for batch in batches:
            at, out, size = [], [], 0
            # One row's values are in hand at a time; whole columns of binaries are never turned into lists.
            for i in range(batch.num_rows):
                for row in work(*(batch.column(n + k)[i].as_py() for k in range(len(inputs)))):
                    at.append(i)
                    out.append(row)
                    size += sum(8 if isinstance(v, (int, float)) or v is None else len(v) for v in row)
                    if size > OUT_BYTES:
                        yield packed(batch, at, out)
                        at, out, size = [], [], 0
            yield packed(batch, at, out)

    return df.select(*keep, *inputs).mapInArrow(run, schema=_fields(df, keep) + added)


def image_values(image: bytes | None, width: int, height: int, stride: int, kind: str = "u1") -> np.ndarray | None:
    """Values of an image row by row; none if it is null, without an area, or shorter than its rows say."""
    size = np.dtype(kind).itemsize
    if image is None or width <= 0 or height <= 0 or stride < width * size or len(image) < stride * height:
        return None
    return np.ndarray((height, width), kind, image, strides=(stride, size))


def image_tiles(images: DataFrame, keys: list[str], tile: int = TILE, kind: str = "u1") -> DataFrame:
    """keys and tiles of ``images`` (keys, image bytes, width, height, stride_bytes); ``kind`` is numpy's name of a value.

    An image that is null, without an area, or shorter than its rows say has no tiles.
    """

    def cut(image, width, height, stride):
        data = image_values(image, width, height, stride, kind)
        if data is None:
            return
        data = data.astype(np.uint8 if data.itemsize == 1 else _WIDE)
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                part = data[y : y + tile, x : x + tile]
                yield x // tile, y // tile, part.shape[1], part.shape[0], part.tobytes()

    return map_rows(images, keys, _BYTES, cut, ["image", "width", "height", "stride_bytes"])


def pixels(tiles: DataFrame, keys: list[str], value: str = "v", tile: int = TILE) -> DataFrame:
    """One row per pixel (keys, x, y, value), for looking at small images."""

    def spread(tx, ty, w, h, data):
        for i, v in enumerate(_grey(data, w, h).ravel().tolist()):
            yield tx * tile + i % w, ty * tile + i // w, v

    return map_rows(tiles, keys, f"x int, y int, `{value}` int", spread, [*PLACE, "data"])


def whole(tiles: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """keys, image bytes, width and height of each image put together again; an image has a bounded number of tiles."""

    def join(parts):
        width = max(p["tx"] * tile + p["w"] for p in parts)
        height = max(p["ty"] * tile + p["h"] for p in parts)
        values = [_grey(p["data"], p["w"], p["h"]) for p in parts]
        out = np.zeros((height, width), values[0].dtype)
        for p, v in zip(parts, values):
            out[p["ty"] * tile : p["ty"] * tile + p["h"], p["tx"] * tile : p["tx"] * tile + p["w"]] = v
        yield out.tobytes(), width, height

    grouped = tiles.groupBy(*keys).agg(F.collect_list(F.struct(*PLACE, "data")).alias("_parts"))
    return map_rows(grouped, keys, "image binary, width int, height int", join, ["_parts"])


# --- gather -------------------------------------------------------------------------------------


def _grid(rows: DataFrame, width: Column, height: Column, tile: int) -> DataFrame:
    """Rows once for each tile of an image of that size, with the tile's place and size."""
    last = lambda n: F.floor((n - 1) / tile).cast("int")
    spread = rows.withColumn("tx", F.explode(F.sequence(F.lit(0), last(width)))).withColumn("ty", F.explode(F.sequence(F.lit(0), last(height))))
    side = lambda n, t: F.least(F.lit(tile), n - F.col(t) * tile).cast("int")
    return spread.withColumns({"w": side(width, "tx"), "h": side(height, "ty")})


def gather(
    requests: DataFrame, tiles: DataFrame, source: list[str], target: list[str], rect: tuple[Column, Column, Column, Column],
    work: Callable[[np.ndarray, int, int, dict], np.ndarray], payload: list[str] = (), tile: int = TILE,
) -> DataFrame:
    """Tiles of new images, each made from a rectangle of its source image.

    ``requests`` has a row for each output tile: ``source`` and ``target`` keys, place and ``payload``; ``rect`` is the
    rectangle (x0, y0, x1, y1, ends included) it looks at, inside the source.  ``work`` gets the rectangle's values,
    its corner and the request, and returns the tile.  A request whose source lacks a tile gives nothing.
    """
    known = [*dict.fromkeys([*source, *target])]
    asked = requests.select(*known, *PLACE, F.struct(*[c.cast("int").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), rect)], *payload).alias("_ask"))
    under = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"_ask.{a}") / tile).cast("int"), F.floor(F.col(f"_ask.{b}") / tile).cast("int")))
    wanted = asked.withColumn("_sx", under("x0", "x1")).withColumn("_sy", under("y0", "y1"))
    have = tiles.select(*source, F.col("tx").alias("_sx"), F.col("ty").alias("_sy"), F.col("w").alias("_sw"), F.col("h").alias("_sh"), "data")
    met = wanted.join(have, [*source, "_sx", "_sy"])

    def cut(sx, sy, sw, sh, data, ask):
        x0, y0 = max(ask["x0"], sx * tile), max(ask["y0"], sy * tile)
        x1, y1 = min(ask["x1"] + 1, sx * tile + sw), min(ask["y1"] + 1, sy * tile + sh)
        if x1 > x0 and y1 > y0:
            part = _grey(data, sw, sh)[y0 - sy * tile : y1 - sy * tile, x0 - sx * tile : x1 - sx * tile]
            yield x0 - ask["x0"], y0 - ask["y0"], x1 - x0, y1 - y0, part.tobytes()

    keep = [*known, *PLACE, "_ask"]
    cuts = map_rows(met, keep, "_px int, _py int, _pw int, _ph int, _cut binary", cut, ["_sx", "_sy", "_sw", "_sh", "data", "_ask"])
    parts = cuts.groupBy(*known, *PLACE).agg(F.first("_ask").alias("_ask"), F.collect_list(F.struct("_px", "_py", "_pw", "_ph", "_cut")).alias("_parts"))

    def make(tx, ty, w, h, ask, cuts):
        values = [_grey(c["_cut"], c["_pw"], c["_ph"]) for c in cuts]
        area = np.zeros((ask["y1"] - ask["y0"] + 1, ask["x1"] - ask["x0"] + 1), values[0].dtype)
        filled = 0
        for c, v in zip(cuts, values):
            area[c["_py"] : c["_py"] + c["_ph"], c["_px"] : c["_px"] + c["_pw"]] = v
            filled += c["_pw"] * c["_ph"]
        if filled == area.size:
            out = work(area, ask["x0"], ask["y0"], ask | {"x": tx * tile, "y": ty * tile, "w": w, "h": h})
            yield tx, ty, w, h, np.ascontiguousarray(out, area.dtype).tobytes()

    return map_rows(parts, target, _BYTES, make, [*PLACE, "_ask", "_parts"])


def crop(tiles: DataFrame, frame_roi: DataFrame, frame: list[str], tile: int = TILE) -> DataFrame:
    """Tiles of each usable region, counted from the region's corner: frame keys, roi_name, place, data."""
    boxes = frame_roi.where("in_image").select(*frame, "roi_name", "rx0", "ry0", "rx1", "ry1")
    asked = _grid(boxes, F.col("rx1") - F.col("rx0") + 1, F.col("ry1") - F.col("ry0") + 1, tile)
    x, y = F.col("rx0") + F.col("tx") * tile, F.col("ry0") + F.col("ty") * tile
    return gather(asked, tiles, frame, [*frame, "roi_name"], (x, y, x + F.col("w") - 1, y + F.col("h") - 1), lambda area, x0, y0, ask: area, tile=tile)


def warp(tiles: DataFrame, targets: DataFrame, frame: list[str], tile: int = TILE) -> DataFrame:
    """Perspective crop: every output pixel blends the (at most four) source pixels around its source point.

    ``targets`` has frame keys, roi_name, a nine-value ``matrix`` (output to source), ``out_w``, ``out_h`` and the
    frame's ``width`` and ``height``.  An output tile asks for the rectangle around its mapped corners; where the
    matrix's horizon cuts the tile, corners bound nothing and it asks for the whole image.
    """
    asked = _grid(targets, F.col("out_w"), F.col("out_h"), tile)
    corners = [(F.col("tx") * tile + dx, F.col("ty") * tile + dy) for dx in (F.lit(0), F.col("w") - 1) for dy in (F.lit(0), F.col("h") - 1)]
    m = F.col("matrix")
    depth = [m[6] * x + m[7] * y + m[8] for x, y in corners]
    safe = (F.least(*depth) > 1e-9) | (F.greatest(*depth) < -1e-9)
    mapped = [apply_homography("matrix", x, y) for x, y in corners]

    def low(axis: int, size: str) -> Column:
        at = F.greatest(F.floor(F.least(*[p[axis] for p in mapped])), F.lit(0))
        return F.when(safe, F.least(at, F.col(size) - 1)).otherwise(0).cast("int")

    def high(axis: int, size: str) -> Column:
        at = F.least(F.floor(F.greatest(*[p[axis] for p in mapped])) + 1, F.col(size) - 1)
        return F.when(safe, F.greatest(at, F.lit(0))).otherwise(F.col(size) - 1).cast("int")

    def blend(area, x0, y0, ask):
        x, y = np.meshgrid(np.arange(ask["x"], ask["x"] + ask["w"], dtype=np.float64), np.arange(ask["y"], ask["y"] + ask["h"], dtype=np.float64))
        a = np.asarray(ask["matrix"], np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            below = a[6] * x + a[7] * y + a[8]
            sx, sy = (a[0] * x + a[1] * y + a[2]) / below, (a[3] * x + a[4] * y + a[5]) / below
        # A point that maps to infinity reads the corner.
        far = np.abs(below) < 1e-9
        sx, sy = np.where(far, 0.0, sx), np.where(far, 0.0, sy)
        sx, sy = np.clip(sx, 0.0, ask["width"] - 1.0), np.clip(sy, 0.0, ask["height"] - 1.0)
        ax, ay = np.floor(sx), np.floor(sy)
        dx, dy = sx - ax, sy - ay
        left, top = ax.astype(int) - x0, ay.astype(int) - y0
        right, bottom = np.minimum(left + 1, area.shape[1] - 1), np.minimum(top + 1, area.shape[0] - 1)
        v = area.astype(np.float64)
        return np.rint(v[top, left] * (1 - dx) * (1 - dy) + v[top, right] * dx * (1 - dy) + v[bottom, left] * (1 - dx) * dy + v[bottom, right] * dx * dy)

    return gather(asked, tiles, frame, [*frame, "roi_name"], (low(0, "width"), low(1, "height"), high(0, "width"), high(1, "height")), blend, ["matrix", "width", "height"], tile)


def apply_shifts(tiles: DataFrame, shifts: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Images moved by (dx, dy) with edge pixels repeated; ``shifts`` has keys, dx, dy, width, height."""
    asked = _grid(shifts, F.col("width"), F.col("height"), tile)
    at = lambda t, d, size, more: F.greatest(F.lit(0), F.least(F.col(t) * tile + F.col(d) + more, F.col(size) - 1))

    def move(area, x0, y0, ask):
        x = np.clip(np.arange(ask["x"], ask["x"] + ask["w"]) + ask["dx"], 0, ask["width"] - 1) - x0
        y = np.clip(np.arange(ask["y"], ask["y"] + ask["h"]) + ask["dy"], 0, ask["height"] - 1) - y0
        return area[np.ix_(y, x)]

    rect = (at("tx", "dx", "width", 0), at("ty", "dy", "height", 0), at("tx", "dx", "width", F.col("w") - 1), at("ty", "dy", "height", F.col("h") - 1))
    return gather(asked, tiles, keys, keys, rect, move, ["dx", "dy", "width", "height"], tile)


def apply_mask(tiles: DataFrame, masks: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Tiles whose values become zero where the mask is zero; ``masks`` are tiles of mask images, joined by ``on``."""
    both = tiles.join(masks.select(*on, "tx", "ty", F.col("w").alias("_mw"), F.col("h").alias("_mh"), F.col("data").alias("_mask")), [*on, "tx", "ty"], "left")

    def hide(tx, ty, w, h, data, mw, mh, mask):
        if mask is None or mw * mh != w * h:
            yield tx, ty, w, h, data
        else:
            v = _grey(data, w, h)
            yield tx, ty, w, h, np.where(_grey(mask, mw, mh).reshape(h, w) == 0, 0, v).astype(v.dtype).tobytes()

    return map_rows(both, keys, _BYTES, hide, [*PLACE, "data", "_mw", "_mh", "_mask"])


# --- light channels -----------------------------------------------------------------------------


def light_channels(tiles: DataFrame, specs: DataFrame, cube: list[str], on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Channel tiles per cube (view and region), and channels that lack one of their lights or have it twice.

    ``tiles`` has cube keys and light_id; ``specs`` (channel, operation, lights, valid) joins by ``on``.  A channel is
    made where its cube has each of its lights once.  Which lights a cube has follows from its first tiles without
    reading values; the tiles of a place then meet in one group of as many rows as the channels name lights.
    """
    lights = F.array_distinct("lights")
    valid = specs.where("valid")
    named = valid.select(*on, "channel", F.size(lights).alias("need"), F.explode(lights).alias("light_id"))
    lit = tiles.where("tx = 0 AND ty = 0").groupBy(*cube, "light_id").agg(F.count("*").alias("times"))
    wanted = lit.select(*cube).distinct().join(valid.select(*on, "channel", "operation", lights.alias("lights")).distinct(), on)
    have = lit.where("times = 1").join(named, [*on, "light_id"]).groupBy(*cube, "channel").agg(F.count("*").alias("have"))
    # A small table of names that four of the steps below read.
    judged = cut_lineage(wanted.join(have, [*cube, "channel"], "left").withColumn("whole", F.coalesce("have", F.lit(0)) == F.size("lights")))
    missing = judged.where("NOT whole").select(*cube, "channel")
    plans = judged.where("whole").groupBy(*cube).agg(F.collect_list(F.struct("channel", "operation", "lights")).alias("_plans"))
    used = judged.where("whole").select(*cube, F.explode("lights").alias("light_id")).distinct()
    contrast = judged.where("whole AND operation = 'local_contrast'").select(*cube, F.explode("lights").alias("light_id")).distinct()

    def total(w, h, data):
        yield w * h, int(_grey(data, w, h).sum(dtype=np.int64))

    sums = map_rows(tiles.join(contrast, [*cube, "light_id"], "left_semi"), [*cube, "light_id"], "n long, total long", total, ["w", "h", "data"])
    mean = sums.groupBy(*cube, "light_id").agg(F.floor(F.sum("total") / F.sum("n")).cast("int").alias("_mean"))
    placed = tiles.join(used, [*cube, "light_id"], "left_semi").join(mean, [*cube, "light_id"], "left")
    groups = placed.groupBy(*cube, *PLACE).agg(F.collect_list(F.struct("light_id", "_mean", "data")).alias("_lit")).join(plans, cube)

    def build(tx, ty, w, h, lit, plans):
        values = {r["light_id"]: _grey(r["data"], w, h) for r in lit}
        means = {r["light_id"]: r["_mean"] for r in lit}
        for plan in plans:
            stack = [values[name] for name in plan["lights"] if name in values]
            if len(stack) < len(plan["lights"]):
                continue
            if plan["operation"] == "light":
                out = stack[0]
            elif plan["operation"] == "local_contrast":
                out = np.abs(stack[0].astype(np.int64) - means[plan["lights"][0]]).astype(stack[0].dtype)
            else:  # absolute difference and spread are both maximum minus minimum
                out = np.max(stack, axis=0) - np.min(stack, axis=0)
            yield plan["channel"], tx, ty, w, h, out.tobytes()

    return map_rows(groups, cube, f"channel string, {_BYTES}", build, [*PLACE, "_lit", "_plans"]), missing


def _scaled(data: bytes, w: int, h: int, scale: float) -> np.ndarray:
    return np.clip(_grey(data, w, h).ravel() / scale, 0.0, 1.0)


def feature_tensors(channels: DataFrame, cube: list[str], scale: float = 255.0) -> DataFrame:
    """Channel values over ``scale`` clipped to [0, 1], tile by tile: cube, channel, place, values array<float>."""

    def tensor(tx, ty, w, h, data):
        yield tx, ty, w, h, _scaled(data, w, h, scale).astype(np.float32)

    return map_rows(channels, [*cube, "channel"], "tx int, ty int, w int, h int, values array<float>", tensor, [*PLACE, "data"])


def tensor_shapes(channels: DataFrame, cube: list[str], tile: int = TILE) -> DataFrame:
    """Per cube and channel height, width and the ``issue`` of a tensor that has not all its values; no value is read."""
    width, height = F.max(F.col("tx") * tile + F.col("w")), F.max(F.col("ty") * tile + F.col("h"))
    shapes = channels.groupBy(*cube, "channel").agg(height.alias("height"), width.alias("width"), F.sum(F.col("w") * F.col("h")).alias("_n"))
    issue = F.when(F.col("_n") != F.col("height") * F.col("width"), F.lit("feature channel length mismatch"))
    return shapes.withColumn("issue", issue).drop("_n")


def statistical_embedding(channels: DataFrame, cube: list[str], positions: DataFrame, dim: int, scale: float = 255.0, per_model: list[str] = ()) -> DataFrame:
    """Mean and population deviation per channel, in channel order, padded or cut to ``dim``.

    ``positions`` has channel and pos; with ``per_model`` keys (on both sides or in ``positions`` only) there is one
    embedding per cube and model.  Tiles send their sums, so nothing of an image is gathered.
    """

    def sums(w, h, data):
        v = _scaled(data, w, h, scale)
        mean = float(v.mean())
        yield len(v), float(v.sum()), mean, float(((v - mean) ** 2).sum())

    parts = map_rows(channels, [*cube, "channel"], "n long, s double, m double, q double", sums, ["w", "h", "data"])
    # Squares around each tile's own mean, moved to the common mean.
    whole = parts.groupBy(*cube, "channel").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), (F.sum("q") + F.sum(F.col("n") * F.col("m") * F.col("m"))).alias("q"), F.sum("q").alias("inner"), F.count("*").alias("tiles")
    )
    mean = F.col("s") / F.col("n")
    spread = F.when(F.col("tiles") == 1, F.col("inner")).otherwise(F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)))
    stats = whole.select(*cube, "channel", mean.alias("m"), F.sqrt(spread / F.col("n")).alias("s"))
    on = [*[k for k in per_model if k in cube], "channel"]
    keys = [*dict.fromkeys([*cube, *per_model])]
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))
    pairs = F.flatten(F.transform(ordered, lambda p: F.array(p["m"], p["s"])))
    padded = F.slice(F.concat(pairs, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    return stats.join(positions, on).groupBy(*keys).agg(padded.alias("embedding"))


def feature_summary(channels: DataFrame, cube: list[str], tile: int = TILE) -> DataFrame:
    """Sorted channel names, their number and the region's shape; no value is read."""
    per_channel = tensor_shapes(channels, cube, tile)
    return per_channel.groupBy(*cube).agg(
        F.sort_array(F.collect_set("channel")).alias("features"), F.count("*").alias("channels"), F.max("height").alias("height"), F.max("width").alias("width")
    )
