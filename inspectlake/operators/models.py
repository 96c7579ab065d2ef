"""Pluggable models: embeddings and detectors run batch by batch, with failures as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inspectlake.operators.ordered import cut_lineage
from inspectlake.operators.pixels import assemble_patches

# Error codes.
INTERNAL_ERROR, CONFIGURATION_ERROR = 9, 13


class AssetUnavailable(Exception):
    """A model file is missing or empty: the job is re-checked and kept as a training sample."""


def onnx_model(path: str, every_output: bool = False) -> Callable[[], Callable[[np.ndarray], np.ndarray | list[np.ndarray]]]:
    """Factory for a model file that every executor can reach; the session opens once per task.

    The model gives its first output, or the list of all of them.
    """

    def load():
        import os

        if not os.path.exists(path) or os.path.getsize(path) <= 1:
            raise AssetUnavailable(path)
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        run = lambda batch: [np.asarray(out) for out in session.run(None, {name: batch.astype(np.float32)})]
        return run if every_output else lambda batch: run(batch)[0]

    return load


def apply_model(tensors: DataFrame, keys: list[str], load: Callable, out_dim: int | None = None) -> DataFrame:
    """Model output per row: keys, ``output`` array, ``error_code`` and ``error``.

    ``tensors`` holds ``values`` and its ``shape``; rows of one shape in a batch go through together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, broken = None, None
        try:
            model = load()
        except AssetUnavailable as exc:
            broken = (CONFIGURATION_ERROR, f"asset unavailable: {exc}")
        except Exception as exc:  # a model that cannot start fails its rows, not the task
            broken = (INTERNAL_ERROR, str(exc))
        for batch in batches:
            out = batch[keys].reset_index(drop=True)
            outputs: list = [None] * len(out)
            code, text = [0] * len(out), [""] * len(out)
            if broken:
                code, text = [broken[0]] * len(out), [broken[1]] * len(out)
            else:
                shapes = [tuple(s) for s in batch["shape"]]
                for shape in dict.fromkeys(shapes):
                    at = [i for i, s in enumerate(shapes) if s == shape]
                    try:
                        stacked = np.stack([np.asarray(batch["values"].iloc[i]).reshape(shape) for i in at])
                        result = np.asarray(model(stacked)).reshape(len(at), -1)
                        if out_dim is not None and result.shape[1] != out_dim:
                            raise ValueError(f"output dimension {result.shape[1]} != {out_dim}")
                        for i, row in zip(at, result):
                            outputs[i] = row.astype(float).tolist()
                    except Exception as exc:
                        for i in at:
                            code[i], text[i] = INTERNAL_ERROR, str(exc)
            yield out.assign(output=outputs, error_code=code, error=text)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tensors.select(*keys).schema)
    return tensors.select(*keys, "values", "shape").mapInPandas(run, f"{fields}, output array<double>, error_code int, error string")


def embed_layers(tensors: DataFrame, keys: list[str], load: Callable, layers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of the feature maps of a model with one output per layer, and the rows that failed.

    Cells have keys, layer (its place in ``layers``), layer_h, layer_w, row, col and vector, as assemble_patches takes
    them; failures keys, error_code and error.  Each output is (batch, channels, height, width).  The model runs once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, broken = None, None
        try:
            model = load()
        except AssetUnavailable as exc:
            broken = (CONFIGURATION_ERROR, f"asset unavailable: {exc}")
        except Exception as exc:  # a model that cannot start fails its rows, not the task
            broken = (INTERNAL_ERROR, str(exc))
        for batch in batches:
            maps: list = [None] * len(batch)
            failed = [broken or (0, "")] * len(batch)
            shapes = [tuple(s) for s in batch["shape"]]
            for shape in [] if broken else dict.fromkeys(shapes):
                at = [i for i, s in enumerate(shapes) if s == shape]
                try:
                    outputs = model(np.stack([np.asarray(batch["values"].iloc[i]).reshape(shape) for i in at]))
                    if len(outputs) != len(layers):
                        raise ValueError(f"{len(outputs)} outputs for {len(layers)} layers")
                    for name, out in zip(layers, outputs):
                        if np.ndim(out) != 4 or len(out) != len(at):
                            raise ValueError(f"layer {name} has shape {np.shape(out)}")
                    for place, i in enumerate(at):
                        maps[i] = [
                            {"layer": n, "layer_h": out.shape[2], "layer_w": out.shape[3], "cells": np.moveaxis(out[place], 0, -1).reshape(-1, out.shape[1]).astype(float).tolist()}
                            for n, out in enumerate(map(np.asarray, outputs))
                        ]
                except Exception as exc:
                    for i in at:
                        failed[i] = (INTERNAL_ERROR, str(exc))
            yield batch[keys].reset_index(drop=True).assign(layers=maps, error_code=[f[0] for f in failed], error=[f[1] for f in failed])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tensors.select(*keys).schema)
    layer = "struct<layer: int, layer_h: int, layer_w: int, cells: array<array<double>>>"
    done = cut_lineage(tensors.select(*keys, "values", "shape").mapInPandas(run, f"{fields}, layers array<{layer}>, error_code int, error string"))
    each = done.where("error_code = 0").select(*keys, F.explode("layers").alias("l")).select(*keys, "l.layer", "l.layer_h", "l.layer_w", F.posexplode("l.cells").alias("i", "vector"))
    cells = each.select(*keys, "layer", "layer_h", "layer_w", F.floor(F.col("i") / F.col("layer_w")).cast("int").alias("row"), (F.col("i") % F.col("layer_w")).alias("col"), "vector")
    return cells, done.where("error_code <> 0").select(*keys, "error_code", "error")


def spatial_embeddings(tensors: DataFrame, keys: list[str], load: Callable, layers: list[str], height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """One vector per patch of a ``height`` x ``width`` grid, all layers joined in order, and the rows that failed."""
    cells, failed = embed_layers(tensors, keys, load, layers)
    return assemble_patches(cells, keys, height, width), failed


def embed(tensors: DataFrame, keys: list[str], load: Callable, dim: int) -> DataFrame:
    return apply_model(tensors, keys, load, dim).withColumnRenamed("output", "embedding")


def detect(tensors: DataFrame, keys: list[str], load: Callable, row_width: int) -> DataFrame:
    """Raw detector rows with their place ``row``, one per detection; a failed tensor keeps one row with its error.

    An output whose length is no multiple of ``row_width`` is a failure too.
    """
    out = apply_model(tensors, keys, load)
    ragged = (F.col("error_code") == 0) & (F.size("output") % row_width != 0)
    out = out.withColumns(
        {
            "error": F.when(ragged, F.concat(F.lit("output length "), F.size("output").cast("string"), F.lit(f" is no multiple of {row_width}"))).otherwise(F.col("error")),
            "error_code": F.when(ragged, INTERNAL_ERROR).otherwise(F.col("error_code")),
        }
    )
    count = F.floor(F.size("output") / row_width).cast("int")
    rows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("output", i * row_width + 1, F.lit(row_width)))
    good = out.where((F.col("error_code") == 0) & (F.size("output") >= row_width)).select(*keys, F.posexplode(rows).alias("row", "raw"), "error_code", "error")
    bad = out.where("error_code <> 0").select(*keys, F.lit(None).cast("int").alias("row"), F.lit(None).cast("array<double>").alias("raw"), "error_code", "error")
    return good.unionByName(bad)


def route(tensors: DataFrame, keys: list[str], backends: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each model key's rows through its backend; a key without a backend fails its rows.

    A missing asset turns a row into RECHECK and marks it as a training sample, any other failure into ERROR.
    """
    parts = [run(tensors.where(F.col("model_key") == key)) for key, run in backends.items()]
    unknown = tensors.where(~F.col("model_key").isin(list(backends))).select(
        *keys, F.lit(None).cast("array<double>").alias("output"), F.lit(INTERNAL_ERROR).alias("error_code"), F.lit("unknown model").alias("error")
    )
    rows = reduce(lambda a, b: a.unionByName(b), [p.select(*keys, "output", "error_code", "error") for p in parts] + [unknown])
    missing = F.col("error_code") == CONFIGURATION_ERROR
    decision = F.when(missing, F.lit("RECHECK")).when(F.col("error_code") != 0, F.lit("ERROR"))
    return rows.withColumns({"failed_decision": decision, "collect_sample": missing})
