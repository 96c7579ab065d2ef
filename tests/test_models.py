"""Detector outputs, repeated lights and plans that parse once."""

import numpy as np
from pyspark.sql import functions as F

from inspectlake.operators import models as md
from inspectlake.sources import json_lines as js


def test_detector_rows_keep_their_place_and_ragged_outputs_fail(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 1.0, 2.0], [4]), (2, [1.0, 2.0, 3.0], [3]), (3, [], [0])], "vec_id int, values array<double>, shape array<int>")
    out = md.detect(rows, ["vec_id"], lambda: (lambda batch: np.asarray(batch)), 2).collect()
    assert sorted((r["vec_id"], r["row"], r["raw"]) for r in out if r["error_code"] == 0) == [(1, 0, [1.0, 2.0]), (1, 1, [1.0, 2.0])]
    assert [(r["vec_id"], r["raw"]) for r in out if r["error_code"] == md.INTERNAL_ERROR] == [(2, None)]


def test_layers_of_a_model_become_patches(spark):
    """Maps of different size join by nearest cell; wrong numbers and shapes of outputs fail their rows only."""
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [2, 2]), (2, [5.0, 6.0, 7.0, 8.0], [2, 2]), (3, [1.0], [1, 1])], "k int, values array<double>, shape array<int>")

    def model(batch):
        if batch.shape[1:] != (2, 2):
            raise ValueError("size")
        return [batch[:, None], batch.mean((1, 2)).reshape(-1, 1, 1, 1) * np.ones((1, 2, 1, 1))]

    grid, failed = md.spatial_embeddings(rows, ["k"], lambda: model, ["a", "b"], 2, 4)
    got = {(r.k, r.patch_row, r.patch_col): r.embedding for r in grid.collect()}
    assert len(got) == 16 and got[1, 1, 3] == [4.0, 2.5, 2.5] and got[2, 0, 1] == [5.0, 6.5, 6.5]
    assert [(r.k, r.error_code, r.error) for r in failed.collect()] == [(3, md.INTERNAL_ERROR, "size")]
    for layers, load, code in ((["a"], lambda: model, md.INTERNAL_ERROR), (["a", "b"], lambda: (lambda b: [b, b]), md.INTERNAL_ERROR), (["a"], md.onnx_model("/nowhere.onnx", True), md.CONFIGURATION_ERROR)):
        cells, failed = md.embed_layers(rows.where("k < 3"), ["k"], load, layers)
        assert cells.count() == 0 and [r.error_code for r in failed.collect()] == [code, code]


def test_event_lines_are_parsed_once(spark):
    plan = js.parse_detection_events(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1, plan
