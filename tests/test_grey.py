"""Pixels of vectors whose components are hard to turn into grey values."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from oracle import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Other tables do not matter: 60 vectors, some with values where single and double precision part, or outside a byte."""
    path = tmp_path_factory.mktemp("grey")
    rng = np.random.default_rng(3)
    many = rng.uniform(-0.6, 0.6, 4_000_000).astype(np.float32)
    single = np.floor((many + np.float32(0.6)) / np.float32(1.2) * np.float32(255))
    parted = many[single != np.floor((many.astype(np.float64) + 0.6) / 1.2 * 255)]
    assert len(parted) > 5
    vectors = rng.uniform(-0.6, 0.6, (60, 64)).astype(np.float32)
    vectors[::4, 9], vectors[1::4, 20], vectors[2::4, 30] = np.float32(-0.63), np.float32(0.7), np.float32(1.9)
    vectors[:, 18] = np.resize(parted, 60)
    table = pa.table({"vec_id": pa.array(range(60), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(60)], pa.int32())})
    pq.write_table(table, os.path.join(path, "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("name", [
    "agg_frame_exposure", "agg_frame_motion", "agg_frame_report", "agg_frame_sharpness", "agg_light_stability", "agg_stat_embedding", "agg_feature_tensor",
    "flt_roi_mask", "join_light_channels", "join_registration_apply", "join_registration_search", "join_roi_crop", "join_roi_warp",
])
def test_pixels_are_those_of_the_sql(spark, folder, name):
    assert compare(spark, duck(folder), folder, QUERIES[name], SQL[name]) in (None, "EMPTY")
