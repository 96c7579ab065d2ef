"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, FOLDER, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


HOT = [
    "win_recheck_streak", "win_alarm_level", "win_station_state", "win_running_totals", "win_fault_backoff", "win_camera_reset",
    "win_presence_stable", "win_tact_rate", "win_retention_plan", "agg_timing_report", "join_manual_request", "join_ng_ack",
    "win_nms_merge", "join_eval_match", "agg_group_truth", "win_capture_sessions", "win_capture_zip", "agg_overlap_ranges",
    "agg_coreset_stride", "agg_calibrate_distances",
]


@pytest.mark.parametrize("name", HOT)
def test_query_with_every_group_hot(spark, con, name, monkeypatch):
    """The same results when even small groups are treated as too large for one task."""
    from inspectlake.operators import anomaly, events, fusion, ordered

    for module in (events, fusion, ordered):
        monkeypatch.setattr(module, "HOT_GROUP_ROWS", 6)
    monkeypatch.setattr(anomaly, "RANK_ROWS", 6)
    assert compare(spark, con, FOLDER, QUERIES[name], SQL[name]) is None


def test_overlaps_in_crowded_regions(spark, con, monkeypatch):
    from inspectlake.operators import fusion

    real = fusion.overlapping_pairs
    monkeypatch.setattr(fusion, "overlapping_pairs", lambda *a, **k: real(*a, **{**k, "partners": 0}))
    assert compare(spark, con, FOLDER, QUERIES["join_iou"], SQL["join_iou"]) is None
