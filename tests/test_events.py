"""Event rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from inspectlake.functions import text
from inspectlake.operators import decide, events as ev


def test_counts_and_rate(spark):
    df = spark.createDataFrame([("OK",), ("maybe",), ("ok",)], "decision string")
    r = ev.decision_counts(df).first()
    assert (r["total"], r["ok"], r["recheck"], r["ok_rate"]) == (3, 2, 1, 66.67)


def test_target_missing_and_messages(spark):
    rows = [("ROI未匹配 seat", "RECHECK", False, False), ("", "ERROR", False, False), ("", "RECHECK", True, False), ("blur", "NG", False, True), ("", "OK", False, False)]
    df = spark.createDataFrame(rows, "message string, decision string, asset_unavailable boolean, sample_enabled boolean")
    status = ev.normal_status("decision")
    out = df.select(ev.target_missing(), ev.status_message(status), ev.operation_mode(status)).collect()
    assert [r[0] for r in out] == [True, False, False, False, False]
    assert [r[1] for r in out] == ["ROI未匹配 seat", ev.TEXT_ERROR, ev.TEXT_SAMPLING, "blur", ""]
    assert [r[2] for r in out] == [ev.MODE_RECHECK, ev.MODE_RECHECK, ev.MODE_SAMPLING, ev.MODE_SAMPLING, ev.MODE_ONLINE]


def test_primary_defect_takes_the_first_on_a_tie(spark):
    rows = [(1, 0, "a", "", "", "C", "C", 0.5), (1, 1, "b", "scratch", "", "C", "P", 0.9), (1, 2, "c", "", "seat", "C", "C", 0.9)]
    df = spark.createDataFrame(rows, "e int, pos int, defect_id string, class_name string, roi_name string, camera_id string, pose_id string, score double")
    r = ev.primary_defects(df, ["e"]).select("best.*", "defects").first()
    assert (r["label"], r["camera"], r["score"], r["defects"]) == ("scratch", "C/P", 0.9, 3)
    tiles = {t["camera"]: (t["defect_label"], t["defect_summary"], t["camera_summary"]) for t in ev.defects_by_camera(df, ["e"]).collect()}
    assert tiles == {"C": ("seat x2", "scratch / 共 3 处", "C(2), C/P(1)"), "C/P": ("scratch", "scratch / 共 3 处", "C(2), C/P(1)")}


def test_serial_forms(spark):
    df = spark.createDataFrame([("SN1",), ("L_SN1",), ("SN1_123456789012",), ("SN1_12",)], "seat_id string")
    got = {}
    for r in ev.result_serials(df).collect():
        got.setdefault(r["seat_id"], set()).add(r["serial"])
    assert got["SN1"] == {"SN1"} and "SN1" in got["L_SN1"] and "SN1" in got["SN1_123456789012"] and "SN1" not in got["SN1_12"]


def test_manual_request_times_out_at_the_limit(spark):
    asks = spark.createDataFrame([(1, 7, "A", 1_000_000)], "request_id long, station_id long, serial string, requested_us long")
    result = lambda at: spark.createDataFrame([(5, 7, "A", at, "ng")], "sequence_id long, station_id long, seat_id string, ts_us long, decision string")
    outcome = lambda at: ev.match_manual_requests(asks, result(at), ["station_id"]).first()["outcome"]
    assert outcome(1_000_000) == "NG" and outcome(30_999_999) == "NG"
    assert outcome(31_000_000) == "TIMEOUT" and outcome(999_999) == "TIMEOUT"


def test_serial_check(spark):
    df = spark.createDataFrame([(" A-1._b ",), ("",), ("a b",), ("x" * 49,), (None,)], "s string")
    assert [r[0] for r in df.select(ev.valid_serial("s")).collect()] == [True, False, False, False, False]


def test_excess_logs(spark):
    df = spark.createDataFrame([("d", f"log{i:02d}") for i in range(8)] + [("e", "log1")], "dir string, name string")
    assert sorted(r["name"] for r in ev.excess_logs(df, ["dir"], "name").collect()) == ["log00", "log01", "log02"]


def test_retention_ratio_ends(spark):
    df = spark.createDataFrame([("r", "s", f"seat{i}", i, i, d) for i, d in enumerate(["OK", "OK", "NG", "ERROR"])], "recipe_id string, sku string, seat_id string, sequence_id long, trigger_id long, decision string")
    keep = lambda ratio, **k: decide.retained(df, ratio, **{"save_ng": True, "save_recheck": True, **k}).count()
    assert keep(0.0) == 2 and keep(1.0) == 4 and keep(5.0) == 4 and keep(0.0, save_ng=False) == 1
    assert decide.retained(df, 1.0, True, True, enabled=False).count() == 0


def test_sample_score_is_a_hash_fraction(spark):
    import hashlib

    df = spark.createDataFrame([("r", "s", 5)], "a string, b string, c long")
    want = int.from_bytes(hashlib.sha256(b"r|s|5").digest()[:8], "big") / float(1 << 64)
    assert abs(df.select(text.sample_score("a", "b", "c")).first()[0] - want) < 1e-15


def test_contract_order(spark):
    row = lambda d, q, e, n: (1, 2, "s", d, q, e, n, 1, 2, "s", n)
    rows = [row("OK", True, 0, 0), row("OK", False, 0, 0), row("NG", True, 0, 0), row("ERROR", False, 0, 0), row("RECHECK", False, 0, 0), row("RECHECK", True, 0, 0)]
    df = spark.createDataFrame(rows, "sequence_id int, trigger_id int, seat_id string, decision string, quality_pass boolean, error_code int, defect_count int, want_sequence_id int, want_trigger_id int, want_seat_id string, defect_rows int")
    out = decide.result_contract(df).collect()
    assert [r["violation"] is None for r in out] == [True, False, False, False, False, True]
    assert all(r["final_decision"] == "RECHECK" and r["final_error_code"] == 2 for r in out if r["violation"])


def test_names(spark):
    df = spark.createDataFrame([(2, 13, 1_700_000_000_000_042, "a b/ü-é_1")], "d int, e int, us long, n string")
    r = df.select(text.decision_name("d"), text.error_name("e"), text.manual_serial("us"), text.safe_name("n"), text.safe_path_name("n")).first()
    assert tuple(r) == ("NG", "ConfigurationError", "MANUAL_20231114221320000042", "a_b_ü-é_1", "a_b__-__1")


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_tact_rate_keeps_rows_without_time_or_line(spark, rows, hot_rows):
    """Rows without a time see each other, as under a range frame; none is lost in either way."""
    data = [("a", 1, 0), ("a", 2, 60_000_000), ("a", 3, 60_000_001), ("a", 4, 60_000_001), ("a", 5, None), ("a", 6, None), (None, 7, 5)]
    df = spark.createDataFrame(data, "line string, id long, ts long")
    out = ev.tact_rate(df, ["line"], "ts", "id", 60, hot_rows)
    assert {r["id"]: r["tact_rate"] for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 2, 6: 2, 7: 1}
