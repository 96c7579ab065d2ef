"""The quality gate of whole jobs: every rule fires where it should, with limits from the recipe's own row."""

import pytest

from inspectlake.operators import gate, quality as q

FRAME = (
    "frame_id long, sequence_id int, recipe_id string, camera_id string, pose_id string, light_id string, light_seq_index int, frame_index int, timestamp_us long, exposure_us int, gain double, "
    "shot_id long, robot_timestamp_us long, tx double, rx double, sku string, capture_mode int, width int, height int, stride_bytes int, channels int, pixel_format string, color_order string, dtype string, bit_depth int, image binary"
)
LIGHTS = ("A", "B")


def frames(changes):
    """Jobs of camera T with lights A and B; ``changes`` by job: {light or '*': {column: value}}, or None for no such frame."""
    rows = []
    for job, change in changes.items():
        for i, light in enumerate(LIGHTS):
            if change.get(light, {}) is None:
                continue
            row = {
                "frame_id": 10 * job + i, "sequence_id": job, "recipe_id": "r", "camera_id": "T", "pose_id": "", "light_id": light, "light_seq_index": i, "frame_index": i, "timestamp_us": 1000 + i, "exposure_us": 500,
                "gain": 1.0, "shot_id": 0, "robot_timestamp_us": 0, "tx": 0.0, "rx": 0.0, "sku": "S", "capture_mode": 0, "width": 4, "height": 4, "stride_bytes": 4, "channels": 1, "pixel_format": "MONO8", "color_order": "MONO",
                "dtype": "UINT8", "bit_depth": 8, "image": bytearray([60, 150, 90, 140, 200, 80, 130, 70, 110, 190, 60, 150, 90, 120, 180, 100]),
            }
            rows.append(tuple((row | change.get("*", {}) | change.get(light, {})).values()))
    return rows


CASES = {
    1: ({}, None),
    2: ({"A": {"pixel_format": "RGB"}}, "frame"),
    3: ({"B": {"image": bytearray(5)}}, "frame"),
    4: ({"*": {"image": bytearray(16)}}, "frame"),
    5: ({"A": None}, "T: missing required light A"),
    6: ({"B": {"timestamp_us": 900}}, "T: timestamps are not monotonic by required light order"),
    7: ({"B": {"timestamp_us": 10_000_000}}, "T: capture timestamp span 9999000us exceeds 500000us"),
    8: ({"*": {"frame_index": 7}}, "T: duplicate frame_index in required lights"),
    9: ({"*": {"light_seq_index": 0}}, "T: duplicate light_seq_index in captured lights"),
    10: ({"B": {"exposure_us": 900}}, "T: exposure delta 400us exceeds 200us"),
    11: ({"B": {"gain": 1.5}}, "T: gain delta 0.500 exceeds 0.200"),
    12: ({"A": {"shot_id": 4}}, "T: mixed empty and non-empty shot_id in required lights"),
    13: ({"*": {"capture_mode": 2}}, "T: missing shot_id in required robot lights"),
    14: ({"*": {"shot_id": 1, "robot_timestamp_us": 5, "tx": 1.0}, "B": {"tx": 1.1}}, "T: inconsistent robot_tcp_xyz_mm in required lights"),
    15: ({"*": {"shot_id": 1, "robot_timestamp_us": 5, "rx": 1.0}}, None),
    16: ({"*": {"pose_id": "P9"}}, None),
    17: ({"*": {"sku": "other"}}, "job: sku mismatch: job=other recipe=S"),
    18: ({"*": {"recipe_id": "none"}}, "job: unknown recipe: none"),
    19: ({"*": {"camera_id": "U", "light_id": "A"}, "B": {"light_id": "B"}}, "job: T: missing configured camera bundle"),
    20: ({"B": {"pose_id": "T"}}, "T/T: duplicate camera pose bundle"),
    21: ({"B": {"light_id": "C"}}, "stray"),
    22: ({"B": {"image": bytearray([250, 0] * 8)}}, "frame"),
    23: ({"*": {"recipe_id": "strict"}}, "frame"),
    24: ({"*": {"recipe_id": "wide"}, "B": {"exposure_us": 900, "timestamp_us": 900}}, None),
    25: ({"*": {"recipe_id": "posed", "pose_id": "P1", "shot_id": 1, "robot_timestamp_us": 5, "tx": 1.0}}, None),
    26: ({"*": {"recipe_id": "posed", "pose_id": "P2", "shot_id": 1, "robot_timestamp_us": 5, "tx": 1.0}}, "T/P2: camera pose not enabled by recipe"),
    27: ({"*": {"recipe_id": "posed", "pose_id": "P1"}}, "T/P1: missing shot_id in required robot lights"),
}


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame(frames({k: c for k, (c, _) in CASES.items()}), FRAME)
    recipes = spark.createDataFrame(
        [("r", "S", None, None, None), ("strict", "S", 100.0, None, None), ("wide", "S", None, 1000, False), ("posed", "S", None, None, None)],
        "recipe_id string, recipe_sku string, max_mean_gray double, max_exposure_delta_us long, require_monotonic_timestamps boolean",
    )
    views = spark.createDataFrame([("r", "T", ""), ("strict", "T", ""), ("wide", "T", ""), ("posed", "T", "P1")], "recipe_id string, camera_id string, pose_id string")
    lights = spark.createDataFrame([(r, i, n, True) for r in ("r", "strict", "wide", "posed") for i, n in enumerate(LIGHTS)], "recipe_id string, pos int, light_id string, required boolean")
    rules = gate.recipe_rules(recipes)
    seen = gate.view_reports(gate.frame_reports(df, rules), rules, views, lights, ["sequence_id"], ["tx"], ["rx"])
    jobs = {r.sequence_id: r for r in gate.job_reports(seen, ["sequence_id"]).collect()}
    return jobs, {r.sequence_id: r for r in seen.collect()}


@pytest.mark.parametrize("job", sorted(CASES))
def test_rules(judged, job):
    jobs, views = judged
    want = CASES[job][1]
    found = [*views[job].messages, *[f"job: {m}" for m in jobs[job].messages]]
    assert jobs[job].quality_pass == (want is None), found
    if want == "frame":
        assert jobs[job].failed_frames > 0
    elif want == "stray":
        assert views[job].stray_lights == 1 and views[job].first_stray == "T/C: light not in configured light_order"
    elif want:
        assert want in found


def test_limits_are_typed_and_default(spark):
    row = gate.recipe_rules(spark.createDataFrame([("r", "7", None)], "recipe_id string, max_iterations string, ng_score double")).first()
    assert (row.max_iterations, row.ng_score, row.min_correlation, row.method) == (7, 0.35, 0.05, "fixed_calibration")
    assert {k: dict(gate.recipe_rules(spark.createDataFrame([("r",)], "recipe_id string")).dtypes)[k] for k in ("max_pose_delta", "max_iterations")} == {"max_pose_delta": "double", "max_iterations": "int"}


def test_robot_pose_is_required_per_recipe(spark):
    """Posed views, and a camera listed twice, ask for robot poses; the single check takes it as a column."""
    views = spark.createDataFrame([("a", "T", ""), ("b", "T", "P1"), ("c", "T", ""), ("c", "T", "T"), ("d", "T", ""), ("d", "U", "")], "recipe_id string, camera_id string, pose_id string")
    need = {r.recipe_id: r.pose_required for r in q.robot_pose_required(views).collect()}
    assert need == {"a": False, "b": True, "c": True, "d": False}
    df = spark.createDataFrame(frames({1: {}, 2: {}}), FRAME).selectExpr("*", "sequence_id = 2 AS need")
    lights = spark.createDataFrame([("r", i, n, True) for i, n in enumerate(LIGHTS)], "recipe_id string, pos int, light_id string, required boolean")
    out = q.pose_consistency(df, lights, ["sequence_id"], ["tx"], ["rx"], required="need").collect()
    assert {r.sequence_id for r in out} == {2} and len(out) == 3
