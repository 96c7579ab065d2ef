"""Files on disk through the sources and sinks."""

import json

from pyspark.sql import functions as F

from inspectlake.operators import models as md
from inspectlake.sinks import tables as sk
from inspectlake.sources import json_lines as js, paths


def test_event_files(spark, tmp_path):
    lines = [
        json.dumps({"schema": "x.display_event.v1", "sequence_id": 3, "decision": "", "defects": [{"camera_id": "T"}, 5], "error": {"asset": {"kind": "bank"}}}),
        '{"schema":"x.display_event.v1","sequence_id":',
        "",
        json.dumps({"schema": "other", "sequence_id": 4}),
        json.dumps([1]),
        json.dumps({"schema": "x.display_event.v1", "sequence_id": "9", "trigger_id": None, "quality_pass": True, "defect_count": 7, "source": "rig"}),
    ]
    (tmp_path / "events.jsonl").write_text("\n".join(lines))
    out = {r["sequence_id"]: r for r in js.parse_detection_events(js.read_lines(spark, str(tmp_path))).collect()}
    assert set(out) == {3, 9}
    assert out[3]["decision"] == "RECHECK" and out[3]["defect_count"] == 1 and out[3]["asset_unavailable"] and out[3]["sample_collection"]
    assert out[3]["defects"][0]["pose_id"] == "T" and out[3]["source"] == "python_detector"
    assert out[9]["quality_pass"] and out[9]["defect_count"] == 7 and out[9]["source"] == "rig" and not out[9]["asset_unavailable"]


def test_journal_with_a_broken_line_is_void(spark):
    log = lambda i: json.dumps({"record_type": "log", "record": {"id": i, "status": "OK"}})
    rows = [("a", 1, log(1)), ("a", 2, ""), ("a", 3, log(2)), ("a", 4, json.dumps({"record_type": "operator_action", "record": {}})), ("b", 1, log(1)), ("b", 2, "{")]
    df = spark.createDataFrame(rows, "j string, n int, value string")
    assert sorted((r["j"], r["id"]) for r in js.parse_operator_log(df, ["j"], "n").collect()) == [("a", 1), ("a", 2)]
    assert [r["id"] for r in js.parse_operator_log(df, ["j"], "n", limit=1).collect()] == [2]


def test_manifest_rows(spark):
    base = {"sample_id": "s", "camera_id": "T", "roi_name": "seat", "light_id": "A", "image_path": "p.png"}
    bad = [{**base, "light_id": ""}, {**base, "bbox_xyxy_pixel": [[3, 0, 1, 1]]}, {**base, "ground_truth": [{"bbox_xyxy_pixel": [1, 2, 3]}]}, {**base, "ground_truth": 4}]
    good = [base, {**base, "ground_truth_bbox": [[1, 1, 2, 2]], "severity": "x"}, {**base, "ground_truth": [], "bbox_xyxy_pixel": [[1, 1, 2, 2]]}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(bad + good)] + [(99, "[1]"), (98, "")]
    out = {r["n"]: r for r in js.parse_manifest(spark.createDataFrame(rows, "n int, value string")).collect()}
    assert [out[i]["issue"] is not None for i in (0, 1, 2, 3, 99)] == [True] * 5 and 98 not in out
    assert [out[i]["issue"] for i in (4, 5, 6)] == [None] * 3
    assert out[4]["split"] == "unassigned" and out[4]["pose_id"] == "T" and not out[4]["has_defect"]
    assert out[5]["ground_truth"][0]["bbox"] == [1, 1, 2, 2] and out[5]["has_defect"] and out[6]["ground_truth"] == []


def test_result_folders_and_listing(spark, tmp_path):
    for name, parts in {"a": {"result.json": {"decision": "NG", "sequence_id": 4}, "job.json": {"seat_id": "S4", "recipe_id": "rj"}}, "b": {"job.json": {}}, "c": {"result.json": {"sequence_id": 1}}}.items():
        (tmp_path / name).mkdir()
        for f, body in parts.items():
            (tmp_path / name / f).write_text(json.dumps(body, indent=1))
    out = {r["trace_dir"].rsplit("/", 1)[1]: r for r in js.result_traces(js.read_documents(spark, [str(tmp_path)])).collect()}
    assert set(out) == {"a", "c"} and (out["a"]["seat_id"], out["a"]["recipe_id"], out["a"]["issue"]) == ("S4", "rj", None)
    assert out["c"]["issue"] == "missing decision"
    (tmp_path / "x_1_L1_o.PNG").write_bytes(b"1")
    assert paths.list_files(spark, str(tmp_path), "*.PNG").first()["length"] == 1


def test_image_decoding(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + bytes([10 * y + x for x in range(3)]) for y in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "i.png").write_bytes(png)
    r = paths.read_images(spark, str(tmp_path)).first()
    assert (r["width"], r["height"], r["channels"]) == (3, 2, 1) and len(r["image"]) == 6


def test_latest_snapshot_versions(spark, tmp_path):
    event = lambda seq, ts, rev, rich: (7, seq, seq, ts, rev, rich, f"r{rev}")
    schema = "station_id long, sequence_id long, trigger_id long, timestamp_ms long, revision int, enrichment boolean, note string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    path = str(tmp_path / "latest")
    assert sk.newest_version(spark, path) is None
    for n, rows in enumerate([[event(1, 10, 0, False)], [event(1, 10, 1, True)], [event(2, 20, 0, False), event(1, 10, 2, True)], [event(9, 5, 3, True)]]):
        sk.write_version(sk.merge_latest(sk.newest_version(spark, path, below=n), batch(*rows)), path, n)
        r = sk.newest_version(spark, path).first()
        assert (r["sequence_id"], r["revision"]) == [(1, 0), (1, 1), (2, 0), (2, 0)][n]


def test_models_fail_rows_not_tasks(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [2]), (2, [3.0, 4.0], [2]), (3, [1.0], [2])], "k int, values array<double>, shape array<int>").repartition(1)
    ok = {r["k"]: r for r in md.embed(df.where("k < 3"), ["k"], lambda: (lambda b: b * 2), 2).collect()}
    assert list(ok[2]["embedding"]) == [6.0, 8.0] and ok[2]["error_code"] == 0
    assert md.embed(df.where("k = 1"), ["k"], lambda: (lambda b: b), 3).first()["error_code"] == md.INTERNAL_ERROR
    assert md.embed(df, ["k"], md.onnx_model("/nowhere.onnx"), 2).first()["error_code"] == md.CONFIGURATION_ERROR
    routed = md.route(df.withColumn("model_key", F.lit("gone")), ["k"], {"gone": lambda x: md.apply_model(x, ["k"], md.onnx_model("/nowhere.onnx"))})
    assert {(r["failed_decision"], r["collect_sample"]) for r in routed.collect()} == {("RECHECK", True)}


def test_queue_versions_and_streamed_lines(spark, tmp_path):
    """A later queue replaces the earlier one, a version written twice counts once; a stream started again adds nothing."""
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "review_id long")
    path = str(tmp_path / "reviews")
    sk.write_reviews(frame([1, 2]), frame([10]), path, 0)
    for _ in range(2):
        sk.write_reviews(frame([2, 3]), frame([11, 12]), path, 1)
    assert sorted(r[0] for r in sk.newest_version(spark, f"{path}/queue").select("review_id").collect()) == [2, 3]
    assert sorted(r["review_id"] for r in spark.read.parquet(f"{path}/actions").collect()) == [10, 11, 12]
    frame([1, 2, 3]).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("review_id long").parquet(str(tmp_path / "in"))
        sk.append_stream(stream, str(tmp_path / "lines"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.schema("review_id long").json(str(tmp_path / "lines")).count() == 3


def test_assets_and_partitions(spark, tmp_path):
    bank = spark.createDataFrame([(1, [0.5]), (2, [0.25])], "vec_id long, embedding array<float>")
    folder = sk.write_model_assets("v7", bank, bank.groupBy().count(), None, str(tmp_path / "assets"))
    again = sk.write_model_assets("v8", bank.orderBy(F.desc("vec_id")), bank.groupBy().count(), None, str(tmp_path / "assets"))
    read = lambda f: {r["name"]: r for r in sk.asset_contract(spark, f).collect()}
    assert read(folder)["bank"]["content_hash"] == read(again)["bank"]["content_hash"] and read(folder)["bank"]["rows"] == 2
    assert all(r["intact"] for r in read(folder).values()) and set(read(folder)) == {"bank", "thresholds"}
    # Other vectors under the same contract are found out; inputs are named with their own hash.
    bank.where("vec_id = 1").unionByName(bank.where("vec_id = 1")).write.mode("overwrite").parquet(f"{again}/bank")
    assert not read(again)["bank"]["intact"] and read(again)["thresholds"]["intact"]
    named = sk.write_model_assets("v9", bank, bank.groupBy().count(), bank.select("vec_id"), str(tmp_path / "assets"), inputs={"samples": bank})
    rows = read(named)
    assert rows["samples"]["kind"] == "input" and rows["samples"]["content_hash"] == rows["bank"]["content_hash"] and rows["pca"]["has_pca"]
    results = spark.createDataFrame([(1, 5, 1_700_000_000_000_000)], "station_id long, sequence_id long, ts_us long")
    sk.write_by_day(results, str(tmp_path / "r"))
    assert (tmp_path / "r" / "day=20231114" / "station_id=1").is_dir()
