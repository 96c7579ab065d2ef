"""Result and station events: normalising, alerts, counts, tiles, logs and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inspectlake.operators.asof import next_after
from inspectlake.operators.ordered import HOT_GROUP_ROWS, Ordered

# Fixed values.
ALERT_EVENTS = [
    "inspection_recheck",
    "recheck_output_failed",
    "signal_result_publish_failed",
    "capture_only_result_publish_failed",
]
TARGET_MISSING_PHRASES = [
    "未识别到目标",
    "目标未检测到",
    "目标未识别",
    "目标丢失",
    "未检测到目标",
    "无目标",
    "ROI未匹配",
    "ROI无结果",
    "未匹配到目标",
    "目标不存在",
    "检测目标失败",
    "target not found",
    "no target detected",
]
TEXT_TARGET_MISSING = "未识别到目标物体"
TEXT_IMAGE_FAILED = "图像加载失败"
TEXT_SAMPLING = "模型资产未就绪，当前任务保存为训练样本"
TEXT_RECHECK = "当前结果需要复检"
TEXT_ERROR = "检测链路异常"
MODE_SAMPLING, MODE_RECHECK, MODE_ONLINE = "采样模式", "复检/异常", "在线检测"
SOURCE_DETECTOR, SOURCE_CONTROLLER = "python_detector", "cpp_controller"
LIGHT_RANK = {"DIFFUSE": 0, "POLAR_DIFFUSE": 1, "HIGH_LEFT": 2, "HIGH_RIGHT": 3}


def filled(column) -> Column:
    """Null when the text is missing or empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != "", c)


def normal_status(decision) -> Column:
    status = F.upper(F.col(decision) if isinstance(decision, str) else decision)
    return F.when(status.isin("OK", "NG", "ERROR"), status).otherwise(F.lit("RECHECK"))


def published_decision(decision: str) -> Column:
    return F.when(F.col(decision) == "ERROR", F.lit("RECHECK")).otherwise(F.col(decision))


def current_session(events: DataFrame, time_us: str, session_start_ms: int) -> DataFrame:
    """Events without a time, or no older than two seconds before the session."""
    return events.where((F.col(time_us) <= 0) | (F.col(time_us) >= (session_start_ms - 2000) * 1000))


def controller_alerts(events: DataFrame) -> DataFrame:
    return events.where((F.col("error_code") != 0) | F.col("event").isin(ALERT_EVENTS))


def target_missing(message: str = "message") -> Column:
    text = F.lower(F.col(message))
    found = F.lit(False)
    for phrase in TARGET_MISSING_PHRASES:
        found = found | text.contains(phrase.lower())
    return F.coalesce(found, F.lit(False))


def sampling() -> Column:
    return F.col("asset_unavailable") | F.col("sample_enabled")


def operation_mode(status: Column) -> Column:
    return (
        F.when(sampling(), F.lit(MODE_SAMPLING))
        .when(status.isin("RECHECK", "ERROR"), F.lit(MODE_RECHECK))
        .otherwise(F.lit(MODE_ONLINE))
    )


def status_message(status: Column, message: str = "message") -> Column:
    return (
        F.when(sampling(), F.coalesce(filled(message), F.lit(TEXT_SAMPLING)))
        .when(F.col(message) != "", F.col(message))
        .when(status == "RECHECK", F.lit(TEXT_RECHECK))
        .when(status == "ERROR", F.lit(TEXT_ERROR))
        .otherwise(F.lit(""))
    )


def display_camera(camera: str = "camera_id", pose: str = "pose_id") -> Column:
    """``camera`` or ``camera/pose`` when the pose is a different one."""
    c, p = F.col(camera), F.col(pose)
    return F.when((p != "") & (p != c), F.concat_ws("/", c, p)).otherwise(c)


def defect_label() -> Column:
    return F.coalesce(filled("class_name"), filled("roi_name"), F.col("defect_id"))


def primary_defects(defects: DataFrame, keys: list[str]) -> DataFrame:
    """Highest score per key, first listed on a tie; combines before the shuffle."""
    best = F.max_by(
        F.struct("defect_id", defect_label().alias("label"), "score", display_camera().alias("camera")),
        F.struct("score", -F.col("pos")),
    )
    return defects.groupBy(*keys).agg(best.alias("best"), F.count("*").alias("defects"))


def decision_counts(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    status = normal_status("decision")
    counts = [F.count("*").alias("total")] + [
        F.count_if(status == s).alias(n) for s, n in (("OK", "ok"), ("NG", "ng"), ("RECHECK", "recheck"), ("ERROR", "error"))
    ]
    rate = F.bround(F.col("ok") / F.greatest(F.col("total"), F.lit(1)) * 100.0, 2)
    return events.groupBy(*keys).agg(*counts).withColumn("ok_rate", rate)


def log_stats(log: DataFrame) -> DataFrame:
    """Counts over log rows whose status is one of the four known ones."""
    status = F.upper("status")
    known = log.where(status.isin("OK", "NG", "RECHECK", "ERROR"))
    return decision_counts(known.withColumn("decision", status))


def defect_distribution(results: DataFrame, defects: DataFrame, keys: list[str]) -> DataFrame:
    ng = results.where(normal_status("decision") == "NG").select(*keys)
    primary = primary_defects(defects, keys)
    return (
        ng.join(primary, keys)
        .select(F.col("best.label").alias("label"))
        .where(F.col("label") != "")
        .groupBy("label")
        .agg(F.count("*").alias("ng_count"))
    )


def camera_defects(defects: DataFrame, keys: list[str]) -> DataFrame:
    """Per event and display camera: defect count, label (with ``xN`` beyond one) and confidence."""
    shown = defects.withColumn("camera", display_camera()).where(F.col("camera") != "")
    label, n = F.col("best.label"), F.col("defects")
    counted = F.concat(F.when(label != "", label).otherwise(F.lit("NG")), F.lit(" x"), n.cast("string"))
    return primary_defects(shown, keys + ["camera"]).select(
        *keys, "camera", n.alias("defect_count"), F.when(n > 1, counted).otherwise(label).alias("defect_label"), F.col("best.score").alias("confidence")
    )


def defects_by_camera(defects: DataFrame, keys: list[str]) -> DataFrame:
    """Camera rows plus the event's summary lines."""
    tiles = camera_defects(defects, keys)
    # One entry per camera of the event: the list is as short as the camera list.
    per_event = tiles.groupBy(*keys).agg(
        F.sum("defect_count").alias("total"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("camera", "defect_count"))),
                lambda t: F.concat(t["camera"], F.lit("("), t["defect_count"].cast("string"), F.lit(")")),
            ),
            ", ",
        ).alias("camera_summary"),
    )
    first = primary_defects(defects, keys).select(*keys, F.col("best.label").alias("label"))
    summary = F.when(F.col("total") <= 1, F.col("label")).otherwise(
        F.concat(F.coalesce(filled("label"), F.lit("NG")), F.lit(" / 共 "), F.col("total").cast("string"), F.lit(" 处"))
    )
    events = per_event.join(first, keys).select(*keys, summary.alias("defect_summary"), "camera_summary")
    return tiles.join(events, keys)


def camera_status(events: DataFrame, images: DataFrame, defects: DataFrame, cameras: list[str], keys: list[str]) -> DataFrame:
    """One tile per event and camera; the first rule that holds gives status and label."""
    status = normal_status("decision")
    tiles = events.select(
        *keys,
        status.alias("status"),
        "message",
        target_missing().alias("missing"),
        F.explode(F.array(*[F.lit(c) for c in cameras])).alias("camera"),
    )
    failed = (
        images.withColumn("camera", display_camera())
        .groupBy(*keys, "camera")
        .agg((F.max("failed") & ~F.max(~F.col("failed"))).alias("image_failed"))
    )
    labels = camera_defects(defects, keys).select(*keys, "camera", F.col("defect_label").alias("ng_label"))
    joined = tiles.join(failed, keys + ["camera"], "left").join(labels, keys + ["camera"], "left")
    message = filled("message")
    rules = [
        ((F.col("status") == "NG") & F.col("ng_label").isNotNull(), "ng", F.col("ng_label")),
        (F.col("image_failed"), "warn", F.lit(TEXT_IMAGE_FAILED)),
        (F.col("missing"), "warn", F.coalesce(message, F.lit(TEXT_TARGET_MISSING))),
        (F.col("status") == "ERROR", "error", F.coalesce(message, F.col("status"))),
        (F.col("status") == "RECHECK", "warn", F.coalesce(message, F.col("status"))),
    ]
    tile, label = F.lit("ok"), F.lit("")
    for rule, name, text in reversed(rules):
        tile, label = F.when(rule, F.lit(name)).otherwise(tile), F.when(rule, text).otherwise(label)
    return joined.select(*keys, "camera", tile.alias("tile_status"), label.alias("tile_label"))


def event_message(quality_messages: str, error_message: str, error_type: str) -> Column:
    kept = F.filter(F.col(quality_messages), lambda m: m != "")
    return F.coalesce(
        F.when(F.size(kept) > 0, F.array_join(kept, "；")), filled(error_message), filled(error_type), F.lit("")
    )


def quality_reasons(job_messages: DataFrame, frame_messages: DataFrame, keys: list[str], order: str, limit: int = 5) -> DataFrame:
    """First ``limit`` reasons per job: job messages, then ``camera/light: a, b`` per failing frame.

    Both inputs have the keys and ``order``; ``job_messages`` a message, ``frame_messages`` camera_id,
    light_id and a list of messages.  Only the first few reasons of a job are ever gathered.
    """
    label = F.concat("camera_id", F.lit("/"), "light_id", F.lit(": "), F.array_join("messages", ", "))
    said = job_messages.select(*keys, F.lit(0).alias("_kind"), F.col(order).alias("_at"), F.col("message").alias("_text"))
    failing = frame_messages.where(F.size("messages") > 0).select(*keys, F.lit(1).alias("_kind"), F.col(order).alias("_at"), label.alias("_text"))
    first = Window.partitionBy(*keys).orderBy("_kind", "_at", "_text")
    kept = said.unionByName(failing).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(limit, 0))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda r: r["_text"])
    return kept.groupBy(*keys).agg(listed.alias("reasons"))


def error_reason(error_type: str, message: str) -> Column:
    return F.concat_ws(": ", filled(F.trim(error_type)), filled(F.trim(message)))


def dedupe_events(events: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """First event per identity.  Copies collapse map-side, so a hot identity stays small."""
    rest = [c for c in events.columns if c not in identity]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(*identity).agg(first.alias("r")).select(*identity, "r.*").select(*events.columns)


def display_image(images: DataFrame, keys: list[str]) -> DataFrame:
    """Best image per camera: raw first, then light order, then path."""
    light = F.create_map(*[F.lit(v) for p in LIGHT_RANK.items() for v in p])[F.col("light_id")]
    rank = F.struct(
        F.when(F.col("kind") == "raw_image", 0).otherwise(1).alias("k"),
        F.coalesce(light, F.lit(9)).alias("l"),
        F.col("path").alias("p"),
    )
    return (
        images.withColumn("camera", display_camera())
        .where(F.col("camera") != "")
        .groupBy(*keys, "camera")
        .agg(F.min_by(F.struct("kind", "light_id", "path"), rank).alias("i"))
        .select(*keys, "camera", "i.*")
    )


def tact_rate(events: DataFrame, keys: list[str], time_us: str, id_col: str, window_s: int = 60, hot_rows: int | None = None) -> DataFrame:
    """Results of the trailing ``window_s`` seconds, both ends included, at each result."""
    span = window_s * 1_000_000
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    # Each result also expires once; the running balance is the count.  A range frame would count its rows anew at each.
    row = F.struct(*[F.col(c) for c in events.columns]).alias("_row")
    enter = events.select(*keys, F.col(time_us).alias("_t"), F.lit(0).alias("_kind"), F.col(id_col).alias("_id"), F.lit(1).alias("_d"), row)
    leave = enter.select(*keys, (F.col("_t") + span).alias("_t"), F.lit(1).alias("_kind"), "_id", F.lit(-1).alias("_d"), F.lit(None).cast(enter.schema["_row"].dataType).alias("_row"))
    balance = Ordered(enter.unionByName(leave), keys, ["_t", "_kind", "_id"], limit).running(tact_rate=("sum", F.col("_d")))
    rows = balance.result().where(F.col("_kind") == 0)
    # Results of the same microsecond see each other.
    peers = F.max("tact_rate").over(Window.partitionBy(*keys, "_t"))
    return rows.withColumn("tact_rate", peers).select("_row.*", "tact_rate")


def log_tail(log: DataFrame, newest_first: list[Column], limit: int = 500) -> DataFrame:
    return log.orderBy(*newest_first).limit(limit)


def detection_log(results: DataFrame, defects: DataFrame, keys: list[str]) -> DataFrame:
    status = normal_status("decision")
    primary = primary_defects(defects, keys)
    missing = target_missing()
    return results.join(primary, keys, "left").select(
        *keys,
        "ts_us",
        F.lit(SOURCE_DETECTOR).alias("source"),
        F.coalesce(F.col("best.camera"), F.lit("")).alias("camera_id"),
        status.alias("status"),
        F.when(missing, F.col("message")).otherwise(status_message(status)).alias("reason"),
        F.coalesce(F.col("best.label"), F.lit("")).alias("defect_type"),
        F.coalesce(F.col("best.score"), F.lit(0.0)).alias("confidence"),
        "trigger_id",
        "seat_id",
        "error_code",
    )


def controller_log(events: DataFrame, keys: list[str]) -> DataFrame:
    return controller_alerts(events).select(
        *keys,
        "ts_us",
        F.lit(SOURCE_CONTROLLER).alias("source"),
        F.lit("").alias("camera_id"),
        normal_status("decision").alias("status"),
        F.coalesce(filled("message"), filled("error"), F.col("event")).alias("reason"),
        F.col("error").alias("defect_type"),
        F.lit(0.0).alias("confidence"),
        "trigger_id",
        "seat_id",
        "error_code",
    )


def camera_union(images: DataFrame, defects: DataFrame) -> DataFrame:
    named = defects.where(F.col("camera_id") != "")
    return images.select(display_camera().alias("camera")).union(named.select(display_camera().alias("camera"))).distinct()


def failed_minus_ok(images: DataFrame, keys: list[str]) -> DataFrame:
    """Cameras with a failed image and no good one, per event."""
    return (
        images.withColumn("camera", display_camera())
        .groupBy(*keys, "camera")
        .agg(F.max("failed").alias("any_failed"), F.max(~F.col("failed")).alias("any_ok"))
        .where(F.col("any_failed") & ~F.col("any_ok"))
        .select(*keys, "camera")
    )


def review_queue(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Marked for review and neither confirmed nor dismissed since."""
    marked = actions.where(F.col("action") == "mark_review").groupBy(*keys).agg(F.max("ts_us").alias("marked_us"))
    closed = (
        actions.where(F.col("action").isin("review_confirm_defect", "review_dismiss_as_ok"))
        .groupBy(*keys)
        .agg(F.max("ts_us").alias("closed_us"))
    )
    on = [marked[k] == closed[k] for k in keys] + [closed["closed_us"] >= marked["marked_us"]]
    return marked.join(closed, on, "left_anti")


def result_serials(results: DataFrame, seat: str = "seat_id") -> DataFrame:
    """Every serial a seat id can stand for, one row each: itself, any ``_`` suffix, the stem of ``SN_`` + 12 digits."""
    parts = F.split(F.col(seat), "_")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "_")
    )
    stem = F.regexp_extract(F.col(seat), r"^(.*)_[0-9]{12}$", 1)
    names = F.array_distinct(F.filter(F.concat(suffixes, F.array(stem)), lambda s: s != ""))
    plain = ~F.col(seat).contains("_")
    return results.withColumn("serial", F.explode(F.when(plain, F.array(seat)).otherwise(names)))


def match_manual_requests(requests: DataFrame, results: DataFrame, keys: list[str], timeout_s: int = 30, hot_rows: int | None = None) -> DataFrame:
    """First result for a manual serial before the wait runs out; results need a time."""
    found = next_after(
        requests, result_serials(results), keys + ["serial"], "requested_us", "ts_us", "sequence_id", ["sequence_id", "decision"], hot_rows
    )
    in_time = F.col("next_match.at") < F.col("requested_us") + timeout_s * 1_000_000
    return found.select(
        *requests.columns,
        F.when(in_time, F.col("next_match.sequence_id")).alias("result_sequence_id"),
        F.when(in_time, normal_status("next_match.decision")).otherwise(F.lit("TIMEOUT")).alias("outcome"),
    )


def acknowledge_alerts(alerts: DataFrame, actions: DataFrame, keys: list[str], timeout_s: int = 30, hot_rows: int | None = None) -> DataFrame:
    """Operator action on each alert before its countdown ends, else the automatic one."""
    found = next_after(alerts, actions, keys, "ts_us", "acted_us", "action_id", ["action"], hot_rows)
    in_time = F.col("next_match.at") < F.col("ts_us") + timeout_s * 1_000_000
    return found.select(
        *alerts.columns,
        F.when(in_time, F.col("next_match.action")).otherwise(F.lit("auto_confirm_defect")).alias("operator_action"),
    )


def valid_serial(serial: str) -> Column:
    text = F.trim(F.col(serial))
    return F.coalesce((F.length(text) <= 48) & text.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))


def excess_logs(files: DataFrame, keys: list[str], name: str, keep: int = 5) -> DataFrame:
    """Files beyond the newest ``keep`` by name; only the kept few per folder are ever ranked."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(name))
    cut = (
        files.select(*keys, name)
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= keep)
        .groupBy(*keys)
        .agg(F.min(name).alias("oldest_kept"))
    )
    return files.join(cut, keys).where(F.col(name) < F.col("oldest_kept")).drop("oldest_kept")
