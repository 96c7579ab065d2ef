"""JSON sources read as text lines and turned into typed rows with the stations' defaults.

Each ``parse_*`` takes a DataFrame with a ``value`` text column, so batch files, streams and tables
go through the same code.  Fields are lenient: a missing or empty value becomes its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Fixed values.
DISPLAY_SCHEMA_SUFFIX = "display_event.v1"
DEFAULT_SOURCE = "python_detector"


def _text(v: str, path: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(F.col(v), f"$.{path}", "string"), F.lit(default))


def _nonempty(v: str, path: str, default) -> Column:
    text = F.try_variant_get(F.col(v), f"$.{path}", "string")
    return F.coalesce(F.when(text != "", text), default if isinstance(default, Column) else F.lit(default))


def _long(v: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col(v), f"$.{path}", "bigint"), F.lit(0))


def _flag(v: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col(v), f"$.{path}", "boolean"), F.lit(False))


def _is_object(v) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New files of a folder as they arrive; the checkpoint remembers what was read."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def _records(lines: DataFrame, fields: str) -> DataFrame:
    """Lines that hold a JSON object, each parsed once; scalars arrive as text, so any spelling of a number will do."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = F.from_json(F.col("value"), f"{fields}, _broken STRING", options)
    # Behind a generator, so that no filter on a field is pushed below and parses the line a second time.
    return lines.where(F.ltrim("value").startswith("{")).select("*", F.explode(F.array(parsed)).alias("e")).drop("value")


def _field(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"e.{name}"), F.lit(default))


def _filled(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"e.{name}"), F.lit("")), F.lit(default))


def _number(name: str, kind: str = "bigint") -> Column:
    return F.coalesce(F.col(f"e.{name}").try_cast(kind), F.lit(0).cast(kind))


def _truth(column: Column) -> Column:
    return F.coalesce(column.try_cast("boolean"), F.lit(False))


_EVENT_FIELDS = (
    "schema STRING, sequence_id STRING, trigger_id STRING, seat_id STRING, sku STRING, recipe_id STRING, decision STRING, quality_pass STRING, "
    "error_code STRING, elapsed_ms STRING, defect_count STRING, defects ARRAY<VARIANT>, message STRING, trace_dir STRING, timestamp_ms STRING, "
    "source STRING, error STRUCT<asset_unavailable: STRING, asset: MAP<STRING, STRING>>, sample_collection STRUCT<enabled: STRING>"
)


def parse_detection_events(lines: DataFrame) -> DataFrame:
    events = _records(lines, _EVENT_FIELDS).where(_field("schema").endswith(DISPLAY_SCHEMA_SUFFIX))
    get = lambda d, path, t="string": F.try_variant_get(d, f"$.{path}", t)
    blank = lambda c: F.coalesce(c, F.lit(""))
    defect = lambda d: F.struct(
        blank(get(d, "defect_id")).alias("defect_id"),
        blank(get(d, "class_name")).alias("class_name"),
        blank(get(d, "severity")).alias("severity"),
        blank(get(d, "camera_id")).alias("camera_id"),
        F.coalesce(F.nullif(get(d, "pose_id"), F.lit("")), get(d, "camera_id"), F.lit("")).alias("pose_id"),
        blank(get(d, "roi_name")).alias("roi_name"),
        F.coalesce(get(d, "score", "double"), F.lit(0.0)).alias("score"),
        blank(get(d, "decision")).alias("decision"),
    )
    objects = F.filter(F.col("e.defects"), lambda d: d.isNotNull() & _is_object(d))
    defects = F.coalesce(F.transform(objects, defect), F.array().cast(_DEFECTS))
    extra = [c for c in lines.columns if c != "value"]
    missing = _truth(F.col("e.error.asset_unavailable")) | F.coalesce(F.size("e.error.asset") > 0, F.lit(False))
    return events.withColumn("defects", defects).select(
        *extra,
        _number("sequence_id").alias("sequence_id"),
        _number("trigger_id").alias("trigger_id"),
        _field("seat_id").alias("seat_id"),
        _field("sku").alias("sku"),
        _field("recipe_id").alias("recipe_id"),
        _filled("decision", "RECHECK").alias("decision"),
        _truth(F.col("e.quality_pass")).alias("quality_pass"),
        _number("error_code", "int").alias("error_code"),
        _number("elapsed_ms", "double").alias("elapsed_ms"),
        F.coalesce(F.col("e.defect_count").try_cast("int"), F.size("defects")).alias("defect_count"),
        "defects",
        _field("message").alias("message"),
        _field("trace_dir").alias("trace_dir"),
        _number("timestamp_ms").alias("timestamp_ms"),
        _filled("source", DEFAULT_SOURCE).alias("source"),
        missing.alias("asset_unavailable"),
        (missing | _truth(F.col("e.sample_collection.enabled"))).alias("sample_collection"),
    )


_DEFECTS = (
    "array<struct<defect_id:string,class_name:string,severity:string,camera_id:string,pose_id:string,roi_name:string,score:double,decision:string>>"
)


def parse_controller_events(lines: DataFrame) -> DataFrame:
    names = ["timestamp_us", "event", "sequence_id", "trigger_id", "seat_id", "sku", "decision", "error", "error_code", "station_state", "alarm_level", "message"]
    records = _records(lines, ", ".join(f"{n} STRING" for n in names)).where(F.col("e._broken").isNull())
    extra = [c for c in lines.columns if c != "value"]
    special = {
        "timestamp_us": _number("timestamp_us"), "sequence_id": _number("sequence_id"), "trigger_id": _number("trigger_id"),
        "decision": _filled("decision", "RECHECK"), "error_code": _number("error_code", "int"),
    }
    return records.select(*extra, *[special.get(n, _field(n)).alias(n) for n in names])


def parse_operator_log(lines: DataFrame, journal: list[str], line_no: str, limit: int = 500) -> DataFrame:
    """Log records of each journal, newest ``limit``; one unreadable line voids its whole journal."""
    full = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    broken = full.where(F.col("v").isNull()).select(*journal).distinct()
    logs = full.where(_is_object(F.col("v")) & (_text("v", "record_type") == "log")).where(
        F.schema_of_variant(F.variant_get("v", "$.record", "variant")).startswith("OBJECT")
    )
    newest = Window.partitionBy(*journal).orderBy(F.desc(line_no))
    kept = logs.join(broken, journal, "left_anti").withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit)
    names = ["id", "timestamp", "source", "camera_id", "status", "reason", "defect_type", "confidence", "operator_action", "sequence_id", "trigger_id", "seat_id", "error_code"]
    kinds = {"id": "bigint", "timestamp": "double", "confidence": "double", "sequence_id": "bigint", "trigger_id": "bigint", "error_code": "int"}
    return kept.select(*journal, line_no, *[F.try_variant_get("v", f"$.record.{n}", kinds.get(n, "string")).alias(n) for n in names])


def parse_reviews(files: DataFrame) -> DataFrame:
    """Review queue snapshots, one JSON array of objects per row; anything else holds no reviews."""
    extra = [c for c in files.columns if c != "value"]
    parsed = files.withColumn("v", F.try_parse_json("value")).where(F.col("v").isNotNull())
    items = F.filter(F.try_variant_get("v", "$", "array<variant>"), lambda i: i.isNotNull() & _is_object(i))
    get = lambda n, t="string": F.try_variant_get("r", f"$.{n}", t).alias(n)
    return parsed.select(*extra, F.explode(items).alias("r")).select(
        *extra, get("id", "bigint"), get("status"), get("review_status"), get("seat_id"), get("sequence_id", "bigint")
    )


def _boxes(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", "array<array<double>>")


def _bad_boxes(v: str, path: str) -> Column:
    """True when a box field is there but is not a list of four ordered numbers each."""
    raw = F.try_variant_get(F.col(v), f"$.{path}", "variant")
    empty = raw.isNull() | F.schema_of_variant(raw).isin("VOID") | (F.try_variant_get(F.col(v), f"$.{path}", "string") == "")
    boxes = _boxes(v, path)
    wrong = lambda b: b.isNull() | (F.size(b) != 4) | F.exists(b, lambda n: n.isNull()) | (b[2] < b[0]) | (b[3] < b[1])
    return ~F.coalesce(empty, F.lit(False)) & (boxes.isNull() | F.exists(boxes, wrong))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Manifest rows with resolved ground truth; ``issue`` names what makes a row unusable.

    Ground truth is the ``ground_truth`` list, else ``ground_truth_bbox``, else ``bbox_xyxy_pixel``.
    """
    c = F.col
    extra = [n for n in lines.columns if n != "value"]
    rows = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    is_object = F.coalesce(_is_object(c("v")), F.lit(False))
    truth_box = lambda b: F.transform(b, lambda n: n.cast("int"))
    common = lambda b: F.struct(truth_box(b).alias("bbox"), _text("v", "severity").alias("severity"), _text("v", "roi_name").alias("roi_name"))
    listed = F.try_variant_get("v", "$.ground_truth", "array<variant>")
    item_box = lambda i: F.try_variant_get(i, "$.bbox_xyxy_pixel", "array<double>")
    from_list = F.transform(
        listed,
        lambda i: F.struct(
            truth_box(item_box(i)).alias("bbox"),
            F.coalesce(F.try_variant_get(i, "$.severity", "string"), F.lit("")).alias("severity"),
            F.coalesce(F.try_variant_get(i, "$.roi_name", "string"), F.lit("")).alias("roi_name"),
        ),
    )
    own, plain = _boxes("v", "ground_truth_bbox"), _boxes("v", "bbox_xyxy_pixel")
    has_list = F.try_variant_get("v", "$.ground_truth", "variant").isNotNull() & (F.schema_of_variant(F.try_variant_get("v", "$.ground_truth", "variant")) != "VOID")
    truth_type = "array<struct<bbox:array<int>,severity:string,roi_name:string>>"
    empty = F.array().cast(truth_type)
    truth = (
        F.when(has_list, from_list)
        .when(F.size(own) > 0, F.transform(own, common))
        .when(F.size(plain) > 0, F.transform(plain, common))
        .otherwise(empty)
    ).cast(truth_type)
    wrong = lambda b: b.isNull() | (F.size(b) != 4) | F.exists(b, lambda n: n.isNull()) | (b[2] < b[0]) | (b[3] < b[1])
    bad_list = has_list & (listed.isNull() | F.exists(listed, lambda i: F.coalesce(wrong(item_box(i)), F.lit(True))))
    required = ["sample_id", "light_id", "camera_id", "roi_name", "image_path"]
    issue = F.when(~is_object, F.lit("not a JSON object"))
    for name in required:
        issue = issue.when(_text("v", name) == "", F.lit(f"missing {name}"))
    issue = issue.when(_bad_boxes("v", "bbox_xyxy_pixel"), F.lit("bad bbox_xyxy_pixel")).when(
        bad_list | (~has_list & _bad_boxes("v", "ground_truth_bbox")), F.lit("bad ground truth")
    )
    typed = rows.withColumn("issue", issue).withColumn("ground_truth", truth)
    return typed.select(
        *extra,
        "issue",
        *[_text("v", n).alias(n) for n in ("sample_id", "source_trace_dir", "recipe_id", "seat_id", "decision", "camera_id", "roi_name", "light_id", "image_path")],
        _long("v", "sequence_id").alias("sequence_id"),
        _flag("v", "quality_pass").alias("quality_pass"),
        _nonempty("v", "pose_id", _text("v", "camera_id")).alias("pose_id"),
        _text("v", "split", "unassigned").alias("split"),
        _text("v", "label_status", "unlabeled").alias("label_status"),
        F.coalesce(F.try_variant_get("v", "$.has_defect", "boolean"), F.size("ground_truth") > 0).alias("has_defect"),
        "ground_truth",
    )


def read_documents(spark: SparkSession, paths: str | list[str], glob: str = "*.json") -> DataFrame:
    """Whole files below ``paths`` as (path, value): snapshots and the files of result directories."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def result_traces(files: DataFrame) -> DataFrame:
    """One row per result directory: result.json, with fields missing there taken from job.json and recipe_summary.json."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    name = F.substring_index("path", "/", -1)
    parsed = files.select(folder.alias("trace_dir"), name.alias("name"), F.try_parse_json("value").alias("v")).where(
        F.col("name").isin("result.json", "job.json", "recipe_summary.json")
    )
    pick = lambda n: F.max(F.when(F.col("name") == n, F.to_json("v")))
    joined = parsed.groupBy("trace_dir").agg(
        F.max(F.col("name") == "result.json").alias("has_result"), pick("result.json").alias("rt"), pick("job.json").alias("jt"), pick("recipe_summary.json").alias("ct")
    ).where("has_result").select("trace_dir", *[F.try_parse_json(t).alias(n) for t, n in (("rt", "r"), ("jt", "j"), ("ct", "c"))])
    from_both = lambda n: F.coalesce(F.nullif(F.try_variant_get("r", f"$.{n}", "string"), F.lit("")), F.try_variant_get("j", f"$.{n}", "string"), F.lit(""))
    decision = _text("r", "decision")
    return joined.select(
        "trace_dir",
        F.coalesce(F.try_variant_get("r", "$.sequence_id", "bigint"), F.try_variant_get("j", "$.sequence_id", "bigint"), F.lit(0)).alias("sequence_id"),
        from_both("seat_id").alias("seat_id"),
        decision.alias("decision"),
        _flag("r", "quality_pass").alias("quality_pass"),
        F.coalesce(F.try_variant_get("c", "$.recipe_id", "string"), F.try_variant_get("j", "$.recipe_id", "string"), F.lit("")).alias("recipe_id"),
        F.when(F.col("r").isNull(), F.lit("unreadable result")).when(decision == "", F.lit("missing decision")).alias("issue"),
    )
