"""Column functions on names, identifiers and decision codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
DECISIONS = {1: "OK", 2: "NG", 3: "RECHECK", 4: "ERROR"}
ERROR_NAMES = [
    "None", "ProtocolMismatch", "InvalidPayload", "CrcMismatch", "SlotUnavailable", "DetectorTimeout",
    "MissingFrame", "QualityFailed", "DeviceFault", "InternalError", "LightFault", "CameraFault",
    "TriggerSyncFault", "ConfigurationError", "Reserved14",
]
DECISION_RANK = {"OK": 0, "RECHECK": 1, "NG": 2, "ERROR": 3}


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def safe_name(value) -> Column:
    return F.regexp_replace(_c(value), r"[^\p{L}\p{N}_-]", "_")


def safe_path_name(value) -> Column:
    """ASCII form used in directory names; an empty name becomes ``unknown``."""
    text = F.regexp_replace(_c(value), r"[^A-Za-z0-9_-]", "_")
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def _lookup(pairs, value) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])[value]


def decision_name(code) -> Column:
    return F.coalesce(_lookup(DECISIONS.items(), _c(code)), F.lit("UNKNOWN"))


def decision_code(name) -> Column:
    return _lookup([(v, k) for k, v in DECISIONS.items()], _c(name))


def decision_rank(name) -> Column:
    return _lookup(DECISION_RANK.items(), _c(name))


def error_name(code) -> Column:
    return F.coalesce(_lookup(enumerate(ERROR_NAMES), _c(code)), F.lit("UnknownError"))


def manual_serial(micros) -> Column:
    """``MANUAL_`` + local time to the second + six digits of microseconds."""
    us = _c(micros)
    return F.concat(
        F.lit("MANUAL_"),
        F.date_format(F.timestamp_micros(us), "yyyyMMddHHmmss"),
        F.lpad((us % 1_000_000).cast("string"), 6, "0"),
    )


def seat_id(serial, micros) -> Column:
    """``SN_HHMMSSffffff``."""
    us = _c(micros)
    return F.concat(
        _c(serial),
        F.lit("_"),
        F.date_format(F.timestamp_micros(us), "HHmmss"),
        F.lpad((us % 1_000_000).cast("string"), 6, "0"),
    )


def sample_id(trace_name, trace_path, sequence_id, camera_id, pose_id, roi_name, light_id) -> Column:
    parts = [
        safe_name(trace_name),
        F.substring(F.sha1(_c(trace_path)), 1, 8),
        _c(sequence_id).cast("string"),
        *[safe_name(p) for p in (camera_id, pose_id, roi_name, light_id)],
    ]
    return F.concat_ws("_", *parts)


def sample_score(*parts) -> Column:
    """First eight bytes of sha256 over ``a|b|c`` as a fraction of 2^64."""
    digest = F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("double")
    return high / 4294967296.0 + low / 18446744073709551616.0


def event_json(columns: list[str], binary: list[str] = ()) -> Column:
    """Row as JSON; binary columns are replaced by their size."""
    fields = [
        F.struct(F.length(c).alias("memoryview_bytes")).alias(c) if c in binary else F.col(c)
        for c in columns
    ]
    return F.to_json(F.struct(*fields))
