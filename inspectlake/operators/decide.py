"""Candidate filtering, job decisions, result contracts and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.functions import text
from inspectlake.functions.boxes import aspect_ok

QUALITY_FAILED, DETECTOR_TIMEOUT, CRC_MISMATCH, INVALID_PAYLOAD, CONFIGURATION_ERROR = 7, 5, 3, 2, 13


def judge_candidates(
    candidates: DataFrame,
    recheck_score: float | Column = 0.5,
    ng_score: float | Column = 0.8,
    min_area_px: int | Column = 1,
    min_aspect: float | Column = 0.0,
    max_aspect: float | Column = 0.0,
) -> DataFrame:
    """Every candidate with its ``decision``, null where it does not count; own thresholds win over the recipe's.

    The limits are numbers or columns of the candidates' recipe.
    """
    recheck = F.coalesce(F.col("recheck_score"), F.lit(recheck_score))
    ng = F.coalesce(F.col("ng_score"), F.lit(ng_score))
    is_ng = (
        (F.col("score") >= ng)
        & (F.col("area_px") >= min_area_px)
        & aspect_ok("x0", "y0", "x1", "y1", min_aspect, max_aspect)
    )
    return candidates.withColumn("decision", F.when(is_ng, F.lit("NG")).when(F.col("score") >= recheck, F.lit("RECHECK")))


def filter_defects(candidates: DataFrame, *limits: float | Column, **named: float | Column) -> DataFrame:
    """Candidates that count, with ``decision`` and ``severity``."""
    judged = judge_candidates(candidates, *limits, **named).where(F.col("decision").isNotNull())
    return judged.withColumn("severity", F.when(F.col("decision") == "NG", F.lit("critical")).otherwise(F.lit("suspect")))


def defect_counts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per job: counted NG and RECHECK candidates, and the overflow of its regions, in one pass."""
    overflow = F.sum("overflow") if "overflow" in judged.columns else F.lit(0)
    return judged.groupBy(*keys).agg(
        F.count_if(F.col("decision") == "NG").alias("ng"), F.count_if(F.col("decision") == "RECHECK").alias("recheck"), overflow.alias("overflow_count")
    )


def job_decisions(jobs: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """NG over RECHECK over OK per job; failed quality and overflow turn it into RECHECK.

    ``jobs`` carries ``quality_pass`` (and may bring its own ``overflow_count``); only per-job counts
    are joined.
    """
    counts = defect_counts(judged, keys)
    if "overflow_count" in jobs.columns:
        counts = counts.drop("overflow_count")
    ng, recheck = F.coalesce("ng", F.lit(0)), F.coalesce("recheck", F.lit(0))
    found = F.when(ng > 0, F.lit("NG")).when(recheck > 0, F.lit("RECHECK")).otherwise(F.lit("OK"))
    spilled = (found == "OK") & (F.coalesce("overflow_count", F.lit(0)) > 0)
    passed = F.col("quality_pass")
    return jobs.join(counts, keys, "left").select(
        *keys,
        F.when(~passed | spilled, F.lit("RECHECK")).otherwise(found).alias("decision"),
        F.when(~passed, QUALITY_FAILED).when(spilled, CONFIGURATION_ERROR).otherwise(0).alias("error_code"),
        "quality_pass",
        F.when(passed, ng + recheck).otherwise(0).alias("defect_count"),
    )


def first_issue(rules: list[tuple[Column, str]]) -> Column:
    """Text of the first rule that holds, null when none does."""
    out = F.lit(None).cast("string")
    for rule, message in reversed(rules):
        out = F.when(rule, F.lit(message)).otherwise(out)
    return out


def result_contract(results: DataFrame) -> DataFrame:
    """Results with the first broken rule; a broken result is published as RECHECK with InvalidPayload.

    Needs the expected ids as ``want_sequence_id``, ``want_trigger_id``, ``want_seat_id`` and the
    number of defect records as ``defect_rows``.
    """
    c = F.col
    ok, ng = c("decision") == "OK", c("decision") == "NG"
    no_error = c("error_code") == 0
    issue = first_issue(
        [
            (c("sequence_id") != c("want_sequence_id"), "detector result sequence_id mismatch"),
            (c("trigger_id") != c("want_trigger_id"), "detector result trigger_id mismatch"),
            (c("seat_id") != c("want_seat_id"), "detector result seat_id mismatch"),
            (~c("decision").isin("OK", "NG", "RECHECK", "ERROR"), "detector result decision is invalid"),
            (c("defect_count") != c("defect_rows"), "detector result defect_count does not match payload"),
            (ok & ~c("quality_pass"), "detector result OK with quality_pass=false"),
            (ok & ~no_error, "detector result OK with non-zero error_code"),
            (ok & (c("defect_count") != 0), "detector result OK with defects"),
            (ng & ~c("quality_pass"), "detector result NG with quality_pass=false"),
            (ng & ~no_error, "detector result NG with non-zero error_code"),
            (ng & (c("defect_count") == 0), "detector result NG without defects"),
            ((c("decision") == "ERROR") & no_error, "detector result ERROR with empty error_code"),
            (
                (c("decision") == "RECHECK") & no_error & ~c("quality_pass"),
                "detector result RECHECK with quality_pass=false but no error_code",
            ),
        ]
    )
    return results.withColumn("violation", issue).withColumns(
        {
            "final_decision": F.when(c("violation").isNotNull(), F.lit("RECHECK")).otherwise(c("decision")),
            "final_error_code": F.when(c("violation").isNotNull(), F.lit(INVALID_PAYLOAD)).otherwise(c("error_code")),
        }
    )


def retained(results: DataFrame, save_ok_ratio: float, save_ng: bool, save_recheck: bool, enabled: bool = True) -> DataFrame:
    """Results whose traces are kept; OK ones by a stable hash of their identity."""
    if not enabled:
        return results.where(F.lit(False))
    ratio = max(0.0, min(float(save_ok_ratio), 1.0))
    score = text.sample_score("recipe_id", "sku", "seat_id", "sequence_id", "trigger_id")
    keep_ok = F.lit(ratio >= 1.0) if ratio <= 0.0 or ratio >= 1.0 else score < ratio
    keep = (
        F.when(F.col("decision") == "OK", keep_ok)
        .when(F.col("decision") == "NG", F.lit(save_ng))
        .when(F.col("decision").isin("RECHECK", "ERROR"), F.lit(save_recheck))
        .otherwise(F.lit(True))
    )
    return results.where(keep)


def result_timeouts(jobs: DataFrame, replies: DataFrame, keys: list[str], timeout_s: float = 5.0) -> DataFrame:
    """Earliest reply to each published job; none in time is RECHECK with DetectorTimeout, a broken one CrcMismatch.

    Keyed on the job, so replies combine before the shuffle and at most one row per job is joined.
    """
    limit = int(timeout_s * 1_000_000)
    first = (
        replies.join(jobs.select(*keys, "published_us"), keys)
        .where((F.col("reply_us") >= F.col("published_us")) & (F.col("reply_us") <= F.col("published_us") + limit))
        .groupBy(*keys)
        .agg(F.min_by(F.struct("reply_us", "corrupt"), F.struct("reply_us", "corrupt")).alias("r"))
    )
    code = (
        F.when(F.col("r").isNull(), DETECTOR_TIMEOUT).when(F.col("r.corrupt"), CRC_MISMATCH).otherwise(0)
    )
    return (
        jobs.join(first, keys, "left")
        .select(
            *keys,
            F.when(F.col("r").isNotNull(), F.col("r.reply_us") - F.col("published_us")).alias("wait_us"),
            code.alias("error_code"),
        )
        .withColumn("outcome", F.when(F.col("error_code") == 0, F.lit("RESULT")).otherwise(F.lit("RECHECK")))
    )
