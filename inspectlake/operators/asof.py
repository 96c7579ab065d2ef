"""First later match per key and time, without pairing rows.

Requests, alerts and jobs all wait for "the first answer after me".  A range
join would pair every request with every answer of a busy key, so both sides
are laid out in one time order and the next answer is carried back to each
request as a running value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inspectlake.operators.ordered import Ordered


def next_after(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    right_id: str,
    take: list[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """``left`` plus struct ``next_match``: the earliest ``right`` row at or after it (ties: lowest id)."""
    answer = F.struct(F.col(right_time).alias("at"), *[F.col(c) for c in take])
    asks = left.select(
        *keys,
        (-F.col(left_time)).alias("_back"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("long").alias("_id"),
        F.lit(None).cast(right.select(answer.alias("a")).schema["a"].dataType).alias("_answer"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    answers = right.select(
        *keys,
        (-F.col(right_time)).alias("_back"),
        F.lit(0).alias("_kind"),
        (-F.col(right_id)).cast("long").alias("_id"),
        answer.alias("_answer"),
        F.lit(None).cast(asks.schema["_left"].dataType).alias("_left"),
    )
    carried = (
        Ordered(asks.unionByName(answers), keys, ["_back", "_kind", "_id"], hot_rows)
        .running(next_match=("last", F.col("_answer")))
        .result()
    )
    return carried.where(F.col("_kind") == 1).select("_left.*", "next_match")
