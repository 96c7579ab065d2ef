"""Streams that wait: keyed state with event-time timers.

Rows of both sides travel as one stream with one watermark, so the engine's clock is common to them.  A bucket of keys
holds what is still open in list state and one timer for the moment at which something of it can be settled; nothing else
is touched in a batch.  An answer is final once the watermark has passed it (no earlier one can come any more), and a wait
is over once the watermark has passed its end, so results do not depend on how rows were cut into batches: they are
those of the batch operators.  Rows behind the watermark are dropped by the engine.
"""

from __future__ import annotations

import json
import pickle
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Kinds of rows: one that waits, one that answers, and one that only moves the clock.
ASK, ANSWER, TICK = "ask", "answer", "tick"
#: Keys that wait are dealt to so many groups by a hash.  A call to a state store costs a thousand times what a row does,
#: so a group reads, writes and sets its timer once a batch for all its keys.  It decides speed only.
BUCKETS = 1024


class _Waiting(StatefulProcessor):
    """The first answer at or after each question and before its wait ends, else its expiry, for the keys of a bucket.

    A bucket keeps its open rows (kind, at_us, id, detail, who) as blocks, one a batch: a state value for each row would
    cost a message each way.
    """

    names = ["who", "at_us", "ask_id", "answer_us", "answer_id", "detail"]

    def __init__(self, wait_us: int, inclusive: bool, by_detail: bool):
        self.wait_us, self.inclusive, self.by_detail = wait_us, inclusive, by_detail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, timeless = [], []
        for part in rows:
            for who, what in zip(part["who"], part["what"]):
                kind, at, ident, detail = json.loads(what)
                if kind != TICK and at is not None:
                    fresh.append((kind, at, ident, detail, who))
                elif kind == ASK:
                    timeless.append((who, None, ident, None, None, None))
        if fresh:
            self.open.appendValue((pickle.dumps(fresh),))
            self._wake(fresh, timerValues.getCurrentWatermarkInMs())
        return self._frames(timeless)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Everything up to this moment has come.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        groups: dict[str, list[tuple]] = {}
        for (block,) in self.open.get():
            for row in pickle.loads(block):
                groups.setdefault(row[4], []).append(row)
        out, stay = [], []
        for who, rows in groups.items():
            self._settle(who, rows, now, out, stay)
        if stay:
            self.open.put([(pickle.dumps(stay),)])
            self._wake(stay, timerValues.getCurrentWatermarkInMs())
        else:
            self.open.clear()
        return self._frames(out)

    def _settle(self, who: str, rows: list[tuple], now: int, out: list[tuple], stay: list[tuple]) -> None:
        """What can be told of one key's rows goes to ``out``, what is still open to ``stay``."""
        asks = sorted((r[1:3] for r in rows if r[0] == ASK), key=lambda r: (r[0], _order(r[1])))
        answers = sorted((r[1:4] for r in rows if r[0] == ANSWER), key=lambda r: (r[0], _order(r[2]), _order(r[1])) if self.by_detail else (r[0], _order(r[1])))
        times = [r[0] for r in answers]
        for at, ident in asks:
            i, end = bisect_left(times, at), at + self.wait_us
            hit = i < len(times) and (times[i] <= end if self.inclusive else times[i] < end)
            if hit and times[i] <= now:
                out.append((who, at, ident, *answers[i]))
            elif not hit and end <= now:
                out.append((who, at, ident, None, None, None))
            else:
                stay.append((ASK, at, ident, None, who))
        # Questions that are still to come are later than the watermark, so older answers are of no more use.
        stay += [(ANSWER, *r, who) for r in answers if r[0] > now]

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        # As objects: a column of numbers and nulls would turn into floating point.
        return iter([pd.DataFrame(out, columns=self.names, dtype=object)] if out else [])

    def _wake(self, rows: list[tuple], now_ms: int) -> None:
        """One timer, for the first moment at which a row of the bucket can be settled."""
        due = min(r[1] if r[0] == ANSWER else r[1] + self.wait_us for r in rows)
        due = max(due // 1000 + 1, now_ms + 1)
        timers = [timer for timer in self.handle.listTimers() if timer > now_ms]  # others go as this batch ends
        for timer in timers:
            if timer > due:
                self.handle.deleteTimer(timer)
        if not timers or min(timers) > due:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def _order(value) -> tuple:
    """Sorts nulls first."""
    return () if value is None else (value,)


def first_answers(
    asks: DataFrame, answers: DataFrame, keys: list[str], wait_us: int, lateness: str, detail: Column | None = None, inclusive: bool = False, by_detail: bool = False, ticks: DataFrame | None = None
) -> DataFrame:
    """Each question once: keys, at_us, ask_id, and answer_us, answer_id, detail of its first answer, null when none came.

    ``asks`` and ``answers`` have the keys, ``at_us`` and a long ``ask_id``, their own number; ``detail`` is a text of the answer; of answers
    at one time the smallest id is taken (``by_detail``: the smallest detail first).  A question without a time has no
    answer, and an answer without one is none.
    ``ticks`` (at_us) only move the clock: a source that has fallen silent, or has ended, is settled by them.
    """
    # Keys and values travel as two texts: a row's cost in a task follows its columns, and numbers stay exact beside nulls.
    own = F.to_json(F.struct(*keys), JSON)
    part = lambda df, kind, text: df.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket"), own.alias("who"), _what(kind, F.col("ask_id").cast("long"), text.cast("string")).alias("what"), F.col("at_us").cast("long").alias("at_us"))
    rows = part(asks, ASK, F.lit(None)).unionByName(part(answers, ANSWER, F.lit(None) if detail is None else detail))
    if ticks is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(ticks.select(F.lit(0).cast("long").alias("bucket"), F.lit("").alias("who"), _what(TICK, none, none).alias("what"), F.col("at_us").cast("long").alias("at_us")))
    timed = rows.withColumn("event_time", F.timestamp_micros("at_us")).withWatermark("event_time", lateness).drop("at_us")
    schema = "who string, at_us long, ask_id long, answer_us long, answer_id long, detail string"
    out = timed.groupBy("bucket").transformWithStateInPandas(_Waiting(wait_us, inclusive, by_detail), schema, "append", "eventTime")
    who = F.from_json("who", asks.select(*keys).schema, JSON)
    return out.select(*[who.getField(k).alias(k) for k in keys], *_Waiting.names[1:])


#: Every key and every digit of it comes back.
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _what(kind: str, ident: Column, text: Column) -> Column:
    """The JSON list [kind, at_us, id, detail]."""
    null = F.lit("null")
    said = F.regexp_extract(F.to_json(F.struct(text.alias("t")), JSON), r"(?s)^\{\"t\":(.*)\}$", 1)
    number = lambda value: F.coalesce(value.cast("string"), null)
    return F.concat(F.lit(f'["{kind}",'), number(F.col("at_us").cast("long")), F.lit(","), number(ident), F.lit(","), said, F.lit("]"))


class _Lights(StatefulProcessor):
    """Lights of one captured view, each counted once, judged when the capture is over."""

    def __init__(self, keys: list[str], expected: list[str], span_us: int):
        self.names = [*keys, "frames", "failed", "missing"]
        self.expected, self.span_us = expected, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lights = handle.getMapState("lights", "light_id string", "frames long, failed long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen: dict[str, list[int]] = {}
        newest = None
        for r in rows:
            if r["light_id"] is not None:
                counts = seen.setdefault(r["light_id"], [0, 0])
                counts[0] += 1
                counts[1] += not r["passed"]
                newest = r["at_us"] if newest is None else max(newest, r["at_us"])
        for light, (frames, failed) in seen.items():
            old = self.lights.getValue((light,)) if self.lights.containsKey((light,)) else (0, 0)
            self.lights.updateValue((light,), (old[0] + frames, old[1] + failed))
        if newest is not None:
            # One emission: a capture ends a span after the newest row, so the timer moves with it.
            due = max((newest + self.span_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
            for timer in list(self.handle.listTimers()):
                due = max(due, timer)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = {k[0]: v for k, v in self.lights.iterator()}
        self.lights.clear()
        missing = [light for light in self.expected if light not in seen]
        row = (*key, sum(v[0] for v in seen.values()), sum(v[1] for v in seen.values()), missing)
        yield Row(**dict(zip(self.names, row)))

    def close(self) -> None:
        pass


def view_lights(frames: DataFrame, keys: list[str], expected: list[str], span_us: int, lateness: str, ticks: DataFrame | None = None) -> DataFrame:
    """Each captured view once, when its capture is over: keys, frames, failed, missing lights, quality_pass.

    ``frames`` has keys, light_id, passed and at_us.  A capture is over when the watermark lies ``span_us`` behind its
    newest frame; lights are kept by name, so a light that comes twice counts once.
    """
    types = dict(frames.select(*keys).dtypes)
    rows = frames.select(*keys, "light_id", "passed", F.col("at_us").cast("long").alias("at_us"))
    if ticks is not None:
        rows = rows.unionByName(ticks.select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], F.lit(None).cast("string").alias("light_id"), F.lit(True).alias("passed"), "at_us"))
    timed = rows.withColumn("event_time", F.timestamp_micros("at_us")).withWatermark("event_time", lateness)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", frames long, failed long, missing array<string>"
    out = timed.groupBy(*keys).transformWithState(_Lights(keys, expected, span_us), schema, "append", "eventTime")
    return out.withColumn("quality_pass", (F.col("failed") == 0) & (F.size("missing") == 0))
