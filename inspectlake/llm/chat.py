r"""Chat formatting in windows of a token budget.

A turn is written as ``<|role|>``, a line end, the text and ``<|end|>`` with a line end.  In roles and texts, ``\`` and
``|`` get a ``\`` before them, so no text can spell a control string and reading back gives every text exactly.

Windows are whole turns.  The running sum of turn tokens says where a window must end: it holds the conversation's
leading system turn, up to ``history`` tokens of turns repeated from before, and new turns while the budget lasts; one
new turn always fits, so a turn larger than the budget has a window of its own.  Only new assistant turns are under the
loss mask: what is repeated is context, and each assistant text is a target once.

Rows are shuffled once, by conversation, and streamed in order of their turns; a task holds one window and the turns it
may repeat, however long a conversation is.  The digest of a conversation must read its texts in order, so a conversation
is read by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inspectlake.llm.common import column

BUDGET = 1024
HISTORY = 256
#: Windows of one Arrow batch.
BATCH = 256
_TOKENS = re.compile(r"\w+|[^\w\s]")
_CONTROL = re.compile(r"[\\|]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|((?:[^\\|]|\\.)*)\|>\n((?:[^\\|]|\\.)*?)<\|end\|>\n", re.S)

WINDOWS = "conv_id long, window long, text string, repeated int, loss array<struct<start: int, stop: int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def count_tokens(text: str) -> int:
    """Words and single marks."""
    return sum(1 for _ in _TOKENS.finditer(text))


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[dict]]:
    """Text of a window and the spans under the loss mask: new assistant texts, escaped as they stand."""
    parts, loss, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = f"<|{escape(role)}|>\n", escape(text)
        if k >= repeated and role == "assistant":
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + len("<|end|>\n")
    return "".join(parts), loss


def parse(window: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


class Windows:
    """Windows of one conversation as its turns come in."""

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]):
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: tuple[str, str, int] | None = None
        self.past: deque[tuple[str, str, int]] = deque()
        self.past_tokens = 0
        self.new: list[tuple[str, str, int]] = []
        self.used = self.count = 0
        self.kept: list[tuple[str, str, int]] = []

    def add(self, role: str, text: str) -> dict | None:
        """Takes a turn; returns the window that it closes, if it does."""
        turn = (role, text, self.tokens(text))
        closed = None
        if self.new and self.used + turn[2] > self.budget:
            closed = self.close()
        if not self.new and self.count:
            self.kept = [self.system] if self.system else []
            room = self.budget - turn[2] - sum(t[2] for t in self.kept)
            back: list[tuple[str, str, int]] = []
            for old in reversed(self.past):
                if sum(t[2] for t in back) + old[2] > min(self.history, room):
                    break
                back.insert(0, old)
            self.kept += back
            self.used = sum(t[2] for t in self.kept)
        if role == "system" and not self.count and not self.new:
            self.system = turn
        self.new.append(turn)
        self.used += turn[2]
        return closed

    def close(self) -> dict:
        text, loss = render([t[:2] for t in self.kept + self.new], len(self.kept))
        out = {"window": self.count, "text": text, "repeated": len(self.kept), "loss": loss}
        for turn in self.new:
            if turn is not self.system:
                self.past.append(turn)
                self.past_tokens += turn[2]
        while self.past and self.past_tokens - self.past[0][2] >= self.history:
            self.past_tokens -= self.past.popleft()[2]
        self.new, self.used, self.count = [], 0, self.count + 1
        return out


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_tokens) -> DataFrame:
    """Windows of all conversations, ordered within each partition: conv_id, window, text, repeated, loss.

    Turns are ordered by turn, then role and text; nulls come first.  Null roles and texts are empty; rows without a
    conv_id are one conversation.  ``repeated`` counts the leading turns that an earlier window already had.
    """
    own = conversations.select(*[column(conversations, c).alias(c) for c in ("conv_id", "turn", "role", "text")])
    order = ["conv_id", "turn", "role", "text"]
    rows = own.repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_windows: Windows | None = None
        conv = None
        out: list[dict] = []
        for batch in batches:
            for key, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
                if open_windows is None or key != conv:
                    if open_windows is not None:
                        out.append({"conv_id": conv} | open_windows.close())
                    open_windows, conv = Windows(budget, history, tokens), key
                closed = open_windows.add(role or "", text or "")
                if closed:
                    out.append({"conv_id": conv} | closed)
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if open_windows is not None:
            out.append({"conv_id": conv} | open_windows.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
    )
    return rows.mapInArrow(run, WINDOWS)


class Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = self.windows = 0

    def add(self, window: str, repeated: int, loss: list[dict]) -> None:
        for role, text in parse(window)[repeated:]:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(window[span["start"] : span["stop"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted += len(window)
        self.windows += 1

    def row(self, conv) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.windows


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read from their texts and masks alone.

    ``formatted`` has the windows of a conversation in one partition and in order, as ``windows`` leaves them.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            out = []
            for key, window, repeated, loss in zip(*[batch[c].to_pylist() for c in ("conv_id", "text", "repeated", "loss")]):
                if digest is None or key != conv:
                    if digest is not None:
                        out.append(digest.row(conv))
                    conv, digest = key, Digest()
                digest.add(window, repeated, loss)
            if out:
                yield _batch(out)
        if digest is not None:
            yield _batch([digest.row(conv)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return formatted.mapInArrow(run, DIGESTS)
