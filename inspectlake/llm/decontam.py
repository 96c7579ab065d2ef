"""Benchmark decontamination by pigeonhole edit matching.

Each benchmark item may differ from a passage by a budget of k edits.  The item is cut into k + 1 pieces, so one piece at
least is untouched in any passage within the budget.  All pieces are searched at once; around each hit, Myers'
bit-parallel algorithm gives the smallest edit distance of the item to any passage there.

Texts and items are compared in lower case with runs of white space as one space.  Documents are read once per block of
items, in place: nothing is shuffled, and a passage that a third of the documents share costs no more than others.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from inspectlake.llm.common import column, map_arrow

#: Edits allowed for each character of an item.
BUDGET = 0.05
#: Characters of items that are searched in one pass; larger benchmarks take several.
BLOCK_CHARS = 500_000

MATCHES = "doc_id long, item_id long, distance int, start long, stop long"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 nearly equal pieces, with their offsets."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance, if at most ``most``, of ``item`` to any part of ``text``, and where that part ends."""
    where: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        where[c] |= 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, distance, best = full, 0, len(item), None
    for at, c in enumerate(text, 1):
        equal = where.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if distance <= most and (best is None or distance < best[0]):
            best = distance, at
    return best


@lru_cache(maxsize=4)
def _automaton(items: tuple[tuple[int, str], ...], rate: float):
    found: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, (_, text) in enumerate(items):
        for offset, piece in pieces(text, int(rate * len(text))):
            found[piece].append((k, offset))
    machine = ahocorasick.Automaton()
    for piece, uses in found.items():
        machine.add_word(piece, (len(piece), uses))
    machine.make_automaton()
    return machine


def matches(text: str, items: tuple[tuple[int, str], ...], rate: float) -> list[tuple[int, int, int, int]]:
    """(item_id, distance, start, stop) of the best passage for each item that ``text`` holds within the budget."""
    starts: dict[int, list[int]] = defaultdict(list)
    for end, (size, uses) in _automaton(items, rate).iter(text):
        for k, offset in uses:
            starts[k].append(end + 1 - size - offset)
    out = []
    for k, guesses in starts.items():
        item_id, item = items[k]
        budget, best, seen = int(rate * len(item)), None, None
        exact = next((g for g in guesses if g >= 0 and text.startswith(item, g)), None)
        if exact is not None:
            out.append((item_id, 0, exact, exact + len(item)))
            continue
        for guess in sorted(guesses):
            if seen is not None and guess <= seen:
                continue
            # One window serves all hits whose passages start within a budget of this one.
            seen = guess + budget
            low = max(0, guess - budget)
            window = text[low : seen + len(item) + budget]
            hit = myers(item, window, budget)
            if hit and (best is None or hit[0] < best[0]):
                best = hit[0], low + hit[1]
        if best:
            out.append((item_id, best[0], max(0, best[1] - len(item)), best[1]))
    return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[tuple[tuple[int, str], ...]]:
    """The benchmark in blocks of bounded size; null and blank items are left out, for they match nothing."""
    own = benchmark.select(column(benchmark, "item_id").alias("item_id"), column(benchmark, "text").alias("text")).where(F.length(F.trim("text")) > 0)
    out: list[list[tuple[int, str]]] = []
    size = block_chars
    for row in own.orderBy("item_id", "text").toLocalIterator():
        text = plain(row["text"])
        if not text:
            continue
        if size + len(text) > block_chars:
            out.append([])
            size = 0
        out[-1].append((row["item_id"], text))
        size += len(text)
    return [tuple(b) for b in out]


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = BUDGET) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, distance, start, stop (in the lower-cased, squeezed text).

    Of several passages that with the smallest distance is given, of equal ones the first; ``start`` is the stop less
    the item's length where the distance is not 0.  Null and empty texts match nothing; repeated rows give a row each.
    """
    own = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))

    def finder(items):
        def work(batch: pa.RecordBatch) -> dict:
            rows = [(doc, *m) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for m in matches(plain(text), items, rate)]
            return dict(zip(("doc_id", "item_id", "distance", "start", "stop"), zip(*rows) if rows else [[]] * 5))

        return work

    found = [map_arrow(own, MATCHES, finder(items)) for items in blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = BUDGET) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item within the budget; all columns unchanged."""
    at = [c.lower() for c in docs.columns].index("text")
    plain_names = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema: StructType = plain_names.schema

    def cleaner(items):
        def work(batch: pa.RecordBatch) -> dict:
            clean = pa.array([not matches(plain(t), items, rate) for t in batch[at].to_pylist()])
            return {name: batch[name].filter(clean) for name in batch.schema.names}

        return work

    for items in blocks(benchmark):
        plain_names = map_arrow(plain_names, schema, cleaner(items))
    return plain_names.toDF(*docs.columns)
