"""Spelling variants: words that one inserted, deleted or replaced code point turns into each other.

Words lie in rows of padded code-point matrices.  Two words of lengths m and m or m + 1 are one edit apart exactly when
their common prefix p and common suffix s reach the longer length minus one, so blocks of words are compared as tiles:
column by column, p and s of all pairs of a tile at once.

Tiles are only laid over words that can match.  With u = m div 3 every such pair has s >= 2u, or p >= u and s >= u, or
p >= 2u (p + s >= m - 1 leaves no other case), so a word goes into three cells, named by its last 2u, its first and last
u, or its first 2u code points, for its own length as m and for one less.  A pair counts in the first of the cells that
it fits, so nothing has to be made distinct.  Cells of more than BLOCK_ROWS words are cut into blocks and each pair of
blocks is a tile of its own; small cells are compared together, row by shifted row.  A task hands on one row for each
word of a cell (near words, and the best of them), never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inspectlake.llm.common import column, written

#: Letters of a run, least length and number of a word, and how much more frequent a form has to be.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_TIMES = 10
#: Of so many (doc_id, run) hashes one loses a code point.
DROP_EVERY = 31
BLOCK_ROWS = 2048
#: Cells of up to so many rows are compared by shifts, larger ones by tiles of so many rows.
SMALL_CELL = 48
TILE = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words of ``docs`` (doc_id, text) and how often they occur.

    Runs of LETTERS, only A-Z put in lower case; a run whose hash with its doc_id divides by DROP_EVERY loses one code
    point.  A null text has no runs; a null doc_id hashes as the empty text.  Counts are combined before the shuffle.
    """
    # Shorter runs cannot become words, so they are not even taken out of the text.
    runs = F.expr(f"regexp_extract_all(text, '[{LETTERS}]{{{least_length},}}', 0)")
    rows = docs.select(column(docs, "doc_id").cast("string").alias("id"), column(docs, "text").alias("text")).select("id", F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP_EVERY == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _cells(found: DataFrame) -> DataFrame:
    """cell, m, box, word, n: each word under three cells for its length as m and three for one less."""
    size, word = F.length("word"), F.col("word")

    def cell(m: Column, box: int) -> Column:
        u = F.floor(m / 3).cast("int")
        head, tail = (lambda k: word.substr(F.lit(1), k)), (lambda k: word.substr(size - k + 1, k))
        key = (tail(2 * u), F.concat_ws("|", head(u), tail(u)), head(2 * u))[box]
        return F.struct(F.xxhash64(m, F.lit(box), key).alias("cell"), m.cast("short").alias("m"), F.lit(box).cast("short").alias("box"))

    every = F.array(*[cell(m, box) for m in (size, size - 1) for box in range(3)])
    return found.select("word", "n", F.explode(every).alias("c")).select("c.cell", "c.m", "c.box", "word", "n")


def _blocks(cells: DataFrame, block_rows: int) -> DataFrame:
    """Cells of more than ``block_rows`` words as pairs of blocks (lo, hi); ``own`` is a row's block."""
    large = cells.groupBy("cell", "m", "box").count().where(F.col("count") > block_rows)
    large = large.select("cell", "m", "box", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    rows = cells.join(large, ["cell", "m", "box"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("cell", "m", "box", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "word", "n")


class _Rows:
    """Words of one or more cells as padded matrices, from the left and from the right."""

    def __init__(self, names: list[str]):
        width = max(map(len, names))
        self.left = np.array(names, f"U{width}").view(np.uint32).reshape(len(names), width)
        self.left = self.left.astype(np.uint8)  # padded with zeros; counts over an end are cut to the shorter size
        self.size = np.fromiter(map(len, names), np.int16, len(names))
        cols = np.arange(width)[None, :]
        self.right = np.take_along_axis(self.left, np.maximum(self.size[:, None] - 1 - cols, 0), axis=1)
        self.right[cols >= self.size[:, None]] = 0


def _common(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of common beginnings of the broadcast rows, counted up to ``most`` columns."""
    alive = a[..., 0] == b[..., 0]
    total = alive.astype(np.uint8)
    for k in range(1, most):
        alive &= a[..., k] == b[..., k]
        if not alive.any():
            break
        total += alive
    return total.astype(np.int16)


def _fits(p: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Whether pairs of sizes x, y are one edit apart and the cell (m, box) is the first that they fit."""
    short, long = np.minimum(x, y), np.maximum(x, y)
    # Equal words have p + s = 2m; words in a cell are distinct, so p < m there.
    near = (short == m) & (long - short <= 1) & (p + s >= long - 1)
    u = m // 3
    first = np.where(s >= 2 * u, 0, np.where((p >= u) & (s >= u), 1, 2))
    return near & (first == box)


def _by_shift(rows: _Rows, cell: np.ndarray, m: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of many small cells; ``cell`` numbers the cells, whose rows stand together."""
    left, right, most = [], [], rows.left.shape[1]
    for k in range(1, SMALL_CELL):
        i = np.flatnonzero(cell[k:] == cell[:-k])
        if not len(i):
            break
        j = i + k
        ok = np.abs(rows.size[i] - rows.size[j]) <= 1
        i, j = i[ok], j[ok]
        p, s = _common(rows.left[i], rows.left[j], most), _common(rows.right[i], rows.right[j], most)
        ok = _fits(np.minimum(p, rows.size[i]), np.minimum(s, rows.size[i]), rows.size[i], rows.size[j], m[i], box[i])
        left.append(i[ok])
        right.append(j[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _by_tiles(rows: _Rows, own: np.ndarray, lo: int, hi: int, m: int, box: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of one large cell, or of two blocks of it, tile by tile."""
    x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    left, right, most = [], [], min(m + 1, rows.left.shape[1])
    for a in range(0, len(x), TILE):
        i = x[a : a + TILE]
        for b in range(a if lo == hi else 0, len(y), TILE):
            j = y[b : b + TILE]
            p = _common(rows.left[i][:, None, :], rows.left[j][None, :, :], most)
            s = _common(rows.right[i][:, None, :], rows.right[j][None, :, :], most)
            size_i, size_j = rows.size[i][:, None], rows.size[j][None, :]
            short = np.minimum(size_i, size_j)
            ok = _fits(np.minimum(p, short), np.minimum(s, short), size_i, size_j, np.int16(m), np.int16(box))
            at, to = np.nonzero(ok & (i[:, None] < j[None, :]) if lo == hi else ok)
            left.append(i[at])
            right.append(j[to])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _best(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with near rows, how many these are, and the most frequent of them; rows of a cell are in word order."""
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((j, -n[j], i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
    return i[start], np.diff(np.append(start, len(i))), j[start]


_KEYS = ("cell", "m", "box", "lo", "hi")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, block pair and word to one row for each word with near words in its cell."""

    def found(table: pa.Table) -> pa.RecordBatch:
        names = table["word"].to_pylist()
        n, own = table["n"].to_numpy(), table["own"].to_numpy()
        keys = [table[k].to_numpy() for k in _KEYS]
        change = np.zeros(len(names), bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.append(np.flatnonzero(change), len(names))
        sizes = np.diff(starts)
        rows = _Rows(names)
        number = np.cumsum(change)
        small = np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes)
        # A block pair that happens to have few rows is still a tile: rows of one block meet in that block's own pair.
        small &= keys[3] == keys[4]
        at = np.flatnonzero(small)
        part = _Rows.__new__(_Rows)
        part.left, part.right, part.size = rows.left[at], rows.right[at], rows.size[at]
        i, j = _by_shift(part, number[at], keys[1][at], keys[2][at])
        pairs = [(at[i], at[j])]
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1 and not small[a]:
                part.left, part.right, part.size = rows.left[a:b], rows.right[a:b], rows.size[a:b]
                i, j = _by_tiles(part, own[a:b], keys[3][a], keys[4][a], int(keys[1][a]), int(keys[2][a]))
                pairs.append((a + i, a + j))
        i, count, j = _best(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), n)
        word = table["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(i)), pa.array(count.astype(np.int64)), pa.array(n[j]), word.take(pa.array(j))], names=["word", "n_near", "best_n", "best"])

    wait: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        wait.append(batch)
        held += batch.num_rows
        last = [batch[k][batch.num_rows - 1].as_py() for k in _KEYS]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(_KEYS, last):
            same &= batch[k].to_numpy() == v
        cut = int(np.argmax(same))
        if not cut or held < 4 * BLOCK_ROWS:  # the last cell may go on in the next batch
            continue
        yield found(pa.Table.from_batches([*wait[:-1], batch.slice(0, cut)]))
        wait, held = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield found(pa.Table.from_batches(wait))


def near_words(found: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, n_near, best_n, best of the words of ``found`` (word, n) that have a near word.

    ``best`` is the near word of largest n, of equal ones the smallest in code-point order.  Words are code points up to
    U+00FF of at least six.
    """
    rows = _blocks(_cells(found), block_rows)
    rows = rows.repartition("cell", "m", "box", "lo", "hi").sortWithinPartitions("cell", "m", "box", "lo", "hi", "word")
    some = rows.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): the end of each word's chain, found by doubling.

    A form is at least FORM_TIMES as frequent as its word, so there are no cycles, chains are as long as a count has
    digits, and a few rounds do.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    Null and empty texts, and texts without long runs, add nothing; rows that are repeated count again; an empty table
    gives no rows.  A text's length is no matter, as runs leave the text one by one.  Other columns are not read.
    """
    found = written(words(docs), "words")
    near = written(near_words(found), "near")
    judged = found.join(near, "word", "left").withColumn("has", F.col("best_n") >= FORM_TIMES * F.col("n"))
    forms = near.join(found, "word").where(F.col("best_n") >= FORM_TIMES * F.col("n")).select("word", F.col("best").alias("form"))
    ends = roots(forms)
    out = judged.select("word", F.when(F.col("has"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
