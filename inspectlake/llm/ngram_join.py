"""Near duplicates by a Jaccard join of word shingles with count vectors in an R-tree.

Every document is a set of five-word shingles.  Shingles are hashed into 64 groups; the counts by group are a point, and
the sum of coordinate minima of two points bounds the overlap of their sets.  An R-tree over points therefore prunes a
whole node when the sum of minima with the node's upper corner cannot reach the overlap that the threshold asks for.

In many dimensions corners alone separate little, so the root of the tree is split by content: a document lies under
each of the first floor(n/5)+1 shingles of its set in one global order, and two documents of Jaccard similarity 0.8 or
more always meet under one of them.  The order puts shingles that are frequent in a bounded sample last; it decides
speed only, never results.

Links are wanted for components, so copies and large groups are not expanded into pairs:
1. rows with equal sets become one node;
2. every node is paired with the smallest node under any of its shingles, then under each shingle every component with the
   smallest node there; pairs are verified exactly, and links are tied together;
3. under shingles with many nodes, every node is paired with the one that most others there may be linked with, once in a
   round, so that a large group of near copies is tied by as many pairs as it has nodes;
4. only shingles under which several components remain are joined pair by pair, through an R-tree of their points, and
   survivors of the bound are verified.  After that no link between different components can exist.
Large cells of step 4 are joined block by block, so that no task holds an unbounded group.  The
tree has 64 coordinates; pairs that pass it are bounded once more by finer groups, four or more for each shingle of the
set up to FINE_GROUPS, for in 64 groups the counts of large sets are all alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inspectlake.llm.common import as_bytes, column, content_key, discard, keep_rows, map_arrow, shuffles_removed, tie, written
from inspectlake.llm.naming import numbered
from inspectlake.llm.shingles import shingle_set

GROUPS = 64
FINE_GROUPS = 4096
#: Bits for each row, and bits at most, of the filter that tells which texts are needed for exact counts.
FILTER_BITS = 16
FILTER_MOST = 1 << 27
#: Documents of the sample that only sets the order of shingles, and the share of them that makes a shingle frequent.
ORDER_SAMPLE = 20_000
FREQUENT = 0.0004
BLOCK_ROWS = 2048
FANOUT = 16
#: A row of a cell carries so many of its node's keys before the cell's, and a vector of so many groups at most.
KEYS_BEFORE = 32
CELL_GROUPS = 256
#: Cells with more rows carry fine vectors, and their nodes look for a partner in so many rounds before pairs are joined.
HOT_ROWS = 256
#: Rows of cells that a task joins at once.
CELL_ROWS = 8192
HUB_ROUNDS = 3


def need(size_a, size_b):
    """Least overlap of sets of these sizes at a Jaccard similarity of 0.8: 100 i >= 80 (a + b - i)."""
    return (4 * (size_a + size_b) + 8) // 9


def _sets(batch: pa.RecordBatch) -> dict:
    sets = [shingle_set(t) for t in as_bytes(batch["text"])]
    return {"uid": batch["uid"], "shingles": _lists(sets)}


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.array([], np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that many documents of the sample have; at most (mean set size / FREQUENT) of them."""
    total = docs.count()
    share = min(1.0, ORDER_SAMPLE / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("uid", "text")
    least = max(8, int(FREQUENT * min(total, ORDER_SAMPLE)))
    counts = map_arrow(sample, "uid long, shingles array<long>", _sets).select(F.explode("shingles").alias("s")).groupBy("s").count()
    with shuffles_removed(docs.sparkSession):
        rows = counts.where(F.col("count") >= least).select("s").toPandas()
    return np.sort(rows["s"].to_numpy(np.int64).view(np.uint64))


def _points(frequent: np.ndarray):
    def work(batch: pa.RecordBatch) -> dict:
        sizes, prints, fine, small, prefixes = [], [], [], [], []
        for text in as_bytes(batch["text"]):
            found = shingle_set(text)
            n = len(found)
            sizes.append(n)
            prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None)
            fine.append(_counts(found, min(FINE_GROUPS, max(GROUPS, 1 << (4 * n).bit_length()))))
            small.append(_counts(found, min(CELL_GROUPS, max(GROUPS, 1 << (n // 8).bit_length()))))
            if len(frequent) and n:
                at = np.searchsorted(frequent, found)
                at[at == len(frequent)] = 0
                common = frequent[at] == found
                found = np.concatenate([found[~common], found[common]])
            prefixes.append(found[: n // 5 + 1])
        return {"uid": batch["uid"], "doc_id": batch["doc_id"], "n": sizes, "print": prints, "fine": fine, "small": small, "keys": _lists(prefixes), "key": batch["key"]}

    return work


def _counts(found: np.ndarray, groups: int) -> bytes:
    counts = np.bincount((found & np.uint64(groups - 1)).astype(np.intp), minlength=groups)
    width = 1 if counts.max() < 256 else 2 if counts.max() < 65536 else 4
    return b"%d" % width + counts.astype(f"<u{width}").tobytes()


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=1).astype(np.int32)


def _fold(x: np.ndarray, groups: int) -> np.ndarray:
    """Counts by fewer groups: hashes that agree in the lower bits fall together."""
    return x.reshape(-1, groups).sum(axis=0)


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """Sum of coordinate minima; the finer of two vectors is folded to the groups of the other."""
    groups = min(len(x), len(y))
    return int(np.minimum(_fold(x, groups), _fold(y, groups)).sum())


def all_shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """``most_shared`` of every x with every y, folded to the fewest groups among them.

    The lesser of two counts is the number of levels that both reach, so the sum of minima is a sum of matrix products.
    """
    groups = min(len(v) for v in (*x, *y))
    x, y = (np.stack([_fold(v, groups) for v in z]) for z in (x, y))
    out, level = np.zeros((len(x), len(y)), np.float32), 1
    while len(at := np.flatnonzero((x.max(axis=0) >= level) & (y.max(axis=0) >= level))):
        x, y = x[:, at], y[:, at]
        out += (x >= level).astype(np.float32) @ (y >= level).astype(np.float32).T
        level += 1
    return out


class RTree:
    """Count vectors of many cells in sorted tiles; each level keeps the upper corner and the sizes of its nodes.

    A cell is a subtree of its own: no tile reaches over two of them.  ``cells`` (0, 1, ...) tell whose a point is.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, cells: np.ndarray | None = None, groups: np.ndarray | None = None):
        cells = np.zeros(len(points), np.int64) if cells is None else cells
        groups = np.arange(len(points)) if groups is None else groups
        widest = np.argsort(-points.var(axis=0))[:2]
        counts = np.bincount(cells) if len(cells) else np.zeros(1, np.int64)
        by_size = np.lexsort((sizes, cells))
        slab = np.empty(len(cells), np.int64)
        slab[by_size] = (np.arange(len(cells)) - np.repeat(np.cumsum(counts) - counts, counts)) // (FANOUT * FANOUT)
        self.order = np.lexsort((points[:, widest[1]], points[:, widest[0]], slab, cells))
        corner, least, most = points[self.order], sizes[self.order], sizes[self.order]
        self.groups = groups[self.order]
        self.levels = [(corner, least, most, np.cumsum(counts) - counts, counts)]
        while counts.max() > FANOUT:
            inner = np.arange(len(corner)) - np.repeat(np.cumsum(counts) - counts, counts)
            cuts = np.flatnonzero(inner % FANOUT == 0)
            corner, least, most = np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            counts = -(-counts // FANOUT)
            self.levels.append((corner, least, most, np.cumsum(counts) - counts, counts))

    def search(self, points: np.ndarray, sizes: np.ndarray, cells: np.ndarray | None = None, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs of one cell, and of different groups if there are any, whose sizes and summed minima allow the overlap they need."""
        cells = np.zeros(len(points), np.int64) if cells is None else cells
        groups = np.full(len(points), -1) if groups is None else groups
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # Queries in runs, so that what is open at a time does not follow the square of a cell.
        for at in range(0, len(points), 1 << 12):
            found.append(self._descend(np.arange(at, min(len(points), at + (1 << 12))), points, sizes, cells, groups))
        q, p = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return q, self.order[p]

    def _descend(self, q, points, sizes, cells, groups) -> tuple[np.ndarray, np.ndarray]:
        _, _, _, starts, counts = self.levels[-1]
        q, node = _spread(q, starts[cells[q]], counts[cells[q]])
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least, most, starts, _ = self.levels[depth]
            n = sizes[q]
            may = (5 * most[node] >= 4 * n) & (5 * n >= 4 * least[node])
            if not depth:
                may &= self.groups[node] != groups[q]
            q, node = q[may], node[may]
            stay = np.zeros(len(q), bool)
            for at in range(0, len(q), 1 << 15):
                a, b = q[at : at + (1 << 15)], node[at : at + (1 << 15)]
                stay[at : at + (1 << 15)] = np.minimum(points[a], corner[b]).sum(axis=1) >= need(sizes[a], least[b])
            q, node = q[stay], node[stay]
            if depth:
                _, _, _, below, counts = self.levels[depth - 1]
                own = cells[q]
                first = (node - starts[own]) * FANOUT
                q, node = _spread(q, below[own] + first, np.minimum(FANOUT, counts[own] - first))
        return q, node


def _spread(each: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``each`` with the numbers first, first + 1, ... first + count - 1 of its own."""
    ends = np.cumsum(count)
    return np.repeat(each, count), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node): those of keys with several nodes, with the key's smallest node as leader."""
    held = np.zeros((0, 2), np.int64)  # a last row of which it is not known yet whether its key has more
    lead: tuple | None = None  # key and leader of a run that may go on in the next batch
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch["key"].to_numpy(), batch["node"].to_numpy()], axis=1)])
        if not len(rows):
            continue
        start = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        first = np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
        leader = rows[first, 1].copy()
        many = ~start | np.append(~start[1:], False)
        if lead and rows[0, 0] == lead[0]:
            going = first == 0
            leader[going], many[going] = lead[1], True
        lead, held = ((rows[-1, 0], leader[-1]), rows[:0]) if many[-1] else (None, rows[-1:])
        out = rows[many]
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(leader[many])], names=["key", "node", "leader"])


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (uid, doc_id, text): doc_id, n_shingles, component_id, uid, and the key of the text.

    Row numbers are taken once, with the points; texts that are read again are found by their content.

    Null and blank texts have the empty set, link with nothing and are their own component; their component_id is their
    doc_id.  Rows with equal sets are linked.  Null ids are passed over when the smallest id of a component is taken.
    """
    kinds = "uid long, doc_id long, n int, print binary, fine binary, small binary, keys array<long>, key struct<k1: bigint, k2: bigint>"
    points = written(map_arrow(docs.select("uid", "doc_id", "text", content_key(F.col("text")).alias("key")), kinds, _points(_frequent(docs))), "points")
    nodes = points.where("n > 0").groupBy("print").agg(F.min_by(F.struct("uid", "keys"), "uid").alias("x")).select(F.col("x.uid").alias("node"), F.explode("x.keys").alias("key"))
    cells = nodes.select("key", "node").repartition("key").sortWithinPartitions("key", "node")
    shared = written(cells.mapInArrow(_leaders, "key long, node long, leader long"), "cells")
    vectors = points.select(F.col("uid").alias("node"), "n", F.col("fine").alias("vec"))

    def tried(pairs: DataFrame) -> DataFrame:
        fit = written(_bounded(pairs, vectors), "pairs")
        linked = verify(fit, docs, points)
        discard(fit)
        return linked

    def placed(roots: DataFrame) -> DataFrame:
        return shared.join(roots.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))

    # Each node with its smallest leader, so that a large group of near copies costs one pair a node, not one a shingle.
    lone = shared.where("leader <> node").groupBy(F.col("node").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    links = tried(lone)
    # Then, under each shingle, the smallest node of every component with the smallest of all.
    per = placed(tie(links)).groupBy("key", "root").agg(F.min("node").alias("b"))
    lead = per.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("roots")).where("roots > 1").select("key", "a")
    second = written(per.join(lead, "key").where("a <> b").select("a", "b").distinct().join(lone, ["a", "b"], "left_anti"), "second")
    links = links.unionByName(tried(second))
    roots = tie(links)
    known = lone.unionByName(second)

    def mixed(left: DataFrame) -> DataFrame:
        return left.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi and rows > 2").select("key", "rows")

    # Under shingles with many nodes, each with the one that most may be linked with; what fails is left to the join below.
    hubs: list[DataFrame] = []
    for _ in range(HUB_ROUNDS):
        left = placed(roots)
        hot = left.join(mixed(left).where(F.col("rows") > HOT_ROWS), "key").join(vectors, "node")
        hubs.append(written(_hub_pairs(hot).join(known, ["a", "b"], "left_anti"), "hubs"))
        more = tried(hubs[-1])
        if not more.limit(1).count():
            break
        known, links = known.unionByName(hubs[-1]), links.unionByName(more)
        roots = tie(links)
    # What is left under shingles that still have several components; with two nodes, their pair was tried above.
    left = placed(roots)
    # The keys of a node just before a cell's travel with it: two nodes that share one of these meet there already.  Most
    # pairs are so given once, and a row stays small however many keys its node has; the rest is made distinct.
    light = points.select(F.col("uid").alias("node"), "n", F.col("small").alias("vec"), "fine")
    rest = left.join(mixed(left), "key").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("key", "rows"))).alias("cells")).join(light, "node")
    before = F.slice(F.col("cells.key"), F.greatest(F.col("i") - KEYS_BEFORE, F.lit(0)) + 1, F.least("i", F.lit(KEYS_BEFORE)))
    rest = rest.select("node", "root", "n", "vec", "fine", "cells", F.posexplode("cells").alias("i", "c"))
    rest = rest.select("node", "root", "n", "vec", F.when(F.col("c.rows") > HOT_ROWS, F.col("fine")).alias("fine"), before.alias("before"), "c.key", "c.rows")
    pairs = _bounded(_tree_join(rest).distinct().join(known, ["a", "b"], "left_anti"), vectors)
    pairs = written(pairs, "pairs")
    discard(shared, second, *hubs)
    more = verify(pairs, docs, points)
    discard(pairs)
    if more.limit(1).count():
        roots = tie(links.unionByName(more))
    nodes = points.where("n > 0").groupBy("print").agg(F.min("uid").alias("node"))
    member = points.select("uid", "doc_id", "n", "print", "key").join(nodes, "print", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    member = member.select("uid", "doc_id", "n", "key", F.coalesce("root", "node", "uid").alias("root"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return member.join(least, "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "uid", "key")


def _bounded(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs whose sizes and summed minima still allow a link."""
    a = vectors.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    b = vectors.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    both = pairs.join(a, "a").join(b, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")

    def work(batch: pa.RecordBatch) -> dict:
        size = batch["na"].to_numpy() + batch["nb"].to_numpy()
        most = [most_shared(_vector(x), _vector(y)) for x, y in zip(batch["va"].to_pylist(), batch["vb"].to_pylist())]
        ok = pa.array(np.array(most) >= need(size, 0))
        return {k: batch[k].filter(ok) for k in ("a", "b")}

    return map_arrow(both, "a long, b long", work)


def _hub_pairs(hot: DataFrame) -> DataFrame:
    """Each node of the cells (key, node, root, n, vec, rows) with one of another root that it may be linked with: (a, b).

    It is the one that most nodes of its cell may be linked with, so that few of them draw a whole group together.  A block
    of a big cell meets itself and the first block, as this only prepares the join of all that is left.
    """
    blocks = hot.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("own")))
    cells = blocks.withColumn("other", F.explode(met)).select("key", F.greatest("own", "other").alias("hi"), "own", "node", "root", "n", "vec")
    cells = cells.repartition("key", "hi").sortWithinPartitions("key", "hi", "node")

    def partners(cell: list[tuple]) -> list[tuple]:
        own, node, root, size = (np.array([r[i] for r in cell]) for i in (2, 3, 4, 5))
        if (root == root[0]).all():
            return []
        vectors, out = [_vector(r[6]) for r in cell], []
        for at, to in {(0, cell[0][1]), (cell[0][1], cell[0][1])}:
            x, y = np.flatnonzero(own == at), np.flatnonzero(own == to)
            if not len(x) or not len(y):
                continue
            fit = all_shared([vectors[i] for i in x], [vectors[i] for i in y]) >= need(size[x][:, None], size[y][None])
            fit &= 5 * np.minimum(size[x][:, None], size[y][None]) >= 4 * np.maximum(size[x][:, None], size[y][None])
            for a, b, may in ((x, y, fit), (y, x, fit.T)):
                many = may.sum(axis=0)
                open_ = np.where(may & (root[a][:, None] != root[b][None]), many[None], 0)
                best = open_.argmax(axis=1)
                some = np.flatnonzero(open_.max(axis=1))
                out += zip(node[a[some]].tolist(), node[b[best[some]]].tolist(), many[best[some]].tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, ("key", "hi", "own", "node", "root", "n", "vec"), 2):
            if found := partners(cell):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["node", "other", "many"])

    found = cells.mapInArrow(run, "node long, other long, many long").groupBy("node").agg(F.max(F.struct("many", -F.col("other"))).alias("best"))
    other = -F.col("best.col2")
    return found.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def _cells(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow one another with the same first ``keys`` columns."""
    cell: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch[k].to_pylist() for k in names]):
            if cell and cell[0][:keys] != row[:keys]:
                yield cell
                cell = []
            cell.append(row)
    if cell:
        yield cell


def _tree_join(rest: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different roots whose points pass the bound; big cells are joined in blocks.

    A pair is passed over in a cell where both nodes have a key in common among the KEYS_BEFORE before the cell's: they
    meet under that one.  So each pair is given at least once.
    """
    blocks = rest.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "n", "vec", "before", "fine"
    )
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, ("key", "lo", "hi")):
            found = _near_pairs(table)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows in runs of about CELL_ROWS that end where a cell ends: most cells are small, and each costs a call otherwise."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, CELL_ROWS):
            held.append(batch.slice(at, CELL_ROWS))
            if sum(b.num_rows for b in held) < CELL_ROWS:
                continue
            table = pa.Table.from_batches(held)
            _, starts = _cell_starts(table, keys)
            if starts[-1]:
                yield table.slice(0, starts[-1])
            held = table.slice(starts[-1]).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _cell_starts(table: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    columns = [table[k].to_numpy() for k in keys]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _near_pairs(table: pa.Table) -> np.ndarray:
    """Pairs (a, b) of the nodes of whole cells that pass all bounds."""
    cell, starts = _cell_starts(table, ("key", "lo", "hi"))
    lo, hi, own, node, root, size = (table[k].to_numpy() for k in ("lo", "hi", "own", "node", "root", "n"))
    size = size.astype(np.int64)
    points = _counts_of(table["vec"].to_pylist())
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    # Cells of one block of each side only; numbers of cells are those of the tree.
    q, p = RTree(points[GROUPS][0][right], size[right], cell[right], root[right]).search(points[GROUPS][0][left], size[left], cell[left], root[left]) if len(left) and len(right) else (left[:0], right[:0])
    q, p = left[q], right[p]
    # Within one block a pair is found from both sides.
    once = (lo[q] != hi[q]) | (node[q] < node[p])
    q, p = q[once], p[once]
    for groups, (counts, has) in sorted(points.items())[1:]:
        stay = ~(has[q] & has[p])
        for at in range(0, len(q), 1 << 13):
            part = slice(at, at + (1 << 13))
            fits = np.minimum(counts[q[part]], counts[p[part]]).sum(axis=1, dtype=np.int64) >= need(size[q[part]], size[p[part]])
            stay[part] |= fits
        q, p = q[stay], p[stay]
    if len(q):
        before = table["before"].combine_chunks()
        values, offsets = before.values.to_numpy(), before.offsets.to_numpy()
        sets = {i: frozenset(values[offsets[i] : offsets[i + 1]].tolist()) for i in set(q.tolist()) | set(p.tolist())}
        ok = np.array([sets[i].isdisjoint(sets[j]) for i, j in zip(q.tolist(), p.tolist())], bool)
        q, p = q[ok], p[ok]
    fine = {i: f for i in set(q.tolist()) | set(p.tolist()) if (f := table["fine"][i].as_py()) is not None}
    if fine:
        ok = [i not in fine or most_shared(_vector(fine[i]), _vector(fine[j])) >= n for i, j, n in zip(q.tolist(), p.tolist(), need(size[q], size[p]).tolist())]
        q, p = q[np.array(ok, bool)], p[np.array(ok, bool)]
    return np.unique(np.stack([np.minimum(node[q], node[p]), np.maximum(node[q], node[p])], axis=1), axis=0)


def _counts_of(raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts by 64, 128, ... groups, and which rows have so many; vectors of one form are decoded together."""
    forms: dict[tuple[int, bytes], list[int]] = {}
    for i, x in enumerate(raw):
        forms.setdefault((len(x), x[:1]), []).append(i)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for (_, width), at in forms.items():
        vectors = np.frombuffer(b"".join([raw[i][1:] for i in at]), f"<u{width.decode()}").reshape(len(at), -1)
        groups = vectors.shape[1]
        while groups >= GROUPS:
            counts, has = out.setdefault(groups, (np.zeros((len(raw), groups), np.int32), np.zeros(len(raw), bool)))
            counts[at], has[at] = vectors.reshape(len(at), -1, groups).sum(axis=1, dtype=np.int32), True
            groups //= 2
    return out


def _filter(codes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each code, built where the codes are; its size is fixed, whatever their number."""
    parts = codes.select(F.floor(F.col("code") / 32768).cast("int").alias("part"), (F.col("code") % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def verify(pairs: DataFrame, docs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of row numbers of ``points`` whose sets have a Jaccard similarity of 0.8 or more, counted exactly.

    Sets are made anew from the texts that the pairs need, which are found by their content.  A filter of its hashes
    passes over the other texts where they are read; a text that it lets through in vain only costs time.
    """
    bits = min(FILTER_MOST, max(1 << 20, 1 << (FILTER_BITS * max(1, points.count())).bit_length()))
    code = lambda key: F.pmod(key["k1"], F.lit(bits))
    used = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct().join(points.select("uid", "key"), "uid")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(used.select(code(F.col("key")).alias("code")), bits))

    def work(batch: pa.RecordBatch) -> dict:
        at = batch["code"].to_numpy()
        some = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
        keys = some["key"].to_pylist()
        first = {(k["k1"], k["k2"]): i for i, k in reversed(list(enumerate(keys)))}
        some = some.take(pa.array(sorted(first.values()), pa.int64()))  # copies in a batch are read once
        return {"key": some["key"], "shingles": _lists([shingle_set(t) for t in as_bytes(some["text"])])}

    key = content_key(F.col("text"))
    rows = docs.select("text", key.alias("key")).withColumn("code", code(F.col("key")))
    sets = map_arrow(rows, "key struct<k1: bigint, k2: bigint>, shingles array<long>", work)
    sets = used.join(sets.groupBy("key").agg(F.first("shingles").alias("shingles")), "key").select("uid", "shingles")
    sets = written(sets, "sets")
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    linked = both.select("a", "b", same.alias("i"), (F.size("x") + F.size("y")).alias("t")).where("100 * i >= 80 * (t - i)").select("a", "b")
    linked = written(linked, "links")
    discard(sets)
    return linked


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest id (of equal ids the first row); all columns unchanged."""
    groups = near_groups(numbered(docs)).withColumn("component", F.coalesce(F.col("component_id"), -1 - F.col("uid")))
    # Rows with null ids only are a component of their own each unless a linked row has an id.
    best = groups.groupBy("component").agg(F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best"))
    judged = groups.join(best, "component").select("doc_id", "key", (F.col("uid") == F.col("best")).alias("stay"))
    return keep_rows(docs, judged, content_key(column(docs, "text")))
